"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, written as Parquet and read again. All but
the last return the columns of their input, whatever other columns there are and however
they are named; an empty table gives an empty one.

Cases, stage by stage. Null and empty texts: ``toxicity`` scores them as empty texts (with
the bias alone) and so keeps them; ``exact_dedup`` takes both for equal and leaves the one
with the largest id; ``near_dedup`` keeps what is left of them, since texts without words
have no near copies; ``pii`` leaves null texts null; ``packing`` gives an empty text one
piece of one token. Null ids: below every other in ``exact_dedup``; in ``near_dedup`` their
component is named by its other members, or null; such rows are packed as documents.
Repeated rows: one of the rows that repeat id and text stays in ``exact_dedup``. Ties: of
near copies the smallest id stays, and all rows of that id whose texts differ. Very long
texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import exact_dedup, neardup, packing, pii, toxicity
from spindrift.llm.common import discard, materialise, read_table, small_batches

#: The last stages' decisions cannot be expressed in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents, judged by a model of the documents' own labels.

    Labels of no document, or null ones, teach nothing; without any label all stay.
    """
    return toxicity.drop_toxic(spark, docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    return exact_dedup.deduplicate(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicate(spark, docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars follows the new text."""
    small_batches(spark)
    out = pii.sanitise(spark, docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(spark, docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(spark, docs, f"stage-{name}")
            discard(spark, before)
            before = docs
    return docs
