"""Exact deduplication with a persistent digest index, in DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest. New rows are grouped by
digest with map-side combining, so a group of any size arrives as one row a task; a
sort-merge anti-join against the buckets (no exchange on the index side) finds digests
not seen before, and those are appended. Buckets are as many as the rows need; once
appends have left many files a bucket, or buckets have grown past their size, the index
is written anew as its next generation.

Cases: a null text counts as empty; empty texts are equal to one another; texts of any
length count whole; of equal texts the row with the largest id stays; a null id is below
every other; rows that repeat id and text share one verdict in ``decide``, while
``deduplicate`` leaves one of them, whichever; an empty table gives no rows; other columns,
whatever their names, are ignored by ``decide`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import discard, lookup, materialise, new_path, read_table, remove, text_or_empty

SCHEMA = "digest BINARY, keep_id BIGINT"
#: Digests that a bucket holds, about (some 100 MB).
BUCKET_ROWS = 2_000_000
#: Files a bucket, on average, at which the index is written anew.
FILES = 8


class DigestIndex:
    """Digests seen so far and the id that each keeps, at ``path``, over sessions.

    A generation is a bucketed table; a small table beside them says which one holds and
    how many buckets it has. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, expected_rows: int = 0):
        self.spark, self.path = spark, path
        self.state = f"{path}/state"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/_SUCCESS")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            self.generation, self.buckets, self.size = spark.read.parquet(self.state).select("generation", "buckets", "size").first()
        else:
            self.generation, self.buckets, self.size = 0, self.needed(expected_rows), 0
        self.table = self.create(self.generation, self.buckets)

    @staticmethod
    def needed(rows: int) -> int:
        return max(8, -(-rows // BUCKET_ROWS))

    def create(self, generation: int, buckets: int) -> str:
        name = f"spindrift_digests_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{generation}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/generation-{generation}'"
        )
        return name

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame) -> None:
        """``groups``: one row per digest. Digests already in the index stay as they are."""
        dealt = groups.select("digest", "keep_id").repartition(self.buckets, "digest")
        fresh = dealt.join(self.rows().hint("merge"), "digest", "left_anti")
        fresh.write.insertInto(self.table)
        self.size = self.rows().count()
        if len(self.rows().inputFiles()) > FILES * self.buckets or self.size > 2 * BUCKET_ROWS * self.buckets:
            self.compact()
        self.save()

    def compact(self) -> None:
        """The same digests in as many buckets as they need, one sorted file each."""
        old, buckets = self.table, self.needed(self.size)
        new = self.create(self.generation + 1, buckets)
        self.rows().repartition(buckets, "digest").write.insertInto(new)
        self.generation, self.buckets, self.table = self.generation + 1, buckets, new
        self.save()  # from here on the new generation holds; the old one is but files
        self.spark.sql(f"DROP TABLE {old}")
        remove(self.spark, f"{self.path}/generation-{self.generation - 1}")

    def save(self) -> None:
        one = self.spark.range(1).select(F.lit(self.generation).alias("generation"), F.lit(self.buckets).alias("buckets"), F.lit(self.size).cast("bigint").alias("size"))
        one.coalesce(1).write.mode("overwrite").parquet(self.state)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"))


def decide(spark: SparkSession, df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on each row of ``df``: id, keep_id, group_size (within ``df``), kept, text_sha256.

    Digests that an earlier batch put into ``index`` keep that batch's row, so none of
    ``df``'s rows with such a digest is kept unless its id is that very one.
    """
    rows = materialise(spark, digests(df, id_col, text_col), "digests")
    groups = materialise(spark, rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    index.append_new(groups)
    sizes = groups.select("digest", "group_size").repartition(index.buckets, "digest")
    known = sizes.join(index.rows().hint("merge"), "digest")
    found = lookup(rows, materialise(spark, known, "known"), "digest", "group_size", rows.count())
    discard(spark, groups)
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(spark: SparkSession, df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that stay, with all their columns.

    Verdicts follow the id; the rows themselves meet them through a join on (id, digest).
    """
    index = index or DigestIndex(spark, new_path(spark, "digest-index"), df.count())
    stay = decide(spark, df, index, id_col, text_col).filter("kept").groupBy(F.col(id_col).alias("_sd_id"), F.col("text_sha256").alias("_sd_digest")).agg(F.count(F.lit(1)).alias("_sd_n"))
    stay = materialise(spark, stay, "staying")
    here = df.withColumn("_sd_own", F.sha2(text_or_empty(text_col), 256))
    same = F.col(id_col).eqNullSafe(F.col("_sd_id")) & (F.col("_sd_own") == F.col("_sd_digest"))
    once = here.join(stay.filter("_sd_n = 1"), same, "left_semi")
    # Rows that repeat id and text are combined before their shuffle, so a hot pair is one row a task.
    several = here.join(stay.filter("_sd_n > 1"), same, "left_semi").dropDuplicates([id_col, "_sd_own"])
    return once.unionByName(several).drop("_sd_own")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decide(spark, docs, DigestIndex(spark, new_path(spark, "digest-index"), docs.count()))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
