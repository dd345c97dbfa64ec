"""Readers, and views that put the driver's tables in the engine's own shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Class labels in index order.
LABELS = ["NOISE", "UP", "DOWN", "ECHO", "BURST"]
# Event types and the labels they stand for.
EVENT_LABELS = {"view": "NOISE", "click": "UP", "purchase": "DOWN", "signup": "ECHO", "error": "BURST"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached frames of recordings; older caches without probabilities read as null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df if "probs" in df.columns else df.withColumn("probs", F.lit(None).cast("array<double>"))


def write_frames(df: DataFrame, path: str) -> None:
    """One folder per recording, so that a search of one prunes to its files."""
    df.repartition("recording").sortWithinPartitions("frame").write.mode("overwrite").partitionBy("recording").parquet(path)


def candidate_spans(spark: SparkSession, path: str, n_samples: int, window: int = 5120) -> DataFrame:
    """Spans from a CSV of starts and stops, clamped to the recording; shorter ones than a window go."""
    df = spark.read.csv(path, header=True, schema="starts bigint, stops bigint")
    df = df.select(F.col("starts").alias("start"), F.least("stops", F.lit(n_samples)).alias("stop"))
    return df.filter(F.col("stop") - F.col("start") >= window)


def sidecar(spark: SparkSession, path: str, default_model: str = "default") -> DataFrame:
    df = spark.read.json(path)
    for name, kind, value in (("sample_rate", "int", None), ("embedding_model", "string", default_model)):
        df = df.withColumn(name, F.coalesce(F.col(name) if name in df.columns else F.lit(None), F.lit(value)).cast(kind))
    return df.select("sample_rate", "embedding_model")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, frame, label, value: each user's events in time order."""
    e = read(spark, sf_dir, "events")
    label = F.lit("NOISE")
    for event, name in EVENT_LABELS.items():
        label = F.when(F.col("event_type") == event, name).otherwise(label)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("recording"), (F.row_number().over(order) - 1).cast("bigint").alias("frame"), label.alias("label"), "value")


def vec_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, frame, vec_id, embedding: the vectors of a label in order."""
    e = read(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    return e.select(F.col("label").alias("recording"), (F.row_number().over(order) - 1).cast("bigint").alias("frame"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit table: sub-model, score, confidence, classification, recording, frames."""
    names = F.when(F.col("l_returnflag") == "R", "WHISTLE").when(F.col("l_returnflag") == "A", "BURST").otherwise("NOISE")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("submodel"), F.col("l_extendedprice").alias("llr"), (F.col("l_quantity") / 50).alias("confidence"),
        names.alias("classification"), F.col("l_orderkey").alias("recording"), F.col("l_partkey").alias("hit"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("n_frames"),
    )
