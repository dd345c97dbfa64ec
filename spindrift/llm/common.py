"""What the text operators share: shared-folder tables, row keys and skew-proof lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys are ever broadcast by :func:`lookup`.
HOT_KEYS = 512
#: Whether Spark removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a session in one
    process (as in tests) gets a temporary folder, which ends with it; on a cluster no folder
    of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found[len("file://"):], True)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrift/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The written table takes the place of the shuffles that made it, so their files go with
    the write and do not add up over the rounds of an iteration.
    """
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more: all made from them is written."""
    for path in [t.written_to for t in tables if t is not None]:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder, once no result is read any more."""
    remove(spark, f"{shared_dir(spark)}/spindrift/{spark.sparkContext.applicationId}")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def lookup(left: DataFrame, table: DataFrame, key: str, weight: str, n_rows: int, bound: int = HOT_KEYS) -> DataFrame:
    """Left join of ``left`` with ``table`` on ``key`` that no hot key can skew.

    ``table`` has one row per key and in ``weight`` the number of rows of ``left`` with
    that key; ``left`` has ``n_rows`` rows. Keys with over ``n_rows / bound`` rows number
    fewer than ``bound``, whatever the input's size, so just these are broadcast; all
    others go through a shuffle join in which each has few rows. ``key`` is not null.
    """
    is_hot = F.col(weight) * bound > F.lit(n_rows)
    hot = table.filter(is_hot)
    heavy = left.join(F.broadcast(hot), key)
    light = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(~is_hot), key, "left")
    return heavy.unionByName(light)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def may_hold(df: DataFrame, hash_col: str, keys: DataFrame, buckets: int = 1 << 18) -> DataFrame:
    """All rows of ``df`` whose ``hash_col`` is among ``keys`` (one column of that name), and,
    as long as these are few, few others: a semi-join with the remainders that occur, of
    which there are ``buckets`` at most, whatever the tables' sizes.
    """
    seen = keys.select(F.pmod(F.col(hash_col), F.lit(buckets)).cast("int").alias("_sd_bucket")).distinct()
    return df.join(F.broadcast(seen), F.pmod(F.col(hash_col), F.lit(buckets)).cast("int") == F.col("_sd_bucket"), "left_semi")
