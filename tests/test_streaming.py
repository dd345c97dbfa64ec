"""The stream of regions against the batch operator."""

from pyspark.sql import functions as F

from spindrift.operators import frames as fr
from spindrift.sources import tables as tb
from spindrift.streaming.regions import region_stream


def test_stream_is_batch(spark, tmp_path):
    f = tb.frames(spark, "/root/testdata/sf0.001").select("recording", "frame", "label").filter("recording < 30")
    ends = f.groupBy("recording").agg(F.max("frame").alias("frame")).select("recording", (F.col("frame") + 1).alias("frame"), F.lit("END").alias("label"))
    every = f.unionByName(ends).cache()
    # Frames arrive in three files, each with frames that the one before left out.
    for k in range(3):
        every.filter((F.xxhash64("recording", "frame") % 3 == k) | (F.xxhash64("recording", "frame") % 3 == -k)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = region_stream(stream, 3).writeStream.format("memory").queryName("regions_found").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("regions_found").collect())
    assert got == sorted(tuple(r) for r in fr.regions(f, 3).collect()) and got
