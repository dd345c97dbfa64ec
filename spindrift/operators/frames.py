"""Label sequences: runs, regions, gaps, trains, distances to signal. Windows per recording only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_frame():
    return Window.partitionBy("recording").orderBy("frame")


def whole():
    return Window.partitionBy("recording")


def run_ids(df: DataFrame, key: Column, name: str = "run") -> DataFrame:
    """``df`` with a number that grows wherever ``key`` changes along a recording."""
    keyed = df.withColumn("_key", key)
    new = F.when(F.lag("_key").over(by_frame()).eqNullSafe(F.col("_key")), 0).otherwise(1)
    return keyed.withColumn("_new", new).withColumn(name, F.sum("_new").over(by_frame())).drop("_key", "_new")


def runs(df: DataFrame) -> DataFrame:
    """Run-length encoding of labels: recording, label, start, stop (exclusive), n."""
    g = run_ids(df, F.col("label")).groupBy("recording", "run").agg(F.first("label").alias("label"), F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"))
    return g.select("recording", "label", "start", "stop", (F.col("stop") - F.col("start")).alias("n"))


def regions(df: DataFrame, min_size: int = 10) -> DataFrame:
    """Maximal runs without NOISE of at least ``min_size`` frames."""
    signal = F.col("label") != "NOISE"
    g = run_ids(df, signal).filter(signal).groupBy("recording", "run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"))
    return g.select("recording", "start", "stop").filter(F.col("stop") - F.col("start") >= min_size)


def nearest_signal(df: DataFrame) -> DataFrame:
    """``df`` with the distance in frames to the nearest frame that is not NOISE (null if there is none)."""
    at = F.when(F.col("label") != "NOISE", F.col("frame"))
    before = F.last(at, True).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, True).over(by_frame().rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("to_signal", F.least(F.col("frame") - before, after - F.col("frame")))


def far_from_signal(df: DataFrame, more_than: int = 17) -> DataFrame:
    """Frames further from any signal than that; all of a recording without signal."""
    return nearest_signal(df).filter(F.col("to_signal").isNull() | (F.col("to_signal") > more_than))


def interior_noise(df: DataFrame, min_run: int = 5, margin: int = 1) -> DataFrame:
    """NOISE frames of long runs, without a margin on either side."""
    r = run_ids(df, F.col("label"))
    w = Window.partitionBy("recording", "run")
    r = r.withColumn("first", F.min("frame").over(w)).withColumn("last", F.max("frame").over(w))
    inside = (F.col("frame") >= F.col("first") + margin) & (F.col("frame") <= F.col("last") - margin)
    return r.filter((F.col("label") == "NOISE") & (F.col("last") - F.col("first") + 1 >= min_run) & inside).select("recording", "frame")


def trains(df: DataFrame, max_gap: int = 17, min_labelled: int = 5) -> DataFrame:
    """Signal frames merged across gaps of up to ``max_gap`` frames."""
    s = df.filter(F.col("label") != "NOISE")
    new = F.when(F.col("frame") - F.lag("frame").over(by_frame()) - 1 <= max_gap, 0).otherwise(1)
    g = s.withColumn("new", new).withColumn("train", F.sum("new").over(by_frame())).groupBy("recording", "train")
    out = g.agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.count(F.lit(1)).alias("labelled"))
    return out.filter(F.col("labelled") >= min_labelled).select("recording", "start", "stop", "labelled")


def close_gaps(df: DataFrame, fill: Column, max_gap: int = 6) -> DataFrame:
    """NOISE runs of up to ``max_gap`` frames between signal get ``fill`` for a label."""
    r = run_ids(df, F.col("label") != "NOISE")
    w = Window.partitionBy("recording", "run")
    r = r.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_last", F.max("run").over(whole()))
    inner = (F.col("label") == "NOISE") & (F.col("run") > 1) & (F.col("run") < F.col("_last")) & (F.col("_n") <= max_gap)
    return r.withColumn("label", F.when(inner, fill).otherwise(F.col("label"))).drop("run", "_n", "_last")


def inner_gaps(df: DataFrame) -> DataFrame:
    """Census of NOISE runs between signal: length and number."""
    r = runs(df).withColumn("k", F.row_number().over(Window.partitionBy("recording").orderBy("start"))).withColumn("last", F.max("k").over(whole()))
    return r.filter((F.col("label") == "NOISE") & (F.col("k") > 1) & (F.col("k") < F.col("last"))).groupBy(F.col("n").alias("gap")).agg(F.count(F.lit(1)).alias("n_gaps"))


def flank_runs(df: DataFrame) -> DataFrame:
    """Per recording the NOISE frames before all signal, after it, and between, where they are folded in."""
    r = runs(df).withColumn("k", F.row_number().over(Window.partitionBy("recording").orderBy("start"))).withColumn("last", F.max("k").over(whole()))
    n = lambda c: F.coalesce(F.sum(F.when(c & (F.col("label") == "NOISE"), F.col("n"))), F.lit(0).cast("long"))
    first, end = F.col("k") == 1, F.col("k") == F.col("last")
    return r.groupBy("recording").agg(n(first).alias("leading"), n(end & ~first).alias("trailing"), n(~first & ~end).alias("folded"))


def switchpoints(df: DataFrame, k: int, value: str = "value") -> DataFrame:
    """recording, point, height: of the adjacent-distance profile of a number, its two ends and the
    ``k`` highest strict local maxima, the first among equals."""
    profile = df.withColumn("height", F.abs(F.col(value) - F.lag(value).over(by_frame()))).withColumn("point", F.col("frame") - 1).filter("point >= 0")
    w = Window.partitionBy("recording").orderBy("point")
    p = profile.withColumn("a", F.lag("height").over(w)).withColumn("b", F.lead("height").over(w))
    peaks = p.filter("height > a AND height > b").withColumn("rank", F.row_number().over(Window.partitionBy("recording").orderBy(F.col("height").desc(), "point"))).filter(F.col("rank") <= k)
    last = p.withColumn("last", F.max("point").over(whole()))
    ends = last.filter("point = 0").unionByName(last.filter("point = last"))
    return peaks.select("recording", "point", "height").unionByName(ends.select("recording", "point", "height"))


def sliding_changes(df: DataFrame, size: int = 100, step: int = 50) -> DataFrame:
    """Label changes within windows of ``size`` frames every ``step``; the last frame of a window may not be the recording's."""
    changed = F.when(F.lag("label").over(by_frame()) != F.col("label"), 1).otherwise(0)
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - (size - 1)) / step))
    d = df.withColumn("changed", changed).withColumn("w", F.explode(F.sequence(first.cast("long"), F.floor(F.col("frame") / step).cast("long"))))
    return d.groupBy("recording", (F.col("w") * step).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("frame") > F.col("w") * step, F.col("changed")).otherwise(0)).alias("n_changed"))


def majority(df: DataFrame, by: list[str], label: Column, order: Column) -> DataFrame:
    """Most frequent label of each group and its share; the first seen wins a tie."""
    per = df.groupBy(*by, label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return per.groupBy(*by).agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("label"), (F.max("n") / F.sum("n")).alias("share"))


def in_regions(df: DataFrame, found: DataFrame) -> DataFrame:
    """Frames of each region: a join on the recording and the interval."""
    r = found.select(F.col("recording").alias("_r"), "start", "stop")
    return df.join(r, (F.col("recording") == F.col("_r")) & (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))).drop("_r")
