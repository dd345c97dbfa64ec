"""Samples and splits, all by hashes of keys, so they repeat and need no order of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import squared_distance


def unit(seed: int, *keys: str) -> Column:
    """An even number in (0, 1) by the keys."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def balanced(df: DataFrame, label: str, key: str, per_class: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """``per_class`` rows of each class: the first ones in hashed order (or ``order``), without
    repeats if there are enough, else all of them in turn until there are; with ``copy``, the turn.

    Places in a class are found in two steps, within hash ranges and across them, so a
    large class is not one task's; with an ``order`` of the caller's it is.
    """
    if_even = df.withColumn("_o", unit(seed, key) if order is None else order)
    if_even = if_even.withColumn("_r", F.floor(F.col("_o") * 256) if order is None else F.lit(0).cast("bigint"))
    ranges = if_even.groupBy(label, "_r").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_r")
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(label)))
    inside = Window.partitionBy(label, "_r").orderBy("_o", key)
    placed = if_even.join(F.broadcast(ranges), [label, "_r"]).withColumn("_k", F.row_number().over(inside) + F.col("_before"))  # 256 ranges a class
    times = F.floor(F.lit(per_class) / F.col("_total")) + F.when(F.col("_k") <= F.lit(per_class) % F.col("_total"), 1).otherwise(0)
    drawn = placed.withColumn("_t", times.cast("int")).filter("_t > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_o", "_r", "_n", "_before", "_total", "_k", "_t")


def block_key(dataset: Column, offset: Column, block: int) -> Column:
    """Name of the block of a dataset that an offset lies in."""
    return F.concat(dataset, F.lit(":"), F.floor(offset / block).cast("string"))


def block_split(df: DataFrame, block: str, share: float = 0.15, seed: int = 0) -> DataFrame:
    """``df`` with split: the rounded ``share`` of all blocks, those of the smallest hashes, is ``val``.

    Whole blocks fall on one side.
    """
    blocks = df.select(block).distinct()
    n = round(blocks.count() * share)
    held = blocks.orderBy(unit(seed, block), block).limit(n).withColumn("_held", F.lit(True))
    return df.join(held, block, "left").withColumn("split", F.when(F.col("_held"), "val").otherwise("train")).drop("_held")


def triplets(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """key, label, positive, negative_label, negative: for each row another one of its label (itself,
    if it is the only one) and one of another label, each drawn by the row's hash.

    Members of a label are numbered, so a draw is a join on (label, number).
    """
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    labels = sizes.agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("labels"))  # one entry a label
    members = df.select(F.col(label).alias("label"), F.col(key).alias("key")).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("key")) - 1)
    rows = members.join(F.broadcast(sizes), "label").crossJoin(F.broadcast(labels))
    other = F.filter("labels", lambda x: x["label"] != F.col("label"))
    draw = lambda n, s: F.floor(unit(s, "key") * n).cast("int")
    rows = rows.withColumn("pos_k", F.when(F.col("n") > 1, (F.col("k") + 1 + draw(F.col("n") - 1, seed)) % F.col("n")).otherwise(F.col("k")))
    rows = rows.withColumn("neg", F.get(other, draw(F.size(other), seed + 1))).withColumn("neg_k", draw(F.col("neg.n"), seed + 2))
    pos = members.select(F.col("label").alias("pl"), F.col("k").alias("pk"), F.col("key").alias("positive"))
    neg = members.select(F.col("label").alias("nl"), F.col("k").alias("nk"), F.col("key").alias("negative"))
    out = rows.join(pos, (F.col("label") == F.col("pl")) & (F.col("pos_k") == F.col("pk"))).join(neg, (F.col("neg.label") == F.col("nl")) & (F.col("neg_k") == F.col("nk")), "left")
    return out.select(F.col("key").alias(key), F.col("label").alias(label), "positive", F.col("neg.label").alias("negative_label"), "negative")


def spread_sample(df: DataFrame, k: int, batch: int = 64, seed: int = 0, key: str = "id", vector: str = "v") -> list:
    """Keys of ``k`` vectors drawn in proportion to the squared distance from those before, ``batch`` at
    a time (fewer where the rest equal drawn ones).

    Each round is one pass: a row's draw is -log(u) over its weight, and the smallest win.
    The driver holds the drawn vectors only.
    """
    first = df.orderBy(unit(seed, key), key).select(key, vector).limit(1).collect()
    chosen, centres = [r[0] for r in first], [r[1] for r in first]
    from spindrift.operators.clusters import stored

    far = stored(df.select(key, vector).withColumn("d", F.lit(float("inf"))))
    new, round_no = centres, 0
    while chosen and len(chosen) < k:
        round_no += 1
        to_new = F.array_min(F.transform(F.lit([list(map(float, c)) for c in new]), lambda c: squared_distance(F.col(vector), c)))
        far = stored(far.withColumn("d", F.least("d", to_new)))  # each round reads the one before it
        drawn = far.filter("d > 0").orderBy(-F.log(unit(seed + round_no, key)) / F.col("d"), key).limit(min(batch, k - len(chosen))).collect()
        if not drawn:
            break
        new = [r[vector] for r in drawn]
        chosen += [r[key] for r in drawn]
    return chosen


def window_spans(df: DataFrame, hops: int = 2) -> DataFrame:
    """recording, start, stop, n_vectors of the spans that sampled windows of ``hops`` frames cover,
    where those that overlap or touch are one."""
    w = Window.partitionBy("recording").orderBy("frame")
    new = F.when(F.col("frame") - F.lag("frame").over(w) <= hops, 0).otherwise(1)
    d = df.select("recording", "frame").distinct().withColumn("_new", new)
    runs = d.withColumn("_s", F.sum("_new").over(w))
    return runs.groupBy("recording", "_s").agg(F.min("frame").alias("start"), (F.max("frame") + hops).alias("stop"), F.count(F.lit(1)).alias("n_vectors")).drop("_s")


def budget_split(df: DataFrame, key: str, frames: str, held: int, train: int, least: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """key, split of recordings: in hashed order (or ``order``), those of ``least`` frames or more fill the
    held-out frames until there are ``held``, then the training frames until there are ``train``."""
    order = order if order is not None else unit(seed, key)
    w = Window.orderBy("_o", key).rowsBetween(Window.unboundedPreceding, -1)  # a row a recording
    sized = df.filter(F.col(frames) >= least).select(key, frames).withColumn("_o", order)
    before = sized.withColumn("_b", F.coalesce(F.sum(frames).over(w), F.lit(0)))
    is_held = F.col("_b") < held
    total = F.sum(F.when(is_held, F.col(frames)).otherwise(0)).over(Window.partitionBy())
    split = F.when(is_held, "heldout").when(F.col("_b") - F.col("_h") < train, "train")
    return before.withColumn("_h", total).select(key, split.alias("split")).filter("split IS NOT NULL")


def region_windows(df: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """start of each whole window of ``size`` in each region (start, stop), one after another; the early
    form leaves out a last window that ends with the region."""
    last = F.col("stop") - size - (1 if drop_last else 0)
    return df.filter(last >= F.col("start")).withColumn("window", F.explode(F.sequence(F.col("start"), last, F.lit(size))))


def with_background(x: Column, noise: Column, ratio: Column) -> Column:
    """``x`` plus the noise at ``ratio`` of its own loudness (root mean square)."""
    rms = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b) / F.size(v)) + 1e-8
    gain = ratio * rms(x) / rms(noise)
    return F.zip_with(x, noise, lambda a, b: a + b * gain)


def log_uniform(low: float, high: float, seed: int, *keys: str) -> Column:
    return F.exp(F.lit(float(np.log(low))) + unit(seed, *keys) * float(np.log(high) - np.log(low)))
