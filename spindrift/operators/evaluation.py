"""Reports: confusion and accuracy, decoded hits against labels, paired changes, training runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.frames import far_from_signal, trains


def crosstab(df: DataFrame, rows: str, columns: str, values: list, normalise: bool = False, most: int | None = None) -> DataFrame:
    """Counts of each pair (or shares of each row); ``most`` clips numeric column values to it."""
    d = df.withColumn(columns, F.least(F.col(columns), F.lit(most))) if most is not None else df
    out = d.groupBy(rows).pivot(columns, values).count().na.fill(0)
    if normalise:
        total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
        out = out.select(rows, *[F.try_divide(F.col(f"`{v}`"), total).alias(str(v)) for v in values])
    return out


def accuracy(df: DataFrame, gold: str, scores: str, masked: int | None = None) -> DataFrame:
    """One row: accuracy of the best class of ``scores`` (an array; the first among equals), with one
    class masked too: its accuracy, the mean recall over classes that occur, and how often the
    masked class was best."""
    best = lambda x: F.array_position(x, F.array_max(x)) - 1
    hidden = F.transform(scores, lambda x, k: F.when(k == (masked if masked is not None else -1), F.lit(-math.inf)).otherwise(x))
    d = df.select(F.col(gold).alias("gold"), best(F.col(scores)).alias("all"), best(hidden).alias("some"))
    per = d.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("all") == F.col("gold")).alias("a"), F.count_if(F.col("some") == F.col("gold")).alias("b"), F.count_if(F.col("all") == F.lit(masked)).alias("m"))
    return per.agg((F.sum("a") / F.sum("n")).alias("accuracy"), (F.sum("b") / F.sum("n")).alias("accuracy_masked"), F.avg(F.col("b") / F.col("n")).alias("balanced_accuracy"), (F.sum("m") / F.sum("n")).alias("masked_rate"))


def train_hits(frames: DataFrame, label: Column, whole: float = 0.9) -> DataFrame:
    """One row over the trains of some labels: their number, distinct hits in them, summed cover by
    the largest hit, trains that are whole and trains that are missed.

    ``frames`` has recording, frame, label and hit (-1 for none).
    """
    spans = trains(frames.withColumn("label", F.when(label, "SIGNAL").otherwise("NOISE"))).select(F.col("recording").alias("r"), "start", "stop")
    inside = frames.join(spans, (F.col("recording") == F.col("r")) & (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop")) & (F.col("hit") >= 0))
    per_hit = inside.groupBy("r", "start", "hit").agg(F.count(F.lit(1)).alias("n"))
    per_train = per_hit.groupBy("r", "start").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("largest"))
    both = spans.join(per_train, ["r", "start"], "left").withColumn("cover", F.coalesce(F.col("largest") / (F.col("stop") - F.col("start")), F.lit(0.0)))
    zero = F.lit(0).cast("long")
    return both.agg(F.count(F.lit(1)).alias("trains"), F.coalesce(F.sum("hits"), zero).alias("hits"), F.coalesce(F.sum("cover"), F.lit(0.0)).alias("cover"), F.count_if(F.col("cover") >= whole).alias("whole"), F.count_if(F.col("hits").isNull()).alias("missed"))


def decoded_metrics(frames: DataFrame, scores: DataFrame, far: int = 17, short: int = 10, whole: float = 0.9) -> DataFrame:
    """One row of ratios on decoded hits against labels; a ratio of nothing is not a number.

    ``frames`` (recording, frame, label, hit), ``scores`` (recording, score).
    """
    signal, matched = F.col("label") != "NOISE", F.col("hit") >= 0
    c = frames.agg(F.count(F.lit(1)).alias("frames"), F.count_if(matched).alias("match"), F.count_if(signal).alias("signal"), F.count_if(matched & signal).alias("match_on_signal"))
    c = c.crossJoin(far_from_signal(frames, far).agg(F.count(F.lit(1)).alias("far"), F.count_if(matched).alias("far_matched")))
    per = frames.filter(matched).groupBy("recording", "hit").agg(F.count(F.lit(1)).alias("n"))
    c = c.crossJoin(per.agg(F.count(F.lit(1)).alias("hits"), F.sum("n").alias("hit_frames"), F.count_if(F.col("n") < short).alias("short_hits")))
    c = c.crossJoin(scores.agg(F.sum("score").alias("score")))
    for name, label in (("whistle", F.col("label").isin("UP", "DOWN")), ("signal", signal)):
        t = train_hits(frames, label, whole)
        c = c.crossJoin(t.select(*[F.col(x).alias(f"{name}_{x}") for x in t.columns]))
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b).cast("double"), F.lit(math.nan))
    out = [
        over("score", "frames").alias("score_per_frame"), over("match", "frames").alias("match_fraction"), over("far_matched", "far").alias("background_matched"),
        over("match_on_signal", "signal").alias("signal_recall"), over("hit_frames", "hits").alias("mean_hit_frames"), over("short_hits", "hits").alias("short_hit_fraction"),
    ]
    for name in ("whistle", "signal"):
        found = F.col(f"{name}_trains") - F.col(f"{name}_missed")
        out += [over(f"{name}_hits", found).alias(f"hits_per_{name}_train"), over(f"{name}_cover", f"{name}_trains").alias(f"{name}_largest_hit_cover"), over(f"{name}_whole", f"{name}_trains").alias(f"{name}_trains_whole"), F.col(f"{name}_trains")]
    return c.select(*out)


def sign_test(gained: int, lost: int) -> float:
    """Two-sided p of as uneven a split of changes under even odds; 1 without changes."""
    n, k = gained + lost, min(gained, lost)
    if not n:
        return 1.0
    log_c = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * math.fsum(math.exp(log_c(i)) for i in range(k + 1)))


def paired_changes(df: DataFrame, before: str, after: str, by: str) -> DataFrame:
    """Per group how many items gained and lost a yes, and the sign test on that."""
    test = F.udf(sign_test, "double")  # one row a group
    counts = df.groupBy(by).agg(F.count_if(F.col(after) & ~F.col(before)).alias("gained"), F.count_if(~F.col(after) & F.col(before)).alias("lost"))
    return counts.withColumn("p", test(F.col("gained").cast("int"), F.col("lost").cast("int")))


def best_epoch(history: DataFrame, run: str, epoch: str, loss: str, patience: int = 4, least_gain: float = 1e-4) -> DataFrame:
    """Per run the epoch that early stopping keeps, and the last one it would have trained.

    An epoch is better if its loss is lower by more than ``least_gain`` than at the best one
    before; training stops after ``patience`` epochs in a row without one.
    """
    state = F.struct(F.lit(math.inf).alias("best"), F.lit(None).cast("bigint").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("last"))

    def step(s: Column, e: Column) -> Column:
        over = s["bad"] >= patience
        better = ~over & (e["loss"] < s["best"] - least_gain)
        return F.struct(F.when(better, e["loss"]).otherwise(s["best"]).alias("best"), F.when(better, e["epoch"]).otherwise(s["at"]).alias("at"), F.when(over, s["bad"]).when(better, 0).otherwise(s["bad"] + 1).alias("bad"), F.when(over, s["last"]).otherwise(e["epoch"]).alias("last"))

    rows = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("loss"))))
    return history.groupBy(run).agg(F.aggregate(rows, state, step).alias("s")).select(run, F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best_loss"), F.col("s.last").alias("last_epoch"))


def step_curve(history: DataFrame, run: str, epoch: str, step: str, loss: str, width: int = 20) -> DataFrame:
    """Where each step lies within its epoch's unit span, and the mean loss of the last ``width`` steps
    (null where there are fewer)."""
    in_epoch = Window.partitionBy(run, epoch)
    along = Window.partitionBy(run).orderBy(epoch, step)
    last = along.rowsBetween(1 - width, 0)
    x = F.row_number().over(in_epoch.orderBy(step)) / F.count(F.lit(1)).over(in_epoch) + F.col(epoch) - 1
    smooth = F.when(F.row_number().over(along) >= F.least(F.lit(width), F.count(F.lit(1)).over(Window.partitionBy(run))), F.avg(loss).over(last))
    return history.select(run, epoch, step, x.alias("x"), smooth.alias("smoothed"))


def picked_examples(df: DataFrame, key: str, change: str, most: int = 4, others: int = 2, order: Column | None = None) -> DataFrame:
    """The ``most`` rows that changed most (by ``key`` among equals; nulls last), and ``others`` of the rest in
    hashed order (or ``order``), each with why it was picked. ``key`` is unique and not null."""
    order = order if order is not None else F.xxhash64(F.col(key), F.lit(0))
    first = df.orderBy(F.col(change).desc_nulls_last(), key).limit(most)
    rest = df.join(F.broadcast(first.select(key)), key, "left_anti").orderBy(order, key).limit(others)  # ``most`` rows
    return first.withColumn("picked", F.lit("most changed")).unionByName(rest.withColumn("picked", F.lit("random")))
