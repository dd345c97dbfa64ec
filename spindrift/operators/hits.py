"""Hit tables: filters, top sets, reports, user marks, logs and context features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least score of each class; other classes pass.
CLASS_LLR = {"WHISTLE": 30.0, "BURST": 10.0, "ECHO": 10.0, "NOISE": 15.0}


def threshold_filter(df: DataFrame, limits: dict[str, float | None], label: str = "classification", score: str = "llr", default: float | None = None) -> DataFrame:
    """Rows that reach their class's limit. A class with None is off; without a limit (and no
    default) and with a null score rows stay."""
    limit: Column = F.lit(default).cast("double")
    off = [k for k, v in limits.items() if v is None]
    for k, v in limits.items():
        limit = F.when(F.col(label) == k, F.lit(v).cast("double")).otherwise(limit)
    keep = limit.isNull() | F.col(score).isNull() | (F.col(score) >= limit)
    return df.filter(keep & ~F.coalesce(F.col(label).isin(off), F.lit(False)) if off else keep)


def display_set(df: DataFrame, top: int = 15, least: int = 5, confidence: float = 0.8) -> DataFrame:
    """Best ``top`` sure hits of each sub-model that has at least ``least`` of them."""
    sure = df.filter((F.col("confidence") > confidence) & (F.col("classification") != "NOISE"))
    order = Window.partitionBy("submodel").orderBy(F.col("llr").desc(), "hit", "recording", "line")
    ranked = sure.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("submodel"))).filter(F.col("n") >= least).drop("n")


def sweep(df: DataFrame, thresholds: list[float], score: str = "llr") -> DataFrame:
    """One row per class and threshold over one scan: hits above it and their mean length."""
    out = df.groupBy("classification").agg(*[F.struct(F.count(F.when(F.col(score) > t, 1)).alias("n_above"), F.avg(F.when(F.col(score) > t, F.col("n_frames"))).alias("mean_frames")).alias(f"t{k}") for k, t in enumerate(thresholds)])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}.n_above").alias("n_above"), F.col(f"t{k}.mean_frames").alias("mean_frames")) for k, t in enumerate(thresholds)]))
    return out.select("classification", each.alias("x")).select("classification", "x.*")


def motif_summary(df: DataFrame) -> DataFrame:
    """Per sub-model: hits, mean score and length, distinct recordings, and the classes with their
    numbers (classification, n), the most frequent first."""
    per = df.groupBy("submodel", "classification").agg(F.count(F.lit(1)).alias("n"))
    classes = per.groupBy("submodel").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "classification", "n"))), lambda c: F.struct(c["classification"].alias("classification"), c["n"].alias("n"))).alias("classes"))
    whole = df.groupBy("submodel").agg(F.count(F.lit(1)).alias("n"), F.avg("llr").alias("mean_llr"), F.avg("n_frames").alias("mean_frames"), F.countDistinct("recording").alias("n_recordings"))
    return whole.join(classes, "submodel")


def pass_rates(df: DataFrame, limits: dict[str, float], default: float = 5.0, score: str = "llr") -> DataFrame:
    """Per class: hits, its limit (or the default), and how many and which share reach it."""
    limit = F.lit(float(default))
    for k, v in limits.items():
        limit = F.when(F.col("classification") == k, F.lit(float(v))).otherwise(limit)
    g = df.withColumn("threshold", limit).groupBy("classification", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= F.col("threshold")).alias("n_pass"))
    return g.select("classification", "n", "threshold", "n_pass", (F.col("n_pass") / F.col("n")).alias("frac_pass"))


def per_recording(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Hits and path of each recording that has hits, and whether its path is missing."""
    n = df.groupBy("recording").agg(F.count(F.lit(1)).alias("n"))
    return n.join(paths, "recording", "left").select("recording", "n", "path", F.col("path").isNull().alias("missing"))


def candidate_stats(recordings: DataFrame, sources: DataFrame, medoids: DataFrame) -> DataFrame:
    """``recordings`` with n_found, n_used and n_medoids: regions found (sources), those with a candidate,
    and those whose candidate is among the medoids."""
    m = medoids.select(F.col("candidate").alias("_c")).distinct().withColumn("is_medoid", F.lit(True))
    s = sources.join(m, F.col("candidate") == F.col("_c"), "left")
    per = s.groupBy("recording").agg(F.count(F.lit(1)).alias("n_found"), F.count("candidate").alias("n_used"), F.count("is_medoid").alias("n_medoids"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return recordings.join(per, "recording", "left").select(*recordings.columns, zero("n_found"), zero("n_used"), zero("n_medoids"))


def histogram(df: DataFrame, score: str, bins: int) -> DataFrame:
    """classification, bin, n: even bins between the least and the greatest score of all classes."""
    edges = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide((F.col(score) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(0)))
    return df.crossJoin(F.broadcast(edges)).groupBy("classification", place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, score: str) -> DataFrame:
    q = lambda p: F.percentile(F.col(score), p)
    return df.groupBy("classification").agg(F.min(score).alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(score).alias("high"))


# Metrics for which less, and more, is better.
LESS_IS_BETTER = ["bic", "gap_ratio", "gap_opens", "gap_extends", "total_gaps", "gap_percentage", "mean_variance", "median_variance", "percentage_noise", "mean_gap_pct", "median_gap_pct", "std_gap_pct", "max_gap_pct", "mean_max_consecutive", "max_consecutive"]
MORE_IS_BETTER = ["mean_fit", "well_fit_rate", "percentage_clean"]


def compare_runs(df: DataFrame, run: str, baseline: str, metrics: list[str]) -> DataFrame:
    """run, metric, value, baseline, lift, magnitude, verdict of each run but the baseline."""
    from spindrift.functions.scalars import lift_percent, magnitude

    u = df.select(run, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(run, metrics, "metric", "value")
    base = u.filter(F.col(run) == baseline).select("metric", F.col("value").alias("baseline"))  # a row a metric
    each = u.filter(F.col(run) != baseline).join(F.broadcast(base), "metric").withColumn("lift", lift_percent(F.col("value"), F.col("baseline")))
    better = F.when(F.col("metric").isin(LESS_IS_BETTER), F.col("lift") < 0).when(F.col("metric").isin(MORE_IS_BETTER), F.col("lift") > 0)
    verdict = F.when(F.col("lift").isNull(), None).when(better, "improvement").when(~better, "degradation").otherwise("change")
    return each.select(run, "metric", "value", "baseline", "lift", magnitude(F.col("lift")).alias("magnitude"), verdict.alias("verdict"))


def locate(exemplars: DataFrame, frames: DataFrame) -> DataFrame:
    """exemplar, recording, start of exemplars (exemplar, xs) that are a slice of a recording: their first
    and last frames are found by content (each at its first place), as far apart as they are long."""
    index = frames.groupBy(F.xxhash64("x").alias("h"), "x").agg(F.min(F.struct("recording", "frame")).alias("at"))
    end = lambda place, name: exemplars.select("exemplar", F.size("xs").alias("n"), F.element_at("xs", place).alias("v")).withColumn("h", F.xxhash64("v")).join(index, "h").filter(F.col("v") == F.col("x")).select("exemplar", "n", F.col("at").alias(name))
    both = end(1, "a").join(end(-1, "b").drop("n"), "exemplar")
    fits = (F.col("a.recording") == F.col("b.recording")) & (F.col("b.frame") - F.col("a.frame") == F.col("n") - 1)
    return both.filter(fits).select("exemplar", "a.recording", F.col("a.frame").alias("start"))


def with_marks(df: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Left join of user marks; a missing mark is null."""
    return df.join(marks, key, "left")


def unmarked(df: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    return df.join(marks, key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` after changes, of which the last row given for a key wins by ``seq``; a null value deletes."""
    value = next(c for c in table.columns if c != key)
    last = changes.groupBy(key).agg(F.max_by(value, "seq").alias(value))
    return table.join(last.select(key), key, "left_anti").unionByName(last.filter(F.col(value).isNotNull()).select(table.columns))


def forward_fill(df: DataFrame, column: str, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, True).over(w))


def context_pairs(df: DataFrame, group: str, order: list[str], seconds: str, back: int) -> DataFrame:
    """Each row with all rows before it in its group that are no more than ``back`` older.

    Rows of the anchor's own time that sort after it are no context, so rows are numbered.
    """
    n = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    a, c = n.alias("a"), n.alias("c")
    on = (F.col(f"a.{group}") == F.col(f"c.{group}")) & (F.col("c.rn") < F.col("a.rn")) & (F.col(f"c.{seconds}") >= F.col(f"a.{seconds}") - back)
    return a.join(c, on)


def dedupe(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def keyword_flags(text: str, terms: list[str]) -> list[Column]:
    """One 0/1 column per term, terms in order."""
    return [F.when(F.contains(F.col(text), F.lit(t)), 1).otherwise(0).alias(f"has_{t.lower().replace(' ', '_')}") for t in sorted(terms)]


def balanced_accuracy(df: DataFrame, gold: str, guess: str) -> DataFrame:
    """Precision, recall and F1 per class, from one grouped pass."""
    cells = df.groupBy(F.col(gold).alias("g"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("g").alias("cls"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("guessed")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("guessed")))).alias("x")).select("x.*")
    s = each.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("gold").alias("gold"), F.sum("guessed").alias("guessed"))
    return s.select("cls", "gold", "guessed", F.try_divide("tp", "guessed").alias("precision"), F.try_divide("tp", "gold").alias("recall"), F.try_divide(F.col("tp") * 2, F.col("gold") + F.col("guessed")).alias("f1"))
