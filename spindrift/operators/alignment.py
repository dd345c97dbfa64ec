"""Quality of an alignment: columns are the match states of all sub-models in turn, rows are
sequences, and a cell that a path never visits is a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(matched: DataFrame, sequences: DataFrame, models: int, states: int, vector: str = "x") -> DataFrame:
    """seq, col, n, mean (array) of every cell; gaps have n = 0 and no mean.

    ``matched`` (recording, submodel, k, and a vector of each matched frame); the sentinel
    state 0 is in no column. The grid has as many cells a sequence as the model has states.
    """
    col = (F.col("submodel") * (states - 1) + F.col("k") - 1).cast("int").alias("col")
    each = matched.filter("k > 0").select(F.col("recording").alias("seq"), col, F.posexplode(vector).alias("dim", "v"))
    per_dim = each.groupBy("seq", "col", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    full = per_dim.groupBy("seq", "col").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"))
    grid = sequences.select(F.col("recording").alias("seq")).distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(models * (states - 1) - 1))))
    return grid.join(full, ["seq", "col"], "left").select("seq", "col", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("m.mean").alias("mean"))


def gap_steps(grid: DataFrame) -> DataFrame:
    """The grid with gap, opens and extends of each cell, and the run of gaps or matches it is in."""
    w = Window.partitionBy("seq").orderBy("col")
    gap = grid.withColumn("gap", F.col("n") == 0)
    before = F.coalesce(F.lag("gap").over(w), F.lit(False))
    marked = gap.withColumn("opens", F.col("gap") & ~before).withColumn("extends", F.col("gap") & before)
    return marked.withColumn("run", F.sum(F.when(F.col("gap") == F.coalesce(F.lag("gap").over(w), ~F.col("gap")), 0).otherwise(1)).over(w))


def gap_metrics(grid: DataFrame) -> DataFrame:
    """One row: gap_ratio (infinite without extensions), gap_opens, gap_extends, total_gaps."""
    s = gap_steps(grid).agg(F.count_if("opens").alias("gap_opens"), F.count_if("extends").alias("gap_extends"), F.count_if("gap").alias("total_gaps"))
    ratio = F.when(F.col("gap_extends") > 0, F.col("gap_opens") / F.col("gap_extends")).otherwise(F.lit(float("inf")))
    return s.select(ratio.alias("gap_ratio"), "gap_opens", "gap_extends", "total_gaps")


def column_variances(grid: DataFrame) -> DataFrame:
    """col, n_seq, variance: the mean over dimensions of the population variance between the
    sequences' means; null where fewer than two sequences have the column."""
    each = grid.filter("n > 0").select("seq", "col", F.posexplode("mean").alias("dim", "v"))
    per_dim = each.groupBy("col", "dim").agg(F.var_pop("v").alias("v"), F.count(F.lit(1)).alias("n"))
    found = per_dim.groupBy("col").agg(F.first("n").alias("n_seq"), F.avg("v").alias("variance"))
    columns = grid.select("col").distinct().join(found, "col", "left")
    return columns.select("col", F.coalesce("n_seq", F.lit(0).cast("long")).alias("n_seq"), F.when(F.col("n_seq") >= 2, F.col("variance")).alias("variance"))


def cleanliness(grid: DataFrame, clean: float = 0.1, noisy: float = 1.0) -> DataFrame:
    """One row: mean and median variance, and the shares (per cent) of gaps, clean and noisy columns."""
    v = column_variances(grid).agg(
        F.coalesce(F.avg("variance"), F.lit(0.0)).alias("mean_variance"), F.coalesce(F.percentile("variance", 0.5), F.lit(0.0)).alias("median_variance"),
        (F.count_if(F.col("variance") < clean) * 100.0 / F.count(F.lit(1))).alias("percentage_clean"), (F.count_if(F.col("variance") > noisy) * 100.0 / F.count(F.lit(1))).alias("percentage_noise"), F.count(F.lit(1)).alias("total_columns"),
    )
    g = grid.agg(F.coalesce(F.count_if(F.col("n") == 0) * 100.0 / F.count(F.lit(1)), F.lit(0.0)).alias("gap_percentage"))
    return v.crossJoin(g).select("mean_variance", "median_variance", "gap_percentage", "percentage_clean", "percentage_noise", "total_columns")


def sequence_gaps(grid: DataFrame) -> DataFrame:
    """seq, n_gaps, n_columns, gap_pct, longest run of gaps."""
    steps = gap_steps(grid)
    runs = steps.groupBy("seq", "run").agg(F.count_if("gap").alias("gaps"), F.count(F.lit(1)).alias("n"))
    s = runs.groupBy("seq").agg(F.sum("gaps").alias("n_gaps"), F.sum("n").alias("n_columns"), F.max("gaps").alias("longest"))
    return s.select("seq", "n_gaps", "n_columns", (F.col("n_gaps") * 100.0 / F.col("n_columns")).alias("gap_pct"), "longest")


def gap_statistics(grid: DataFrame) -> DataFrame:
    """One row over the sequences' gaps."""
    p = F.col("gap_pct")
    return sequence_gaps(grid).agg(
        F.avg(p).alias("mean_gap_pct"), F.percentile(p, 0.5).alias("median_gap_pct"), F.stddev_pop(p).alias("std_gap_pct"), F.min(p).alias("min_gap_pct"), F.max(p).alias("max_gap_pct"),
        F.avg("longest").alias("mean_max_consecutive"), F.max("longest").alias("max_consecutive"), F.sum("n_gaps").alias("total_gap_positions"), F.sum("n_columns").alias("total_positions"),
    )


def all_metrics(grid: DataFrame) -> DataFrame:
    """All of these in one row of 19 columns."""
    return gap_metrics(grid).crossJoin(cleanliness(grid)).crossJoin(gap_statistics(grid))
