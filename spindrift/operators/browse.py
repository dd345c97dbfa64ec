"""What a browser of hits needs: filters by type, user edits, groups of merged sub-models, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators.clusters import merged_roots, stored
from spindrift.operators.hits import unmarked

#: Rows that a table of merges may have: it passes through the driver.
MAX_MERGES = 1_000_000


def shown_hits(hits: DataFrame, settings: DataFrame, marks: DataFrame, key: str = "hit") -> DataFrame:
    """Hits of enabled types that reach their type's least score and confidence and bear no mark.

    ``settings`` (classification, enabled, min_llr, min_conf) has a row a type.
    """
    on = settings.filter("enabled").select("classification", "min_llr", "min_conf")
    kept = hits.join(F.broadcast(on), "classification").filter((F.col("llr") >= F.col("min_llr")) & (F.col("confidence") >= F.col("min_conf")))
    return unmarked(kept.drop("min_llr", "min_conf"), marks, key)


def upsert_settings(table: DataFrame, changes: DataFrame, key: str = "classification") -> DataFrame:
    """Settings after changes: the last row given (by ``seq``) for a type replaces its row whole."""
    values = [c for c in table.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*values), "seq").alias("_v")).select(key, "_v.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(table.columns))


def reset(merges: DataFrame, marks: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """No merges and no marks any more; settings stay."""
    return merges.limit(0), marks.limit(0), settings


def type_summary(hits: DataFrame, group: str = "submodel") -> DataFrame:
    """Per group: hits, mean and population deviation of scores, and the most frequent type with its
    number, the first by name among equals."""
    per = hits.groupBy(group, "classification").agg(F.count(F.lit(1)).alias("n"), F.sum("llr").alias("s"))
    types = per.groupBy(group).agg(F.min_by(F.struct("classification", "n"), F.struct(-F.col("n"), F.col("classification"))).alias("t"))
    moments = hits.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("llr").alias("mean_llr"), F.stddev_pop("llr").alias("sd_llr"))
    return moments.join(types, group).select(group, "n", "mean_llr", "sd_llr", F.col("t.classification").alias("majority"), F.col("t.n").alias("n_majority"))


def half_matrix(links: DataFrame) -> DataFrame:
    return links.filter("model_i < model_j")


def group_roots(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """model, root of every sub-model in the table of merges (child, parent)."""
    rows = merges.limit(MAX_MERGES + 1).collect()
    if len(rows) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    roots = merged_roots({r["child"]: r["parent"] for r in rows})
    return spark.createDataFrame(sorted(roots.items()), "model bigint, root bigint")


def numbered(df: DataFrame, *order: str, start: int = 1, name: str = "results_id") -> DataFrame:
    """``df`` with running numbers in the given order, in parallel: rows are dealt by ranges of it,
    and a range's numbers begin after those of the ranges before."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_i") + start).drop("_p", "_i", "_before")


def pool_union(base: DataFrame, mined: DataFrame, order: list[str], key: str = "candidate_index") -> DataFrame:
    """The base pool, and after it the mined rows, whose numbers go on from the base's."""
    n = base.count()
    return base.unionByName(numbered(mined, *order, start=n, name=key).select(base.columns))


def audio_parts(df: DataFrame, group: str, order: list[str], size: str, most: float) -> DataFrame:
    """``df`` with the part that each row of a group falls in, and its offset there.

    Rows follow one another; a part ends before the row that would take it beyond ``most``.
    Which part a row is in depends on all before it, so a group is one task's.
    """
    import pandas as pd

    fields = [f for f in df.schema.fields if f.name not in ("part", "offset")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", part int, offset double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        part, at, parts, offsets = 0, 0.0, [], []
        for x in g[size]:
            if at and at + x > most:
                part, at = part + 1, 0.0
            parts.append(part)
            offsets.append(at)
            at += x
        return g.assign(part=parts, offset=offsets)

    return df.groupBy(group).applyInPandas(run, ddl)
