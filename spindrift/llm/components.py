"""Connected components of a table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import discard, lookup, materialise

#: Links that one task of a round handles.
TASK = 250_000


def follow(df: DataFrame, col: str, up: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` rows, with the values of ``col`` that ``up`` (x, p) has replaced by p.

    What one task handles anyway cannot be skewed and is joined as it is.
    """
    if n <= TASK:
        found = df.join(up.select(F.col("x").alias("_key"), F.col("p").alias("_to")), F.col(col) == F.col("_key"), "left")
        return found.select(*[F.coalesce("_to", c).alias(c) if c == col else F.col(c) for c in df.columns])
    times = df.groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    table = times.join(up, "x", "left").select(F.col("x").alias("_key"), "_n", F.col("p").alias("_to"))
    found = lookup(df.withColumn("_key", F.col(col)), table, "_key", "_n", n)
    return found.select(*[F.coalesce("_to", c).alias(c) if c == col else F.col(c) for c in df.columns])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round gives every node the smallest of itself and the nodes next to it, follows two
    such steps, and contracts the links to what they point to. Every node with a smaller
    neighbour is merged into it, so each component loses a node at least; chains by order
    halve, as do random ones, and a star goes in a round or two, whatever its centre.
    A component or a hub of any size is looked up without a hot key. Self-links count;
    links whose end is null are left out; an empty table gives no rows.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = materialise(spark, links.select("a", "b").distinct(), "links")
    tasks = 8 + edges.count() // TASK
    # Later rounds have fewer links still: their tables are written by as many tasks as these links need.
    keep = lambda df, name: materialise(spark, df.coalesce(tasks), name)
    edges, every = keep(edges, "few-links"), edges
    discard(spark, every)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels, steps, n_nodes = nodes.withColumn("component", F.col("node")), 0, nodes.count()
    n_links = edges.filter("a <> b").count()
    while n_links:
        steps += 1
        old = [edges] if steps == 1 else [edges, labels]
        both = edges.filter("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        up = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p"))
        up = keep(up, f"parents-{steps}")
        old.append(up)
        up = keep(follow(up, "p", up, n_nodes), f"jumps-{steps}")
        labels = keep(follow(labels, "component", up, n_nodes), f"labels-{steps}")
        moved = follow(follow(edges.filter("a <> b"), "a", up, n_links), "b", up, n_links)
        edges = keep(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"links-{steps}")
        n_links = edges.count()
        discard(spark, *old, up)
    return labels
