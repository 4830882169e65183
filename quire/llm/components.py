"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the same key; edges are rewritten until none changes. Every step is
written to the shared folder, so lineage stays short. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import attach, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: neighbours above u are linked with u's least neighbour. Small: those below it."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.distinct()
    else:
        both = edges
    both = written(both, "both")
    least = written(both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")), "least")
    least = least.withColumn("m", F.least("u", "_m")).drop("_m")
    met = attach(both, least, "u", "_n")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the least id that can be reached.

    Self links and repeated links are allowed and change nothing, rows with a null end are ignored; no edge, no row.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        edges = written(_star(written(_star(edges, True), "large"), False), "small")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: two sums of unlike hashes beside the count."""
    low = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    high = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), low, high).first())
