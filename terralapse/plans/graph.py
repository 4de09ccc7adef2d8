"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terralapse.plans.storage import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every neighbour of a node is tied to the node's least neighbour instead.

    The large star does so with the greater neighbours of each node (edges both ways),
    the small star with the lesser ones and the node itself. The least neighbour comes
    from an aggregate that is combined before the shuffle and is joined back, so a node
    with very many neighbours is a skewed join, which Spark splits, and not one group.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        kept = both.where("v > u")
    else:
        both = edges
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        kept = both
    tied = kept.join(least, "u")
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, left: str, right: str, tag: str = "components") -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Large and small stars by turns (Kiveris et al., Connected Components in MapReduce and
    Beyond, 2014) until no edge changes; each round is written to the shared folder, which
    cuts lineage, and the round before it is removed. Nulls and loops are ignored; nodes without an edge don't appear.
    """
    ends = [F.col(left), F.col(right)]
    now = edges.where(F.col(left) != F.col(right)).select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).distinct()
    before, seen, last = None, {}, None
    while True:
        # Counted while it is written: a second pass over the edges isn't needed.
        told = Observation()
        counted = now.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total"))
        now, seen = stored(counted, tag), told.get
        if last is not None:
            dropped(last)
        last = now
        if not seen["n"] or (seen["n"], seen["total"]) == before:
            break
        before = (seen["n"], seen["total"])
        now = _star(_star(now, True), False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
