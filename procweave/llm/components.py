"""Connected components of link tables, and their extension by later links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from procweave.llm.common import settle


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The settled edges with their number and a digest of all, taken while they are written."""
    seen = Observation()
    out = settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")))
    return out, (seen.get["n"], seen.get["digest"])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` (the smallest node that can be reached) for every node of the links ``(a, b)``.

    Each round links a node's larger neighbours to its smallest one, then its smaller ones. Minima are pre-aggregated and joined
    back by sorted merges, so a hub is split like any skewed join and the driver holds no table; a round is one written table.
    """
    e, mark = _marked(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    for _ in range(rounds if mark[0] else 0):
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.join(low.hint("merge"), "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        up = down.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, now = _marked(up.distinct())
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("c"))
    return settle(nodes.join(roots.hint("merge"), nodes.node == roots.u, "left").select("node", F.coalesce("c", "node").alias("component")))


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known`` (node, component) with the links ``(a, b)`` added; only links between different components are followed."""
    label = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}c")).hint("merge")
    met = edges.join(label("a"), "a", "left").join(label("b"), "b", "left")
    ends = met.select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")).filter("a <> b").distinct()
    over = components(ends).select(F.col("node").alias("component"), F.col("component").alias("to")).hint("merge")
    moved = known.join(over, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = over.join(known.select(F.col("component")).distinct().hint("merge"), "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return settle(moved.unionByName(new))
