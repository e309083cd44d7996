"""Connected components by large-star and small-star rounds: linear tables, no group gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, materialize

ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours. Written out, so that the join below shuffles both sides and can split a node with many neighbours."""
    return materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v: long) -> node, component: the least node that can be reached. Nodes without an edge are left out."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(ROUNDS):
        # large star: each node's larger neighbours go to the least one around
        both = materialize(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        around = _least(both)
        large = both.hint("merge").join(around, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        # small star: a node and its smaller neighbours go to the least of them
        least = _least(large)
        small = large.hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialize(small)
        same = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        before, after = same(edges), same(small)
        discard(edges, both, around, large, least)
        edges = small
        if before == after:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
