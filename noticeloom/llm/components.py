"""Connected components by alternating large and small stars over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``u, v``: each u connects its neighbours (large: the larger ones; small: the smaller ones and itself) to the least."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``a, b`` (any integers) to ``id, component``: the least id that it is connected with; ids without edge don't appear.

    Edges stay at most as many as at the start, so memory follows the input; hubs are grouped by partial aggregation and
    joined, never collected. Rounds grow with the logarithm of the longest path.
    """
    now = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen or not state["n"]:
            break
        seen = tuple(state)
        now = scratch.written(_star(_star(now, True), False), label)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
