"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicelake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every larger (large star) or every smaller (small star) neighbour of a node to its smallest one."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a > b in ``edges``: without the mirror image every neighbour is smaller
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")  # a hot node's rows are split by AQE
    to = F.col("b") > F.col("a") if large else F.lit(True)
    moved = joined.where(to).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        moved = moved.union(joined.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node of ``links`` (``a``, ``b``)."""
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now
        edges = stored(_star(_star(edges, True), False), "edges")
