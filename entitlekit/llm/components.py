"""Connected components of a table of links, by alternating star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import checkpoint

MAX_ROUNDS = 60


def _least_of(edges: DataFrame) -> DataFrame:
    """Each end of a link with the least node among itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the least node it reaches.

    Each round links every neighbour to the least node of its star, first the larger neighbours
    and then all of a node's smaller ones, until each node is linked to its root alone. The rows
    never outnumber the links; joins on a node with many neighbours are left to Spark's skew join.
    """
    edges = checkpoint(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.where("b > a").join(_least_of(edges), "a")
            .select(F.col("least").alias("a"), "b").where("a <> b").distinct()
        )
        # b > a: keyed by the larger end, each node sends its smaller neighbours and itself to the least
        smaller = large.select(F.col("b").alias("node"), F.col("a").alias("other"))
        least = smaller.groupBy("node").agg(F.min("other").alias("least"))
        small = smaller.join(least, "node").select(
            F.col("least").alias("a"), F.explode(F.array("node", "other")).alias("b")
        ).where("a <> b").distinct()
        edges = checkpoint(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links didn't settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
