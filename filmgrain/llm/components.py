"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a group-by with map-side combining and a join on the node; nothing is gathered on the driver but one count for
each round. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b <= a")
    # written, so that both sides of the join are plain shuffles, of which adaptive execution splits the one with a hub's edges
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")))
    linked = (both.where("b > a") if large else both).join(least, "a")
    out = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for every node of edges (a, b) the least node that it is linked with. NULL ends are dropped."""
    plain = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    now = cut(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        now = cut(_star(_star(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"the components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
