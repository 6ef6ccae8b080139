"""Connected components of an edge table, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._shared import discard, staged

MOST_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``; component is the least id reachable.

    Large-star and small-star rounds alternate until the edges are stars.  Each
    round aggregates the least neighbour by id, which combines on the map side,
    and joins it back, which adaptive execution splits for a very frequent id.
    Each round's edges are a table in the shared folder.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(MOST_ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, staged(small, name)
        discard(before)
        # stars: no node has two edges down, and no centre has one itself
        twice = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty() and now.select(F.col("v").alias("u")).join(now, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    centres = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
