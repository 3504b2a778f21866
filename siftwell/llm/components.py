"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregation and a join, and writes its edges to the shared folder; only two sums reach the driver.
The least neighbours are a table of their own, so that both sides of the join are plain exchanges: Spark can split the one
partition in which a vertex with a third of all edges lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``(k, root)`` for every end of the edges ``(a, b)``; root is the smallest number of its component."""
    cur = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_steps):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(materialize(_least(both), "least"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: the neighbours are all smaller here, as u > v holds in every edge.
        small = large.join(materialize(_least(large), "least"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        cur = materialize(small, "edges")
        now = tuple(cur.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)), F.coalesce(F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))"), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return cur.select(F.col("u").alias("k"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("k"), F.col("v").alias("root")).distinct())
