"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import discard, durable


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def cluster_links(edges: DataFrame, src: str, dst: str, rounds: int = 200) -> DataFrame:
    """``(id, cluster)`` for every linked id: the smallest id linked to it, directly or through others.

    Large star: each node's larger neighbours are tied to its smallest one; small star: the same for smaller neighbours and itself.  The two alternate until
    nothing changes (O(log^2 n) rounds); every step keeps at most one edge a node and direction.  Null ends and loops are dropped.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    ids = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = durable(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = _both(state)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = durable(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low2, "u").select("v", "u", "m")
        small = durable(down.select(F.explode(F.array("u", "v")).alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        same = small.count() == state.count() and small.join(state, ["u", "v"], "left_anti").isEmpty()
        discard(large)
        discard(state)
        state = small
        if same:
            break
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    roots = state.groupBy("u").agg(F.min("v").alias("m"))
    return ids.join(roots, ids["id"] == roots["u"], "left").select("id", F.coalesce("m", "id").alias("cluster"))
