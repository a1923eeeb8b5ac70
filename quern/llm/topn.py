"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import durable

#: Sub-groups over which the copies of one item may spread before the first shuffle.
SPREAD = 16


def top_n(df: DataFrame, group: str, score: str, item: str, n: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The ``n`` best items of every group, best first: ``(group, item, score, rank)``.

    Order: score descending, then item ascending, so the result is the same on every run.  Only rows with a group, an item and a
    score in ``[low, high]`` count; null and NaN scores are out, ``-0.0`` ranks as ``0.0``.  Repeated rows count once; an item
    that a group holds with several scores counts with its best.  A group with fewer items keeps them all; an empty table gives
    an empty result.  Other columns of ``df`` are ignored, whatever they are called.

    Plan.  Both rank filters are ``rank <= n`` over a window, so Catalyst puts a WindowGroupLimit before and after each
    exchange: a map task sends at most ``n`` distinct (score, item) a group, however large the group.  The first window ranks densely
    inside (group, map task modulo SPREAD): copies of one row tie, and a group of copies that fills a third of the table is
    spread over SPREAD reducers instead of one.  The aggregation then merges an item's scores (with map-side combine) and
    a row_number window over what is left, at most ``n * SPREAD`` items a group, ranks for good.

    An item with several scores takes several of the first ranks and may push another one out.  Groups in which that is so are ranked again
    from all of their rows, merged by item before anything is cut; tables without such items never pay for it.
    """
    s = F.col(score).cast("double")
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.between(low, high)).select(
        F.col(group).alias("__g"), F.col(item).alias("__i"), (s + F.lit(0.0)).alias("__s"), F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("__part")
    )
    near = Window.partitionBy("__g", "__part").orderBy(F.col("__s").desc(), F.col("__i").asc())
    kept = rows.withColumn("__r", F.dense_rank().over(near)).where(F.col("__r") <= n)
    once = durable(kept.groupBy("__g", "__i").agg(F.max("__s").alias("__s"), F.min("__s").alias("__low")))
    mixed = once.where("__low < __s")
    if mixed.isEmpty():
        ranked = _ranked(once, n)
    else:
        groups = durable(mixed.select("__g").distinct())
        parts = groups.select("__g", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__part"))  # a hot group stays spread
        merged = rows.join(parts.hint("merge"), ["__g", "__part"], "left_semi").groupBy("__g", "__i").agg(F.max("__s").alias("__s"))
        ranked = _ranked(once.join(groups, "__g", "left_anti"), n).unionByName(_ranked(merged, n))
    return ranked.select(F.col("__g").alias(group), F.col("__i").alias(item), F.col("__s").alias("score"), F.col("__n").alias("rank"))


def _ranked(once: DataFrame, n: int) -> DataFrame:
    whole = Window.partitionBy("__g").orderBy(F.col("__s").desc(), F.col("__i").asc())
    return once.select("__g", "__i", "__s").withColumn("__n", F.row_number().over(whole)).where(F.col("__n") <= n)
