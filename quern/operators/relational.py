"""Ranking, picking, deduplication and range predicates: thin helpers that state an order explicitly and leave the plan to Catalyst."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import durable


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; the optimiser's group limit prunes before the shuffle where ``k`` is a number."""
    out = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k)
    return out.withColumnRenamed("__n", rank) if rank else out.drop("__n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the stated order."""
    return top_k(df, keys, order, 1)


def earliest_per_key(df: DataFrame, keys: Sequence[str], date: str, tie: str) -> DataFrame:
    """The row with the earliest date for each key; a missing date counts as 0.  A partial aggregate: no sort."""
    row = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(F.coalesce(F.col(date), F.lit(0)), F.col(tie))).alias("__row"))
    return best.select("__row.*")


def with_rank0(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank0") -> DataFrame:
    """``name``: the place of each row, from 0, within its ``keys``, or in the whole table without any (see :func:`numbered`)."""
    if not keys:
        return numbered(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank0") -> DataFrame:
    """Every row with its place, from 0, in a total order of the whole table, without a window over one partition.

    The rows are sorted by ranges and written with their place inside the range; the ranges' sizes, one row each, are summed up before them.
    """
    placed = durable(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    starts = sizes.select("__part", before.alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + at).drop("__part", "__before", "__m")


def confidence_class(score: Column | str, gap: Column | str) -> Column:
    """``strong`` from .7 with a gap of .2, ``probable`` from .5 with a gap of .1, else ``ambiguous``."""
    s, g = _c(score), _c(gap)
    return F.when((s >= 0.7) & (g >= 0.2), "strong").when((s >= 0.5) & (g >= 0.1), "probable").otherwise("ambiguous")


def rank_with_gap(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[Column], k: int | None = 10) -> DataFrame:
    """``rank`` (1 is best), ``gap`` to the next score (the last one's own score) and ``confidence``; the first ``k`` of each group."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    out = out.withColumn("confidence", confidence_class(score, "gap"))
    return out if k is None else out.where(F.col("rank") <= k)


def unique_pairs(df: DataFrame, left: str, right: str, name: str = "unique") -> DataFrame:
    """Marks pairs whose two ends occur in no other pair.  Ends are counted by aggregates, combined map-side, and joined back; null ends are like any."""
    ends = lambda c, as_: df.groupBy(F.col(c).alias(f"__{as_}")).agg(F.count(F.lit(1)).alias(f"__n{as_}"))
    out = df.join(ends(left, "l"), F.col(left).eqNullSafe(F.col("__l"))).join(ends(right, "r"), F.col(right).eqNullSafe(F.col("__r")))
    return out.withColumn(name, (F.col("__nl") == 1) & (F.col("__nr") == 1)).select(*df.columns, name)


def score_cutoff(df: DataFrame, keys: Sequence[str], score: str, share: float = 0.3) -> DataFrame:
    """The rows of each group that reach a share of its best score; the best is an aggregate, joined back."""
    best = df.groupBy(*keys).agg(F.max(score).alias("__best"))
    return df.join(best, list(keys)).where(F.col(score) >= share * F.col("__best")).drop("__best")


def margin_pick(df: DataFrame, keys: Sequence[str], distance: str, tie: Sequence[Column], most: float, margin: float, lone: float) -> DataFrame:
    """The nearest candidate of each key where it is near (``most``) and ahead of the second by ``margin``; a lone one within ``lone``."""
    w = Window.partitionBy(*keys).orderBy(F.col(distance).asc_nulls_last(), *tie)
    out = df.withColumn("__n", F.row_number().over(w)).withColumn("second", F.lead(distance).over(w)).where("__n = 1").drop("__n")
    ahead = (F.col(distance) <= most) & (F.col("second") - F.col(distance) >= margin)
    return out.where(F.when(F.col("second").isNull(), F.col(distance) <= lone).otherwise(ahead))


def nearest(df: DataFrame, keys: Sequence[str], at: str, value: str, payload: Sequence[str]) -> DataFrame:
    """For each key the payload whose ``value`` is nearest to ``at``; equal distances by smaller value.  A partial aggregate."""
    gap = F.abs(F.col(value) - F.col(at))
    best = df.groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), F.col(value).alias("near"), *[F.col(p) for p in payload])).alias("__b"))
    return best.select(*keys, "__b.*")


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a1 >= b0) & (a0 <= b1)


def era_distance(at: Column, low: Column, high: Column) -> Column:
    """0 inside a range, else the distance to the nearer end; null if either side has no date."""
    lo, hi = F.coalesce(low, high), F.coalesce(high, low)
    return F.when(at.isNotNull() & lo.isNotNull(), F.when(at.between(lo, hi), F.lit(0)).otherwise(F.least(F.abs(at - lo), F.abs(at - hi))))


def range_join(a: DataFrame, b: DataFrame, a0: str, a1: str, b0: str, b1: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs whose integer ranges overlap (and whose ``keys`` are equal), through buckets of ``width``: an equi-join, not a nested loop.

    Each range is copied to the buckets that it touches; a pair is kept in the first bucket that both touch, so none comes twice.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = lambda df, s, e: df.where(F.col(s) <= F.col(e)).withColumn("__b", F.explode(F.sequence(bucket(s), bucket(e))))
    out = spread(a, a0, a1).join(spread(b, b0, b1), ["__b", *keys]).where((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)))
    return out.where(F.col("__b") == F.greatest(bucket(a0), bucket(b0))).drop("__b")


def first_wins(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union in which the earlier part wins for each key."""
    tagged = [p.withColumn("__prio", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_per_key(out, keys, [F.col("__prio").asc(), *order]).drop("__prio")


def append_unseen(known: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``known`` and the rows of ``more`` whose keys it lacks."""
    return known.unionByName(more.join(known.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def capped_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` of each group, each with ``hidden``: how many more there are."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    kept = top_k(df, keys, order, k)
    return kept.join(sizes, list(keys)).withColumn("hidden", F.greatest(F.col("__size") - k, F.lit(0))).drop("__size")


def counts_in_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts by value in a fixed order of values; values not in it come last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)), F.lit(len(order) + 1))
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("place", place.cast("int"))


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, size: int = 50, sep: str = ", ") -> DataFrame:
    """Texts of each key joined in chunks of ``size``, in order; the chunk number is ``chunk``.

    Rows are numbered in one order over all keys and counted from the first of their key, so a key with a third of all rows is no task's burden.
    """
    n = numbered(df, [*[F.col(k).asc() for k in keys], *order], "__at")
    starts = n.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min("__at").alias("__start"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.lit(True))
    own = n.join(starts, same).select(*keys, F.col(text), (F.col("__at") - F.col("__start")).alias("__n"))
    made = own.withColumn("chunk", F.floor(F.col("__n") / size)).groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("__n", text))).alias("__x"))  # at most size entries
    return made.select(*keys, "chunk", F.array_join(F.transform("__x", lambda x: x[text]), sep).alias("text"))


def natural_key(text: Column) -> Column:
    """A sort key under which digits count as numbers: each run of digits is padded to twelve."""
    padded = F.regexp_replace(text, r"(\d+)", "000000000000$1")
    return F.regexp_replace(F.lower(padded), r"0*(\d{12})(?!\d)", "$1")


def substring_rank(df: DataFrame, text: str, query: str, tie: Sequence[Column], also: str | None = None) -> DataFrame:
    """Rows that hold ``query``, earliest position first; a hit in ``also`` only counts as position 1000."""
    at = F.instr(F.lower(F.col(text)), query.lower())
    place = F.when(at > 0, at - 1)
    if also:
        place = F.coalesce(place, F.when(F.instr(F.lower(F.col(also)), query.lower()) > 0, F.lit(1000)))
    return df.withColumn("position", place).where("position is not null").orderBy("position", *tie)


def weighted_score(signals: Column) -> Column:
    """The mean of the present signals by weight, less the share of weight that is absent; 0 if none is present.

    ``signals``: ``map<string, struct<score, weight, is_absent>>`` or an array of such structs.
    """
    return F.aggregate(
        signals,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
        lambda acc, x: F.struct((acc["s"] + F.when(x["is_absent"], 0.0).otherwise(x["weight"] * x["score"])).alias("s"), (acc["w"] + x["weight"]).alias("w")),
        lambda acc: F.when(acc["w"] > 0, acc["s"] / acc["w"]).otherwise(F.lit(0.0)),
    )


def grouped_values(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """``(*keys, values)``: the distinct values of each group in the order of their first position.  Values are merged before they are gathered."""
    first = df.groupBy(*keys, value).agg(F.min(position).alias("__at"))
    made = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", value))).alias("__v"))
    return made.select(*keys, F.transform("__v", lambda x: x[value]).alias("values"))


def limit_large_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], above: int, k: int) -> DataFrame:
    """The first ``k`` rows of groups of more than ``above`` rows; other groups whole."""
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) > above).alias("__large"))
    tagged = df.join(sizes, list(keys))
    return tagged.where("not __large").unionByName(top_k(tagged.where("__large"), keys, order, k)).drop("__large")
