"""Transitive closure of a relation: a semi-naive fix-point that is safe on cycles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

from quern.runtime import discard, durable


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.selectExpr("src", "dst as mid").join(b.selectExpr("src as mid", "dst"), "mid").select("src", "dst")


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def transitive_closure(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """Distinct ``(src, dst)`` with a path of one or more edges from src to dst.

    After k rounds all paths of up to 2 ** k edges are known, and beside them the pairs joined by exactly that many; the known pairs are
    extended by these, so a path of n edges takes log2(n) rounds and each length is derived once.  Pairs known before are dropped by an anti-join, and a
    round without a new one is the last.  Null ends are dropped.  A closure that is not complete after ``rounds`` rounds is an error.
    """
    step = durable(edges.selectExpr(f"`{src}` as src", f"`{dst}` as dst").dropna().distinct())
    parts = [step]
    for _ in range(rounds):
        known = _union(parts)
        fresh = durable(_joined(known, step).distinct().join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            discard(fresh)
            return known
        parts.append(fresh)
        longer = durable(_joined(step, step).distinct())
        if step is not parts[0]:
            discard(step)
        step = longer
    raise RuntimeError(f"the closure is not complete after {rounds} rounds")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` for the given starts ``(src)`` only: what each of them reaches by one or more edges.

    The frontier grows by one edge a round and carries nothing but pairs that were not known, so the work is that of the part of the
    graph that can be reached, not of the whole relation.
    """
    edges = durable(edges.select("src", "dst").dropna().distinct())
    first = edges.join(starts.select("src").distinct(), "src", "left_semi")
    parts = [durable(first)]
    while not parts[-1].isEmpty():
        known = _union(parts)
        parts.append(durable(_joined(parts[-1], edges).distinct().join(known, ["src", "dst"], "left_anti")))
    return _union(parts)
