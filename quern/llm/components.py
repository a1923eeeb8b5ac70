"""Consolidating pairwise matches into groups: deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.uris import canonical_uri, json_uris, map_uris, qids
from quern.runtime import discard, durable, settles


#: A key with more rows than this, and more than a HUBS-th of all rows, is a hub: there are fewer than HUBS of them, whatever the table.
HOT, HUBS = 100_000, 1000


def hubs(stream: DataFrame, key: str) -> list:
    """The keys that are hubs of a written table; fewer than HUBS, as each holds more than that share of its rows."""
    n = stream.count()  # from the Parquet footers
    if n <= HOT:
        return []
    most = max(HOT, n / HUBS)
    return [r[key] for r in stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(key).limit(HUBS).collect()]


def hub_join(stream: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """``stream`` joined with ``table``, which has one row a key.  Rows of hubs never meet in one task: their fewer than HUBS rows of the table go to
    where the stream is; the rest is joined by a shuffle."""
    if not hot:
        return stream.join(table, key)
    is_hub = F.col(key).isin(*hot)
    cold = stream.where(~is_hub).join(table.where(~is_hub), key)
    return cold.unionByName(stream.where(is_hub).join(F.broadcast(table.where(is_hub)), key))


def _distinct_edges(a, b, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col("u") < F.col("v")).distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """``(node, parent)``: every component takes its smallest outgoing edge; of two that chose the same edge, the smaller is root.

    Edges are compared by their (smaller, larger) ends, a total order, so the chosen edges form trees in which the only cycles
    are such pairs.  The minimum is combined map-side: a component with a third of all edges costs one row per map task.
    """
    edge = F.struct(F.col("u").alias("a"), F.col("v").alias("b"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), edge.alias("e")), F.struct(F.col("v").alias("n"), edge.alias("e")))).alias("x"))
    best = ends.groupBy(F.col("x.n").alias("node")).agg(F.min("x.e").alias("e"))
    parent = F.when(F.col("e.a") == F.col("node"), F.col("e.b")).otherwise(F.col("e.a"))
    chosen = durable(best.select("node", parent.alias("parent")))
    up = chosen.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    root = (F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent"))
    return hub_join(chosen, up, "parent", hubs(chosen, "parent")).select("node", F.when(root, F.col("node")).otherwise(F.col("parent")).alias("parent"))


def _collapse(hooks: DataFrame) -> DataFrame:
    """Trees to stars by pointer doubling; a tree of depth d takes log2(d) rounds."""
    state = durable(hooks)
    while True:
        up = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        moved = durable(hub_join(state, up, "parent", hubs(state, "parent")).select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        discard(state)
        if moved.where("moved").isEmpty():
            return moved.select("node", "parent")
        state = moved.select("node", "parent")


def connected_components(edges: DataFrame, src: str, dst: str, nodes: DataFrame | None = None, node: str | None = None) -> DataFrame:
    """``(id, component)`` for every node: the smallest id that it is linked to, directly or through others.

    Edges with a null end, loops, repeats and both directions of a link are fine.  ``nodes`` adds nodes without a link, which are
    their own component; null nodes are dropped.  Empty edges give each node its own component.  Ids may have any type with an
    order; strings are ordered by code points.

    Per round: hooking, pointer doubling, relabelling and deduplication of the edges.  The number of components with an open edge at
    least halves, so there are at most log2(n) rounds, on tables that shrink as fast; the maps of the rounds are composed at the end, from
    the smallest to the largest.  Nothing is collected; every table is written to the shared folder.
    """
    open_edges = durable(_distinct_edges(F.col(src), F.col(dst), edges))
    all_nodes = open_edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    maps: list[DataFrame] = []
    while not open_edges.isEmpty():
        stars = _collapse(_hook(open_edges))
        maps.append(stars)
        left = stars.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        right = stars.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        relabelled = hub_join(hub_join(open_edges, left, "u", hubs(open_edges, "u")), right, "v", hubs(open_edges, "v")).where("ru <> rv")
        following = durable(_distinct_edges(F.col("ru"), F.col("rv"), relabelled))
        discard(open_edges)
        open_edges = following
    if maps:
        composed = maps[-1]
        for earlier in reversed(maps[:-1]):
            later = composed.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            composed = earlier.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
        composed = durable(composed)
        names = composed.groupBy("parent").agg(F.min("node").alias("component"))
        linked = hub_join(composed, names, "parent", hubs(composed, "parent")).select(F.col("node").alias("id"), "component")
    else:
        linked = all_nodes.select("id", F.col("id").alias("component"))
    if nodes is None:
        return linked
    every = nodes.select(F.col(node or "id").alias("id")).where("id is not null").distinct()
    return every.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def shared_key_edges(records: DataFrame, record: str, key: str) -> DataFrame:
    """``(src, dst)``: each record tied to the smallest record that holds the same key: n - 1 edges for n holders, never n squared."""
    held = durable(records.select(F.col(record).alias("src"), F.col(key).alias("k")).where("src is not null and k is not null").distinct())
    first = held.groupBy("k").agg(F.min("src").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "dst")
    return hub_join(held, first, "k", hubs(held, "k")).where("src <> dst").select("src", "dst")


def entity_keys(entities: DataFrame) -> DataFrame:
    """``(id, key)``: every canonical URI of ``uris`` and ``uris_json`` and every QID a record holds; broken JSON holds nothing."""
    uris = F.transform(F.concat(map_uris("uris"), json_uris("uris_json")), lambda u: canonical_uri(u))
    keys = F.concat(F.transform(uris, lambda u: F.concat(F.lit("u:"), u)), F.transform(qids("wikidata_qid"), lambda q: F.concat(F.lit("q:"), q)))
    return entities.where("id is not null").select("id", F.explode(F.array_distinct(keys)).alias("key")).where("key is not null")


@settles
def entity_groups(entities: DataFrame) -> DataFrame:
    """``(group_id, id)`` for every entity record: the smallest id among the records tied to it by a URI or a QID."""
    groups = connected_components(shared_key_edges(entity_keys(entities), "id", "key"), "src", "dst", entities, "id")
    return groups.select(F.col("component").alias("group_id"), "id")
