"""Cross-dataset links with provenance: look-ups, cross references, see-also, clusters of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import dataset_of, era_label, is_known_uri, slug
from quern.operators.components import cluster_links
from quern.operators.relational import append_unseen, first_wins, top_k
from quern.functions.uris import DOMAIN_ALIASES, canonical_uri, qids
from quern.plans.syntax import OWL, RDFS, SKOS, TYPE

# Properties that say that two URIs mean the same thing.
SAME = (SKOS + "closeMatch", SKOS + "exactMatch", OWL + "sameAs", "http://schema.org/sameAs")


def _directed(links: DataFrame) -> DataFrame:
    """Each link seen from both of its ends."""
    cols = ["relationship", "confidence", "basis", "method", "note"]
    there = links.select(F.col("source").alias("uri"), F.col("target"), F.lit("forward").alias("direction"), *cols)
    back = links.select(F.col("target").alias("uri"), F.col("source").alias("target"), F.lit("reverse").alias("direction"), *cols)
    return there.unionByName(back)


def find_links(uris: DataFrame, links: DataFrame, concordances: DataFrame | None = None) -> DataFrame:
    """``(uri, target, direction, relationship, confidence, ...)`` for a set of URIs: links with provenance in both directions, then the
    default graph's concordances ``(s, p, o)`` for targets not linked already, with confidence ``concordance``."""
    asked = uris.select("uri").distinct()
    own = _directed(links).join(asked, "uri", "left_semi")
    if concordances is None:
        return own
    same = concordances.select(F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("relationship"), F.lit("concordance").alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("basis", "method", "note")])
    more = _directed(same).join(asked, "uri", "left_semi")
    return append_unseen(own, more.dropDuplicates(["uri", "target"]), ["uri", "target"])


def provenance(links: DataFrame, source: str, target: str) -> DataFrame:
    """The first link of a pair (by relationship, then id) with its provenance; no row if there is none."""
    return links.where((F.col("source") == source) & (F.col("target") == target)).orderBy("relationship", "link_id").limit(1)


def cross_references(quads: DataFrame, uris: DataFrame) -> DataFrame:
    """``(uri, target, property)``: statements of sameness in the data itself, in both directions."""
    rows = quads.where(F.col("p").isin(*SAME) & (F.col("o_kind") == "iri")).select("s", "o", "p")
    both = rows.select(F.col("s").alias("uri"), F.col("o").alias("target"), F.col("p").alias("property")).unionByName(rows.select(F.col("o").alias("uri"), F.col("s").alias("target"), F.col("p").alias("property")))
    return both.join(uris.select("uri").distinct(), "uri", "left_semi").distinct()


def see_also(result: DataFrame, columns: list[str], links: DataFrame, most: int = 50) -> DataFrame:
    """``(target, uri, relationship)``: what the URIs of a result are linked to, one row a target.

    Runs on full IRIs, before any are shortened; at most ``most`` distinct URIs (the smallest) are looked up.
    """
    values = result.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("uri")).where(is_known_uri(F.col("uri"))).distinct().orderBy("uri").limit(most)
    return top_k(_directed(links).join(values, "uri"), ["target"], [F.col("uri").asc(), F.col("relationship").asc()], 1).select("target", "uri", "relationship")


def merged_references(curated: DataFrame, in_data: DataFrame) -> DataFrame:
    """Curated links before references in the data; one row for each target."""
    return first_wins([curated.select("target", "relationship"), in_data.select("target", F.col("property").alias("relationship"))], ["target"], [F.col("relationship").asc()])


def build_entities(links: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, canonical_name, entity_type, date_range, description, uris)``: one record for each cluster of linked URIs.

    Clusters are connected components of the links alone (provenance never joins them).  ``names(uri, name, start, end, note)`` fills in: the
    name of the smallest URI that has one, the widest era, the longest description.
    """
    clusters = cluster_links(links, "source", "target")
    known = clusters.join(names, clusters["id"] == names["uri"], "left")
    uri = F.struct(dataset_of(F.col("id")).alias("dataset"), F.col("id").alias("uri"))
    out = known.groupBy("cluster").agg(
        F.min(F.when(F.col("name").isNotNull(), F.struct("id", "name"))).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.max(F.when(F.col("note").isNotNull(), F.struct(F.char_length("note").alias("l"), "note"))).alias("d"), F.sort_array(F.collect_set(uri)).alias("u"),
    )
    by_set = F.array_distinct(F.transform("u", lambda x: F.coalesce(x["dataset"], F.lit("other"))))
    uris = F.map_from_arrays(by_set, F.transform(by_set, lambda d: F.transform(F.filter("u", lambda x: F.coalesce(x["dataset"], F.lit("other")) == d), lambda x: x["uri"])))
    name = F.coalesce(F.col("n.name"), F.substring_index("cluster", "/", -1))
    return out.select(slug(name).alias("id"), name.alias("canonical_name"), F.lit("person").alias("entity_type"), era_label(F.col("start"), F.col("end")).alias("date_range"), F.col("d.note").alias("description"), uris.alias("uris"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with rows of ``changes`` in place of those with the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def entities_of(uris: DataFrame, entities: DataFrame) -> DataFrame:
    """``(uri, id)``: the entity record that holds a URI."""
    held = entities.select("id", F.explode(F.flatten(F.map_values("uris"))).alias("uri"))
    return uris.join(held, "uri").select("uri", "id").distinct()


def entity_card(quads: DataFrame, uris: DataFrame, limit: int = 100) -> DataFrame:
    """``(uri, property, values)``: literals in English, Latin or no language and links of each URI; values distinct, sorted."""
    lang = F.coalesce(F.col("o_lang"), F.lit(""))
    rows = quads.where((F.col("o_kind") != "lit") | lang.isin("en", "la", "")).join(uris.select(F.col("uri").alias("s")).distinct(), "s", "left_semi")
    kept = top_k(rows.select("s", "p", "o").distinct(), ["s"], [F.col("p").asc(), F.col("o").asc()], limit)
    return kept.groupBy(F.col("s").alias("uri"), F.col("p").alias("property")).agg(F.sort_array(F.collect_set("o")).alias("values"))  # at most ``limit`` values


def best_name(candidates: Column) -> Column:
    """The name among ``array<struct<lang, text>>``: English, then untagged, then any."""
    pick = lambda test: F.array_min(F.transform(F.filter(candidates, test), lambda c: c["text"]))
    return F.coalesce(pick(lambda c: c["lang"] == "en"), pick(lambda c: F.coalesce(c["lang"], F.lit("")) == ""), pick(lambda c: F.lit(True)))


def concordance(left: DataFrame, right: DataFrame, item: str, left_ns: str, right_ns: str, property: str = SKOS + "closeMatch") -> DataFrame:
    """``(s, p, o)``: the entities of two sources that are tied to one shared item of a third; IRIs are made of namespaces and ids.  Both: ``(item, id)``."""
    pairs = left.select(item, F.col("id").cast("string").alias("a")).dropna().distinct().join(right.select(item, F.col("id").cast("string").alias("b")).dropna().distinct(), item)
    return pairs.select(F.concat(F.lit(left_ns), "a").alias("s"), F.lit(property).alias("p"), F.concat(F.lit(right_ns), "b").alias("o")).distinct()


def extend_clusters(members: DataFrame, authorities: DataFrame, holders: DataFrame, most: int = 50) -> DataFrame:
    """``members(cluster, uri)`` with what authority files add: an authority that a member is an exact match of, and the entities of other sources that say
    they are the same as that authority, at most ``most`` for each (the smallest).

    ``authorities(uri, authority)``, ``holders(authority, uri)``; authorities are compared by canonical form, so both spellings of their URIs meet.
    """
    key = canonical_authority(F.col("authority"))
    found = members.join(authorities.select("uri", "authority").dropna().distinct(), "uri").select("cluster", F.col("authority").alias("uri"), key.alias("key"))
    own = holders.select(key.alias("key"), "uri").dropna().distinct()
    more = top_k(found.select("cluster", "key").distinct().join(own, "key"), ["cluster", "key"], [F.col("uri").asc()], most).select("cluster", "uri")
    return members.select("cluster", "uri").unionByName(found.select("cluster", "uri")).unionByName(more).distinct()


def canonical_authority(uri: Column) -> Column:
    """An authority's id: its QID where it has one, else its canonical URI."""
    return F.coalesce(F.get(qids(uri), F.lit(0)), canonical_uri(uri))


def describe_entities(parts: DataFrame) -> DataFrame:
    """``(id, description)`` of ``parts(id, label, place, text)``: texts joined in order; of several descriptions of one id the longest, ties by text."""
    said = parts.where("text is not null and trim(text) <> ''").groupBy("id", "source").agg(F.sort_array(F.collect_set(F.struct("place", "label", "text"))).alias("t"))
    made = said.select("id", F.concat_ws(". ", F.transform("t", lambda x: F.when(x["label"].isNotNull(), F.concat(x["label"], F.lit(": "), x["text"])).otherwise(x["text"]))).alias("d"))
    best = made.groupBy("id").agg(F.min(F.struct((-F.char_length("d")).alias("l"), "d")).alias("b"))
    return best.select("id", F.col("b.d").alias("description"))


# Properties that hold a name, in order of preference, and local names that may stand in for one.
NAME_PROPERTIES = (RDFS + "label", SKOS + "prefLabel", "http://purl.org/dc/terms/title")


def resolve_entities(quads: DataFrame, uris: DataFrame, limit: int = 100, most_see_also: int = 10) -> DataFrame:
    """``(uri, name, description, types, see_also, properties)`` of every URI that the data know, under either scheme.

    ``name``: a label in English, else untagged, else any, else the end of the URI.  ``description``: the smallest comment.  ``types``: local
    names, those of w3.org aside.  ``see_also``: the smallest ``most_see_also``.  ``properties``: map from property to distinct values (literals in English,
    Latin or no language), in the order of their first place, at most ``limit`` statements.
    """
    key = lambda c: F.regexp_replace(c, r"^https?://", "")
    asked = uris.select("uri", key(canonical_scheme(F.col("uri"))).alias("k")).distinct()
    facts = quads.select(key(F.col("s")).alias("k"), F.col("p"), F.col("o"), "o_kind", F.coalesce("o_lang", F.lit("")).alias("lang")).join(asked.select("k").distinct(), "k", "left_semi").distinct()
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "", 1).otherwise(2)
    names = F.min(F.when(F.col("p").isin(*NAME_PROPERTIES) & (F.col("o_kind") == "lit"), F.struct(rank.alias("r"), F.array_position(F.array(*map(F.lit, NAME_PROPERTIES)), F.col("p")).alias("n"), "o"))).alias("name")
    one = facts.groupBy("k").agg(
        names, F.min(F.when(F.col("p") == RDFS + "comment", F.col("o"))).alias("description"),
        F.sort_array(F.collect_set(F.when((F.col("p") == TYPE) & ~F.col("o").startswith("http://www.w3.org/"), F.regexp_extract("o", r"([^/#]*)$", 1)))).alias("types"),
    )
    see = top_k(facts.where(F.col("p") == RDFS + "seeAlso").select("k", "o").distinct(), ["k"], [F.col("o").asc()], most_see_also).groupBy("k").agg(F.sort_array(F.collect_list("o")).alias("see_also"))
    shown = top_k(facts.where((F.col("o_kind") != "lit") | F.col("lang").isin("en", "la", "")).select("k", "p", "o").distinct(), ["k"], [F.col("p").asc(), F.col("o").asc()], limit, "place")
    props = shown.groupBy("k", "p").agg(F.sort_array(F.collect_list(F.struct("place", "o"))).alias("v")).groupBy("k").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", F.transform("v", lambda x: x["o"]).alias("v"))))).alias("properties"))
    out = asked.join(one, "k").join(see, "k", "left").join(props, "k", "left")
    tail = F.regexp_extract(F.rtrim("uri", F.lit("/")), r"([^/#]*)$", 1)
    return out.select("uri", F.coalesce("name.o", tail).alias("name"), "description", "types", F.coalesce("see_also", F.array().cast("array<string>")).alias("see_also"), "properties")


def canonical_scheme(uri: Column) -> Column:
    """A URI without ``www.`` and with its dataset's own host, scheme kept."""
    out = F.replace(uri, F.lit("://www."), F.lit("://"))
    for alias, host in DOMAIN_ALIASES.items():
        out = F.regexp_replace(out, f"://{alias.replace('.', '[.]')}/edh/", f"://{host}/edh/")
    return out


def property_metadata(quads: DataFrame, properties: DataFrame) -> DataFrame:
    """``(property, label, comment, domain, range)`` of ``properties(property)``: the smallest of each; domain and range by their local names."""
    local = lambda c: F.regexp_extract(c, r"([^/#]*)$", 1)
    said = quads.select(F.col("s").alias("property"), "p", "o").join(properties.select("property").distinct(), "property", "left_semi")
    pick = lambda name: F.min(F.when(F.col("p") == RDFS + name, F.col("o")))
    made = said.groupBy("property").agg(pick("label").alias("label"), pick("comment").alias("comment"), local(pick("domain")).alias("domain"), local(pick("range")).alias("range"))
    return properties.select("property").distinct().join(made, "property", "left")


def session_report(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(dataset, calls, queries, searches, chars, ms, first_at, last_at, version, license, citation)``: what a session used of each dataset, with
    what is needed to cite it.  ``log(tool, dataset, output_length, duration_ms, at)``; calls without a dataset are summed under null."""
    used = log.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("tool") == "query").alias("queries"), F.count_if(F.col("tool") == "search_entities").alias("searches"),
        F.sum("output_length").alias("chars"), F.sum("duration_ms").alias("ms"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )
    known = catalog.select("dataset", *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("version", "license", "citation")])
    return used.join(known, "dataset", "left").select("dataset", "calls", "queries", "searches", "chars", "ms", "first_at", "last_at", *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("version", "license", "citation")])


def report_text(report: DataFrame, calls: DataFrame) -> str:
    """The report of one session as Markdown; a session is a list that somebody reads."""
    lines = ["# Session report", ""]
    for r in calls.orderBy("id").collect():
        lines.append(f"{r['id']}. {r['tool']} ({r['dataset'] or '-'}): {r['input'] or ''}")
    lines += ["", "## Sources", ""]
    lines += [f"- {r['dataset']} {r['version']}: {r['calls']} calls, {r['queries']} queries. {r['license']}. {r['citation']}" for r in report.where("dataset is not null").orderBy("dataset").collect()]
    return "\n".join(lines) + "\n"
