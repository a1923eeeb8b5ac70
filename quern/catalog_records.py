"""More queries over records: names, texts, retrieval, resolution, links of entities; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import _BM25, NS, query, table
from quern.functions import onomastics as N
from quern.functions import text as X
from quern.functions.uris import canonical_uri, json_uris, map_uris, qids
from quern.operators import linkage as L
from quern.operators import profile as P
from quern.operators import relational as R
from quern.operators import resolve as E
from quern.operators import search as Q
from quern.plans.syntax import OWL, RDFS, SKOS, TYPE
from quern.sources.sessions import feed_filter


def _case(key: str, pairs: dict[str, str], otherwise: str = "NULL") -> str:
    quote = lambda x: x.replace("'", "''")
    return f"CASE {key} " + " ".join(f"WHEN '{quote(a)}' THEN '{quote(b)}'" for a, b in pairs.items()) + f" ELSE {otherwise} END"


# -- names
def _latin_sql(name: str) -> str:
    """Transliteration in SQL, from the same fixed values."""
    words = f"list_filter(string_split_regex(strip_accents(lower({name})), '\\s+'), lambda w: w <> '')"
    named = f"array_to_string(list_transform({words}, lambda w: {_case('w', {k: v for k, v in N.FORENAMES.items() if len(k) > 3 and k[0] > 'ͯ'}, 'w')}), ' ')"
    out = named
    for a, b in N.GREEK_GROUPS.items():
        out = f"replace({out}, '{a}', '{b}')"
    single = {a: b for a, b in N.GREEK_LETTERS.items() if len(b) == 1}
    out = f"translate({out}, '{''.join(single)}', '{''.join(single.values())}')"
    ends = " ".join(f"WHEN w LIKE '%{a}' THEN substr(w, 1, length(w) - {len(a)}) || '{b}'" for a, b in N.LATIN_ENDINGS.items())
    ended = f"array_to_string(list_transform(string_split_regex({out}, '\\s+'), lambda w: CASE {ends} ELSE w END), ' ')"
    greek = lambda x: f"regexp_matches({x}, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]')"
    return f"CASE WHEN NOT {greek(name)} THEN {name} WHEN {greek(named)} THEN {ended} ELSE {named} END"


@query(rf"SELECT name, trim(replace(regexp_replace(x, '\(=\s*\w+\)', '', 'g'), '?', '')) AS latin, true AS was_greek FROM (SELECT name, {_latin_sql('name')} AS x FROM (SELECT DISTINCT name FROM person_contexts WHERE regexp_matches(name, '[\x{{0370}}-\x{{03FF}}\x{{1F00}}-\x{{1FFF}}]')))")
def greek_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "person_contexts").select("name").distinct().where(N.is_greek(F.col("name")))
    made = n.select("name", N.normalize_inscription_name(F.col("name")).alias("x"))
    return made.select("name", F.col("x.name").alias("latin"), F.col("x.was_greek").alias("was_greek"))


_PRAE = _case("lower(w1)", N.FORENAMES, _case("rtrim(lower(w1), '.')", N.FORENAMES))
_NAMES = rf"""(WITH t AS (SELECT k, list_filter(string_split_regex(regexp_replace(regexp_replace(k, '\(\d+\)|[?\[\]]', '', 'g'), '^[A-Z]+\d+\s+', ''), '\s+'), lambda w: w <> '') AS ws FROM ({{source}})),
p AS (SELECT k, ws[1] AS w1, ws FROM t), q AS (SELECT k, {_PRAE} AS praenomen, ws FROM p), n AS (SELECT k, praenomen, CASE WHEN praenomen IS NULL THEN ws ELSE ws[2:] END AS ws FROM q),
r AS (SELECT k, praenomen, rtrim(ws[1], '.,;') AS nomen, regexp_replace(' ' || array_to_string(ws[2:], ' '), ' [A-Z][^ .,;]?[.,;]*( [^ ]+|$)', '', 'g') AS rest FROM n),
s AS (SELECT k, praenomen, nomen, list_filter(list_transform(string_split(rest, ' '), lambda w: rtrim(w, '.,;')), lambda w: regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN ('f', 'n', 'fil', 'filius', 'nepos')) AS c FROM r)
SELECT k, praenomen, nomen, c[1] AS cognomen, nullif(array_to_string(c[2:], ' '), '') AS more FROM s)"""


@query("SELECT k AS dprr_label, praenomen, nomen, cognomen, more FROM " + _NAMES.format(source="SELECT DISTINCT dprr_label AS k FROM dprr_persons"))
def roman_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "dprr_persons").select("dprr_label").distinct()
    return n.select("dprr_label", N.parse_roman_name(F.col("dprr_label"), True).alias("x")).select("dprr_label", "x.praenomen", "x.nomen", "x.cognomen", F.array_join("x.cognomina_extra", " ").alias("more"))


_SIGNS = [
    (r"(^|\W)cos\b", "consul"), (r"(^|\W)procos\b", "proconsul"), (r"(^|\W)pr\b\.\s*($|[^q\s])", "praetor"), (r"(^|\W)tr\.\s*pl\b", "tribunus plebis"), (r"(^|\W)aed\b", "aedilis"),
    (r"(^|\W)q\.\s*(restituit|designat|pro\b|urbana)", "quaestor"), (r"\bquaestor\b", "quaestor"), (r"(^|\W)leg\b", "legatus"), (r"(^|\W)propr\b", "propraetor"),
]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{o}'" for p, o in _SIGNS) + " END AS office FROM documents WHERE text IS NOT NULL")
def offices_in_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", N.parse_office(F.col("text")).alias("office"))


@query(r"SELECT name, strip_accents(name) AS bare FROM (SELECT DISTINCT name FROM person_contexts WHERE name IS NOT NULL)")
def accents_stripped(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "person_contexts").where("name is not null").select("name").distinct()
    return n.select("name", N.strip_accents_nfkd(F.col("name")).alias("bare"))


_PLAIN = r"list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(trim(strip_accents(dprr_label))), '\([\d,.\s]*\)', '', 'g'), '[\[\]?()]', '', 'g'), '(^|[^\pL''])[\pL'']+\.\s*[fn]\.\s*', '\1', 'g'), '\s+'), lambda w: w <> '')"


@query(f"SELECT dprr_label, array_to_string(list_transform({_PLAIN}, lambda w: CASE WHEN w LIKE '%.' THEN {_case('w', N.FORENAMES, 'w')} ELSE w END), ' ') AS plain FROM (SELECT DISTINCT dprr_label FROM dprr_persons)")
def plain_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "dprr_persons").select("dprr_label").distinct()
    return n.select("dprr_label", N.plain_name(F.col("dprr_label")).alias("plain"))


@query(r"SELECT dprr_label, nullif(regexp_extract(' ' || dprr_label, '[^\pL](\p{Lu}\pL*i(?:us|a))($|[^\pL])', 1), '') AS nomen FROM (SELECT DISTINCT dprr_label FROM dprr_persons)")
def simple_nomina(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "dprr_persons").select("dprr_label").distinct()
    return n.select("dprr_label", N.simple_nomen(F.col("dprr_label")).alias("nomen"))


@query(
    r"""SELECT date_range, array_to_string(list_transform(CASE WHEN len(a) > 0 THEN a ELSE b END, lambda x: -x::INT), ',') AS years FROM (SELECT date_range, regexp_extract_all(regexp_extract(date_range, '(\d+(?:\s*-\s*\d+)?)\s*BC', 1), '\d+') AS a,
    regexp_extract_all(regexp_extract(date_range, 'c\.\s*(\d+)', 1), '\d+') AS b FROM (SELECT DISTINCT date_range FROM meta_entities WHERE date_range IS NOT NULL))"""
)
def years_before(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "meta_entities").where("date_range is not null").select("date_range").distinct()
    return r.select("date_range", F.array_join(X.bc_years(F.col("date_range")).cast("array<string>"), ",").alias("years"))


@query("SELECT DISTINCT o_orderpriority AS p, lower(trim(regexp_replace('has' || o_orderpriority, '[_-]+', ' ', 'g'))) AS words FROM orders UNION ALL SELECT DISTINCT p_brand, lower(trim(regexp_replace(regexp_replace(split_part(p_brand, '#', 2) || 'ofBrand', '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'))) FROM part")
def predicate_words(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct().select("p", X.humanise(F.concat(F.lit(NS + "x/has"), "p")).alias("words"))
    b = table(spark, d, "part").select(F.col("p_brand").alias("p")).distinct().select("p", X.humanise(F.concat(F.lit(NS), "p", F.lit("ofBrand"))).alias("words"))
    return o.unionByName(b)


@query(r"SELECT DISTINCT context_id, regexp_replace(source_uri, '/\d+$', '') AS inscription FROM person_contexts WHERE source_uri IS NOT NULL")
def inscription_uris(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "person_contexts").where("source_uri is not null").select("context_id", "source_uri").distinct()
    return c.select("context_id", X.attestation_to_inscription(F.concat("source_uri", F.lit("#ref"))).alias("inscription"))


@query("SELECT n_nationkey AS k, 'Author of ' || n_name || ' (' || (2000 + n_nationkey) || '). The ' || n_name || ' list. http://x.example/' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '. Second edition' ELSE '' END || '.' AS citation FROM nation")
def rendered_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").collect()  # a catalogue's entries, one a dataset
    entry = lambda r: "@misc{k%d,\n author = {Author of {%s}},\n title = {{The %s list}},\n year={%d}, howpublished = {\\url{http://x.example/%d}}%s\n}" % (r["n_nationkey"], r["n_name"], r["n_name"], 2000 + r["n_nationkey"], r["n_nationkey"], ",\n note = {Second edition}" if r["n_nationkey"] % 2 == 0 else "")
    return spark.createDataFrame([(r["n_nationkey"], X.bibtex_citation(entry(r))) for r in rows], "k int, citation string")


_LOW = "lower(text)"
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_LOW}, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in X.INTENTS.items()) + " ELSE 'query' END"
_TIMES = [r"\d{1,4}\s*(?:BC|BCE|AD|CE)", r"(?:early|mid|late|end of the?)\s+(?:republic|empire|principate)", r"\d+(?:st|nd|rd|th)\s+century"]
_TIME = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){t}'), '')" for t in _TIMES) + ")"
_PLACE = "CASE " + " ".join(f"WHEN contains({_LOW}, '{p.lower()}') THEN '{p}'" for p in X.PLACES) + " END"
_CLASS = f"list_filter([{', '.join(repr(c) for c in X.CONCEPTS)}], lambda c: contains({_LOW}, c))"
_SETS = f"list_sort(list_distinct(flatten(list_concat([{', '.join(f'CASE WHEN contains({_LOW}, {c!r}) THEN {s!r} ELSE [] END' for c, s in X.CONCEPTS.items())}], [CASE WHEN {_PLACE} IS NOT NULL THEN ['pleiades'] ELSE [] END]))))"
_COMMON = ", ".join(f"'{c}'" for c in X.COMMON)
_NAMED = rf"list_filter(regexp_extract_all(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1), lambda r: length(r) > 2 AND lower(r) NOT IN ({_COMMON}))"


@query(f"SELECT doc_id, {_INTENT} AS intent, {_TIME} AS temporal, {_PLACE} AS spatial, array_to_string({_CLASS}, ',') AS classes, CASE WHEN len({_SETS}) = 0 THEN 'dprr' ELSE array_to_string({_SETS}, ',') END AS datasets, CASE WHEN NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN len({_NAMED}) END AS names FROM documents WHERE text IS NOT NULL")
def question_extract(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    q = t.select("doc_id", "text", X.question_parts(F.col("text")).alias("q"))
    return q.select("doc_id", "q.intent", "q.temporal", "q.spatial", F.array_join("q.classes", ",").alias("classes"), F.array_join("q.suggested_datasets", ",").alias("datasets"), F.when(~F.col("text").rlike("[^\\x00-\\x7F]"), F.size("q.entities")).alias("names"))


@query("SELECT n_nationkey AS k, 2 AS clauses FROM nation UNION ALL SELECT 100 + r_regionkey, 0 FROM region")
def question_steps(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("Who were the people of "), "n_name", F.lit(" and which coins did they strike then?")).alias("t"))
    r = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("k"), F.concat(F.lit("Who lived in "), "r_name", F.lit("?")).alias("t"))
    return n.unionByName(r).select("k", F.size(X.clauses(F.col("t"))).alias("clauses"))


# -- URIs
_URI_ROWS = """(SELECT DISTINCT trim(x) AS u FROM (SELECT unnest(flatten(map_values(uris))) AS x FROM meta_entities WHERE uris IS NOT NULL UNION ALL
SELECT unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract_string(v, '$[*]') ELSE [json_extract_string(v, '$')] END) FROM (SELECT unnest(json_extract(uris_json, '$.*')) AS v FROM meta_entities WHERE json_valid(uris_json) AND json_type(uris_json) = 'OBJECT')) WHERE x IS NOT NULL)"""


@query(
    rf"""SELECT u, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/#?]') THEN replace(regexp_replace(lower(regexp_extract(rest, '^([^/#?]*)', 1)), '^www\.', ''), 'edh.ub.uni-heidelberg.de', 'edh-www.adw.uni-heidelberg.de') || regexp_replace(rest, '^[^/#?]*', '') END AS canonical FROM (
    SELECT u, regexp_replace(regexp_replace(replace(u, '%23', '#'), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/*(#(this|self|it))?/*$', '', 'i') AS rest FROM {_URI_ROWS})"""
)
def uri_canonical(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "meta_entities").select(F.explode(F.concat(map_uris("uris"), json_uris("uris_json"))).alias("u")).where("u is not null").select(F.trim("u").alias("u")).distinct()
    return u.select("u", canonical_uri(F.col("u")).alias("canonical"))


@query(r"SELECT wikidata_qid, regexp_extract(wikidata_qid, '(?:^|[^\pL\pN])[Qq]0*([1-9][0-9]*)(?:$|[^\pL\pN])', 1) AS number FROM (SELECT DISTINCT wikidata_qid FROM meta_entities) WHERE regexp_matches(wikidata_qid, '(?:^|[^\pL\pN])[Qq]0*([1-9][0-9]*)(?:$|[^\pL\pN])')")
def qid_numbers(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "meta_entities").select("wikidata_qid").distinct()
    return q.select("wikidata_qid", F.explode(qids("wikidata_qid")).alias("q")).select("wikidata_qid", F.substring("q", 2, 40).alias("number"))


@query("SELECT DISTINCT doc_id, u AS uri FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\\s\\)\\]\",><]+)')) AS u FROM documents) WHERE starts_with(u, 'https://edh.example/')")
def text_uris(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(X.uris_in_text(F.col("text"), ("https://edh.example/",))).alias("uri"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'dprr' WHEN 1 THEN 'nomisma' WHEN 2 THEN 'edh' END AS dataset FROM orders")
def dataset_lookup(spark: SparkSession, d: str) -> DataFrame:
    space = F.element_at(F.array(*map(F.lit, ["http://romanrepublic.ac.uk/rdf/", "http://nomisma.org/id/", "https://edh.ub.uni-heidelberg.de/edh/", "http://unknown.example/"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), X.dataset_of(F.concat(space, "o_orderkey")).alias("dataset"))


# -- sessions
@query("SELECT user_id AS session_id, event_id AS seq FROM events WHERE event_type IN ('click', 'view') AND (user_id % 3 = 0 OR user_id % 3 = 1) AND try_cast(json_extract_string(props, '$.k') AS INT) > 9 AND value > 5")
def session_feed(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views of one dataset or none, with rows (``props.k`` over nine counts as some), that somebody bookmarked."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.when(F.col("user_id") % 3 == 0, F.lit("edh")).when(F.col("user_id") % 3 == 2, F.lit("rpc")).alias("dataset"), F.to_json(F.struct(F.greatest(k - 9, F.lit(0)).alias("row_count"))).alias("data"), "value")
    return feed_filter(e, ["click", "view"], ["edh"], e.where("value > 5"), True).select("session_id", "seq")


@query("SELECT dataset, count(*) AS calls, count(*) FILTER (event_type = 'click') AS queries, sum(event_id % 100) AS chars, min(ts) AS first_at, max(ts) AS last_at, CASE dataset WHEN 'd1' THEN '3' ELSE 'unknown' END AS version, CASE dataset WHEN 'd1' THEN 'CC0' WHEN 'd2' THEN 'CC BY' ELSE 'unknown' END AS license FROM (SELECT *, CASE WHEN user_id % 4 > 0 THEN 'd' || user_id % 4 END AS dataset FROM events) GROUP BY 1")
def session_sources(spark: SparkSession, d: str) -> DataFrame:
    """What sessions used of each dataset, with what is needed to cite it."""
    e = table(spark, d, "events")
    log = e.select(F.when(F.col("event_type") == "click", "query").otherwise("search_entities").alias("tool"), F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("d"), F.col("user_id") % 4)).alias("dataset"), (F.col("event_id") % 100).alias("output_length"), F.lit(1).alias("duration_ms"), F.col("ts").alias("at"))
    catalog = spark.createDataFrame([("d1", "3", "CC0", "One."), ("d2", None, "CC BY", None)], "dataset string, version string, license string, citation string")
    return L.session_report(log, catalog).select("dataset", "calls", "queries", "chars", "first_at", "last_at", "version", "license")


# -- ranks and picks
@query(
    """SELECT p_partkey AS id, row_number() OVER (ORDER BY regexp_extract(p_brand, '[0-9]+')::INT, p_size, p_partkey) AS place FROM part"""
)
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """Brands, sizes and keys written into one text, in which 9 comes before 10."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size", F.concat(F.lit("no "), "p_partkey")).alias("t"))
    return R.with_rank0(p, [R.natural_key(F.col("t")).asc()], name="r").select("id", (F.col("r") + 1).alias("place"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS types FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2) GROUP BY 1")
def values_by_first_place(spark: SparkSession, d: str) -> DataFrame:
    made = R.grouped_values(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")
    return made.select("user_id", F.array_join("values", ",").alias("types"))


@query("SELECT p_brand AS brand, p_partkey AS id FROM part QUALIFY count(*) OVER (PARTITION BY p_brand) <= (SELECT count(*) / 25 FROM part) OR row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def limited_large_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_retailprice")
    return R.limit_large_groups(p, ["brand"], [F.col("p_retailprice").desc(), F.col("id").asc()], p.count() // 25, 3).select("brand", "id")


# -- retrieval
def _index(spark: SparkSession, d: str) -> Q.TextIndex:
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("dataset"))
    return Q.TextIndex.stored(docs, "doc_id", "text", False, ("dataset",))


@query(_BM25.format(terms="'mint', 'stone'", where="WHERE id IN (SELECT doc_id FROM documents WHERE source = 'edh')", limit=15))
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """One dataset's documents; the statistics are those of all."""
    return _index(spark, d).search("mint stone", 15, where=F.col("dataset") == "edh").select("id", F.round("score", 6).alias("score"))


@query(_BM25.format(terms="'mint', 'stone'", where="", limit=15).replace("FROM documents", "FROM (SELECT * FROM documents WHERE source IS DISTINCT FROM 'edh')"))
def search_after_clearing(spark: SparkSession, d: str) -> DataFrame:
    """The index without one dataset's documents; the statistics follow."""
    return _index(spark, d).without(F.col("dataset") == "edh").search("mint stone", 15).select("id", F.round("score", 6).alias("score"))


@query("WITH hit AS (" + _BM25.format(terms="'mint', 'stone'", where="", limit=10) + ") SELECT DISTINCT source AS dataset, 'about ' || source AS description FROM documents WHERE doc_id IN (SELECT id FROM hit) AND source IS NOT NULL UNION ALL SELECT DISTINCT source, 'about ' || source FROM documents WHERE source = 'rpc' AND false")
def dataset_discovery(spark: SparkSession, d: str) -> DataFrame:
    catalog = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("dataset")).distinct().withColumn("description", F.concat(F.lit("about "), "dataset"))
    return Q.discover(_index(spark, d), catalog, "mint stone")


@query("SELECT DISTINCT source AS dataset FROM documents WHERE source IN ('rpc', 'edh')")
def dataset_discovery_by_words(spark: SparkSession, d: str) -> DataFrame:
    """A topic that no document knows: the datasets whose description holds one of its words."""
    catalog = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("dataset")).distinct().withColumn("description", F.concat(F.lit("zq"), "dataset"))
    return Q.discover(_index(spark, d), catalog, "zqrpc zqedh").select("dataset")


_ENTITY_BM25 = _BM25.format(terms="'bronze'", where="", limit=10**9).replace("FROM documents", "FROM docs").replace("doc_id, unnest", "doc_id, unnest").strip().removeprefix("WITH ")


@query(
    "WITH docs AS (SELECT DISTINCT id AS doc_id, entity_type AS dataset, description AS text FROM meta_entities WHERE id IS NOT NULL), " + _ENTITY_BM25.replace("SELECT id, round(score, 6) AS score FROM sc", ", hits AS (SELECT dataset, id, score FROM sc JOIN docs ON doc_id = id").replace("ORDER BY sc.score DESC, id LIMIT 1000000000", "")
    + """), top AS (SELECT *, max(score) OVER (PARTITION BY dataset) AS best FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, id) <= 10)),
    named AS (SELECT DISTINCT entity_type AS dataset, id FROM meta_entities WHERE contains(lower(canonical_name), 'bronze'))
    SELECT dataset, id, round(score, 6) AS score FROM top WHERE score >= 0.3 * best UNION ALL SELECT dataset, id, 0.0 FROM named WHERE id NOT IN (SELECT id FROM top WHERE score >= 0.3 * best)"""
)
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meta_entities").where("id is not null").select("id", F.col("entity_type").alias("dataset"), F.col("description").alias("text"), F.col("canonical_name").alias("name")).distinct()
    index = Q.TextIndex.stored(m.select("id", "dataset", "text"), "id", "text", False, ("dataset",))
    return Q.search_entities(index, m.select("dataset", "id", "name"), "bronze").select("dataset", "id", F.round("score", 6).alias("score"))


@query("SELECT md5(string_agg(source || '|1|' || n, chr(10) ORDER BY source || '|1|' || n)) AS fingerprint FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)")
def index_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("triple_count")).withColumn("version", F.lit("1"))
    return spark.createDataFrame([(Q.fingerprint(c),)], "fingerprint string")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\pL\pN]') THEN 1.0 ELSE 0.0 END AS norm, true AS same FROM documents")
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hashed n-gram vectors: of length one, or zero without a word, and the same for the same text in other case."""
    v = table(spark, d, "documents").select("doc_id", Q.embed_text(F.col("text"), 64).alias("v"), Q.embed_text(F.lower(F.col("text")), 64).alias("w"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return v.select("doc_id", F.round(norm, 3).alias("norm"), (F.col("v") == F.col("w")).alias("same"))


_BUILT = """(SELECT 'dataset' AS doc_type, 'All of it' AS text UNION ALL SELECT 'example', 'Who is in ' || n_name || '?' FROM nation UNION ALL SELECT 'tip', r_name || '. Mind it.' FROM region UNION ALL SELECT 'schema_label', r_name FROM region
UNION ALL SELECT 'schema_comment', r_name || ': a part' FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'entity_label', s_name FROM supplier UNION ALL SELECT 'skos_concept', label FROM places_ UNION ALL
SELECT 'skos_vocab', province || ': ' || string_agg(label, ', ' ORDER BY label) FROM (SELECT province, label, (row_number() OVER (PARTITION BY province ORDER BY label) - 1) // 7 AS c FROM places_) GROUP BY province, c)"""
_BUILT = _BUILT.replace("places_", "(SELECT DISTINCT province, label, place_uri FROM places WHERE label IS NOT NULL AND province IS NOT NULL)")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    concepts = table(spark, d, "places").where("label is not null and province is not null").select(F.col("province").alias("scheme"), "label", "place_uri").distinct().select("scheme", "label")
    schema = r.select(F.col("r_name").alias("class"), F.when(F.col("r_regionkey") % 2 == 0, "a part").alias("comment"))
    return Q.build_documents("d", "All of it", n.select(F.concat(F.lit("Who is in "), "n_name", F.lit("?")).alias("question")), r.select(F.col("r_name").alias("title"), F.lit("Mind it.").alias("body")), schema, table(spark, d, "supplier").select(F.col("s_name").alias("label")), concepts, 7)


@query(f"SELECT doc_type, text FROM {_BUILT} WHERE text IS NOT NULL AND text <> ''")
def built_documents(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_type", "text")


@query(f"SELECT doc_type, count(*) AS n FROM {_BUILT} WHERE doc_type IN ('dataset', 'example', 'tip', 'schema_label', 'schema_comment', 'shex_shape') AND text IS NOT NULL GROUP BY 1")
def embeddable_documents(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where(F.col("doc_type").isin(*Q.EMBEDDED_TYPES)).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


_OKV = "(SELECT DISTINCT doc_id, vec FROM doc_vectors WHERE len(vec) = 128 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"
_DOT = "list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]) / (sqrt(list_dot_product(a.vec::DOUBLE[], a.vec::DOUBLE[])) * sqrt(list_dot_product(b.vec::DOUBLE[], b.vec::DOUBLE[])))"


@query(
    _BM25.format(terms="'harbour', 'mint'", where="", limit=30).replace("SELECT id, round(score, 6) AS score FROM sc", ", t AS (SELECT id, score FROM sc").rstrip()
    + f"), v AS (SELECT b.doc_id AS id, 1 - {_DOT} AS dist FROM (SELECT * FROM {_OKV} ORDER BY doc_id LIMIT 1) a, {_OKV} b ORDER BY dist, id LIMIT 30), "
    "r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS n FROM t UNION ALL SELECT id, row_number() OVER (ORDER BY dist, id) - 1 FROM v) SELECT id, round(sum(1 / (60.0 + n)), 9) AS score FROM r GROUP BY id ORDER BY sum(1 / (60.0 + n)) DESC, id LIMIT 10"
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Text and vectors of the same documents; the query's vector is that of the first document that has one."""
    v = table(spark, d, "doc_vectors").where("size(vec) = 128 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)").distinct()
    found = Q.hybrid(_index(spark, d), v, "harbour mint", list(v.orderBy("doc_id").first()["vec"]), 10, ident="doc_id", vec="vec")
    return found.select("id", F.round("score", 9).alias("score"))


# -- resolution
_FIRST = "SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {o}) = 1"
_FATHERS = _case("regexp_extract(filiation, '^(\\S+) f\\.', 1)", {k: v for k, v in N.FORENAMES.items()}).replace("CASE regexp_extract", "CASE lower(regexp_extract").replace("f\\.', 1)", "f\\.', 1))")
_AGES = " ".join(f"WHEN '{o}' THEN {a}" for o, a in E.LEAST_AGE.items())
_OFFICE = "CASE " + " ".join(f"WHEN regexp_matches(office, '(?i){p}') THEN '{o}'" for p, o in _SIGNS) + f" ELSE {_case('lower(trim(office))', {o: o for o in N.OFFICE_ABBREVIATIONS.values()})} END"


@query(
    f"""WITH c AS (SELECT DISTINCT context_id, lower(nomen) AS n, {_FATHERS} AS f, {_OFFICE} AS o, date_start AS a, date_end AS b, findspot_uri AS place FROM person_contexts WHERE nomen IS NOT NULL),
    p AS (SELECT DISTINCT dprr_uri AS person, lower(nomen) AS n, era_from AS lo, era_to AS hi, {_FATHERS} AS kf FROM dprr_persons),
    q AS (SELECT DISTINCT post_id, dprr_uri AS person, lower(office) AS office, date_start, province_uri FROM post_assertions), had AS (SELECT person, count(*) AS n FROM q WHERE person IS NOT NULL GROUP BY 1),
    x AS (SELECT *, a - lo AS age, CASE o {_AGES} ELSE 25 END AS least_age FROM c JOIN p USING (n)),
    h AS (SELECT context_id, x.person, count(*) AS held, min(struct_pack(gap := abs(coalesce(date_start, 0) - a), at := date_start)) AS near FROM x JOIN q ON q.person = x.person AND contains(q.office, x.o) GROUP BY 1, 2),
    y AS (SELECT x.*, coalesce(h.held, 0) AS held, h.near, coalesce(had.n, 0) AS posts, (SELECT count(*) FROM q WHERE q.person = x.person AND province_uri IS NOT NULL) AS provinces, (SELECT count(*) FROM q WHERE q.person = x.person AND province_uri = x.place) AS served FROM x LEFT JOIN h USING (context_id, person) LEFT JOIN had USING (person)),
    s AS (SELECT context_id, person,
      CASE WHEN f IS NULL OR kf IS NULL THEN NULL WHEN f <> kf THEN 0.0 ELSE 0.5 END AS s1,
      CASE WHEN o IS NULL THEN NULL WHEN age < 0 OR age < least_age OR age > 80 THEN 0.0 WHEN held = 0 AND posts > 0 THEN 0.3 WHEN held = 0 THEN 0.0 WHEN a IS NULL OR near.at IS NULL THEN 0.5 WHEN near.gap <= 5 THEN 1.0 WHEN near.gap <= 10 THEN 0.7 WHEN near.gap <= 20 THEN 0.5 ELSE 0.3 END AS s2,
      CASE WHEN place IS NULL OR provinces = 0 THEN NULL WHEN served > 0 THEN 1.0 ELSE 0.0 END AS s3,
      CASE WHEN lo IS NULL AND hi IS NULL THEN NULL WHEN coalesce((a + b) / 2.0, a, b) IS NULL THEN NULL WHEN coalesce((a + b) / 2.0, a, b) BETWEEN coalesce(lo, -500) AND coalesce(hi, 100) THEN 1.0
        WHEN NOT (b < coalesce(lo, -500) OR a > coalesce(hi, 100)) THEN 0.5 ELSE 0.0 END AS s4 FROM y),
    t AS (SELECT context_id, person, 0.4 * coalesce(s1, 0) + 0.3 * coalesce(s2, 0) + 0.2 * coalesce(s3, 0) + 0.1 * coalesce(s4, 0) AS score FROM s)
    SELECT context_id, round(score, 6) AS score, count(*) AS candidates FROM (SELECT *, max(score) OVER (PARTITION BY context_id) AS best FROM t) WHERE round(score, 9) = round(best, 9) GROUP BY 1, 2"""
)
def disambiguated_people(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each context and how many persons reach it."""
    c = table(spark, d, "person_contexts").select("context_id", "nomen", "filiation", "office", "date_start", "date_end", F.col("findspot_uri").alias("findspot")).distinct()
    persons = table(spark, d, "dprr_persons").distinct()
    p = persons.select(F.col("dprr_uri").alias("person"), F.col("dprr_label").alias("label"), "nomen", "era_from", "era_to")
    posts = table(spark, d, "post_assertions").distinct()
    kin = N.parse_filiation(F.col("filiation"))
    family = persons.select(F.col("dprr_uri").alias("person"), kin["father"].alias("father"), kin["grandfather"].alias("grandfather"))
    out = E.disambiguate(c, p, posts.select(F.col("dprr_uri").alias("person"), "office", "date_start"), family, posts.where("province_uri is not null").select(F.col("dprr_uri").alias("person"), F.col("province_uri").alias("place")), None)
    best = out.groupBy("context_id").agg(F.max("score").alias("best"))
    return out.join(best, "context_id").where(F.round("score", 9) == F.round("best", 9)).groupBy("context_id", F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("candidates"))


@query("SELECT c.context_id, praenomen, nomen, cognomen, office, date FROM (SELECT DISTINCT context_id, name, " + _OFFICE + " AS office, date_start AS date FROM (SELECT context_id, name, office, date_start FROM person_contexts WHERE NOT regexp_matches(name, '[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]') AND NOT regexp_matches(name, '^[A-Z]+\\d'))) c LEFT JOIN " + _NAMES.format(source="SELECT DISTINCT name AS k FROM person_contexts") + " n ON n.k = c.name")
def contexts_from_fields(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "person_contexts").where(~N.is_greek(F.col("name")) & ~F.col("name").rlike(r"^[A-Z]+\d"))
    made = E.context_from_fields(c.select("context_id", "name", "filiation", "office", F.col("date_start").alias("date"), F.col("findspot_uri").alias("province")).distinct())
    return made.select("context_id", "praenomen", "nomen", "cognomen", "office", F.col("date_start").alias("date"))


@query(
    r"""WITH c AS (SELECT DISTINCT context_id, name, regexp_replace(source_uri, '/\d+$', '') AS i FROM person_contexts WHERE source_uri IS NOT NULL), first AS (SELECT context_id, min(struct_pack(n := name, i := i)) AS x FROM c WHERE name IS NOT NULL GROUP BY 1),
    e AS (SELECT DISTINCT regexp_replace(source_uri, '/\d+$', '') AS i FROM person_contexts WHERE source_uri IS NOT NULL) SELECT context_id, x.n AS name, 'consul' AS office, length(x.i) AS date_start, NULL AS date_end, 'M. f. ' || x.i || ' cos.' AS filiation FROM first JOIN e ON e.i = x.i"""
)
def contexts_from_inscriptions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "person_contexts").where("source_uri is not null and name is not null")
    persons = c.select("context_id", "name", F.concat("source_uri", F.lit("#ref")).alias("attestation")).distinct()
    i = F.regexp_replace("source_uri", r"/\d+$", "")
    inscriptions = c.select(i.alias("inscription"), F.concat(F.lit("M. f. "), i, F.lit(" cos.")).alias("text"), F.char_length(i).cast("string").alias("start"), F.lit("unknown").alias("end"), F.lit(None).cast("string").alias("findspot")).distinct()
    return E.context_from_inscriptions(persons, inscriptions).select("context_id", "name", "office", "date_start", "date_end", "filiation")


_MATCHES = """WITH l AS (SELECT DISTINCT context_id AS id, lower(praenomen) AS p, lower(cognomen) AS c, lower(nomen) AS n FROM person_contexts WHERE length(nomen) > 2), k AS (SELECT *, n AS key FROM l UNION SELECT *, n[:-2] || 'us' FROM l WHERE n LIKE '%ia'),
r AS (SELECT DISTINCT dprr_uri AS rid, lower(praenomen) AS rp, lower(cognomen) AS rc, lower(nomen) AS key FROM dprr_persons),
s AS (SELECT id, rid, 1 + CASE WHEN p IS NULL OR rp IS NULL THEN 0 WHEN p = rp THEN 2 WHEN c = rc THEN 0 END + CASE WHEN c IS NULL OR rc IS NULL THEN 0 WHEN c = rc THEN 2 WHEN contains(c, rc) OR contains(rc, c) THEN 1 END AS score FROM k JOIN r USING (key)),
m AS (SELECT id AS l_id, rid AS r_id, max(score) AS score FROM s WHERE score >= {least} GROUP BY 1, 2) """


def _matched(spark: SparkSession, d: str, least: int) -> DataFrame:
    l = table(spark, d, "person_contexts").select(F.col("context_id").alias("id"), "praenomen", "nomen", "cognomen").distinct()  # noqa: E741
    r = table(spark, d, "dprr_persons").select(F.col("dprr_uri").alias("id"), "praenomen", "nomen", "cognomen").distinct()
    return E.match_names(l, r, least, strict_praenomen=False)


@query(_MATCHES.format(least=3) + "SELECT l_id, r_id, score FROM m")
def tolerant_name_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, 3)


@query(_MATCHES.format(least=5) + "SELECT l_id, r_id FROM m QUALIFY count(*) OVER (PARTITION BY l_id) = 1 AND count(*) OVER (PARTITION BY r_id) = 1")
def unambiguous_matches(spark: SparkSession, d: str) -> DataFrame:
    return E.split_unambiguous(_matched(spark, d, 5), "l_id", "r_id")[0].select("l_id", "r_id")


@query(
    """WITH c AS (SELECT DISTINCT context_id AS k, date_start AS t, nomen FROM person_contexts WHERE date_start IS NOT NULL AND nomen IS NOT NULL), p AS (SELECT DISTINCT dprr_uri AS id, nomen, coalesce(era_from, era_to) AS lo, coalesce(era_to, era_from) AS hi FROM dprr_persons WHERE coalesce(era_from, era_to) IS NOT NULL),
    d AS (SELECT k, id, CASE WHEN t BETWEEN lo AND hi THEN 0 ELSE least(abs(t - lo), abs(t - hi)) END AS distance FROM c JOIN p USING (nomen)), r AS (SELECT *, row_number() OVER w AS n, lead(distance) OVER w AS second FROM d WINDOW w AS (PARTITION BY k ORDER BY distance, id)),
    b AS (SELECT * FROM r WHERE n = 1 AND CASE WHEN second IS NULL THEN distance <= 50 ELSE second - distance >= 10 END) SELECT k, id, distance FROM b QUALIFY count(*) OVER (PARTITION BY id) = 1"""
)
def margin_disambiguation_wide(spark: SparkSession, d: str) -> DataFrame:
    """The other variant: any distance, but ten years ahead of the second."""
    c = table(spark, d, "person_contexts").where("date_start is not null and nomen is not null").select(F.col("context_id").alias("k"), F.col("date_start").alias("t"), "nomen").distinct()
    p = table(spark, d, "dprr_persons").select(F.col("dprr_uri").alias("id"), "nomen", "era_from", "era_to").distinct()
    return E.disambiguate_by_date(c.join(p, "nomen"), "k", "id", "t", "era_from", "era_to", most=10**6, margin=10).select("k", "id", "distance")


_ERA = "CASE WHEN era_from IS NULL AND era_to IS NULL THEN NULL ELSE coalesce(CASE WHEN era_from < 0 THEN abs(era_from) || ' BC' ELSE era_from || ' AD' END, '?') || '–' || coalesce(CASE WHEN era_to < 0 THEN abs(era_to) || ' BC' ELSE era_to || ' AD' END, '?') END"


@query(f"WITH o AS (SELECT dprr_uri, list_sort(list(DISTINCT office)) AS os FROM post_assertions WHERE office IS NOT NULL AND dprr_uri IS NOT NULL GROUP BY 1) SELECT dprr_uri, concat_ws('. ', dprr_label, nullif(array_to_string(os[:5], ', '), ''), {_ERA}) AS text FROM (SELECT DISTINCT dprr_uri, dprr_label, era_from, era_to FROM dprr_persons) LEFT JOIN o USING (dprr_uri)")
def person_texts(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "post_assertions").where("dprr_uri is not null").groupBy("dprr_uri").agg(F.collect_set("office").alias("os"))  # the offices of one person
    p = table(spark, d, "dprr_persons").select("dprr_uri", "dprr_label", "era_from", "era_to").distinct().join(posts, "dprr_uri", "left")
    return p.select("dprr_uri", E.person_text(F.col("dprr_label"), F.col("os"), F.col("era_from"), F.col("era_to")).alias("text"))


@query(_MATCHES.format(least=3) + "SELECT l_id AS left_id, r_id AS right_id, lower(n) IS DISTINCT FROM key AS new FROM m JOIN l ON l.id = l_id JOIN r ON r.rid = r_id WHERE NOT EXISTS (SELECT 1 FROM candidate_matches x WHERE x.context_id = l_id AND x.dprr_uri = r_id)")
def new_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches by name that no scored candidate holds, and whether the nomina differ."""
    l = table(spark, d, "person_contexts").where("length(nomen) > 2").select(F.col("context_id").alias("l_id"), F.lower("praenomen"), F.lower("cognomen"), F.lower("nomen").alias("left_nomen")).distinct().select("l_id", "left_nomen")  # noqa: E741
    r = table(spark, d, "dprr_persons").select(F.col("dprr_uri").alias("r_id"), F.col("nomen").alias("right_nomen"), "praenomen", "cognomen").distinct().select("r_id", "right_nomen")
    m = _matched(spark, d, 3).join(l, "l_id").join(r, "r_id").select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "left_nomen", "right_nomen")
    known = table(spark, d, "candidate_matches").select(F.col("context_id").alias("left_id"), F.col("dprr_uri").alias("right_id"))
    return E.flag_matches(m, known).select("left_id", "right_id", "new")


@query(
    "WITH p AS (SELECT p_partkey AS k, p_partkey // 3 AS up, ['gaius', 'lucius', 'marcus', NULL][p_partkey % 4 + 1] AS n FROM part) SELECT a.k AS person, b.n AS father, c.n AS grandfather FROM p a JOIN p b ON b.k = a.up AND a.up > 0 LEFT JOIN p c ON c.k = b.up AND b.up > 0"
)
def family_forenames(spark: SparkSession, d: str) -> DataFrame:
    """Forenames over two hops; the second may be missing."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("person"), F.element_at(F.array(F.lit("C."), F.lit("L."), F.lit("M."), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("praenomen"))
    parents = t.select(F.col("person").alias("child"), F.floor(F.col("person") / 3).alias("parent")).where("parent > 0")
    return E.family_forenames(t, parents)


@query("SELECT DISTINCT dprr_uri AS person, 'https://pleiades.stoa.org/places/' || length(label) AS place FROM post_assertions JOIN (SELECT DISTINCT place_uri, label FROM places) ON place_uri = province_uri WHERE label IS NOT NULL AND dprr_uri IS NOT NULL AND length(label) % 2 = 0")
def provinces_served(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "post_assertions").select(F.col("dprr_uri").alias("person"), F.col("province_uri").alias("province"))
    place = F.concat(F.when(F.char_length("label") % 2 == 0, "https://pleiades.stoa.org/places/").otherwise("http://elsewhere.example/"), F.char_length("label"))
    links = table(spark, d, "places").where("label is not null").select(F.col("place_uri").alias("source"), place.alias("target")).distinct()
    return E.provinces_served(posts, links)


# -- links of entities
@query(
    """WITH l AS (SELECT 'http://nomisma.org/id/c' || o_custkey AS s, 'http://nomisma.org/id/o' || o_orderkey AS t, o_orderstatus AS c FROM orders WHERE o_orderkey % 2 = 0), k AS (SELECT 'http://nomisma.org/id/c' || o_custkey AS s, 'http://nomisma.org/id/o' || o_orderkey AS t FROM orders WHERE o_orderkey % 3 = 0),
    u AS (SELECT 'http://nomisma.org/id/c' || c_custkey AS u FROM customer WHERE c_acctbal > 8000), own AS (SELECT u AS uri, t AS target, c AS confidence FROM l JOIN u ON u = s) SELECT * FROM own UNION ALL SELECT u, t, 'concordance' FROM k JOIN u ON u = s WHERE (u, t) NOT IN (SELECT uri, target FROM own)"""
)
def links_with_concordances(spark: SparkSession, d: str) -> DataFrame:
    from quern.catalog import _links

    links = _links(spark, d)
    number = F.regexp_extract("target", r"(\d+)$", 1).cast("long")
    con = links.where(number % 3 == 0).select(F.col("source").alias("s"), F.col("target").alias("o"), F.lit(SKOS + "closeMatch").alias("p"))
    uris = table(spark, d, "customer").where("c_acctbal > 8000").select(F.concat(F.lit("http://nomisma.org/id/c"), "c_custkey").alias("uri"))
    return L.find_links(uris, links.where(number % 2 == 0), con).select("uri", "target", "confidence")


_SAME = f"(SELECT 'n:s' || s_suppkey AS s, CASE s_suppkey % 3 WHEN 0 THEN '{SKOS}closeMatch' WHEN 1 THEN '{OWL}sameAs' ELSE '{NS}other' END AS p, 'n:n' || s_nationkey AS o FROM supplier)"


@query(f"SELECT s AS uri, o AS target, p AS property FROM {_SAME} WHERE p NOT LIKE '%other' UNION SELECT o, s, p FROM {_SAME} WHERE p NOT LIKE '%other'")
def cross_references(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier")
    p = F.element_at(F.array(F.lit(SKOS + "closeMatch"), F.lit(OWL + "sameAs"), F.lit(NS + "other")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    q = t.select(F.concat(F.lit("n:s"), "s_suppkey").alias("s"), p.alias("p"), F.concat(F.lit("n:n"), "s_nationkey").alias("o"), F.lit("iri").alias("o_kind"))
    return L.cross_references(q, q.select(F.explode(F.array("s", "o")).alias("uri")))


@query("WITH m AS (SELECT DISTINCT s_nationkey AS cluster, 'n:' || s_suppkey AS uri FROM supplier), a AS (SELECT uri, 'http://www.wikidata.org/entity/Q' || (1 + s_suppkey % 7) AS auth, 1 + s_suppkey % 7 AS q FROM m JOIN supplier ON uri = 'n:' || s_suppkey WHERE s_suppkey % 2 = 0), h AS (SELECT 'c:' || c_custkey AS uri, 1 + c_custkey % 9 AS q FROM customer), f AS (SELECT cluster, auth, q FROM m JOIN a USING (uri)) SELECT cluster, uri FROM m UNION SELECT cluster, auth FROM f UNION SELECT cluster, uri FROM (SELECT DISTINCT cluster, q, h.uri FROM f JOIN h USING (q)) QUALIFY row_number() OVER (PARTITION BY cluster, q ORDER BY uri) <= 3")
def extended_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with the authorities their members match, and what other sources say is the same as these, written another way."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    members = s.select(F.col("s_nationkey").alias("cluster"), F.concat(F.lit("n:"), "s_suppkey").alias("uri"))
    authorities = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("n:"), "s_suppkey").alias("uri"), F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("s_suppkey") % 7 + 1).alias("authority"))
    holders = c.select(F.concat(F.lit("https://www.wikidata.org/wiki/Q"), F.col("c_custkey") % 9 + 1).alias("authority"), F.concat(F.lit("c:"), "c_custkey").alias("uri"))
    return L.extend_clusters(members, authorities, holders, 3)


@query(
    """WITH t AS (SELECT DISTINCT dprr_uri AS id, 'a' AS source, 1 AS place, 'Name' AS label, nomen AS text FROM dprr_persons UNION SELECT dprr_uri, 'a', 2, 'Era', era_from::VARCHAR FROM dprr_persons UNION SELECT dprr_uri, 'b', 1, NULL, dprr_label FROM dprr_persons),
    m AS (SELECT id, source, string_agg(coalesce(label || ': ', '') || text, '. ' ORDER BY place) AS d FROM t WHERE text IS NOT NULL GROUP BY 1, 2) SELECT id, d AS description FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(d) DESC, d) = 1"""
)
def entity_descriptions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "dprr_persons").distinct()
    cell = lambda source, place, label, c: F.struct(F.lit(source).alias("source"), F.lit(place).alias("place"), F.lit(label).cast("string").alias("label"), F.col(c).cast("string").alias("text"))
    parts = p.select(F.col("dprr_uri").alias("id"), F.explode(F.array(cell("a", 1, "Name", "nomen"), cell("a", 2, "Era", "era_from"), cell("b", 1, None, "dprr_label"))).alias("c")).select("id", "c.*")
    return L.describe_entities(parts)


_OWN = "(SELECT DISTINCT place_uri, label, province FROM places)"


@query(f"SELECT replace(place_uri, 'https://', 'http://www.') AS uri, coalesce(label, regexp_extract(place_uri, '([^/]*)$', 1)) AS name, 'In ' || province AS description, 'Place' AS types, 'http://x.example/' || length(label) AS see_also, CASE WHEN label IS NULL THEN 0 ELSE 2 END AS labels FROM {_OWN}")
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Places asked for under another scheme and host spelling: name, description, types, links, and how many labels are shown."""
    p = table(spark, d, "places").select("place_uri", "label", "province").distinct()
    cell = lambda pred, o, kind="lit", lang=None: F.struct(F.lit(pred).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"))
    cells = F.array(
        cell(TYPE, F.lit(NS + "Place"), "iri"), cell(TYPE, F.lit(OWL + "Thing"), "iri"), cell(RDFS + "label", F.col("label"), lang="en"), cell(RDFS + "label", F.lower("label"), lang="de"), cell(SKOS + "prefLabel", F.upper("label")),
        cell(RDFS + "comment", F.concat(F.lit("In "), "province")), cell(RDFS + "seeAlso", F.concat(F.lit("http://x.example/"), F.char_length("label")), "iri"),
    )
    quads = p.select(F.col("place_uri").alias("s"), F.explode(cells).alias("c")).select("s", "c.*").where("o is not null")
    got = L.resolve_entities(quads, p.select(F.regexp_replace("place_uri", "^https://", "http://www.").alias("uri")))
    shown = lambda k: F.coalesce(F.size(F.try_element_at("properties", F.lit(k))), F.lit(0))
    size = lambda k: F.when(shown(k) > 0, shown(k)).otherwise(0)
    return got.select("uri", "name", "description", F.array_join("types", ",").alias("types"), F.nullif(F.array_join("see_also", ","), F.lit("")).alias("see_also"), (size(RDFS + "label") + size(SKOS + "prefLabel")).alias("labels"))


@query(f"SELECT 'q:' || r_regionkey AS property, r_name AS label, CASE WHEN r_regionkey % 2 = 0 THEN 'Thing' END AS domain FROM region UNION ALL SELECT 'q:none', NULL, NULL")
def property_metadata(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("q:"), "r_regionkey").alias("s"), "r_name", "r_regionkey")
    q = r.select("s", F.lit(RDFS + "label").alias("p"), F.col("r_name").alias("o")).unionByName(r.where("r_regionkey % 2 = 0").select("s", F.lit(RDFS + "domain").alias("p"), F.lit(NS + "Thing").alias("o")))
    asked = r.select(F.col("s").alias("property")).unionByName(spark.createDataFrame([("q:none",)], "property string"))
    return L.property_metadata(q, asked).select("property", "label", "domain")


@query("SELECT 'n:' || l_partkey AS part, min(s_name) AS supplier FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 40 GROUP BY 1")
def labels_of_another_source(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one source, their suppliers' labels from another: one label each, by language first."""
    s = table(spark, d, "supplier")
    null = F.lit(None).cast("string")
    cell = lambda o, lang: F.struct(o.alias("o"), F.lit(lang).alias("o_lang"))
    other = s.select(F.concat(F.lit("n:s"), "s_suppkey").alias("s"), F.explode(F.array(cell(F.concat(F.lit("A "), "s_name"), "de"), cell(F.col("s_name"), "en"))).alias("c")).select(null.alias("g"), "s", F.lit(RDFS + "label").alias("p"), "c.o", F.lit("lit").alias("o_kind"), "c.o_lang")
    issued = table(spark, d, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("n:"), "l_partkey").alias("part"), F.concat(F.lit("n:s"), "l_suppkey").alias("s"))
    named = issued.join(P.labels(other), "s")
    return named.groupBy("part").agg(F.min("label").alias("supplier"))


@query("SELECT DISTINCT id, lower(h) AS host FROM (SELECT id, regexp_extract(replace(trim(x), '%23', '#'), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[Ww][Ww][Ww]\\.)?([^/#?]+)', 1) AS h FROM (SELECT id, unnest(flatten(map_values(uris))) AS x FROM meta_entities WHERE uris IS NOT NULL)) WHERE h <> ''")
def entity_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The entity records that hold a URI, by its canonical host."""
    m = table(spark, d, "meta_entities").where("uris is not null").select("id", "uris")
    asked = m.select(F.explode(map_uris("uris")).alias("uri")).where("uri is not null").distinct()
    held = L.entities_of(asked, m)
    return held.select("id", F.split_part(canonical_uri(F.col("uri")), F.lit("/"), F.lit(1)).alias("host")).where("host is not null").distinct()


