"""Queries over files: what the tables say is written in each format and read back, beside the SQL over the tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.catalog import _P, _TRIPLES, NS, _mapped_quads, lines_graph, query, table
from quern.functions import text as X
from quern.operators import linkage as L
from quern.operators import profile as P
from quern.plans.syntax import RDFS, SKOS, TYPE, XSD
from quern.runtime import scratch
from quern.sources import links as K
from quern.sources import rdf
from quern.sources.sessions import broken_lines, read_sessions, session_summary
from quern.streaming import deduplicated, read_feed, resolve_new_uris

_HEAD = f"@prefix q: <{NS}> .\n@prefix rdfs: <{RDFS}> .\n@prefix xsd: <{XSD}> .\n"


def _written(df: DataFrame, text: Column, each: bool = False) -> str:
    """A folder with the texts of a column: in a file for each row, or together."""
    path = scratch(df.sparkSession)
    (df.select(text.alias("value")).write.option("maxRecordsPerFile", 1 if each else 0)).text(path)
    return path


def _local(path: str) -> Path:
    return Path(path.removeprefix("file:"))


def _esc(c: str) -> Column:
    return F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


# -- Turtle, RDF/XML, JSON-LD, N-Quads
def _turtle(spark: SparkSession, d: str) -> str:
    """Suppliers in Turtle, a file for each nation: lists of objects, abbreviated types, numbers, comments."""
    t = table(spark, d, "supplier")
    line = F.concat(F.lit("<urn:s"), "s_suppkey", F.lit('> a q:Supplier ; # a comment\n  q:name "'), _esc("s_name"), F.lit('"@en , "'), F.upper(_esc("s_name")), F.lit('" ; q:nation <urn:n'), "s_nationkey", F.lit("> ; q:no "), "s_suppkey", F.lit(" ."))
    files = t.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))  # the suppliers of a nation
    return _written(files, F.concat(F.lit(_HEAD), "body"), True)


_SUPPLIERS = f"""SELECT 'urn:s' || s_suppkey AS s, unnest(['{TYPE}', '{NS}name', '{NS}name', '{NS}nation', '{NS}no']) AS p, unnest(['{NS}Supplier', s_name, upper(s_name), 'urn:n' || s_nationkey, s_suppkey::VARCHAR]) AS o,
unnest(['iri', 'lit', 'lit', 'iri', 'lit']) AS o_kind, unnest([NULL, 'en', NULL, NULL, NULL]) AS o_lang FROM supplier"""


@query(_SUPPLIERS)
def turtle_files(spark: SparkSession, d: str) -> DataFrame:
    return rdf.load(spark, _turtle(spark, d)).select("s", "p", "o", "o_kind", "o_lang")


def _xml(spark: SparkSession, d: str) -> str:
    node = F.concat(F.lit('<q:Supplier rdf:about="urn:s'), "s_suppkey", F.lit('"><q:name xml:lang="en">'), "s_name", F.lit("</q:name><q:name>"), F.upper("s_name"), F.lit('</q:name><q:nation rdf:resource="urn:n'), "s_nationkey", F.lit(f'"/><q:no rdf:datatype="{XSD}integer">'), "s_suppkey", F.lit("</q:no></q:Supplier>"))
    files = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(node)), "").alias("body"))
    head = f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:q="{NS}">'
    return _written(files, F.concat(F.lit(head), "body", F.lit("</rdf:RDF>")), True)


@query(_SUPPLIERS)
def rdfxml_files(spark: SparkSession, d: str) -> DataFrame:
    return rdf.load(spark, _xml(spark, d)).select("s", "p", "o", "o_kind", "o_lang")


@query(_SUPPLIERS)
def jsonld_files(spark: SparkSession, d: str) -> DataFrame:
    context = {"q": NS, "nation": {"@id": "q:nation", "@type": "@id"}, "name": "q:name", "no": "q:no", "label": {"@id": "q:name", "@language": "en"}}
    node = F.struct(F.concat(F.lit("urn:s"), "s_suppkey").alias("@id"), F.lit("q:Supplier").alias("@type"), F.upper("s_name").alias("name"), F.col("s_name").alias("label"), F.concat(F.lit("urn:n"), "s_nationkey").alias("nation"), F.col("s_suppkey").alias("no"))
    files = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(node)).alias("body"))
    path = _written(files, F.concat(F.lit(f'{{"@context": {json.dumps(context)}, "@graph": '), "body", F.lit("}")), True)
    rows = spark.read.format("binaryFile").load(path)
    from quern.sources.graphs import QUADS

    import pandas as pd

    def parse(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(rdf.parse_jsonld(bytes(content).decode(), name), columns=[f.name for f in QUADS.fields])

    return rows.select("path", "content").mapInPandas(parse, QUADS).distinct().select("s", "p", "o", "o_kind", "o_lang")


@query("SELECT kind, count(*) AS files FROM (SELECT DISTINCT s_nationkey, unnest(['turtle', 'rdfxml']) AS kind FROM supplier) GROUP BY kind")
def format_sniffing(spark: SparkSession, d: str) -> DataFrame:
    a, b = rdf.file_kinds(spark, _turtle(spark, d)), rdf.file_kinds(spark, _xml(spark, d))
    return a.unionByName(b).where(~F.col("file").startswith("_")).groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


@query(f"SELECT g, dprr_uri AS s, p, o FROM (SELECT dprr_uri, unnest(['{NS}nomen', '{NS}office']) AS p, unnest([nomen, highest_office]) AS o, unnest([NULL, '{NS}office/' || replace(highest_office, ' ', '_')]) AS g FROM {_P}) WHERE o IS NOT NULL")
def nquads_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    rdf.write_lines(lines_graph(spark, d), path)
    return rdf.load(spark, path, "lines").where(F.col("p").isin(NS + "nomen", NS + "office")).select("g", "s", "p", "o")


@query(f"SELECT 'urn:s' || s_suppkey AS s, c AS o FROM supplier, (SELECT unnest(['{NS}Supplier', '{NS}Agent']) AS c)")
def dataset_load(spark: SparkSession, d: str) -> DataFrame:
    """Data files, a sidecar that is passed over, the dataset's ontology, and what follows from it."""
    folder = _turtle(spark, d)
    _local(f"{folder}/_ontology.ttl").write_text(f"<{NS}Supplier> <{RDFS}subClassOf> <{NS}Agent> .", encoding="utf-8")
    _local(f"{folder}/_notes.ttl").write_text("this is no Turtle", encoding="utf-8")
    return rdf.load_dataset(spark, folder).where(F.col("p") == TYPE).select("s", "o")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 2 END AS triples, n_nationkey % 5 = 0 AS failed FROM nation")
def verified_files(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth file is broken."""
    t = table(spark, d, "nation")
    text = F.concat(F.lit(_HEAD), F.lit("<urn:n"), "n_nationkey", F.lit('> q:name "'), "n_name", F.when(F.col("n_nationkey") % 5 == 0, F.lit(" ;")).otherwise(F.lit('" ; q:no ')), "n_nationkey", F.lit(" ."))
    got = rdf.verify(spark, _written(t.withColumn("n_name", F.concat("n_name", F.lit(" "), "n_nationkey")), text, True))
    key = F.regexp_extract("content", r"<urn:n(\d+)>", 1).cast("int")
    named = spark.read.format("binaryFile").load(got.inputFiles() or []).select("path", F.col("content").cast("string").alias("content")) if got.inputFiles() else None
    return got.join(named, "path").select(key.alias("k"), "triples", F.col("error").isNotNull().alias("failed"))


@query(f"SELECT replace(s, 'http://dprr.example/rdf/', 'http://moved.example/') AS s, replace(p, '{NS}', 'http://moved.example/') AS p, replace(o, '{NS}', 'http://moved.example/') AS o FROM {_TRIPLES} WHERE o IS NOT NULL")
def namespace_rewrite(spark: SparkSession, d: str) -> DataFrame:
    q = rdf.rewrite_namespace(rdf.rewrite_namespace(lines_graph(spark, d), NS, "http://moved.example/"), "http://dprr.example/rdf/", "http://moved.example/")
    return q.select("s", "p", "o")


@query(
    r"""SELECT id, regexp_replace(replace(x, '%23', '#'), '(/vocabularies/)(place-types/)?', '\1place-types/', 'g') AS fixed FROM (SELECT id, u || CASE WHEN length(u) % 2 = 0 THEN ' /vocabularies/mint' ELSE ' /vocabularies/place-types/mint' END AS x
    FROM (SELECT DISTINCT id, unnest(flatten(map_values(uris))) AS u FROM meta_entities WHERE uris IS NOT NULL) WHERE u IS NOT NULL)"""
)
def repaired_iris(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "meta_entities").select("id", F.explode(F.flatten(F.map_values("uris"))).alias("u")).where("u is not null").distinct()
    lines = u.select("id", F.concat("u", F.when(F.char_length("u") % 2 == 0, " /vocabularies/mint").otherwise(" /vocabularies/place-types/mint")).alias("fixed"))
    return rdf.repair_iris(lines, "fixed")


@query("SELECT place_uri AS s, label AS name, replace(replace(province, 'ia', 'ya'), 'e', 'E') AS region FROM (SELECT DISTINCT place_uri, label, province FROM places) WHERE label IS NOT NULL AND province IS NOT NULL")
def repaired_xml(spark: SparkSession, d: str) -> DataFrame:
    """RDF/XML that uses entities without declaring them: the declarations are put in, known slips corrected, then it is parsed."""
    p = table(spark, d, "places").distinct().where("label is not null and province is not null")
    node = F.concat(F.lit('<rdf:Description rdf:about="'), "place_uri", F.lit('"><q:name>'), "label", F.lit("</q:name><q:region>"), rdf.correct_text(F.col("province"), {"ia": "ya", "e": "E"}), F.lit('</q:region><q:kind rdf:resource="&own;Place"/></rdf:Description>'))
    body = p.groupBy("province").agg(F.array_join(F.sort_array(F.collect_list(node)), "").alias("body"))
    xml = F.concat(F.lit(f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:q="{NS}">'), "body", F.lit("</rdf:RDF>"))
    quads = rdf.load(spark, _written(body, rdf.inject_entities(xml, {"own": NS}), True))
    of = lambda n: quads.where(F.col("p") == NS + n).select("s", F.col("o").alias(n))
    return of("name").join(of("region"), "s").join(quads.where((F.col("p") == NS + "kind") & (F.col("o") == NS + "Place")).select("s"), "s", "left_semi")


@query(
    """SELECT doc_id, CASE WHEN lang IS NULL THEN '"x" .' ELSE '"x"@' || lower(lang) || CASE WHEN n_chars % 2 = 0 THEN '-x' ELSE '' END || ' .' END || CASE WHEN n_chars % 3 = 0 THEN ' <https://doi.org/' || doc_id || '>' ELSE '' END AS fixed,
    CASE WHEN n_chars % 3 = 0 OR (lang IS NOT NULL AND n_chars % 2 = 0) THEN 1 ELSE 0 END AS changed FROM (SELECT doc_id, CASE WHEN regexp_full_match(lang, '[A-Za-z]{1,8}') THEN lang END AS lang, n_chars FROM documents)"""
)
def sanitize_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the documents' own language tags, some with a part that is too long, and DOIs, some without a scheme."""
    tag = F.lower(F.when(F.col("lang").rlike("^[A-Za-z]{1,8}$"), F.col("lang")))
    line = F.concat(F.when(tag.isNull(), F.lit('"x" .')).otherwise(F.concat(F.lit('"x"@'), tag, F.when(F.col("n_chars") % 2 == 0, "-overlongpart-x").otherwise(""), F.lit(" ."))), F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit(" <doi.org/"), "doc_id", F.lit(">"))).otherwise(""))
    fixed = table(spark, d, "documents").select("doc_id", line.alias("line")).withColumn("fixed", X.sanitize_line(F.col("line")))
    return fixed.select("doc_id", "fixed", (F.col("line") != F.col("fixed")).cast("int").alias("changed"))


# -- link files, context files, schemas, manifests
def _link_file(spark: SparkSession, d: str) -> str:
    """A link file over the nations and their regions, a table of 25 rows; every third link has its own confidence, every second a note."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    links = []
    for r in rows:
        x = {"source": f"urn:n{r['n_nationkey']}", "target": f"urn:r{r['n_regionkey']}"}
        if r["n_nationkey"] % 3 == 0:
            x["confidence"] = "probable"
        if r["n_nationkey"] % 2 == 0:
            x["note"] = r["n_name"]
        links.append(x)
    meta = {"source_dataset": "n", "target_dataset": "r", "relationship": "skos:closeMatch", "confidence": "confirmed", "method": "key", "basis": "table", "author": "us", "date": "2026-01-01"}
    path = _local(scratch(spark))
    path.mkdir(parents=True)
    (path / "links.yaml").write_text(json.dumps({"metadata": meta, "links": links}), encoding="utf-8")  # JSON is YAML
    return str(path / "links.yaml")


_LINK_ROWS = f"(SELECT 'urn:n' || n_nationkey AS source, 'urn:r' || n_regionkey AS target, '{SKOS}closeMatch' AS relationship, CASE WHEN n_nationkey % 3 = 0 THEN 'probable' ELSE 'confirmed' END AS confidence, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS note FROM nation)"


@query(f"SELECT sha256(concat_ws(chr(1), source, target, relationship, confidence, 'table', 'key', 'us', '2026-01-01', note)) AS link_id, * FROM {_LINK_ROWS}")
def link_files(spark: SparkSession, d: str) -> DataFrame:
    return K.load_links(spark, [_link_file(spark, d)]).select("link_id", "source", "target", "relationship", "confidence", "note")


@query(
    f"""WITH l AS (SELECT sha256(concat_ws(chr(1), source, target, relationship, confidence, 'table', 'key', 'us', '2026-01-01', note)) AS id, * FROM {_LINK_ROWS})
    SELECT 'link' AS part, relationship AS p, target AS o, count(*) AS n FROM l GROUP BY 2, 3 UNION ALL SELECT 'prov', 'confidence', confidence, count(*) FROM l GROUP BY 3 UNION ALL SELECT 'prov', 'note', note, 1 FROM l WHERE note IS NOT NULL
    UNION ALL SELECT 'prov', p, o, count(*) FROM l, (VALUES ('type', 'Entity'), ('method', 'key'), ('basis', 'table'), ('wasAttributedTo', 'us'), ('created', '2026-01-01')) v(p, o) GROUP BY 2, 3"""
)
def link_provenance_quads(spark: SparkSession, d: str) -> DataFrame:
    """A link's statement in a graph of its own, six or seven about it in the provenance graph."""
    q = K.link_quads(K.load_links(spark, [_link_file(spark, d)]))
    prov = F.col("g") == K.LINK_NS + "provenance"
    tail = lambda c: F.regexp_extract(c, r"([^/#:]*)$", 1)
    return q.groupBy(F.when(prov, "prov").otherwise("link").alias("part"), F.when(prov, tail(F.col("p"))).otherwise(F.col("p")).alias("p"), F.when(prov & (tail(F.col("p")) == "type"), tail(F.col("o"))).otherwise(F.col("o")).alias("o")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source AS s, confidence AS c, note AS n FROM {_LINK_ROWS} WHERE note IS NOT NULL AND target = 'urn:r1'")
def provenance_join(spark: SparkSession, d: str) -> DataFrame:
    """A link's own graph joined to what the provenance graph says about that graph, in one query."""
    from quern.plans.engine import Graph
    from quern.sources.graphs import QuadSource

    g = Graph(QuadSource(K.link_quads(K.load_links(spark, [_link_file(spark, d)]))), {"l": K.LINK_NS, "skos": SKOS})
    return g.query(f"SELECT ?s ?c ?n WHERE {{ GRAPH ?g {{ ?s skos:closeMatch <urn:r1> }} GRAPH <{K.LINK_NS}provenance> {{ ?g l:confidence ?c ; l:note ?n }} }}")


@query(f"SELECT 'urn:n3' AS source, 'urn:r' || n_regionkey AS target, 'probable' AS confidence, 'key' AS method FROM nation WHERE n_nationkey = 3")
def link_provenance(spark: SparkSession, d: str) -> DataFrame:
    links = K.load_links(spark, [_link_file(spark, d)])
    target = table(spark, d, "nation").where("n_nationkey = 3").first()["n_regionkey"]
    return L.provenance(links, "urn:n3", f"urn:r{target}").unionByName(L.provenance(links, "urn:n3", "urn:nowhere")).select("source", "target", "confidence", "method")


def _context(spark: SparkSession, d: str) -> str:
    """A dataset's context folder made from nations and regions: an example for each nation, a tip for each region."""
    nations, regions = table(spark, d, "nation").collect(), table(spark, d, "region").collect()
    folder = _local(scratch(spark))
    folder.mkdir(parents=True)
    put = lambda name, body: (folder / f"{name}.yaml").write_text(json.dumps(body), encoding="utf-8")
    put("prefixes", {"prefixes": {"q": NS}})
    put("examples", {"examples": [{"question": f"Who lives in {r['n_name']}?", "sparql": "SELECT * WHERE { ?s ?p ?o }", "classes": [f"R{r['n_regionkey']}", f"N{r['n_nationkey']}"]} for r in nations]})
    put("tips", {"tips": [{"title": r["r_name"], "body": "Mind it.", "classes": [f"R{r['r_regionkey']}"] if r["r_regionkey"] else []} for r in regions]})
    put("schemas", {"classes": {f"q:R{r['r_regionkey']}": {"properties": [{"pred": "q:name", "range": "xsd:string", "comment": r["r_name"]}, {"pred": "q:seen", "range": ["xsd:boolean"], "open_world": True}]} for r in regions}})
    return str(folder)


@query("SELECT 'example' AS part, 'Who lives in ' || n_name || '?' AS a, 'R' || n_regionkey || ',N' || n_nationkey AS b FROM nation UNION ALL SELECT 'tip', r_name, CASE WHEN r_regionkey = 0 THEN '' ELSE 'R' || r_regionkey END FROM region UNION ALL SELECT 'schema', 'q:R' || r_regionkey, unnest(['q:name', 'q:seen']) FROM region")
def context_files(spark: SparkSession, d: str) -> DataFrame:
    c = K.context_tables(spark, _context(spark, d))
    part = lambda name, a, b: c[name + ("s" if name != "schema" else "")].select(F.lit(name).alias("part"), F.col(a).alias("a"), b.alias("b"))
    return part("example", "question", F.array_join("classes", ",")).unionByName(part("tip", "title", F.array_join("classes", ","))).unionByName(part("schema", "class", F.col("property")))


@query("SELECT kind, title, overlap, place FROM (SELECT 'example' AS kind, 'Who lives in ' || n_name || '?' AS title, CASE WHEN n_nationkey = 7 THEN 2 ELSE 1 END AS overlap, row_number() OVER (ORDER BY CASE WHEN n_nationkey = 7 THEN 2 ELSE 1 END DESC, 'Who lives in ' || n_name || '?') AS place FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)) WHERE place <= 3 UNION ALL SELECT 'tip', r_name, o, row_number() OVER (ORDER BY o DESC, r_name) FROM (SELECT r_name, CASE WHEN r_regionkey = 0 THEN 0 ELSE 1 END AS o FROM region WHERE r_regionkey = 0 OR r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7))")
def related_context(spark: SparkSession, d: str) -> DataFrame:
    """Examples (three) and tips (five) that share classes with a query about nation 7; those without classes concern all."""
    from quern.operators.search import related_by_class

    c = K.context_tables(spark, _context(spark, d))
    region = table(spark, d, "nation").where("n_nationkey = 7").first()["n_regionkey"]
    wanted = [f"R{region}", "N7"]
    place = F.row_number().over(Window.orderBy(F.col("overlap").desc(), "title"))  # of five rows at most
    found = lambda name, title, k: related_by_class(c[name + "s"], wanted, k, title).select(F.lit(name).alias("kind"), F.col(title).alias("title"), F.col("overlap").cast("int").alias("overlap")).withColumn("place", place)
    return found("example", "question", 3).unionByName(found("tip", "title", 5))


@query(f"SELECT 'q:Person' AS class, 'q:' || regexp_extract(p, '([^/#]*)$', 1) AS property, 'xsd:' || CASE WHEN p IN ('{NS}eraFrom', '{NS}eraTo') THEN 'integer' ELSE 'string' END AS range FROM (SELECT DISTINCT p FROM {_TRIPLES} WHERE o IS NOT NULL AND p <> '{TYPE}')")
def schema_file(spark: SparkSession, d: str) -> DataFrame:
    """An extracted schema, written as YAML and read as a context folder is."""
    folder = _local(scratch(spark))
    folder.mkdir(parents=True)
    (folder / "schemas.yaml").write_text(K.schema_yaml(P.extract_schema(_mapped_quads(spark, d)), {"q": NS, "xsd": XSD, "x": XSD[:10]}), encoding="utf-8")
    return K.context_tables(spark, folder)["schema"].select("class", "property", "range")


@query(f"SELECT p AS property, count(*) AS triples, count(DISTINCT s) AS subjects FROM {_TRIPLES} WHERE o IS NOT NULL GROUP BY p")
def void_file(spark: SparkSession, d: str) -> DataFrame:
    """The profile as Turtle, read back as quads."""
    q = _mapped_quads(spark, d)
    totals, classes, properties = P.void_totals(q).first().asDict(), [tuple(r) for r in P.void_classes(q).collect()], [tuple(r) for r in P.void_properties(q).collect()]
    text = P.void_turtle("urn:set", totals, classes, properties, P.common_prefix(q.select("s"), "s").first()["prefix"])
    from quern.sources.graphs import QUADS

    made = spark.createDataFrame(rdf.parse_turtle(text), QUADS)
    void = "http://rdfs.org/ns/void#"
    of = lambda name, out: made.where(F.col("p") == void + name).select("s", F.col("o").alias(out))
    return of("property", "property").join(of("triples", "triples"), "s").join(of("distinctSubjects", "subjects"), "s").select("property", F.col("triples").cast("long").alias("triples"), F.col("subjects").cast("long").alias("subjects"))


def _layers(spark: SparkSession, d: str, cut: int) -> DataFrame:
    t = table(spark, d, "part").where(F.col("p_partkey") % cut != 0)
    return t.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(""), "p_name", F.lit("-"), "p_partkey").alias("filename"), F.md5(F.concat_ws("|", "p_brand", F.when(F.col("p_partkey") % 11 == 0, F.lit(cut)).otherwise(0))).alias("digest"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END || p_name || '-' || p_partkey AS filename, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 11 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)")
def layer_changes(spark: SparkSession, d: str) -> DataFrame:
    return K.layer_changes(_layers(spark, d, 5), _layers(spark, d, 7))


@query("SELECT 'all' AS what, CASE WHEN (SELECT count(*) FROM part WHERE p_partkey % 2 = 1) > 0 THEN 'data' ELSE 'none' END AS kind UNION ALL SELECT 'sidecars', CASE WHEN (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) > 0 THEN 'sidecar' ELSE 'none' END UNION ALL SELECT 'same', 'none' WHERE EXISTS (SELECT 1 FROM part)")
def layer_change_kinds(spark: SparkSession, d: str) -> DataFrame:
    a, b = _layers(spark, d, 5), _layers(spark, d, 7)
    side = lambda df: df.where(F.col("filename").startswith("_"))
    return spark.createDataFrame([("all", K.change_kind(K.layer_changes(a, b))), ("sidecars", K.change_kind(K.layer_changes(side(a), side(b)))), ("same", K.change_kind(K.layer_changes(a, a)))], "what string, kind string")


@query("SELECT c_custkey AS digest, c_custkey % 90 AS age_days FROM customer WHERE c_custkey % 90 > 30 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphan_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = table(spark, d, "customer").select(F.col("c_custkey").alias("digest"), (F.col("c_custkey") % 90).alias("age_days"))
    return K.orphan_layers(layers, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("digest")), 30)


@query("SELECT source AS dataset, n AS triples, 2 AS revision FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)")
def registry_file(spark: SparkSession, d: str) -> DataFrame:
    """A registry written twice: entries are replaced key by key, what an entry does not say again is kept."""
    path = _local(scratch(spark))
    path.mkdir(parents=True)
    counts = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a source
    for revision in (1, 2):
        for r in counts:
            registry = K.upsert_registry(path / "registry.json", r["source"], {"revision": revision} | ({"triples": r["n"]} if revision == 1 else {}))
    return spark.createDataFrame([(k, v["triples"], v["revision"]) for k, v in registry.items()], "dataset string, triples long, revision int")


_BOM = "(SELECT DISTINCT source AS dataset, md5(source) AS digest, CASE WHEN source = 'edh' THEN 'CC BY' ELSE 'unknown' END AS license, CASE WHEN source IN ('edh', 'rpc') THEN '7' ELSE 'unknown' END AS version, 'unknown' AS citation FROM documents WHERE source IS NOT NULL)"


def _bom(spark: SparkSession, d: str) -> DataFrame:
    manifests = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("dataset"), F.md5(F.col("source").cast("binary")).alias("digest")).distinct()
    return K.bill_of_materials(manifests, spark.createDataFrame([("edh", "CC BY", "7", None), ("rpc", None, "7", None)], "dataset string, license string, version string, citation string"))


@query(f"SELECT * FROM {_BOM}")
def bill_of_materials(spark: SparkSession, d: str) -> DataFrame:
    """Through its JSON form and back."""
    text = K.render(_bom(spark, d), "json")
    return spark.createDataFrame([tuple(r[c] for c in ("dataset", "digest", "license", "version", "citation")) for r in json.loads(text)], "dataset string, digest string, license string, version string, citation string")


@query(f"SELECT '| ' || dataset || ' | ' || digest || ' | ' || license || ' | ' || version || ' | ' || citation || ' |' AS line FROM {_BOM}")
def bill_of_materials_lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in K.render(_bom(spark, d)).splitlines()[2:]], "line string")


@query(
    """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 9000 THEN 0 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT s_suppkey + 100000000, s_name, s_acctbal FROM supplier"""
)
def upserted_records(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 100_000_000).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return L.upsert(c, c.where("balance > 9000").withColumn("balance", F.lit(0.0)).unionByName(s), "id")


@query(f"SELECT DISTINCT 'http://a.example/' || s_suppkey AS s, '{SKOS}closeMatch' AS p, 'http://b.example/' || c_custkey AS o FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal > 9500")
def concordance_links(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("item"), F.col("s_suppkey").alias("id"))
    b = table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("item"), F.col("c_custkey").alias("id"))
    return L.concordance(a, b, "item", "http://a.example/", "http://b.example/")


# -- session logs, whole and as streams
def _feed(spark: SparkSession, d: str) -> str:
    """The events as session logs of JSON lines: every event twice, every 500th line broken."""
    e = table(spark, d, "events")
    data = F.to_json(F.struct(F.concat(F.lit("http://nomisma.org/id/u"), F.col("event_id") % 97).alias("uri")))
    row = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.lit("entity").alias("type"), F.col("event_type").alias("dataset"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), data.alias("data")))
    lines = e.select(F.explode(F.array(row, F.when(F.col("event_id") % 500 == 0, F.concat(F.lit("{broken "), "event_id")).otherwise(row))).alias("line"))
    return _written(lines, F.col("line"))


@query("SELECT user_id::VARCHAR AS session_id, count(*) * 2 - count(*) FILTER (event_id % 500 = 0) AS events, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def session_files(spark: SparkSession, d: str) -> DataFrame:
    return session_summary(read_sessions(spark, _feed(spark, d)).where("_corrupt_record is null"))


@query("SELECT '{broken ' || event_id AS line FROM events WHERE event_id % 500 = 0")
def broken_session_lines(spark: SparkSession, d: str) -> DataFrame:
    return broken_lines(spark, _feed(spark, d))


@query("SELECT user_id::VARCHAR AS session_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def session_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Events in the order of their sessions."""
    from quern.operators.relational import with_rank0

    e = read_sessions(spark, _feed(spark, d)).where("_corrupt_record is null").dropDuplicates(["session_id", "seq"])
    return with_rank0(e, [F.col("timestamp").asc(), F.col("seq").asc()], ["session_id"], "place").select("session_id", "seq", (F.col("place") + 1).alias("place"))


def _drained(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A stream's rows once it has read all there is."""
    out, state = scratch(spark), scratch(spark)
    df.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query("SELECT user_id::VARCHAR AS session_id, event_id AS seq FROM events")
def session_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a stream from its oldest file on, each (session, seq) once; a session's numbers are its own."""
    events = read_feed(spark, _feed(spark, d)).where("seq is not null")
    return _drained(spark, deduplicated(events, "3650 days").select("session_id", "seq"))


@query("SELECT DISTINCT user_id::VARCHAR AS session_id, 'http://nomisma.org/id/u' || event_id % 97 AS uri FROM events")
def incremental_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A stream that resolves each URI once a session: what was resolved, over all its batches."""
    out = scratch(spark)
    events = read_feed(spark, _feed(spark, d), files=1).where("seq is not null")
    resolve_new_uris(events, scratch(spark), lambda found: found.select("session_id", "uri").write.mode("append").parquet(out), scratch(spark)).awaitTermination()
    return spark.read.parquet(out)
