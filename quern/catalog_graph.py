"""More queries over graphs: terms, filters, joins on unbound variables, paths, inference, checks; each beside its SQL."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import catalog
from quern.catalog import _P, _TRIPLES, NS, _axioms, lines_graph, people_graph, quad_sparql, query, sparql, table
from quern.operators import profile as P
from quern.operators.inference import materialize
from quern.plans import analyze as A
from quern.plans.engine import Graph, paged
from quern.plans.syntax import OWL, RDFS, TYPE, XSD, parse, repair_prefixes
from quern.sources.graphs import QUADS, QuadSource

_STR, _INT = f"{XSD}string", f"{XSD}integer"

# -- default graph, repeated variables, all variables
quad_sparql("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", f"SELECT p, count(*) AS n FROM {_TRIPLES} WHERE o IS NOT NULL AND p <> '{NS}office' GROUP BY p", "graph_default")
quad_sparql(
    "SELECT * WHERE { ?s q:nomen ?n ; q:eraFrom ?a }", f"SELECT dprr_uri AS s, nomen AS n, era_from::VARCHAR AS a FROM {_P} WHERE nomen IS NOT NULL AND era_from IS NOT NULL", "select_star"
)


def _pairs_graph(spark: SparkSession, d: str) -> Graph:
    """Parts and suppliers as one kind of node: an edge from a part's number to its supplier's."""
    t = table(spark, d, "lineitem")
    null = F.lit(None).cast("string")
    rows = t.select(null.alias("g"), F.concat(F.lit("n:"), "l_partkey").alias("s"), F.lit("iri").alias("s_kind"), F.lit(NS + "suppliedBy").alias("p"), F.concat(F.lit("n:"), "l_suppkey").alias("o"), F.lit("iri").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    return Graph(QuadSource(spark.createDataFrame([], QUADS).unionByName(rows)), {"q": NS})


@query("SELECT DISTINCT 'n:' || l_partkey AS x FROM lineitem WHERE l_partkey = l_suppkey")
def pattern_repeated_variable(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_graph(spark, d).query("SELECT DISTINCT ?x WHERE { ?x q:suppliedBy ?x }")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def store_length(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_graph(spark, d).length()


sparql(
    "SELECT ?o ?s WHERE { ?o q:status ?s FILTER(?s NOT IN (\"F\", \"O\")) }", f"SELECT '{NS}order/' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", "filter_not_in"
)
sparql(
    "SELECT ?a ?b WHERE { ?a q:segment ?s ; q:balance ?x . ?b a q:Region FILTER(?x > 9900) }",
    f"SELECT '{NS}customer/' || c_custkey AS a, '{NS}region/' || r_regionkey AS b FROM customer, region WHERE c_acctbal > 9900 AND c_mktsegment IS NOT NULL", "cross_product",
)
sparql(
    "SELECT ?d ?p WHERE { ?d a q:Doc OPTIONAL { ?d q:docSource ?l } ?p a q:Nation ; q:nationName ?l }",
    f"SELECT '{NS}doc/' || doc_id AS d, '{NS}nation/' || n_nationkey AS p FROM documents JOIN nation ON source IS NULL OR source = n_name", "join_only_unbound",
)
sparql("SELECT REDUCED ?p WHERE { ?x q:priority ?p }", "SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority IS NOT NULL", "reduced")
sparql(
    "SELECT ?c ?k WHERE { ?c a q:Customer ; q:balance ?b FILTER(?b < 0) FILTER NOT EXISTS { ?o q:customer ?c ; q:status \"F\" } BIND(STR(?c) AS ?k) }",
    f"SELECT '{NS}customer/' || c_custkey AS c, '{NS}customer/' || c_custkey AS k FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "not_exists_status",
)
sparql(
    "SELECT ?o (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) WHERE { ?o q:orderDate ?t }",
    f"SELECT '{NS}order/' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders WHERE o_orderdate IS NOT NULL", "date_functions",
)
sparql(
    "SELECT ?p (MD5(?n) AS ?a) (SHA256(?n) AS ?b) (STRLEN(STRUUID()) AS ?c) (isBlank(BNODE()) AS ?e) WHERE { ?p q:partName ?n }",
    f"SELECT '{NS}part/' || p_partkey AS p, md5(p_name) AS a, sha256(p_name) AS b, 36 AS c, true AS e FROM part WHERE p_name IS NOT NULL", "hash_functions",
)
sparql(
    f"SELECT ?p (IRI(CONCAT(\"{NS}brand/\", ?b)) AS ?i) (ENCODE_FOR_URI(?b) AS ?e) (isIRI(?i) AS ?t) WHERE {{ ?p q:brand ?b }}",
    f"SELECT '{NS}part/' || p_partkey AS p, '{NS}brand/' || p_brand AS i, replace(p_brand, '#', '%23') AS e, true AS t FROM part WHERE p_brand IS NOT NULL", "iri_constructor",
)


# -- literals of many kinds: years, languages, booleans
def _terms_graph(spark: SparkSession, d: str) -> Graph:
    """Places with labels in two languages and without, documents with year literals, meta-entities with an open-world flag (only true is stored)."""
    null = F.lit(None).cast("string")
    row = lambda s, p, o, kind, dt, lang: F.struct(s.alias("s"), F.lit(NS + p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(lang).cast("string").alias("o_lang"))
    places = table(spark, d, "places").distinct()
    u, label = F.col("place_uri"), F.col("label")
    rdf_lang = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
    lab = F.array(row(u, "label", label, "lit", rdf_lang, "en"), row(u, "label", F.upper(label), "lit", rdf_lang, "la"), row(u, "label", F.lower(label), "lit", _STR, None), row(u, "label", F.concat(label, F.lit("!")), "lit", rdf_lang, "en-gb"), row(u, "province", F.concat(F.lit("urn:province:"), F.replace("province", F.lit(" "), F.lit("_"))), "iri", None, None))
    persons = table(spark, d, "dprr_persons").distinct()
    v = F.col("dprr_uri")
    year = lambda c: F.concat(F.when(F.col(c) < 0, "-").otherwise(""), F.lpad(F.abs(F.col(c)).cast("string"), 4, "0"))
    said = F.array(row(v, "from", year("era_from"), "lit", f"{XSD}gYear", None), row(v, "until", year("era_to"), "lit", f"{XSD}gYear", None), row(v, "woman", F.when(F.col("sex") == "female", "true"), "lit", f"{XSD}boolean", None), row(v, "text", F.col("era_from").cast("string"), "lit", _STR, None))
    rows = places.select(F.explode(lab).alias("q")).unionByName(persons.select(F.explode(said).alias("q"))).select("q.*").where("o is not null").distinct()
    return Graph(QuadSource(spark.createDataFrame([], QUADS).unionByName(rows.select(null.alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_dt", "o_lang"))), {"q": NS})


def term_sparql(text: str, sql: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _terms_graph(spark, d).query(text)

    run.__name__ = name
    query(sql)(run)


_PL = "(SELECT DISTINCT place_uri, label, province FROM places)"
_PE = "(SELECT DISTINCT dprr_uri, sex, era_from, era_to FROM dprr_persons)"
term_sparql(
    f'SELECT ?s WHERE {{ ?s q:from ?a ; q:until ?b FILTER(?a >= "-0150"^^<{XSD}gYear> && ?b < "0020"^^<{XSD}gYear>) }}',
    f"SELECT dprr_uri AS s FROM {_PE} WHERE era_from >= -150 AND era_to < 20", "filter_gyear",
)
term_sparql('SELECT ?s ?t WHERE { ?s q:text ?t FILTER(?t >= "-1" && ?t < "-2") }', f"SELECT dprr_uri AS s, era_from::VARCHAR AS t FROM {_PE} WHERE era_from::VARCHAR >= '-1' AND era_from::VARCHAR < '-2'", "filter_string_order")
term_sparql('SELECT ?s ?l WHERE { ?s q:label ?l FILTER(LANG(?l) = "en") }', f"SELECT place_uri AS s, label AS l FROM {_PL} WHERE label IS NOT NULL", "filter_lang")
term_sparql('SELECT ?s ?l WHERE { ?s q:label ?l FILTER(LANG(?l) = "") }', f"SELECT place_uri AS s, lower(label) AS l FROM {_PL} WHERE label IS NOT NULL", "filter_untagged")
term_sparql(
    'SELECT ?s ?l (LANG(?l) AS ?g) WHERE { ?s q:label ?l FILTER(LANGMATCHES(LANG(?l), "EN")) }',
    f"SELECT place_uri AS s, label AS l, 'en' AS g FROM {_PL} WHERE label IS NOT NULL UNION ALL SELECT place_uri, label || '!', 'en-gb' FROM {_PL} WHERE label IS NOT NULL", "filter_langmatches",
)
term_sparql(
    "SELECT ?s ?o (isIRI(?o) AS ?i) (isLiteral(?o) AS ?l) (isBlank(?o) AS ?b) WHERE { ?s q:province|q:label ?o FILTER(isIRI(?o) || LANG(?o) = \"la\") }",
    f"SELECT place_uri AS s, upper(label) AS o, false AS i, true AS l, false AS b FROM {_PL} WHERE label IS NOT NULL UNION ALL SELECT place_uri, 'urn:province:' || replace(province, ' ', '_'), true, false, false FROM {_PL} WHERE province IS NOT NULL", "term_kinds",
)
term_sparql(
    "SELECT ?a ?b WHERE { ?a q:province ?p . ?b q:province ?r FILTER(sameTerm(?p, ?r) && STR(?a) < STR(?b)) }".replace("?b q:province ?r FILTER(sameTerm(?p, ?r) &&", "?b q:province ?p . ?b q:province ?r FILTER(sameTerm(?p, ?r) &&"),
    f"SELECT a.place_uri AS a, b.place_uri AS b FROM {_PL} a JOIN {_PL} b ON a.province = b.province AND a.place_uri < b.place_uri", "same_term",
)
term_sparql(
    f'SELECT ?s (DATATYPE(STRDT(STR(?a), <{XSD}date>)) AS ?t) (LANG(STRLANG(STR(?a), "DE")) AS ?g) (DATATYPE(?a) AS ?own) WHERE {{ ?s q:from ?a }}',
    f"SELECT dprr_uri AS s, '{XSD}date' AS t, 'de' AS g, '{XSD}gYear' AS own FROM {_PE} WHERE era_from IS NOT NULL", "typed_literals",
)
term_sparql("SELECT ?s ?a WHERE { ?s q:from ?a FILTER NOT EXISTS { ?s q:woman true } }", f"SELECT dprr_uri AS s, CASE WHEN era_from < 0 THEN '-' ELSE '' END || lpad(abs(era_from)::VARCHAR, 4, '0') AS a FROM {_PE} WHERE era_from IS NOT NULL AND sex IS DISTINCT FROM 'female'", "open_world_boolean")
term_sparql("SELECT ?s WHERE { ?s q:woman true }", f"SELECT dprr_uri AS s FROM {_PE} WHERE sex = 'female'", "boolean_object")
term_sparql(f"SELECT ?s (<{XSD}integer>(STR(?a)) AS ?y) (YEAR(?a) AS ?z) WHERE {{ ?s q:from ?a }}", f"SELECT dprr_uri AS s, era_from::BIGINT AS y, era_from::BIGINT AS z FROM {_PE} WHERE era_from IS NOT NULL", "gyear_casts")


# -- paths
def _tree_graph(spark: SparkSession, d: str) -> Graph:
    """Parts as a tree: part n stands under part n // 3."""
    null = F.lit(None).cast("string")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 3).alias("up")).where("up > 0")
    rows = t.select(null.alias("g"), F.concat(F.lit("t:"), "k").alias("s"), F.lit("iri").alias("s_kind"), F.lit(NS + "under").alias("p"), F.concat(F.lit("t:"), "up").alias("o"), F.lit("iri").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    return Graph(QuadSource(spark.createDataFrame([], QUADS).unionByName(rows)), {"q": NS})


def tree_sparql(text: str, sql: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _tree_graph(spark, d).query(text)

    run.__name__ = name
    query(sql)(run)


_TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey // 3 > 0), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), n AS (SELECT a FROM e UNION SELECT b FROM e) "
tree_sparql("SELECT ?x ?y WHERE { ?x q:under+ ?y }", _TREE + "SELECT 't:' || a AS x, 't:' || b AS y FROM r", "path_plus_query")
tree_sparql("SELECT ?x ?y WHERE { ?x q:under* ?y }", _TREE + "SELECT 't:' || a AS x, 't:' || b AS y FROM r UNION SELECT 't:' || a, 't:' || a FROM n", "path_star_query")
tree_sparql("SELECT ?x ?y WHERE { ?x q:under? ?y }", _TREE + "SELECT 't:' || a AS x, 't:' || b AS y FROM e UNION SELECT 't:' || a, 't:' || a FROM n", "path_optional_query")
tree_sparql("SELECT ?x WHERE { ?x q:under+ <t:2> }", _TREE + "SELECT 't:' || a AS x FROM r WHERE b = 2", "path_plus_bound_object")
tree_sparql("SELECT ?y WHERE { <t:95> q:under* ?y }", _TREE + "SELECT 't:' || b AS y FROM r WHERE a = 95 UNION SELECT 't:95'", "path_star_bound_subject")
quad_sparql(
    f"SELECT ?s ?o WHERE {{ ?s !(<{TYPE}>|q:nomen|q:cognomen) ?o }}",
    f"SELECT dprr_uri AS s, era_from::VARCHAR AS o FROM {_P} WHERE era_from IS NOT NULL UNION ALL SELECT dprr_uri, era_to::VARCHAR FROM {_P} WHERE era_to IS NOT NULL", "path_negated_set",
)
sparql("SELECT ?n ?r WHERE { ?x q:customerName ?n ; q:nation [ q:region [ q:regionName ?r ] ] }", "SELECT c_name AS n, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_name IS NOT NULL", "blank_node_list")


# -- inference
@query(f"SELECT s, o FROM (SELECT 'n:' || l_suppkey AS s, 'n:' || l_partkey AS o FROM lineitem UNION SELECT 'n:' || l_partkey, 'n:' || l_suppkey FROM lineitem) EXCEPT SELECT 'n:' || l_partkey, 'n:' || l_suppkey FROM lineitem")
def owl_symmetric(spark: SparkSession, d: str) -> DataFrame:
    rules = _axioms(spark, [(NS + "suppliedBy", TYPE, OWL + "SymmetricProperty")])
    return materialize(_pairs_graph(spark, d).source.quads().unionByName(rules), owl=True).where(F.col("p") == NS + "suppliedBy").select("s", "o")


@query("SELECT DISTINCT 'n:' || l_suppkey AS s, 'supplies' AS p, 'n:' || l_partkey AS o FROM lineitem UNION SELECT DISTINCT 'n:' || l_partkey, 'type', 'Part' FROM lineitem UNION SELECT DISTINCT 'n:' || l_suppkey, 'type', 'Supplier' FROM lineitem")
def owl_inverse_domain_range(spark: SparkSession, d: str) -> DataFrame:
    rules = _axioms(spark, [(NS + "suppliedBy", OWL + "inverseOf", NS + "supplies"), (NS + "suppliedBy", RDFS + "domain", NS + "Part"), (NS + "suppliedBy", RDFS + "range", NS + "Supplier")])
    made = materialize(_pairs_graph(spark, d).source.quads().unionByName(rules), owl=True)
    local = lambda c: F.regexp_extract(c, r"([^/#]*)$", 1)
    return made.where(F.col("p").isin(NS + "supplies", TYPE) & F.col("s").startswith("n:")).select("s", local(F.col("p")).alias("p"), F.when(F.col("o").startswith("n:"), F.col("o")).otherwise(local(F.col("o"))).alias("o"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey // 3 > 0), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT 't:' || a AS s, 't:' || b AS o FROM r EXCEPT SELECT 't:' || a, 't:' || b FROM e")
def owl_transitive(spark: SparkSession, d: str) -> DataFrame:
    rules = _axioms(spark, [(NS + "under", TYPE, OWL + "TransitiveProperty")])
    return materialize(_tree_graph(spark, d).source.quads().unionByName(rules), owl=True).where(F.col("p") == NS + "under").select("s", "o")


@query(f"SELECT dprr_uri AS s, '{RDFS}label' AS p, nomen AS o FROM {_P} WHERE nomen IS NOT NULL UNION ALL SELECT dprr_uri, '{TYPE}', '{NS}Agent' FROM {_P}")
def rdfs_restricted(spark: SparkSession, d: str) -> DataFrame:
    """All that follows from one sub-property and one sub-class: nothing from the predicates that no axiom names."""
    rules = _axioms(spark, [(NS + "nomen", RDFS + "subPropertyOf", RDFS + "label"), (NS + "Person", RDFS + "subClassOf", NS + "Agent")])
    return materialize(lines_graph(spark, d).unionByName(rules)).select("s", "p", "o")


# -- schemas
@query(f"SELECT '{NS}r' || r_regionkey AS class, '{NS}hasName' AS property, '{NS}Text' AS range, NULL AS parent FROM region UNION ALL SELECT '{NS}n' || n_nationkey, '{NS}hasName', '{NS}Text', '{NS}r' || n_regionkey FROM nation UNION ALL SELECT '{NS}n' || n_nationkey, '{NS}p' || n_nationkey, NULL, '{NS}r' || n_regionkey FROM nation")
def ontology_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Nations as sub-classes of their regions: each has the properties of both."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    iri = lambda k, c: F.concat(F.lit(NS + k), F.col(c).cast("string"))
    q = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    n = nation.select(F.explode(F.array(q(iri("n", "n_nationkey"), TYPE, F.lit(OWL + "Class")), q(iri("n", "n_nationkey"), RDFS + "subClassOf", iri("r", "n_regionkey")), q(iri("p", "n_nationkey"), RDFS + "domain", iri("n", "n_nationkey")))).alias("q"))
    r = region.select(F.explode(F.array(q(iri("r", "r_regionkey"), TYPE, F.lit(OWL + "Class")), q(F.lit(NS + "hasName"), RDFS + "domain", iri("r", "r_regionkey")), q(F.lit(NS + "hasName"), RDFS + "range", F.lit(NS + "Text")))).alias("q"))
    null = F.lit(None).cast("string")
    quads = n.unionByName(r).select("q.*").distinct().select(null.alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", F.lit("iri").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    return P.ontology_schema(quads).select("class", "property", "range", "parent")


@query(
    """WITH o AS (SELECT DISTINCT l_returnflag AS class, l_partkey AS property FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), n AS (SELECT DISTINCT l_returnflag AS class, l_partkey AS property FROM lineitem WHERE l_quantity < 25),
    a AS (SELECT class, count(*) AS old_n FROM o GROUP BY 1), b AS (SELECT class, count(*) AS new_n FROM n GROUP BY 1)
    SELECT class, CASE WHEN old_n IS NULL THEN 'added' WHEN new_n IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(old_n, 0) AS old_n, coalesce(new_n, 0) AS new_n FROM a FULL JOIN b USING (class) WHERE old_n IS DISTINCT FROM new_n"""
)
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_partkey").alias("property"), "l_shipdate", "l_quantity")
    return P.schema_diff(t.where("l_shipdate < timestamp '1995-06-01'"), t.where("l_quantity < 25"))


_PREFIX = """WITH v AS (SELECT {key} AS k, {value} AS v FROM {table} WHERE {value} IS NOT NULL), e AS (SELECT k, min(v) AS lo, max(v) AS hi FROM v GROUP BY k)
SELECT k, substr(lo, 1, coalesce(list_min([i FOR i IN range(1, least(length(lo), length(hi))::INT + 1) IF substr(lo, i::INT, 1) <> substr(hi, i::INT, 1)]) - 1, least(length(lo), length(hi)))::INT) AS prefix FROM e"""


@query(f"SELECT k, CASE WHEN regexp_full_match(prefix, '[a-z]+:/*|') THEN NULL ELSE prefix END AS prefix FROM ({_PREFIX.format(key='province', value='place_uri', table='places')})")
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The URI space of the places of each province."""
    return P.common_prefix(table(spark, d, "places").select(F.col("province").alias("k"), "place_uri").where("place_uri is not null"), "place_uri", ["k"])


@query(f"SELECT '{NS}Person' AS class, string_agg('  ' || regexp_extract(p, '([^/#]*)$', 1) || ' ' || CASE WHEN p IN ('{NS}eraFrom', '{NS}eraTo') THEN 'integer' ELSE 'string' END || ' *', chr(32) || ';' || chr(10) ORDER BY p) AS body FROM (SELECT DISTINCT p FROM {_TRIPLES} WHERE o IS NOT NULL AND p <> '{TYPE}')")
def class_shape_texts(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.regexp_extract(c, r"([^/#]*)$", 1)
    made = P.class_shapes(P.extract_schema(lines_graph(spark, d)), name)
    return made.select("class", F.regexp_extract("shape", r"(?s)\{\n(.*)\n\}", 1).alias("body"))


@query(f"SELECT 'few' AS name, count(*) >= 1000000 AS enough FROM lineitem WHERE false UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) >= 5000 UNION ALL SELECT 'persons', (SELECT count(*) FROM dprr_persons) >= 5000000")
def least_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return spark.createDataFrame([("few", P.enough(t.where("l_orderkey is null"), 1_000_000)), ("lineitem", P.enough(t, 5000)), ("persons", P.enough(table(spark, d, "dprr_persons"), 5_000_000))], "name string, enough boolean")


@query(f"SELECT split_part(o, '/', 3) AS target, p AS property, count(*) AS links FROM (SELECT place_uri AS o, '{NS}found' AS p FROM (SELECT DISTINCT context_id, findspot_uri AS place_uri FROM person_contexts) WHERE place_uri IS NOT NULL) GROUP BY 1, 2")
def linkset_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "person_contexts").select("context_id", "findspot_uri").distinct().where("findspot_uri is not null")
    quads = c.select(F.concat(F.lit("http://contexts.example/"), "context_id").alias("s"), F.lit(NS + "found").alias("p"), F.col("findspot_uri").alias("o"), F.lit("iri").alias("o_kind"))
    return P.linksets(quads, lambda u: F.split_part(u, F.lit("/"), F.lit(3))).select("target", "property", "links")


@query(f"SELECT s, o AS label FROM (SELECT place_uri AS s, label AS o FROM {_PL} WHERE label IS NOT NULL)")
def preferred_labels(spark: SparkSession, d: str) -> DataFrame:
    q = _terms_graph(spark, d).source.quads()
    return P.labels(q.where(F.col("p") == NS + "label").withColumn("p", F.lit(RDFS + "label")))


# -- extracts
@query(f"SELECT dprr_uri AS s, '{NS}calls' AS p, nomen AS o, 'lit' AS o_kind FROM {_P} WHERE nomen IS NOT NULL AND cognomen IS NOT NULL UNION SELECT dprr_uri, '{TYPE}', '{NS}Named', 'iri' FROM {_P} WHERE nomen IS NOT NULL AND cognomen IS NOT NULL")
def construct_triples(spark: SparkSession, d: str) -> DataFrame:
    return people_graph(spark, d).construct("CONSTRUCT { ?s q:calls ?n . ?s a q:Named . ?n q:never ?s } WHERE { ?s q:nomen ?n ; q:cognomen ?c }").select("s", "p", "o", "o_kind")


@query(f"SELECT dprr_uri AS s, (row_number() OVER (ORDER BY dprr_uri) - 1) // 500 AS page FROM {_P} WHERE nomen IS NOT NULL QUALIFY row_number() OVER (ORDER BY dprr_uri) <= 1200")
def paged_extract(spark: SparkSession, d: str) -> DataFrame:
    return paged(people_graph(spark, d).query("SELECT ?s WHERE { ?s q:nomen ?n }"), [F.col("s").asc()], 500, 1200)


# -- checks of queries: the schema is extracted from the tables, hints and diagnosis from the query's text
_CASES = [
    ("a", "SELECT ?x WHERE { ?x a q:Persn }", "unknown-class"),
    ("b", "SELECT ?x WHERE { ?x a q:Person ; q:nommen ?n }", "unknown-predicate"),
    ("c", 'SELECT ?x WHERE { ?x a q:Person ; q:eraFrom "long ago" }', "datatype"),
    ("d", "SELECT ?x WHERE { ?x a q:Person ; q:certain ?c FILTER(?c = false) }", "open-world"),
    ("e", "SELECT (COUNT(?x) AS ?n) WHERE { ?x a q:Person }", "count-distinct"),
    ("f", "SELECT ?x WHERE { ?x a q:Person }", "no-limit"),
    ("g", "SELECT ?x WHERE { ?x a q:Person ; q:nomen ?n }", "uncertainty"),
]


def _schema(spark: SparkSession, d: str) -> tuple[A.Schema, dict[str, int]]:
    found = P.extract_schema(lines_graph(spark, d)).collect()  # a row a property
    schema = A.schema_from_rows([r.asDict() for r in found] + [{"class": NS + "Person", "property": NS + "certain", "range": f"{XSD}boolean", "open_world": True}])
    schema[NS + "Person"].count_distinct = True
    counts = {r["class"]: r["entities"] for r in P.void_classes(lines_graph(spark, d)).collect()}
    return schema, counts


@query(
    f"SELECT * FROM (VALUES ('a', 'unknown-class'), ('b', 'unknown-predicate'), ('c', 'datatype'), ('d', 'open-world'), ('e', 'count-distinct'), ('g', 'uncertainty')) t(id, code) WHERE EXISTS (SELECT 1 FROM dprr_persons) UNION ALL SELECT 'f', 'no-limit' WHERE (SELECT count(DISTINCT dprr_uri) FROM dprr_persons) > 1000"
)
def query_hints(spark: SparkSession, d: str) -> DataFrame:
    """The hint each of the cases is about, with the classes, predicates and counts of the data."""
    schema, counts = _schema(spark, d)
    g = people_graph(spark, d)
    rows = [(i, code) for i, text, code in _CASES if any(h.code == code for h in A.check(g.tree(text), schema, counts))]
    return spark.createDataFrame(rows, "id string, code string")


@query(f"SELECT DISTINCT 'nommen' AS typed, regexp_extract(p, '([^/#]*)$', 1) AS suggested FROM {_TRIPLES} WHERE p = '{NS}nomen' AND o IS NOT NULL")
def nearest_names(spark: SparkSession, d: str) -> DataFrame:
    names = [A.local(r["p"]) for r in people_graph(spark, d).source.predicates().collect()]  # a row a predicate
    said = A.suggestion("nommen", [n for n in names if n != "cognomen"])
    return spark.createDataFrame([("nommen", n) for n in names if n in said.replace("?", " ").split()], "typed string, suggested string")


@query(f"SELECT 'q:' || k AS prefix, n FROM (SELECT 'nomen' AS k, count(*) AS n FROM {_P} WHERE nomen IS NOT NULL)")
def repaired_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """A query without its PREFIX lines: those that the graph knows are put in before it is parsed."""
    g = people_graph(spark, d)
    text = repair_prefixes("# counts\nSELECT (COUNT(?s) AS ?n) WHERE { ?s q:nomen ?x }", g.prefixes)
    parse(text, {})
    return g.query(text).select(F.lit("q:nomen").alias("prefix"), "n")


@query(
    f"""SELECT id, code FROM (SELECT '1' AS id, 'no-triple' AS code, (SELECT count(*) FROM {_P} WHERE nomen = 'Nobody') AS n UNION ALL SELECT '2', 'filter', (SELECT count(*) FROM {_P} WHERE era_from > 9000)
    UNION ALL SELECT '3', 'bc-sign', (SELECT count(*) FROM {_P} WHERE era_from = 9999)) WHERE n = 0"""
)
def empty_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Why queries find nothing: a triple that matches nothing, a filter, a year without its sign."""
    schema, _ = _schema(spark, d)
    schema[NS + "Person"].properties[NS + "eraFrom"].comment = "negative numbers are BC"
    g = people_graph(spark, d)
    cases = [("1", 'SELECT ?s WHERE { ?s a q:Person ; q:nomen "Nobody" }', "no-triple"), ("2", "SELECT ?s WHERE { ?s q:eraFrom ?a FILTER(?a > 9000) }", "filter"), ("3", "SELECT ?s WHERE { ?s q:eraFrom ?a FILTER(?a = 9999) }", "bc-sign")]
    found = [(i, code) for i, text, code in cases if any(h.code == code for h in A.run_sparql(g, text, schema).diagnosis)]
    return spark.createDataFrame(found, "id string, code string")


@query("SELECT x AS query FROM (VALUES ('none'), ('some')) t(x) WHERE CASE x WHEN 'none' THEN (SELECT count(*) FROM dprr_persons WHERE nomen = 'Nobody') ELSE (SELECT count(*) FROM dprr_persons WHERE nomen IS NOT NULL) END = 0")
def empty_result_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of queries without a result, read back."""
    from quern.runtime import checkpoint_dir

    import uuid
    from pathlib import Path

    g = people_graph(spark, d)
    path = Path(checkpoint_dir(spark).removeprefix("file:")) / f"quern-log-{uuid.uuid4().hex}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    for name, text in (("none", 'SELECT ?none WHERE { ?none q:nomen "Nobody" }'), ("some", "SELECT ?some WHERE { ?some q:nomen ?n }")):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            A.run_sparql(g, text, budget_ms=0, log=path)
    if not path.exists():
        return spark.createDataFrame([], "query string")
    return spark.read.schema("query string").json(f"file:{path}").select(F.regexp_extract("query", r"SELECT \?(\w+)", 1).alias("query"))


_ = catalog
