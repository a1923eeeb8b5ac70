"""The engine's queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import onomastics as N
from quern.functions import text as X
from quern.operators import linkage as L
from quern.operators import profile as P
from quern.operators import relational as R
from quern.operators import resolve as E
from quern.operators import search as Q
from quern.operators.closure import transitive_closure
from quern.operators.components import cluster_links
from quern.operators.inference import materialize
from quern.plans.engine import Graph, compress_iri, expand_iri, local_name, prefer_language
from quern.plans.syntax import RDFS, SKOS, TYPE
from quern.sources.graphs import QUADS, Column_, MappedSource, QuadSource, Table
from quern.sources.sessions import event_uris, session_summary
from quern.streaming import sessionized, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

NS = "http://quern.example/"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def mapped(spark: SparkSession, d: str) -> Graph:
    """The relational tables as one graph: classes Region, Nation, Customer, Supplier, Part, Order, Line, Event, Doc, Person, Post, Place."""
    t = lambda n: table(spark, d, n)
    c = lambda col, ref=None: Column_(col, f"{NS}{ref}/" if ref else None)

    def make(name: str, cls: str, key, cols: dict[str, Column_], rows: float, template: str | None = None, df: DataFrame | None = None) -> Table:
        return Table(df if df is not None else t(name), NS + cls, f"{NS}{cls.lower()}/" if template is None else template, key, {NS + k: v for k, v in cols.items()}, rows)

    line_key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return Graph(
        MappedSource(
            spark,
            [
                make("region", "Region", "r_regionkey", {"regionName": c("r_name")}, 5),
                make("nation", "Nation", "n_nationkey", {"nationName": c("n_name"), "region": c("n_regionkey", "region")}, 25),
                make("customer", "Customer", "c_custkey", {"customerName": c("c_name"), "nation": c("c_nationkey", "nation"), "balance": c("c_acctbal"), "segment": c("c_mktsegment")}, 1.5e5),
                make("supplier", "Supplier", "s_suppkey", {"supplierName": c("s_name"), "nation": c("s_nationkey", "nation"), "balance": c("s_acctbal")}, 1e4),
                make("part", "Part", "p_partkey", {"partName": c("p_name"), "brand": c("p_brand"), "partType": c("p_type"), "size": c("p_size"), "price": c("p_retailprice")}, 2e5),
                make("orders", "Order", "o_orderkey", {"customer": c("o_custkey", "customer"), "status": c("o_orderstatus"), "total": c("o_totalprice"), "orderDate": c("o_orderdate"), "priority": c("o_orderpriority")}, 1.5e6),
                make("lineitem", "Line", line_key, {"order": c("l_orderkey", "order"), "part": c("l_partkey", "part"), "supplier": c("l_suppkey", "supplier"), "quantity": c("l_quantity"), "extended": c("l_extendedprice"), "discount": c("l_discount"), "returnFlag": c("l_returnflag"), "lineStatus": c("l_linestatus")}, 6e6),
                make("events", "Event", "event_id", {"user": c("user_id"), "eventType": c("event_type"), "value": c("value")}, 1e6),
                make("documents", "Doc", "doc_id", {"docLang": c("lang"), "docSource": c("source"), "chars": c("n_chars")}, 1e5),
            ],
        ),
        {"q": NS},
    )


def sparql(text: str, sql: str | None, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return mapped(spark, d).query(text)

    run.__name__ = name
    query(sql)(run)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _queries["minimum_slice"](spark, d)


# -- graph patterns over mapped tables
sparql(
    "SELECT ?n (COUNT(DISTINCT ?c) AS ?k) WHERE { ?c a q:Customer ; q:nation ?n . ?o q:customer ?c ; q:total ?t . FILTER(?t > 1000) } GROUP BY ?n ORDER BY DESC(?k) ?n LIMIT 10",
    f"SELECT '{NS}nation/' || c_nationkey AS n, count(DISTINCT c_custkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_nationkey ORDER BY k DESC, n LIMIT 10",
    "minimum_slice",
)
sparql("SELECT ?c ?name ?b ?s WHERE { ?c a q:Customer ; q:customerName ?name ; q:balance ?b ; q:segment ?s }", f"SELECT '{NS}customer/' || c_custkey AS c, c_name AS name, c_acctbal AS b, c_mktsegment AS s FROM customer WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL", "bgp_star")
sparql(
    "SELECT ?r ?n ?o ?t WHERE { ?o q:customer ?c ; q:total ?t . ?c q:nation ?x . ?x q:nationName ?n ; q:region ?y . ?y q:regionName ?r }",
    f"SELECT r_name AS r, n_name AS n, '{NS}order/' || o_orderkey AS o, o_totalprice AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "bgp_chain",
)
sparql("SELECT ?c ?o ?t WHERE { ?c a q:Customer OPTIONAL { ?o q:customer ?c ; q:total ?t } }", f"SELECT '{NS}customer/' || c_custkey AS c, '{NS}order/' || o_orderkey AS o, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey", "optional_left")
sparql(
    "SELECT ?p ?l ?s WHERE { ?p a q:Part OPTIONAL { ?l q:part ?p ; q:quantity ?k ; q:supplier ?x . ?x q:supplierName ?s FILTER(?k >= 49) } }",
    f"SELECT '{NS}part/' || p_partkey AS p, '{NS}line/' || l_orderkey || '-' || l_linenumber AS l, s_name AS s FROM part LEFT JOIN (lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_quantity >= 49) ON l_partkey = p_partkey",
    "optional_multi",
)
sparql(
    "SELECT ?c ?b ?o WHERE { ?c a q:Customer ; q:balance ?b OPTIONAL { ?o q:customer ?c ; q:total ?t FILTER(?t > ?b * 30) } }",
    f"SELECT '{NS}customer/' || c_custkey AS c, c_acctbal AS b, '{NS}order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 30 WHERE c_acctbal IS NOT NULL",
    "optional_filter",
)
sparql("SELECT ?x ?n WHERE { { ?x q:customerName ?n } UNION { ?x q:supplierName ?n } }", f"SELECT '{NS}customer/' || c_custkey AS x, c_name AS n FROM customer WHERE c_name IS NOT NULL UNION ALL SELECT '{NS}supplier/' || s_suppkey, s_name FROM supplier WHERE s_name IS NOT NULL", "union_bag")
sparql("SELECT DISTINCT ?b WHERE { { ?x q:brand ?b } UNION { ?x q:partType ?b } }", "SELECT p_brand AS b FROM part WHERE p_brand IS NOT NULL UNION SELECT p_type FROM part WHERE p_type IS NOT NULL", "union_distinct")
sparql("SELECT ?c ?n ?b WHERE { { ?c q:customerName ?n } UNION { ?c q:balance ?b . ?c a q:Supplier } }", f"SELECT '{NS}customer/' || c_custkey AS c, c_name AS n, NULL AS b FROM customer WHERE c_name IS NOT NULL UNION ALL SELECT '{NS}supplier/' || s_suppkey, NULL, s_acctbal FROM supplier WHERE s_acctbal IS NOT NULL", "union_unbound")
sparql(f"SELECT ?n ?name WHERE {{ VALUES ?n {{ <{NS}nation/3> <{NS}nation/7> <{NS}nation/99> }} ?n q:nationName ?name }}", f"SELECT '{NS}nation/' || n_nationkey AS n, n_name AS name FROM nation WHERE n_nationkey IN (3, 7, 99)", "values_join")
sparql(f'SELECT ?c ?s WHERE {{ VALUES (?s ?n) {{ ("BUILDING" <{NS}nation/1>) ("MACHINERY" UNDEF) }} ?c q:segment ?s ; q:nation ?n }}', f"SELECT '{NS}customer/' || c_custkey AS c, c_mktsegment AS s FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey = 1) OR (c_mktsegment = 'MACHINERY' AND c_nationkey IS NOT NULL)", "values_undef")
sparql("SELECT ?c WHERE { ?c a q:Customer FILTER EXISTS { ?o q:customer ?c ; q:total ?t FILTER(?t > 300000) } }", f"SELECT '{NS}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "exists_semi")
sparql("SELECT ?c WHERE { ?c a q:Customer FILTER NOT EXISTS { ?o q:customer ?c ; q:total ?t FILTER(?t > 300000) } }", f"SELECT '{NS}customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "not_exists_anti")
sparql(
    "SELECT ?c ?b WHERE { ?c a q:Customer ; q:balance ?b FILTER(?b > 9000 || EXISTS { ?o q:customer ?c ; q:total ?t FILTER(?t > ?b * 90) }) }",
    f"SELECT '{NS}customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 OR (c_acctbal IS NOT NULL AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 90))",
    "exists_in_or",
)
sparql("SELECT ?p WHERE { ?p a q:Part MINUS { ?l q:part ?p ; q:quantity ?k FILTER(?k > 48) } }", f"SELECT '{NS}part/' || p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)", "minus_anti")
sparql('SELECT ?p ?b WHERE { ?p q:brand ?b FILTER(?b IN ("Brand#11", "Brand#12", "Brand#23")) }', f"SELECT '{NS}part/' || p_partkey AS p, p_brand AS b FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')", "filter_in")
sparql('SELECT ?p ?t WHERE { ?p q:partType ?t FILTER(CONTAINS(LCASE(?t), "m") && !STRSTARTS(?t, "SMALL")) }', f"SELECT '{NS}part/' || p_partkey AS p, p_type AS t FROM part WHERE contains(lower(p_type), 'm') AND NOT starts_with(p_type, 'SMALL')", "filter_string")
sparql('SELECT ?p ?n WHERE { ?p q:partName ?n FILTER REGEX(?n, "^(RED|BLUE) .*t$", "i") }', f"SELECT '{NS}part/' || p_partkey AS p, p_name AS n FROM part WHERE regexp_matches(p_name, '^(RED|BLUE) .*t$', 'i')", "filter_regex")
sparql("SELECT ?p ?z ?r WHERE { ?p q:size ?z ; q:price ?r FILTER(?z >= 10 && ?z < 20 && (?r > 1500 || ?r <= 1000)) }", f"SELECT '{NS}part/' || p_partkey AS p, p_size AS z, p_retailprice AS r FROM part WHERE p_size >= 10 AND p_size < 20 AND (p_retailprice > 1500 OR p_retailprice <= 1000)", "filter_numeric")
sparql("SELECT ?x WHERE { ?x a q:Doc FILTER NOT EXISTS { ?x q:docLang ?l } }", f"SELECT '{NS}doc/' || doc_id AS x FROM documents WHERE lang IS NULL", "filter_open_world")
sparql("SELECT ?x (BOUND(?l) AS ?known) (COALESCE(?l, \"none\") AS ?lang) WHERE { ?x a q:Doc OPTIONAL { ?x q:docLang ?l } }", f"SELECT '{NS}doc/' || doc_id AS x, lang IS NOT NULL AS known, coalesce(lang, 'none') AS lang FROM documents", "bound_coalesce")
sparql(
    'SELECT ?w (COUNT(?o) AS ?n) WHERE { ?o q:total ?t BIND(IF(?t > 200000, "large", IF(?t > 100000, "middle", "small")) AS ?w) } GROUP BY ?w',
    "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS w, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1",
    "bind_if_group",
)
sparql("SELECT (COUNT(DISTINCT ?s) AS ?n) (COUNT(*) AS ?rows) WHERE { ?l q:supplier ?s }", "SELECT count(DISTINCT l_suppkey) AS n, count(*) AS rows FROM lineitem WHERE l_suppkey IS NOT NULL", "group_count_distinct")
sparql(
    "SELECT ?f ?s (COUNT(?l) AS ?n) (SUM(?q) AS ?qty) (ROUND(AVG(?e)) AS ?mean) (MIN(?d) AS ?lo) (MAX(?d) AS ?hi) WHERE { ?l q:returnFlag ?f ; q:lineStatus ?s ; q:quantity ?q ; q:extended ?e ; q:discount ?d } GROUP BY ?f ?s",
    "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS qty, floor(avg(l_extendedprice) + 0.5)::BIGINT AS mean, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1, 2",
    "group_multi_agg",
)
sparql("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o q:customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 20)", f"SELECT '{NS}customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 20", "having")
sparql("SELECT ?f (SAMPLE(?p) AS ?one) (GROUP_CONCAT(DISTINCT ?s; SEPARATOR=\"|\") AS ?all) WHERE { ?l q:returnFlag ?f ; q:part ?p ; q:lineStatus ?s } GROUP BY ?f", f"SELECT l_returnflag AS f, '{NS}part/' || min(l_partkey) AS one, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS all FROM lineitem GROUP BY 1", "sample_concat")
sparql(
    "SELECT ?a ?b ?c WHERE { ?a q:customer ?c ; q:status ?s ; q:priority ?p . ?b q:customer ?c ; q:status ?s ; q:priority ?p FILTER(STR(?a) < STR(?b)) }",
    f"SELECT '{NS}order/' || a.o_orderkey AS a, '{NS}order/' || b.o_orderkey AS b, '{NS}customer/' || a.o_custkey AS c FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey::VARCHAR < b.o_orderkey::VARCHAR",
    "self_join_theta",
)
sparql("SELECT ?o ?t WHERE { ?o q:total ?t } ORDER BY DESC(?t) ?o LIMIT 25", f"SELECT '{NS}order/' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o LIMIT 25", "order_limit_topk")
sparql("SELECT ?n WHERE { ?c q:customerName ?n } ORDER BY ?n LIMIT 20 OFFSET 40", "SELECT c_name AS n FROM customer ORDER BY c_name LIMIT 20 OFFSET 40", "offset_page")
sparql("SELECT ?c ?r WHERE { ?c a q:Customer ; q:nation/q:region/q:regionName ?r }", f"SELECT '{NS}customer/' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", "path_sequence")
sparql(f"SELECT ?s WHERE {{ <{NS}nation/4> ^q:nation ?s . ?s a q:Supplier }}", f"SELECT '{NS}supplier/' || s_suppkey AS s FROM supplier WHERE s_nationkey = 4", "path_inverse")
sparql("SELECT ?x ?v WHERE { ?x q:customerName|q:supplierName ?v }", f"SELECT '{NS}customer/' || c_custkey AS x, c_name AS v FROM customer UNION ALL SELECT '{NS}supplier/' || s_suppkey, s_name FROM supplier", "path_alternative")
sparql(f"SELECT ?p ?v WHERE {{ <{NS}part/7> ?p ?v }}", f"SELECT '{NS}' || k AS p, v FROM (SELECT unnest(['partName', 'brand', 'partType', 'size', 'price']) AS k, unnest([p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR]) AS v FROM part WHERE p_partkey = 7) UNION ALL SELECT '{TYPE}', '{NS}Part'", "describe_subject")
sparql("SELECT ?n ?k ?m WHERE { { SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c a q:Customer ; q:nation ?n } GROUP BY ?n } ?n q:nationName ?m }", f"SELECT '{NS}nation/' || c_nationkey AS n, count(*) AS k, n_name AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, n_name", "subselect")
sparql(
    'SELECT ?p (STRLEN(?n) AS ?len) (UCASE(SUBSTR(?n, 1, 4)) AS ?head) (CONCAT(?b, "/", STR(?z)) AS ?key) (STRAFTER(?b, "#") AS ?no) (STRBEFORE(?b, "#") AS ?word) (REPLACE(?t, "[AEIOU]", "*") AS ?masked) WHERE { ?p q:partName ?n ; q:brand ?b ; q:size ?z ; q:partType ?t }',
    f"SELECT '{NS}part/' || p_partkey AS p, length(p_name) AS len, upper(substr(p_name, 1, 4)) AS head, p_brand || '/' || p_size AS key, split_part(p_brand, '#', 2) AS no, split_part(p_brand, '#', 1) AS word, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS masked FROM part",
    "string_functions",
)
sparql(
    "SELECT ?p (ABS(?z - 25) AS ?a) (CEIL(?r) AS ?up) (FLOOR(?r) AS ?down) (?z * 2 + 1 AS ?odd) (<http://www.w3.org/2001/XMLSchema#integer>(STRAFTER(?b, \"#\")) AS ?no) WHERE { ?p q:size ?z ; q:price ?r ; q:brand ?b }".replace("(?z * 2 + 1 AS ?odd)", "((?z * 2 + 1) AS ?odd)"),
    f"SELECT '{NS}part/' || p_partkey AS p, abs(p_size - 25) AS a, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down, p_size * 2 + 1 AS odd, try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS no FROM part",
    "numeric_functions",
)


# -- stored quads
def _quads(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], QUADS).unionByName(df)


def lines_graph(spark: SparkSession, d: str) -> DataFrame:
    """Places and people as quads, what is said about people in named graphs by office."""
    p = table(spark, d, "dprr_persons").distinct()
    lit = lambda pred, col, dt="string": F.struct(F.lit(NS + pred).alias("p"), F.col(col).cast("string").alias("o"), F.lit("lit").alias("o_kind"), F.lit(f"http://www.w3.org/2001/XMLSchema#{dt}").alias("o_dt"))
    kind = F.struct(F.lit(TYPE).alias("p"), F.lit(NS + "Person").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))
    rows = p.select(F.col("dprr_uri").alias("s"), F.when(F.col("highest_office").isNotNull(), F.concat(F.lit(f"{NS}office/"), F.replace("highest_office", F.lit(" "), F.lit("_")))).alias("og"), F.explode(F.array(kind, lit("nomen", "nomen"), lit("cognomen", "cognomen"), lit("office", "highest_office"), lit("eraFrom", "era_from", "integer"), lit("eraTo", "era_to", "integer"))).alias("c")).where("c.o is not null")
    g = F.when(F.col("c.p") == NS + "office", F.col("og"))
    return _quads(rows.select(g.alias("g"), "s", F.lit("iri").alias("s_kind"), F.col("c.p").alias("p"), F.col("c.o").alias("o"), F.col("c.o_kind").alias("o_kind"), F.col("c.o_dt").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")))


def people_graph(spark: SparkSession, d: str) -> Graph:
    return Graph(QuadSource(lines_graph(spark, d)), {"q": NS})


def quad_sparql(text: str, sql: str | None, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return people_graph(spark, d).query(text)

    run.__name__ = name
    query(sql)(run)


_P = "(SELECT DISTINCT dprr_uri, nomen, cognomen, highest_office, era_from, era_to FROM dprr_persons)"
quad_sparql("SELECT ?s ?n ?a WHERE { ?s a q:Person ; q:nomen ?n ; q:eraFrom ?a FILTER(?a < -100) }", f"SELECT dprr_uri AS s, nomen AS n, era_from::VARCHAR AS a FROM {_P} WHERE era_from < -100 AND nomen IS NOT NULL", "quads_typed_filter")
quad_sparql("SELECT ?g ?s WHERE { GRAPH ?g { ?s q:office ?o } }", f"SELECT '{NS}office/' || replace(highest_office, ' ', '_') AS g, dprr_uri AS s FROM {_P} WHERE highest_office IS NOT NULL", "graph_variable")
quad_sparql(f"SELECT ?s WHERE {{ GRAPH <{NS}office/consul> {{ ?s q:office ?o }} }}", f"SELECT dprr_uri AS s FROM {_P} WHERE highest_office = 'consul'", "graph_constant")
quad_sparql(
    "SELECT ?s ?c ?b WHERE { ?s a q:Person OPTIONAL { ?s q:cognomen ?c } OPTIONAL { ?s q:eraTo ?b } } ORDER BY ?s",
    f"SELECT dprr_uri AS s, cognomen AS c, era_to::VARCHAR AS b FROM {_P}", "quads_optional",
)
quad_sparql("SELECT ?s ?x WHERE { { ?s q:nomen ?x } UNION { ?s q:cognomen ?x } }", f"SELECT dprr_uri AS s, nomen AS x FROM {_P} WHERE nomen IS NOT NULL UNION ALL SELECT dprr_uri, cognomen FROM {_P} WHERE cognomen IS NOT NULL", "union_same_subject")
quad_sparql("SELECT ?s WHERE { ?s q:nomen ?x . ?s q:cognomen ?y FILTER(STRENDS(?x, \"ius\") && isLiteral(?y) && DATATYPE(?y) = <http://www.w3.org/2001/XMLSchema#string>) }", f"SELECT dprr_uri AS s FROM {_P} WHERE nomen LIKE '%ius' AND cognomen IS NOT NULL", "term_tests")
quad_sparql(
    "SELECT ?n (COUNT(?s) AS ?k) (MIN(?a) AS ?lo) WHERE { ?s q:nomen ?n OPTIONAL { ?s q:eraFrom ?a } } GROUP BY ?n",
    f"SELECT nomen AS n, count(*) AS k, min(era_from)::VARCHAR AS lo FROM {_P} WHERE nomen IS NOT NULL GROUP BY nomen", "quads_group",
)
quad_sparql(
    "SELECT ?a ?b WHERE { ?a q:nomen ?n ; q:cognomen ?c . ?b q:nomen ?n ; q:cognomen ?c FILTER(STR(?a) < STR(?b)) }",
    f"SELECT a.dprr_uri AS a, b.dprr_uri AS b FROM {_P} a JOIN {_P} b ON a.nomen = b.nomen AND a.cognomen = b.cognomen AND a.dprr_uri < b.dprr_uri", "namesakes",
)



@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey // 2 > 0),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS src, b AS dst FROM r"""
)
def path_plus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")).where("dst > 0")
    return transitive_closure(e)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS a, doc_id - doc_id % 7 AS b FROM documents WHERE doc_id % 7 <> 0 UNION SELECT doc_id, doc_id - 91 FROM documents WHERE doc_id % 91 = 0 AND doc_id > 91),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, c) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT x.b, r.c FROM r JOIN both_ways x ON x.a = r.id WHERE r.c < x.b)
    SELECT id, min(c) AS cluster FROM r GROUP BY id"""
)
def sameas_components(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id")
    near = n.where("doc_id % 7 <> 0").selectExpr("doc_id as a", "doc_id - doc_id % 7 as b")
    far = n.where("doc_id % 91 = 0 and doc_id > 91").selectExpr("doc_id as a", "doc_id - 91 as b")
    return cluster_links(near.unionByName(far), "a", "b")


# -- names and terms
@query(f"SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'qn:' || n_nationkey ELSE 'q:other/' || n_nationkey END AS short FROM nation")
def prefix_compress(spark: SparkSession, d: str) -> DataFrame:
    iri = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit(f"{NS}nation/")).otherwise(F.lit(f"{NS}other/")), "n_nationkey")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), compress_iri(iri, {"q": NS, "qn": f"{NS}nation/"}).alias("short"))


@query(f"SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '{NS}nation/' || n_nationkey ELSE 'zz:' || n_nationkey END AS full_iri FROM nation")
def prefix_expand(spark: SparkSession, d: str) -> DataFrame:
    short = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("qn:")).otherwise(F.lit("zz:")), "n_nationkey")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), expand_iri(short, [{"q": NS}, {"qn": f"{NS}nation/"}]).alias("full_iri"))


@query("SELECT place_uri, regexp_extract(place_uri, '([^/#]*)$', 1) AS name FROM (SELECT DISTINCT place_uri FROM places)")
def local_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "places").select("place_uri").distinct().select("place_uri", local_name(F.col("place_uri")).alias("name"))


@query(
    """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE coalesce(lang, '') WHEN 'en' THEN 0 WHEN '' THEN 1 WHEN 'la' THEN 2 ELSE 3 END, doc_id) AS n FROM documents) WHERE n = 1"""
)
def lang_preference(spark: SparkSession, d: str) -> DataFrame:
    return prefer_language(table(spark, d, "documents").select("source", "doc_id", "lang"), {"doc_id": "lang"}, ["source"], ["doc_id"]).select("source", "doc_id")




@query("SELECT dprr_uri, CASE WHEN era_from IS NULL AND era_to IS NULL THEN NULL ELSE coalesce(CASE WHEN era_from < 0 THEN abs(era_from) || ' BC' ELSE era_from || ' AD' END, '?') || '–' || coalesce(CASE WHEN era_to < 0 THEN abs(era_to) || ' BC' ELSE era_to || ' AD' END, '?') END AS era FROM (SELECT DISTINCT dprr_uri, era_from, era_to FROM dprr_persons)")
def era_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dprr_persons").select("dprr_uri", "era_from", "era_to").distinct().select("dprr_uri", X.era_label(F.col("era_from"), F.col("era_to")).alias("era"))


@query("SELECT dprr_uri, regexp_replace(dprr_label, '^\\S+ ', '') AS label, 'person:' || replace(replace(lower(dprr_label), ' ', '_'), '.', '') AS slug FROM (SELECT DISTINCT dprr_uri, dprr_label FROM dprr_persons)")
def label_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dprr_persons").select("dprr_uri", "dprr_label").distinct().select("dprr_uri", X.drop_code(F.col("dprr_label")).alias("label"), X.slug(F.col("dprr_label")).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS shown FROM documents")
def truncated_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text"), 100).alias("shown"))


@query("SELECT o_orderkey AS k, CASE WHEN y < 0 THEN '-' || lpad((-y)::VARCHAR, 4, '0') ELSE lpad(y::VARCHAR, 4, '0') END AS padded FROM (SELECT o_orderkey, (o_orderkey % 900 - 450)::INT AS y FROM orders)")
def year_padding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), X.pad_year((F.col("o_orderkey") % 900 - 450).cast("string")).alias("padded"))




@query(
    """SELECT filiation, CASE regexp_extract(filiation, '^(\\S+) f\\.$', 1) WHEN 'A.' THEN 'aulus' WHEN 'Ap.' THEN 'appius' WHEN 'C.' THEN 'gaius' WHEN 'Cn.' THEN 'gnaeus' WHEN 'D.' THEN 'decimus' WHEN 'L.' THEN 'lucius' WHEN 'M.' THEN 'marcus'
    WHEN 'M''.' THEN 'manius' WHEN 'N.' THEN 'numerius' WHEN 'P.' THEN 'publius' WHEN 'Q.' THEN 'quintus' WHEN 'Ser.' THEN 'servius' WHEN 'Sex.' THEN 'sextus' WHEN 'Sp.' THEN 'spurius' WHEN 'T.' THEN 'titus' WHEN 'Ti.' THEN 'tiberius' END AS father
    FROM (SELECT DISTINCT filiation FROM dprr_persons WHERE filiation IS NOT NULL)"""
)
def filiations(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "dprr_persons").select("filiation").where("filiation is not null").distinct()
    return f.select("filiation", N.parse_filiation(F.col("filiation"))["father"].alias("father"))


@query("SELECT post_id, office, CASE WHEN office IN ('consul', 'praetor', 'quaestor', 'aedilis', 'tribunus plebis', 'proconsul', 'propraetor', 'legatus') THEN office END AS known FROM (SELECT DISTINCT post_id, office FROM post_assertions)")
def offices_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "post_assertions").select("post_id", "office").distinct().select("post_id", "office", N.normalize_office(F.col("office")).alias("known"))




# -- profiles and schemas
def _mapped_quads(spark: SparkSession, d: str) -> DataFrame:
    return lines_graph(spark, d)


_TRIPLES = f"""(SELECT dprr_uri AS s, unnest(['{TYPE}', '{NS}nomen', '{NS}cognomen', '{NS}office', '{NS}eraFrom', '{NS}eraTo']) AS p, unnest(['{NS}Person', nomen, cognomen, highest_office, era_from::VARCHAR, era_to::VARCHAR]) AS o FROM {_P})"""


@query(f"SELECT count(*) AS triples, count(DISTINCT s) AS entities, count(DISTINCT CASE WHEN p = '{TYPE}' THEN o END) AS classes, count(DISTINCT p) AS properties FROM {_TRIPLES} WHERE o IS NOT NULL")
def void_totals(spark: SparkSession, d: str) -> DataFrame:
    return P.void_totals(_mapped_quads(spark, d))


@query(f"SELECT o AS class, count(DISTINCT s) AS entities FROM {_TRIPLES} WHERE p = '{TYPE}' GROUP BY o")
def void_class_partition(spark: SparkSession, d: str) -> DataFrame:
    return P.void_classes(_mapped_quads(spark, d))


@query(f"SELECT p AS property, count(*) AS triples, count(DISTINCT s) AS distinct_subjects, count(DISTINCT o) AS distinct_objects FROM {_TRIPLES} WHERE o IS NOT NULL GROUP BY p")
def void_property_partition(spark: SparkSession, d: str) -> DataFrame:
    return P.void_properties(_mapped_quads(spark, d))



@query(
    f"""SELECT '{NS}Person' AS class, p AS property, CASE WHEN p IN ('{NS}eraFrom', '{NS}eraTo') THEN 'http://www.w3.org/2001/XMLSchema#integer' ELSE 'http://www.w3.org/2001/XMLSchema#string' END AS range, count(*) AS uses
    FROM {_TRIPLES} WHERE o IS NOT NULL AND p <> '{TYPE}' GROUP BY p"""
)
def schema_extract(spark: SparkSession, d: str) -> DataFrame:
    return P.extract_schema(_mapped_quads(spark, d))



def _axioms(spark: SparkSession, pairs: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(None, s, "iri", p, o, "iri", None, None) for s, p, o in pairs], QUADS)


@query(f"SELECT dprr_uri AS s, p, nomen AS o FROM {_P}, (SELECT unnest(['{RDFS}label', '{NS}namePart']) AS p) WHERE nomen IS NOT NULL")
def rdfs_subproperty(spark: SparkSession, d: str) -> DataFrame:
    rules = _axioms(spark, [(NS + "nomen", RDFS + "subPropertyOf", NS + "namePart"), (NS + "namePart", RDFS + "subPropertyOf", RDFS + "label")])
    made = materialize(lines_graph(spark, d).unionByName(rules))
    return made.where(F.col("p").isin(NS + "namePart", RDFS + "label")).select("s", "p", "o")


@query(f"SELECT dprr_uri AS s, o FROM {_P}, (SELECT unnest(['{NS}Agent', '{NS}Thing']) AS o)")
def rdfs_subclass(spark: SparkSession, d: str) -> DataFrame:
    rules = _axioms(spark, [(NS + "Person", RDFS + "subClassOf", NS + "Agent"), (NS + "Agent", RDFS + "subClassOf", NS + "Thing")])
    return materialize(lines_graph(spark, d).unionByName(rules)).where(F.col("p") == TYPE).select("s", "o")


# -- search
_BM25 = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) * 1.0 / (SELECT count(*) FROM documents) AS avg),
hit AS (SELECT q, doc_id, count(*) AS tf FROM w JOIN (SELECT unnest([{terms}]) AS q) ON starts_with(term, q) GROUP BY 1, 2),
df AS (SELECT q, count(*) AS df FROM hit GROUP BY 1),
sc AS (SELECT doc_id AS id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score, count(*) AS k FROM hit JOIN df USING (q) JOIN len USING (doc_id), st GROUP BY 1)
SELECT id, round(score, 6) AS score FROM sc {where} ORDER BY sc.score DESC, id LIMIT {limit}"""


def _search(spark: SparkSession, d: str, text: str, k: int, every: bool = False) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("dataset"))
    index = Q.TextIndex.stored(docs, "doc_id", "text", False, ("dataset",))  # built once for all queries over these documents
    return index.search(text, k, every).select("id", F.round("score", 6).alias("score"))


@query(_BM25.format(terms="'harbour', 'mint', 'stone'", where="", limit=20))
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "harbour mint stone", 20)


@query(_BM25.format(terms="'ston', 'kept'", where="WHERE k = 2", limit=15))
def prefix_and_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "ston kept", 15, True)


@query()
def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return Q.TextIndex(docs, "doc_id", "text").search("dated inscriptions", 20)


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"])


@query(f"SELECT b.vec_id AS id, round(1 - {_COS}, 6) + 0.0 AS distance FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b ORDER BY 1 - {_COS}, b.vec_id LIMIT 10")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    near = Q.knn(table(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding")
    return near.select("id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))



@query(f"SELECT left_id, right_id FROM (SELECT a.vec_id AS left_id, b.vec_id AS right_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS n, {_COS} AS c FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE n <= 5 AND c >= 0.1")
def similarity_topk_join(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return Q.similarity_join(v.where("id % 20 = 0"), v, 5, 0.1).select("left_id", "right_id")


@query("SELECT source, floor((rn - 1) / 50)::BIGINT AS chunk, string_agg(doc_id::VARCHAR, ', ' ORDER BY rn) AS text FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY 1, 2")
def text_chunk_concat(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.col("doc_id"), F.col("doc_id").cast("string").alias("t"))
    return R.chunks(docs, ["source"], [F.col("doc_id").asc()], "t", 50)


# -- resolution
@query(
    """WITH m AS (SELECT DISTINCT match_id, signals FROM candidate_matches WHERE signals IS NOT NULL), x AS (SELECT match_id, unnest(map_values(signals)) AS s FROM m)
    SELECT match_id, round(sum(CASE WHEN s.is_absent THEN 0 ELSE s.weight * s.score END) / sum(s.weight), 6) AS score FROM x GROUP BY match_id HAVING sum(s.weight) > 0"""
)
def weighted_signal_score(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "candidate_matches").where("signals is not null").select("match_id", F.map_values("signals").alias("s"))
    return m.dropDuplicates(["match_id"]).where(F.size("s") > 0).select("match_id", F.round(R.weighted_score(F.col("s")), 6).alias("score"))


@query(
    """WITH s AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal / 10000 AS score FROM supplier), r AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0) AS gap FROM s WINDOW w AS (PARTITION BY k ORDER BY score DESC, id))
    SELECT k, id, rank, round(gap, 6) AS gap, CASE WHEN score >= 0.7 AND gap >= 0.2 THEN 'strong' WHEN score >= 0.5 AND gap >= 0.1 THEN 'probable' ELSE 'ambiguous' END AS confidence FROM r WHERE rank <= 10"""
)
def rank_gap_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("score"))
    return R.rank_with_gap(s, ["k"], "score", [F.col("id").asc()]).select("k", "id", "rank", F.round("gap", 6).alias("gap"), "confidence")


@query(
    """WITH l AS (SELECT DISTINCT context_id AS id, lower(praenomen) AS p, lower(cognomen) AS c, lower(nomen) AS n FROM person_contexts WHERE length(nomen) > 2), k AS (SELECT *, n AS key FROM l UNION SELECT *, n[:-2] || 'us' FROM l WHERE n LIKE '%ia'),
    r AS (SELECT DISTINCT dprr_uri AS rid, lower(praenomen) AS rp, lower(cognomen) AS rc, lower(nomen) AS key FROM dprr_persons),
    s AS (SELECT id, rid, 1 + CASE WHEN p IS NULL OR rp IS NULL THEN 0 WHEN p = rp THEN 2 END + CASE WHEN c IS NULL OR rc IS NULL THEN 0 WHEN c = rc THEN 2 WHEN contains(c, rc) OR contains(rc, c) THEN 1 END AS score FROM k JOIN r USING (key))
    SELECT id AS l_id, rid AS r_id, max(score) AS score FROM s WHERE score >= 5 GROUP BY 1, 2"""
)
def blocking_name_match(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "person_contexts").select(F.col("context_id").alias("id"), "praenomen", "nomen", "cognomen").distinct()  # noqa: E741
    r = table(spark, d, "dprr_persons").select(F.col("dprr_uri").alias("id"), "praenomen", "nomen", "cognomen").distinct()
    return E.match_names(l, r)



@query(
    """WITH q AS (SELECT DISTINCT dprr_uri, date_start, post_id FROM post_assertions WHERE dprr_uri IS NOT NULL AND date_start IS NOT NULL), p AS (SELECT DISTINCT dprr_uri, era_from FROM dprr_persons WHERE era_from IS NOT NULL)
    SELECT dprr_uri, gap, near, post_id FROM (SELECT dprr_uri, abs(date_start - (era_from + 40)) AS gap, date_start AS near, post_id, row_number() OVER (PARTITION BY dprr_uri ORDER BY abs(date_start - (era_from + 40)), date_start, post_id) AS n FROM p JOIN q USING (dprr_uri)) WHERE n = 1"""
)
def nearest_date_pick(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "post_assertions").where("dprr_uri is not null and date_start is not null").select("dprr_uri", "date_start", "post_id").distinct()
    p = table(spark, d, "dprr_persons").where("era_from is not null").select("dprr_uri", (F.col("era_from") + 40).alias("at")).distinct()
    return R.nearest(p.join(posts, "dprr_uri"), ["dprr_uri"], "at", "date_start", ["post_id"])


@query(
    """WITH c AS (SELECT DISTINCT context_id AS k, date_start AS t, nomen FROM person_contexts WHERE date_start IS NOT NULL AND nomen IS NOT NULL), p AS (SELECT DISTINCT dprr_uri AS id, nomen, coalesce(era_from, era_to) AS lo, coalesce(era_to, era_from) AS hi FROM dprr_persons WHERE coalesce(era_from, era_to) IS NOT NULL),
    d AS (SELECT k, id, CASE WHEN t BETWEEN lo AND hi THEN 0 ELSE least(abs(t - lo), abs(t - hi)) END AS distance FROM c JOIN p USING (nomen)), r AS (SELECT *, row_number() OVER w AS n, lead(distance) OVER w AS second FROM d WINDOW w AS (PARTITION BY k ORDER BY distance, id)),
    b AS (SELECT * FROM r WHERE n = 1 AND CASE WHEN second IS NULL THEN distance <= 50 ELSE distance <= 30 AND second - distance >= 20 END) SELECT k, id, distance FROM b QUALIFY count(*) OVER (PARTITION BY id) = 1"""
)
def margin_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "person_contexts").where("date_start is not null and nomen is not null").select(F.col("context_id").alias("k"), F.col("date_start").alias("t"), "nomen").distinct()
    p = table(spark, d, "dprr_persons").select(F.col("dprr_uri").alias("id"), "nomen", "era_from", "era_to").distinct()
    return E.disambiguate_by_date(c.join(p, "nomen"), "k", "id", "t", "era_from", "era_to").select("k", "id", "distance")


@query("WITH p AS (SELECT DISTINCT o_custkey AS a, o_orderdate AS b FROM orders) SELECT a, b, count(*) OVER (PARTITION BY a) = 1 AND count(*) OVER (PARTITION BY b) = 1 AS only FROM p")
def unique_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderdate").alias("b")).distinct()
    return R.unique_pairs(p, "a", "b", "only")


@query(
    """WITH c AS (SELECT DISTINCT context_id, findspot_uri AS place, date_start AS a0, coalesce(date_end, date_start) AS a1 FROM person_contexts WHERE date_start IS NOT NULL), p AS (SELECT DISTINCT post_id, province_uri AS place, date_start AS b0, coalesce(date_end, date_start) AS b1 FROM post_assertions WHERE date_start IS NOT NULL)
    SELECT context_id, post_id FROM c JOIN p USING (place) WHERE a0 <= b1 AND b0 <= a1 AND a0 <= a1 AND b0 <= b1"""
)
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "person_contexts").where("date_start is not null").select("context_id", F.col("findspot_uri").alias("place"), F.col("date_start").alias("a0"), F.coalesce("date_end", "date_start").alias("a1")).distinct()
    p = table(spark, d, "post_assertions").where("date_start is not null").select("post_id", F.col("province_uri").alias("place"), F.col("date_start").alias("b0"), F.coalesce("date_end", "date_start").alias("b1")).distinct()
    return R.range_join(c, p, "a0", "a1", "b0", "b1", 25, ["place"]).select("context_id", "post_id")


# -- ranking and picking
@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.first_per_key(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()]).select("user_id", "event_id")


@query("SELECT event_type, event_id, n AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS n FROM events) WHERE n <= 10")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.col("value").desc_nulls_last(), F.col("event_id").asc()], 10, "rank").select("event_type", "event_id", "rank")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, value, max(value) OVER (PARTITION BY event_type) AS best FROM events) WHERE value >= 0.3 * best")
def score_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return R.score_cutoff(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value").select("event_type", "event_id")


@query("SELECT dprr_uri, post_id FROM (SELECT dprr_uri, post_id, row_number() OVER (PARTITION BY dprr_uri ORDER BY coalesce(date_start, 0), post_id) AS n FROM (SELECT DISTINCT dprr_uri, post_id, date_start FROM post_assertions WHERE dprr_uri IS NOT NULL)) WHERE n = 1")
def earliest_per_person(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "post_assertions").where("dprr_uri is not null").select("dprr_uri", "post_id", "date_start").distinct()
    return R.earliest_per_key(p, ["dprr_uri"], "date_start", "post_id").select("dprr_uri", "post_id")


@query("SELECT p_brand AS brand, p_partkey AS id, greatest(count(*) OVER (PARTITION BY p_brand) - 5, 0) AS hidden FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5")
def capped_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_retailprice")
    return R.capped_groups(p, ["brand"], [F.col("p_retailprice").desc(), F.col("id").asc()], 5).select("brand", "id", "hidden")


@query("SELECT confidence, count(*) AS n, CASE confidence WHEN 'strong' THEN 1 WHEN 'probable' THEN 2 WHEN 'ambiguous' THEN 3 ELSE 4 END AS place FROM candidate_matches GROUP BY 1")
def confidence_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.counts_in_order(table(spark, d, "candidate_matches"), "confidence", ["strong", "probable", "ambiguous"])


@query("SELECT p_partkey AS id, instr(lower(p_name), 'g') - 1 AS position FROM part WHERE instr(lower(p_name), 'g') > 0")
def substring_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.substring_rank(table(spark, d, "part"), "p_name", "g", [F.col("p_partkey").asc()]).select(F.col("p_partkey").alias("id"), "position")



# -- links
def _links(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    iri = lambda kind, c: F.concat(F.lit(f"http://nomisma.org/id/{kind}"), F.col(c))
    null = F.lit(None).cast("string")
    return o.select(F.col("o_orderkey").cast("string").alias("link_id"), iri("c", "o_custkey").alias("source"), iri("o", "o_orderkey").alias("target"), F.lit(SKOS + "closeMatch").alias("relationship"), F.col("o_orderstatus").alias("confidence"), null.alias("basis"), null.alias("method"), null.alias("note"))


@query(
    """WITH l AS (SELECT 'http://nomisma.org/id/c' || o_custkey AS s, 'http://nomisma.org/id/o' || o_orderkey AS t, o_orderstatus AS c FROM orders), u AS (SELECT 'http://nomisma.org/id/c' || c_custkey AS u FROM customer WHERE c_acctbal > 8000 UNION SELECT 'http://nomisma.org/id/o' || o_orderkey FROM orders WHERE o_totalprice > 300000)
    SELECT u AS uri, t AS target, 'forward' AS direction, c AS confidence FROM l JOIN u ON u = s UNION ALL SELECT u, s, 'reverse', c FROM l JOIN u ON u = t"""
)
def find_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 8000").select(F.concat(F.lit("http://nomisma.org/id/c"), "c_custkey").alias("uri"))
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.concat(F.lit("http://nomisma.org/id/o"), "o_orderkey").alias("uri"))
    return L.find_links(c.unionByName(o), _links(spark, d)).select("uri", "target", "direction", "confidence")


@query(
    """SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY prio, v) AS n FROM (SELECT c_nationkey AS k, 'c' || c_custkey AS v, 0 AS prio FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT s_nationkey, 's' || s_suppkey, 1 FROM supplier)) WHERE n = 1"""
)
def links_first_wins(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"), F.concat(F.lit("c"), "c_custkey").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("s"), "s_suppkey").alias("v"))
    return R.first_wins([a, b], ["k"], [F.col("v").asc()])


@query("SELECT c_nationkey AS k, c_custkey AS v FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def unseen_antijoin(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    return R.append_unseen(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")), ["k"])


@query(
    """WITH u AS (SELECT DISTINCT 'http://nomisma.org/id/c' || o_custkey AS u FROM orders WHERE o_totalprice > 250000 ORDER BY 1 LIMIT 50), l AS (SELECT 'http://nomisma.org/id/c' || o_custkey AS s, 'http://nomisma.org/id/o' || o_orderkey AS t FROM orders)
    SELECT t AS target, min(s) AS uri FROM l JOIN u ON u = s GROUP BY t"""
)
def see_also(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").where("o_totalprice > 250000").select(F.concat(F.lit("http://nomisma.org/id/c"), "o_custkey").alias("c"), F.col("o_orderstatus").alias("status"))
    return L.see_also(r, ["c", "status"], _links(spark, d)).select("target", "uri")


# -- sessions
@query("SELECT user_id AS session_id, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    return session_summary(table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp")))





@query("SELECT event_id, 'http://nomisma.org/id/e' || event_id AS uri FROM events WHERE event_id % 4 IN (0, 1)")
def event_uri_extract(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(F.lit("http://nomisma.org/id/e"), "event_id")
    kind = F.element_at(F.array(*map(F.lit, ["report", "query", "other", "search"])), (F.col("event_id") % 4 + 1).cast("int"))
    data = F.when(kind == "report", F.concat(F.lit('{"markdown": "see ('), u, F.lit(') and http://unknown.example/x"}'))).when(kind == "query", F.concat(F.lit('{"rows": [{"a": "'), u, F.lit('", "b": "plain"}]}'))).otherwise(F.lit('{"results": [{"uri": "http://unknown.example/y"}]}'))
    return table(spark, d, "events").select("event_id", F.explode(event_uris(kind, data)).alias("uri"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"), "1 day", at="ts", kind="event_type").select("start", "event_type", "n")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionized(table(spark, d, "events"), "6 hours", at="ts", key="user_id").select("user_id", "start", "n")


def _everything() -> None:
    """The other modules of the catalogue add theirs when they are imported."""
    from quern import catalog_graph, catalog_io, catalog_records  # noqa: F401


def queries() -> dict[str, Query]:
    _everything()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _everything()
    return dict(_sql)
