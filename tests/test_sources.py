import json

import pytest
from pyspark.sql import functions as F

from graphs import EX, rows
from quern.plans.analyze import ClassSchema, Property, check, explain_empty, run_sparql
from quern.plans.engine import Graph
from quern.plans.syntax import XSD
from quern.sources import links as K
from quern.sources import rdf as A
from quern.sources import sessions as Z
from quern.sources.graphs import QuadSource
from quern.streaming import deduplicated, read_feed, resolve_new_uris

TTL = """@prefix ex: <http://ex.org/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:w1 a ex:Widget ; ex:name "Alpha", "Äpfel"@de ; ex:size 3, 2.5, true ; ex:made "-0043"^^xsd:gYear ; ex:part [ ex:no 1 ; ex:list ( 1 "two" ) ] .
# comment
ex:w2 a ex:Widget ; ex:note \"\"\"two
lines "quoted" \\u00e9\"\"\" .
"""
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex.org/" xml:base="http://ex.org/base">
<ex:Widget rdf:about="http://ex.org/w1" ex:colour="red"><ex:name xml:lang="en">Alpha</ex:name><ex:size rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</ex:size><ex:near rdf:resource="http://ex.org/w2"/><ex:part><ex:Bolt><ex:no>1</ex:no></ex:Bolt></ex:part></ex:Widget></rdf:RDF>"""


def test_turtle_and_xml(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "b.ttl").write_text(XML)
    (tmp_path / "_side.ttl").write_text("not turtle at all")
    df = A.read_files(spark, str(tmp_path))
    got = {(r["s"], r["p"].rsplit("/", 1)[-1], r["o"], r["o_dt"], r["o_lang"]) for r in df.collect()}
    assert (EX + "w1", "size", "2.5", XSD + "decimal", None) in got and any(x[2] == "Äpfel" and x[4] == "de" for x in got) and any("quoted" in x[2] and "é" in x[2] for x in got)
    assert (EX + "w1", "colour", "red", XSD + "string", None) in got and any(x[2] == "Alpha" and x[4] == "en" for x in got)
    assert len(A.parse_turtle(TTL)) == 16 and A.parse_turtle(TTL, "f") == A.parse_turtle(TTL, "f") and len(A.parse_rdfxml(XML)) == 8
    (tmp_path / "bad.ttl").write_text("<a> <b> .")
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in A.verify(spark, str(tmp_path)).collect()}
    assert errors["a.ttl"] is None and errors["bad.ttl"]
    with pytest.raises(Exception):
        A.read_files(spark, str(tmp_path)).count()
    assert A.read_files(spark, str(tmp_path), strict=False).count() == 24
    assert (A.sniff("x.nt", b""), A.sniff("x", b"<?xml"), A.sniff("x.ttl", b"@prefix")) == ("ntriples", "rdfxml", "turtle")


def test_lines_round_trip(spark, tmp_path):
    text = '<http://a> <http://p> "x \\"y\\"\\n\\\\z"@en .\n_:b1 <http://p> <http://o> <http://g> .\n# c\n\n<http://a> <http://p> "3"^^<http://www.w3.org/2001/XMLSchema#integer> .\nbroken\n'
    (tmp_path / "a.nq").write_text(text)
    df = A.read_lines(spark, str(tmp_path / "a.nq"))
    assert df.count() == 3 and A.bad_lines(spark, str(tmp_path / "a.nq")).count() == 1
    assert {r["o"] for r in df.collect()} == {'x "y"\n\\z', "http://o", "3"} and df.where("g = 'http://g'").count() == 1
    A.write_lines(df, str(tmp_path / "out"))
    assert rows(A.read_lines(spark, str(tmp_path / "out"))) == rows(df)
    moved = A.rewrite_namespace(df, "http://o", "http://new")
    assert moved.where("o = 'http://new'").count() == 1 and moved.where("o = '3'").count() == 1
    r = spark.createDataFrame([("a/vocabularies/x%23y",), ("a/vocabularies/place-types/z",)], "value string")
    assert [x[0] for x in A.repair_iris(r).collect()] == ["a/vocabularies/place-types/x#y", "a/vocabularies/place-types/z"]


def test_links(spark, tmp_path):
    f = tmp_path / "l.yaml"
    f.write_text("metadata: {relationship: 'owl:sameAs', confidence: probable, method: m, basis: b, author: a, date: 2026-01-01}\nlinks:\n  - {source: 'http://a', target: 'http://b', confidence: confirmed, note: n}\n  - {source: 'http://c', target: 'http://d'}\n")
    df = K.load_links(spark, [f])
    assert {(r["source"], r["confidence"]) for r in df.collect()} == {("http://a", "confirmed"), ("http://c", "probable")}
    assert rows(K.load_links(spark, [f, f])) == rows(df)
    assert K.link_quads(df).count() == 15 and K.link_quads(df).where("p like '%sameAs'").count() == 2
    bad = tmp_path / "x.yaml"
    bad.write_text("metadata: {relationship: 'made:up'}\nlinks: []\n")
    with pytest.raises(ValueError):
        K.load_links(spark, [bad])
    old = spark.createDataFrame([("a.ttl", "1"), ("_s", "1")], "filename string, digest string")
    new = spark.createDataFrame([("a.ttl", "1"), ("_s", "2")], "filename string, digest string")
    assert K.change_kind(K.layer_changes(old, new)) == "sidecar" and K.change_kind(K.layer_changes(old, old)) == "none"
    assert K.change_kind(K.layer_changes(old, new.withColumn("digest", F.lit("9")))) == "data"
    assert K.upsert_registry(tmp_path / "r.json", "d", {"v": 1}) and K.upsert_registry(tmp_path / "r.json", "d", {"w": 2}) == {"d": {"v": 1, "w": 2}}
    assert K.load_context(tmp_path)["tips"] == {}


def _events():
    known = "http://nomisma.org/id/"
    return [
        {"session_id": "s1", "seq": 1, "type": "query", "dataset": "a", "timestamp": "2026-01-01T00:00:00Z", "data": {"rows": [{"x": known + "1", "y": "no"}], "row_count": 1}},
        {"session_id": "s1", "seq": 2, "type": "search", "dataset": None, "timestamp": "2026-01-01T00:01:00Z", "data": {"results": [{"uri": known + "2"}, {"uri": "http://else"}]}},
        {"session_id": "s1", "seq": 2, "type": "search", "dataset": None, "timestamp": "2026-01-01T00:01:00Z", "data": {"results": [{"uri": known + "2"}]}},
        {"session_id": "s2", "seq": 1, "type": "report", "dataset": "b", "timestamp": "2026-01-01T00:02:00Z", "data": {"markdown": f"see [{known}3] and ({known}1)."}},
        {"session_id": "s2", "seq": 2, "type": "entity", "dataset": "b", "timestamp": "2026-01-01T00:03:00Z", "data": {"uri": known + "4", "properties": [{"obj": known + "5"}], "xrefs": []}},
        {"session_id": "s2", "seq": 3, "type": "links", "dataset": "b", "timestamp": "2026-01-01T00:04:00Z", "data": {"uri": known + "4", "links": [{"target": known + "6"}]}},
    ]


def test_sessions_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, _events())) + "\nnot json\n")
    df = Z.read_sessions(spark, str(tmp_path / "in")).cache()
    assert df.where("_corrupt_record is not null").count() == 1
    good = df.where("session_id is not null")
    found = {(r["session_id"], r["seq"]): [u.rsplit("/", 1)[-1] for u in r["u"]] for r in good.select("session_id", "seq", Z.event_uris(F.col("type"), F.col("data")).alias("u")).collect()}
    assert found[("s1", 1)] == ["1"] and found[("s1", 2)] == ["2"] and found[("s2", 2)] == ["4", "5"] and found[("s2", 3)] == ["4", "6"]
    assert {(r["session_id"], r["events"]) for r in Z.session_summary(good).collect()} == {("s1", 3), ("s2", 3)}
    assert Z.feed_filter(good, ["query", "search"], ["zzz"]).count() == 2
    out = deduplicated(read_feed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert spark.table("dedup").where("session_id is not null").count() == 5
    seen = []
    for _ in range(2):
        q = resolve_new_uris(read_feed(spark, str(tmp_path / "in")), str(tmp_path / "known"), lambda b: seen.extend(r["uri"] for r in b.collect()), str(tmp_path / "cp2"))
        q.awaitTermination(60)
        (tmp_path / "in" / "b.jsonl").write_text(json.dumps(_events()[0] | {"seq": 9}) + "\n")
    assert seen.count("http://nomisma.org/id/2") == 1 and len(set(seen)) == 6


SCHEMA = {
    EX + "Person": ClassSchema({EX + "name": Property([XSD + "string"], XSD + "string"), EX + "born": Property([XSD + "integer"], XSD + "integer", comment="negative for BC"), EX + "doubtful": Property([XSD + "boolean"], XSD + "boolean", True), EX + "holds": Property([EX + "Post"]), EX + "died": Property([XSD + "gYear"], XSD + "gYear")}),
    EX + "Post": ClassSchema({EX + "office": Property([EX + "Office"])}, count_distinct=True),
    EX + "Office": ClassSchema({EX + "title": Property([XSD + "string"], XSD + "string")}),
}


def codes(text, counts=None):
    from quern.plans.syntax import parse

    tree = parse(text, {"ex": EX})
    hints = check(tree, SCHEMA, counts)
    return {h.code for h in hints}, {h.code for h in explain_empty(tree, SCHEMA, hints)}, hints


@pytest.mark.parametrize(
    "text, code, fires",
    [
        ("SELECT ?p { ?p a ex:Persn }", "unknown-class", True),
        ("SELECT ?p { ?p a ex:Person }", "unknown-class", False),
        ("SELECT ?p { ?p a ex:Person ; ex:title ?t }", "unknown-predicate", True),
        ("SELECT ?p { ?p a ex:Person ; ex:holds ?x . ?x ex:office ?o . ?o ex:name ?n }", "unknown-predicate", True),
        ("SELECT ?p { ?p a ex:Person ; ex:holds ?x . ?x ex:office ?o . ?o ex:title ?n }", "unknown-predicate", False),
        ('SELECT ?p { ?p a ex:Person ; ex:born "63 BC" }', "datatype", True),
        ("SELECT ?p { ?p a ex:Person ; ex:born -63 }", "datatype", False),
        ("SELECT ?p { ?p a ex:Person ; ex:doubtful ?d FILTER(?d = false) }", "open-world", True),
        ("SELECT ?p { ?p a ex:Person ; ex:doubtful ?d FILTER(?d = true) }", "open-world", False),
        ("SELECT (COUNT(?x) AS ?n) { ?x a ex:Post }", "count-distinct", True),
        ("SELECT (COUNT(DISTINCT ?x) AS ?n) { ?x a ex:Post }", "count-distinct", False),
        ("SELECT ?p { ?p a ex:Person }", "uncertainty", True),
        ("SELECT ?p { ?p a ex:Person FILTER NOT EXISTS { ?p ex:doubtful true } }", "uncertainty", False),
    ],
)
def test_checks(text, code, fires):
    assert (code in codes(text)[0]) == fires


def test_more_checks(spark):
    assert "no-limit" in codes("SELECT ?p { ?p a ex:Person }", {EX + "Person": 5000})[0] and "no-limit" not in codes("SELECT ?p { ?p a ex:Person } LIMIT 5", {EX + "Person": 5000})[0]
    assert "Person" in codes("SELECT ?p { ?p a ex:Persn }")[2][0].text
    empty = lambda t: codes(t)[1]
    assert "two-types" in empty("SELECT ?p { ?p a ex:Person, ex:Post }") and "bc-sign" in empty("SELECT ?p { ?p ex:born ?b FILTER(?b >= 100) }") and "bc-sign" not in empty("SELECT ?p { ?p ex:born ?b FILTER(?b >= -100) }")
    assert "year-padding" in empty('SELECT ?p { ?p ex:died ?d FILTER(?d > "-44") }') and "year-text" in empty('SELECT ?p { ?p ex:died ?d FILTER(?d > "-0044") }')
    assert "text-for-entity" in empty('SELECT ?p { ?p a ex:Person ; ex:holds ?h FILTER(?h = "consul") }')


def test_run_and_probe(spark, tmp_path):
    df = spark.createDataFrame([(None, EX + "w", "iri", EX + "hasName", "x", "lit", XSD + "string", None)], "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    g = Graph(QuadSource(df), {"ex": EX})
    a = run_sparql(g, 'SELECT ?w { ?w ex:hasName ?n FILTER(?n = "y") }', log=tmp_path / "log.jsonl")
    assert [h.code for h in a.diagnosis] == ["filters", "filter"] and json.loads((tmp_path / "log.jsonl").read_text())["diagnosis"] == ["filters", "filter"]
    b = run_sparql(g, "SELECT ?w { ?w ex:hasName ?n ; ex:hasColor ?c }")
    assert [h.code for h in b.diagnosis] == ["no-pattern", "no-triple"] and "hasColor" in b.diagnosis[1].text
    assert run_sparql(g, "SELECT ?w { ?w ex:hasColor ?c }", budget_ms=0).diagnosis == []
    assert run_sparql(g, "SELECT ?w { ?w ex:hasName ?n }").diagnosis == [] and run_sparql(g, "SELECT ?w {").error
    assert run_sparql(g, "SELECT ?w { ?w ex:hasColor ?c }", log="/nonexistent/dir/x").df is not None


def test_jsonld():
    from quern.sources.rdf import parse_jsonld

    text = """{"@context": {"@vocab": "http://v/", "n": {"@id": "http://v/name", "@language": "EN"}, "knows": {"@type": "@id"}, "ex": "http://ex/"}, "@graph": [
      {"@id": "ex:a", "@type": ["Person", "ex:Thing"], "n": "A", "knows": ["ex:b", {"n": "C"}], "age": 3, "ok": true, "list": {"@list": ["x", "y"]}, "d": {"@value": "1", "@type": "ex:t"}, "gone": null}]}"""
    got = parse_jsonld(text, "f")
    said = {(q[3], q[4], q[5], q[6], q[7]) for q in got if q[1] == "http://ex/a"}
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert {("http://v/name", "A", "lit", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en"), ("http://v/knows", "http://ex/b", "iri", None, None), ("http://v/age", "3", "lit", xsd + "integer", None), ("http://v/ok", "true", "lit", xsd + "boolean", None), ("http://v/d", "1", "lit", "http://ex/t", None)} <= said
    assert sum(q[3].endswith("#first") for q in got) == 2 and got == parse_jsonld(text, "f") and not any("gone" in q[3] for q in got)


def test_load_warns_if_inference_fails(spark, tmp_path, monkeypatch):
    from quern.sources import rdf

    (tmp_path / "a.ttl").write_text("<urn:a> a <urn:B> .")
    (tmp_path / "_skip.ttl").write_text("not turtle")
    (tmp_path / "_ontology.ttl").write_text("<urn:B> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <urn:C> .")
    assert rdf.load_dataset(spark, str(tmp_path)).count() == 3
    monkeypatch.setattr(rdf, "materialize", lambda q: 1 / 0)
    with pytest.warns(UserWarning):
        assert rdf.load_dataset(spark, str(tmp_path)).count() == 2
