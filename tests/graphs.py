"""Small graphs that the tests ask."""

from quern.plans.engine import Graph
from quern.plans.syntax import TYPE, XSD
from quern.sources.graphs import QUADS, QuadSource

EX = "http://ex.org/"


def quads(spark, rows):
    """Rows (s, p, o[, datatype[, language[, graph]]]); names without a colon are in EX; an o with a datatype is a literal."""
    full = lambda x: x if ":" in x else EX + x
    out = []
    for s, p, o, *rest in rows:
        dt, lang, g = [*rest, None, None, None][:3]
        lit = dt is not None or lang is not None
        out.append((full(g) if g else None, full(s), "iri", TYPE if p == "a" else full(p), o if lit else full(o), "lit" if lit else "iri", XSD + dt if dt else None, lang))
    return spark.createDataFrame(out, QUADS)


def graph(spark, rows):
    return Graph(QuadSource(quads(spark, rows)), {"ex": EX})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
