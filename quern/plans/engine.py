"""Running SPARQL: the query entry point, result forms, language preference, prefixes in results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.compile import Compiler
from quern.operators.relational import numbered
from quern.plans.syntax import Select, SparqlError, Triple, Var, parse, repair_prefixes
from quern.plans.terms import constant
from quern.sources.graphs import QUADS, Solution


@dataclass
class Graph:
    """A source with the prefixes that its queries may use."""

    source: object
    prefixes: dict[str, str] = field(default_factory=dict)
    products: bool = False  # whether patterns without a shared variable may both be large

    def tree(self, text: str) -> Select:
        return parse(repair_prefixes(text, self.prefixes), dict(self.prefixes))

    def solve(self, text: str) -> Solution:
        tree = self.tree(text)
        if tree.form != "SELECT":
            raise SparqlError("only SELECT queries are run here, not ASK")
        return Compiler(self.source, products=self.products).select(tree)

    def query(self, text: str) -> DataFrame:
        """Typed result: numbers, strings and times in their own types; IRIs and mixed terms as text."""
        s = self.solve(text)
        return s.df.select(*[(x.lex() if s.slots[n].kind in ("iri", "term") else x.col).alias(n) for n in s.slots for x in [s.slots[n].expr()]])

    def lexical(self, text: str, compress: bool = True) -> DataFrame:
        """Every value as its text, IRIs shortened by the query's and the graph's prefixes; unbound is null."""
        tree = self.tree(text)
        s = Compiler(self.source, products=self.products).select(tree)
        prefixes = self.prefixes | tree.prefixes
        show = lambda e: compress_iri(e.lex(), prefixes) if compress else e.lex()
        return s.df.select(*[show(s.slots[n].expr()).alias(n) for n in s.slots])

    def ask(self, text: str) -> bool:
        """Whether the pattern has a solution; for probes, not an entry point of users."""
        tree = parse(repair_prefixes(text, self.prefixes), dict(self.prefixes))
        return not Compiler(self.source, products=self.products).group(tree.where).df.isEmpty()

    def construct(self, text: str) -> DataFrame:
        """The triples of a CONSTRUCT query, as quads of the default graph: its template filled with every solution; a triple with an unbound part, or
        a literal where none may stand, is left out.  For extracts between stores; users' queries are SELECT."""
        m = re.search(r"(?is)\bCONSTRUCT\s*\{(.*?)\}\s*(WHERE\b.*)$", text)
        if not m:
            raise SparqlError("CONSTRUCT { template } WHERE { pattern } expected")
        head = text[: m.start()]
        template = _walk_triples(self.tree(f"{head} SELECT * WHERE {{ {m[1]} }}"))
        s = self.solve(f"{head} SELECT * {m[2]}")
        cells = []
        for t in template:
            a, p, o = ((s.slots[x.name].expr() if x.name in s.slots else None) if isinstance(x, Var) else constant(x) for x in (t.s, t.p, t.o))
            if a is None or p is None or o is None:
                continue
            a, o = a.general(), o.general()
            ok = a.col.isNotNull() & (a.k != "lit") & p.lex().isNotNull() & (p.kind_col() == "iri") & o.col.isNotNull()
            parts = {"s": a.col, "s_kind": a.k, "p": p.lex(), "o": o.col, "o_kind": o.k, "o_dt": o.d, "o_lang": o.l}
            cells.append(F.when(ok, F.struct(*[c.cast("string").alias(n) for n, c in parts.items()])))
        if not cells:
            return s.df.sparkSession.createDataFrame([], QUADS)
        made = s.df.select(F.explode(F.array(*cells)).alias("q")).where("q is not null").select("q.*").distinct()
        return s.df.sparkSession.createDataFrame([], QUADS).unionByName(made.withColumn("g", F.lit(None).cast("string")))

    def length(self) -> DataFrame:
        """``(n)``: the number of distinct statements."""
        return self.source.quads().distinct().agg(F.count(F.lit(1)).alias("n"))

    def explain(self, text: str) -> None:
        self.query(text).explain("formatted")


def _walk_triples(tree: Select) -> list[Triple]:
    if any(not isinstance(i, Triple) for i in tree.where.items):
        raise SparqlError("a template holds triples only")
    return tree.where.items


def paged(df: DataFrame, order: list[Column], size: int, total: int | None = None) -> DataFrame:
    """The rows with ``page``, as an extract by LIMIT and OFFSET would fetch them: ``size`` a page in a total order, until ``total`` rows or the end.

    One pass numbers all rows; pages are then read apart without skipping over what came before them.
    """
    rows = numbered(df, order, "__at")
    rows = rows if total is None else rows.where(F.col("__at") < total)
    return rows.withColumn("page", F.floor(F.col("__at") / size)).drop("__at")


def compress_iri(value: Column, prefixes: dict[str, str]) -> Column:
    """``prefix:local`` for values that start with http, the longest namespace first; other values stay."""
    out = value
    for prefix, ns in sorted(prefixes.items(), key=lambda kv: (len(kv[1]), kv[0])):
        out = F.when(value.startswith("http") & value.startswith(ns), F.concat(F.lit(f"{prefix}:"), F.substring(value, len(ns) + 1, 2**31 - 1))).otherwise(out)
    return out


def expand_iri(value: Column, maps: list[dict[str, str]]) -> Column:
    """``prefix:local`` as a full IRI by the first map that knows the prefix; full IRIs and unknown prefixes stay."""
    prefix = F.substring_index(value, ":", 1)
    local = F.substring(value, F.length(prefix) + 2, F.length(value))
    known: dict[str, str] = {}
    for m in maps:
        known = m | known
    out = value
    for p, ns in known.items():
        out = F.when((prefix == p) & ~local.startswith("//"), F.concat(F.lit(ns), local)).otherwise(out)
    return out


def local_name(iri: Column) -> Column:
    """The text after the last ``#``, else after the last ``/``."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def prefer_language(df: DataFrame, values: dict[str, str], group: list[str], order: list[str], preference: tuple[str, ...] = ("en", "", "la")) -> DataFrame:
    """One row a group: the one whose language-tagged columns rank best together.

    ``values`` maps a value column to its language column.  A tag's rank is its place in ``preference`` (untagged is ``""``; others come
    last); the lowest sum wins, ties go to the first in ``order``.  With no ``group`` columns a single row survives.
    """
    rank = lambda c: F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("")) == p, F.lit(i)) for i, p in enumerate(preference)], F.lit(len(preference)))
    total = sum((rank(lang) for lang in values.values()), F.lit(0))
    w = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(1)]).orderBy("__rank", *order)
    return df.withColumn("__rank", total).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__rank", "__n")
