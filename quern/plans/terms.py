"""RDF terms as columns: what a variable's columns mean, and how terms compare, order and print."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.syntax import RDF, XSD, Iri, Lit

# Datatypes by family.
INTEGERS = [XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")]
NUMBERS = [*INTEGERS, XSD + "decimal", XSD + "double", XSD + "float"]
YEARS = [XSD + "gYear", XSD + "date", XSD + "dateTime", XSD + "gYearMonth"]
STRING, BOOLEAN, LANG_STRING = XSD + "string", XSD + "boolean", RDF + "langString"


@dataclass(frozen=True)
class Expr:
    """A term-valued expression.

    ``kind``: ``num``, ``str``, ``bool``, ``time`` and ``iri`` hold a native column (an IRI without its ``template``); ``term`` holds any
    term: ``col`` is its text, ``k`` its kind (iri, bnode, lit), ``d`` its datatype, ``l`` its language.  Null is unbound, or an error.
    """

    kind: str
    col: Column
    dt: str | None = None
    template: str = ""
    k: Column | None = None
    d: Column | None = None
    l: Column | None = None

    def lex(self) -> Column:
        if self.kind == "iri":
            return F.concat(F.lit(self.template), self.col.cast("string")) if self.template else self.col.cast("string")
        if self.kind == "time":
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss")
        return self.col.cast("string")

    def kind_col(self) -> Column:
        return self.k if self.kind == "term" else F.when(self.col.isNotNull(), F.lit("iri" if self.kind == "iri" else "lit"))

    def dt_col(self) -> Column:
        return self.d if self.kind == "term" else F.when(self.col.isNotNull(), F.lit(self.dt or _DEFAULT.get(self.kind)))

    def lang_col(self) -> Column:
        return self.l if self.kind == "term" else F.lit(None).cast("string")

    def general(self) -> Expr:
        return self if self.kind == "term" else Expr("term", self.lex(), k=self.kind_col(), d=self.dt_col(), l=self.lang_col())

    def num(self) -> Column:
        if self.kind == "num":
            return self.col
        if self.kind == "term":
            return F.when((self.k == "lit") & self.d.isin(*NUMBERS), self.col.try_cast("double"))
        return F.lit(None).cast("double")

    def text(self) -> Column:
        """The text of a string literal; null for anything else."""
        if self.kind == "str":
            return self.col
        if self.kind == "term":
            return F.when((self.k == "lit") & (self.d.isNull() | self.d.isin(STRING, LANG_STRING)), self.col)
        return F.lit(None).cast("string")

    def boolean(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "term":
            return F.when((self.k == "lit") & (self.d == BOOLEAN), self.col.isin("true", "1"))
        return F.lit(None).cast("boolean")

    def year(self) -> Column:
        """The signed year of a year or date, as written: negative is BC; no calendar type could hold it."""
        if self.kind == "time":
            return F.year(self.col)
        if self.kind == "term":
            return F.when((self.k == "lit") & self.d.isin(*YEARS), F.regexp_extract(self.col, r"^(-?\d+)", 1).try_cast("int"))
        return F.lit(None).cast("int")

    def ebv(self) -> Column:
        """Effective boolean value; null is an error."""
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.kind == "str":
            return self.col != ""
        if self.kind == "term":
            return F.coalesce(self.boolean(), self.num() != 0, self.text() != "")
        return F.lit(None).cast("boolean")


_DEFAULT = {"num": XSD + "double", "str": STRING, "bool": BOOLEAN, "time": XSD + "dateTime"}


def constant(t: Iri | Lit) -> Expr:
    if isinstance(t, Iri):
        return Expr("iri", F.lit(t.value))
    if t.datatype in INTEGERS:
        return Expr("num", F.lit(t.value).try_cast("bigint"), t.datatype)
    if t.datatype in NUMBERS:
        return Expr("num", F.lit(t.value).try_cast("double"), t.datatype)
    if t.datatype == BOOLEAN:
        return Expr("bool", F.lit(t.value in ("true", "1")), BOOLEAN)
    if t.datatype in (None, STRING) and not t.lang:
        return Expr("str", F.lit(t.value), STRING)
    return Expr("term", F.lit(t.value), k=F.lit("lit"), d=F.lit(t.datatype), l=F.lit(t.lang).cast("string"))


def same_term(a: Expr, b: Expr) -> Column:
    """Whether two bound terms are the same term (numbers of one value count as one term); null if one is unbound."""
    if a.kind == b.kind and a.kind in ("num", "str", "bool", "time"):
        return a.col == b.col
    if a.kind == b.kind == "iri":
        if a.template == b.template:
            return a.col == b.col
        for x, y in ((a, b), (b, a)):
            if not x.template and y.template:  # a full IRI against a key
                key = F.when(x.col.startswith(y.template), F.substring(x.col, len(y.template) + 1, 2**31 - 1))
                return F.coalesce(key == y.col.cast("string"), F.when(x.col.isNotNull() & y.col.isNotNull(), F.lit(False)))
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    g, h = a.general(), b.general()
    plain = lambda d: F.when((d == STRING) | d.isNull(), F.lit("")).otherwise(d)
    return (g.col == h.col) & (g.k == h.k) & ((g.k != "lit") | ((plain(g.d) == plain(h.d)) & (F.coalesce(g.l, F.lit("")) == F.coalesce(h.l, F.lit("")))))


_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, a: Expr, b: Expr) -> Column:
    """SPARQL comparison: numbers, strings, booleans and years with their like; IRIs by equality only; null is an error."""
    f = _OPS[op]
    if a.kind == b.kind and a.kind in ("num", "str", "bool", "time"):
        return f(a.col, b.col)
    if a.kind in ("num", "str", "bool") and b.kind == "term" or b.kind in ("num", "str", "bool") and a.kind == "term":
        kind = a.kind if a.kind != "term" else b.kind
        get = {"num": Expr.num, "str": Expr.text, "bool": Expr.boolean}[kind]
        found = f(get(a), get(b))
        return F.coalesce(found, F.when(_known(a, b), F.lit(True))) if op == "!=" else found
    if {a.kind, b.kind} == {"time", "str"}:  # a plain date compares as written
        return f(a.lex(), b.lex())
    if "iri" in (a.kind, b.kind):
        if op not in ("=", "!="):
            return F.lit(None).cast("boolean")
        same = same_term(a, b)
        return same if op == "=" else ~same
    g, h = a.general(), b.general()
    lang_same = F.coalesce(g.l, F.lit("")) == F.coalesce(h.l, F.lit(""))
    ordered = F.coalesce(f(a.num().cast("double"), b.num().cast("double")), F.when(lang_same, f(a.text(), b.text())), f(a.boolean(), b.boolean()))
    years = F.when(a.year() == b.year(), f(a.lex(), b.lex()) if op in ("=", "!=", "<=", ">=") else F.lit(False)).otherwise(f(a.year(), b.year()))
    ordered = F.coalesce(ordered, years)
    if op in ("=", "!="):
        same = same_term(a, b)
        non_literal = (g.k != "lit") | (h.k != "lit")
        return F.coalesce(ordered, F.when(non_literal, same if op == "=" else ~same))
    return ordered


def _known(a: Expr, b: Expr) -> Column:
    """Both bound and one is an IRI or a blank node: such terms differ from every literal."""
    g = a if a.kind == "term" else b
    return g.col.isNotNull() & (g.k != "lit")


def order_keys(e: Expr, ascending: bool) -> list[Column]:
    """Sort keys: unbound, blank nodes, IRIs, literals; numbers by value, years by year, then by text."""
    way = lambda c: c.asc_nulls_first() if ascending else c.desc_nulls_last()
    if e.kind in ("num", "str", "bool", "time"):
        return [way(e.col)]
    if e.kind == "iri":
        return [way(e.lex())]
    rank = F.when(e.col.isNull(), 0).when(e.k == "bnode", 1).when(e.k == "iri", 2).otherwise(3)
    return [way(rank), way(F.coalesce(e.num(), e.year().cast("double"))), way(e.col)]


def conjunction(parts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class Slot:
    """How a variable sits in a solution: its columns' prefix, its kind, and whether it may be unbound."""

    column: str
    kind: str
    dt: str | None = None
    template: str = ""
    maybe: bool = False

    def expr(self) -> Expr:
        c = F.col(f"`{self.column}`")
        if self.kind == "term":
            return Expr("term", c, k=F.col(f"`{self.column}__k`"), d=F.col(f"`{self.column}__d`"), l=F.col(f"`{self.column}__l`"))
        return Expr(self.kind, c, self.dt, self.template)

    @property
    def columns(self) -> list[str]:
        return [self.column, *([f"{self.column}__{x}" for x in "kdl"] if self.kind == "term" else [])]

    def loose(self) -> Slot:
        return replace(self, maybe=True)


def put(name: str, e: Expr, maybe: bool = False) -> tuple[Slot, list[Column]]:
    """A slot for an expression, and the columns that fill it."""
    s = Slot(name, e.kind, e.dt, e.template, maybe)
    cols = [e.col.alias(name)]
    if e.kind == "term":
        cols += [e.k.cast("string").alias(f"{name}__k"), e.d.cast("string").alias(f"{name}__d"), e.l.cast("string").alias(f"{name}__l")]
    return s, cols
