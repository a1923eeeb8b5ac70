"""Graph sources: a stored quad table, and a mapping that shows relational tables as triples without storing them."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.syntax import TYPE, XSD, Iri, Lit, Triple, Var
from quern.plans.terms import NUMBERS, STRING, Expr, Slot, conjunction, constant, put, same_term

QUADS = T.StructType(
    [
        T.StructField("g", T.StringType()),
        T.StructField("s", T.StringType(), False),
        T.StructField("s_kind", T.StringType(), False),
        T.StructField("p", T.StringType(), False),
        T.StructField("o", T.StringType(), False),
        T.StructField("o_kind", T.StringType(), False),
        T.StructField("o_dt", T.StringType()),
        T.StructField("o_lang", T.StringType()),
    ]
)

#: The active graph of a pattern: the default graph, any named graph, or one.
DEFAULT = object()


@dataclass
class Solution:
    """A bag of solutions: a DataFrame and the slots of its variables."""

    df: DataFrame
    slots: dict[str, Slot]


class QuadSource:
    """A table of quads with the columns of QUADS; ``g`` null is the default graph."""

    def __init__(self, df: DataFrame, stats: dict[str, int] | None = None):
        self.df = df
        self.spark = df.sparkSession
        self.stats = stats or {}

    def groups(self, triples: list[Triple], graph: object) -> list[list[Triple]]:
        return [[t] for t in triples]

    def cost(self, group: list[Triple]) -> float:
        """Estimated rows: by predicate counts where known, less for each bound position."""
        t = group[0]
        rows = self.stats.get(t.p.value, 1e6) if isinstance(t.p, Iri) else 1e8
        return rows / (1000 if not isinstance(t.s, Var) else 1) / (100 if not isinstance(t.o, Var) else 1)

    def scan(self, group: list[Triple], graph: object) -> Solution:
        (t,) = group
        df, tests, out, slots = self.df, [], [], {}
        if graph is DEFAULT:
            tests.append(F.col("g").isNull())
        elif isinstance(graph, Var):
            tests.append(F.col("g").isNotNull())
        else:
            tests.append(F.col("g") == graph.value)
        s = Expr("term", F.col("s"), k=F.col("s_kind"), d=F.lit(None).cast("string"), l=F.lit(None).cast("string"))
        p = Expr("iri", F.col("p"))
        o = Expr("term", F.col("o"), k=F.col("o_kind"), d=F.col("o_dt"), l=F.col("o_lang"))
        places = [(t.s, s), (t.p, p), (t.o, o)]
        if isinstance(graph, Var):
            places.append((graph, Expr("iri", F.col("g"))))
        for want, have in places:
            if isinstance(want, Var):
                if want.name in slots:
                    tests.append(same_term(slots[want.name][1], have))
                else:
                    slots[want.name] = (put(want.name, have), have)
            elif isinstance(want, Iri):
                tests.append((have.col == want.value) & (F.lit(True) if have.kind == "iri" else have.k == "iri"))
            else:
                tests.append(literal_test(want, have))
        for (slot, cols), _ in slots.values():
            out += cols
        return Solution(df.where(conjunction(tests)).select(*(out or [F.lit(1).alias("__one")])), {n: v[0][0] for n, v in slots.items()})

    def predicates(self) -> DataFrame:
        return self.df.select("p").distinct()

    def quads(self) -> DataFrame:
        return self.df


def literal_test(want: Lit, have: Expr) -> Column:
    """An object equal to a literal; numbers by value within the numeric types, plain strings with or without their datatype."""
    test = (have.k == "lit") & (have.col == want.value)
    if want.lang:
        return test & (F.lower(have.l) == want.lang)
    if want.datatype in NUMBERS:
        return (have.k == "lit") & have.d.isin(*NUMBERS) & (have.col.try_cast("double") == float(want.value))
    if want.datatype in (None, STRING):
        return test & (have.d.isNull() | (have.d == STRING)) & have.l.isNull()
    return test & (have.d == want.datatype)


@dataclass
class Column_:
    """A predicate's values: a column, or with ``template`` a reference to another table's subjects by key."""

    column: str
    template: str | None = None
    datatype: str | None = None


@dataclass
class Table:
    """A relational table as triples: one subject for each row (the key must be unique), a class, a column for each predicate."""

    df: DataFrame
    class_iri: str
    template: str
    key: str | Column
    predicates: dict[str, Column_]
    rows: float = 1e6
    key_column: str = field(default="__key", init=False)

    def keyed(self) -> DataFrame:
        return self.df.withColumn("__key", F.col(self.key) if isinstance(self.key, str) else self.key)

    def subject(self) -> Expr:
        return Expr("iri", F.col("__key"), None, self.template)

    def value(self, predicate: str) -> Expr:
        c = self.predicates[predicate]
        col = F.col(c.column)
        if c.template:
            return Expr("iri", col, None, c.template)
        kind = self.df.schema[c.column].dataType
        if isinstance(kind, T.BooleanType):
            return Expr("bool", col)
        if isinstance(kind, (T.IntegralType,)):
            return Expr("num", col.cast("bigint"), c.datatype or XSD + "integer")
        if isinstance(kind, T.NumericType):
            return Expr("num", col, c.datatype or XSD + "double")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return Expr("time", col, XSD + "dateTime")
        return Expr("str", col.cast("string"), c.datatype or STRING)


class MappedSource:
    """Relational tables as one graph.  Patterns with one subject over one table become a single scan (no self-join)."""

    def __init__(self, spark: SparkSession, tables: list[Table]):
        self.spark = spark
        self.tables = tables

    def _fits(self, table: Table, t: Triple) -> bool:
        if not isinstance(t.p, Iri):
            return False
        if t.p.value == TYPE:
            return isinstance(t.o, Iri) and t.o.value == table.class_iri
        return t.p.value in table.predicates

    def _owners(self, t: Triple) -> list[Table]:
        return [x for x in self.tables if self._fits(x, t)]

    def groups(self, triples: list[Triple], graph: object) -> list[list[Triple]]:
        """Stars: patterns of one subject that some table answers together; others alone."""
        by: dict[object, list[Triple]] = {}
        alone = []
        for t in triples:
            if isinstance(t.p, Iri) and (self._owners(t) or t.p.value != TYPE) and not isinstance(t.p, Var):
                by.setdefault(t.s, []).append(t)
            else:
                alone.append([t])
        out = []
        for star in by.values():
            owners = [x for x in self.tables if all(self._fits(x, t) for t in star)]
            objects = [t.o.name for t in star if isinstance(t.o, Var)]
            if owners and len(objects) == len(set(objects)) and (not isinstance(star[0].s, Var) or star[0].s.name not in objects):
                out.append(star)
            else:
                out += [[t] for t in star]
        return out + alone

    def cost(self, group: list[Triple]) -> float:
        owners = [x for x in self.tables if all(self._fits(x, t) for t in group)]
        rows = sum(x.rows for x in owners) if owners else 1e9
        bound = sum(not isinstance(t.o, Var) and not (isinstance(t.p, Iri) and t.p.value == TYPE) for t in group)
        return rows / (1000 if not isinstance(group[0].s, Var) else 1) / 10**bound

    def scan(self, group: list[Triple], graph: object) -> Solution:
        if graph is not DEFAULT:
            return QuadSource(self.spark.createDataFrame([], QUADS)).scan(group[:1], graph)
        owners = [x for x in self.tables if all(self._fits(x, t) for t in group)]
        if not all(isinstance(t.p, Iri) for t in group) or any(t.p.value == TYPE and isinstance(t.o, Var) for t in group):
            return QuadSource(self.quads()).scan(group, graph)
        found = [self._star(x, group) for x in owners]
        if not found:
            return QuadSource(self.spark.createDataFrame([], QUADS)).scan(group[:1], DEFAULT)
        return functools.reduce(union, found)

    def _star(self, table: Table, group: list[Triple]) -> Solution:
        df, tests, out, slots = table.keyed(), [], [], {}
        s = group[0].s

        def bind(name: str, e: Expr) -> None:
            slot, cols = put(name, e)
            slots[name] = slot
            out.extend(cols)

        if isinstance(s, Var):
            bind(s.name, table.subject())
        elif isinstance(s, Iri):
            tests.append(same_term(constant(s), table.subject()))
        else:
            tests.append(F.lit(False))
        for t in group:
            if t.p.value == TYPE:
                continue
            have = table.value(t.p.value)
            if isinstance(t.o, Var):
                tests.append(have.col.isNotNull())
                if isinstance(s, Var) and t.o.name == s.name:
                    tests.append(same_term(table.subject(), have))
                else:
                    bind(t.o.name, have)
            elif isinstance(t.o, Iri) and have.kind == "iri" and have.template:
                key = t.o.value[len(have.template) :] if t.o.value.startswith(have.template) else None
                tests.append(have.col == F.lit(key).try_cast(df.schema[table.predicates[t.p.value].column].dataType) if key is not None else F.lit(False))
            else:
                tests.append(F.coalesce(same_term(constant(t.o), have), F.lit(False)))
        return Solution(df.where(conjunction(tests)).select(*(out or [F.lit(1).alias("__one")])), slots)

    def quads(self) -> DataFrame:
        """The same graph as a quad table, for patterns with a variable predicate or class; one pass over each table."""
        parts = []
        for x in self.tables:
            cells = [F.struct(F.lit(TYPE).alias("p"), F.lit(x.class_iri).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))]
            for p in x.predicates:
                e = x.value(p)
                cells.append(F.struct(F.lit(p).alias("p"), e.lex().alias("o"), e.kind_col().alias("o_kind"), (F.lit(None).cast("string") if e.kind == "iri" else e.dt_col()).alias("o_dt")))
            rows = x.keyed().select(x.subject().lex().alias("s"), F.explode(F.array(*cells)).alias("c")).where("c.o is not null")
            parts.append(rows.select(F.lit(None).cast("string").alias("g"), "s", F.lit("iri").alias("s_kind"), F.col("c.p").alias("p"), F.col("c.o").alias("o"), F.col("c.o_kind").alias("o_kind"), F.col("c.o_dt").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")))
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], QUADS)


def align(a: Solution, b: Solution, name: str) -> tuple[Expr, Expr]:
    """A variable's expressions on both sides, brought to one kind."""
    x, y = a.slots[name].expr(), b.slots[name].expr()
    if (x.kind, x.template) == (y.kind, y.template):
        return x, y
    if x.kind == y.kind == "iri":
        return Expr("iri", x.lex()), Expr("iri", y.lex())
    return x.general(), y.general()


def union(a: Solution, b: Solution) -> Solution:
    """All solutions of both; a variable that one side lacks is unbound there."""
    slots, left, right = {}, [], []
    for name in [*a.slots, *[n for n in b.slots if n not in a.slots]]:
        if name in a.slots and name in b.slots:
            x, y = align(a, b, name)
            maybe = a.slots[name].maybe or b.slots[name].maybe
            slots[name], cols = put(name, x, maybe)
            left += cols
            right += put(name, y)[1]
        else:
            here = a if name in a.slots else b
            slots[name], cols = put(name, here.slots[name].expr(), True)
            blank = [F.lit(None).cast(here.df.schema[c].dataType).alias(c) for c in slots[name].columns]
            left += cols if here is a else blank
            right += blank if here is a else cols
    one = [F.lit(1).alias("__one")]
    return Solution(a.df.select(*(left or one)).unionByName(b.df.select(*(right or one))), slots)
