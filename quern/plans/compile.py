"""From the syntax tree of a query to one DataFrame plan."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.closure import reachable, transitive_closure
from quern.plans import syntax as S
from quern.plans.expressions import compile_expr
from quern.plans.terms import Expr, Slot, compare, conjunction, constant, order_keys, put, same_term
from quern.sources.graphs import DEFAULT, Solution, align, union

#: VALUES with at most so many rows of one variable become an IN filter where they can.
SMALL = 64
#: Of two patterns without a shared variable, one may have at most so many solutions.
PRODUCT = 100_000


@dataclass
class Compiler:
    """Compiles the patterns of one query over one source."""

    source: object
    hidden: int = 0
    products: bool = False

    @property
    def spark(self):
        return self.source.spark

    def fresh(self) -> S.Var:
        self.hidden += 1
        return S.Var(f"_p{self.hidden}")

    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(F.lit(1).alias("__one")), {})

    # -- joins
    def _sides(self, a: Solution, b: Solution) -> tuple[DataFrame, list[str], dict[str, tuple[Expr, Expr]]]:
        """The right side with its shared variables renamed, their names, and both sides' expressions, aligned."""
        shared = [n for n in a.slots if n in b.slots]
        names = {}
        cols = []
        for n, slot in b.slots.items():
            other = replace(slot, column=f"__r_{slot.column}") if n in shared else slot
            names[n] = other
            cols += [F.col(f"`{x}`").alias(y) for x, y in zip(slot.columns, other.columns)]
        right = Solution(b.df.select(*(cols or [F.lit(1).alias("__one_r")])), {n: names[n] for n in b.slots})
        return right.df, shared, {n: align(a, right, n) for n in shared}

    def _condition(self, a: Solution, b: Solution, pairs: dict[str, tuple[Expr, Expr]]) -> Column:
        tests = []
        for n, (x, y) in pairs.items():
            same = same_term(x, y)
            if a.slots[n].maybe or b.slots[n].maybe:  # unbound is compatible with anything
                same = F.coalesce(same, F.lit(False)) | x.col.isNull() | y.col.isNull()
            tests.append(same)
        return conjunction(tests)

    def _product(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """All pairs of two patterns without a shared variable: the smaller side is counted up to PRODUCT and sent to every task; two larger ones
        are refused, unless ``products`` asks for them."""
        for small, large, left in ((b, a, True), (a, b, False)):
            if small.limit(PRODUCT + 1).count() <= PRODUCT:
                return large.crossJoin(F.broadcast(small)) if left else F.broadcast(small).crossJoin(large)
        if not self.products:
            raise S.SparqlError(f"two patterns without a shared variable have more than {PRODUCT} solutions each")
        return a.crossJoin(b)

    def _split_join(self, a: Solution, b: Solution, name: str) -> Solution:
        """The join on a variable that may be unbound: bound values meet by an equi-join; rows without a value, which fit any, by what else is shared."""
        def bound(s: Solution, yes: bool) -> Solution:
            first = F.col(f"`{s.slots[name].columns[0]}`")
            if yes:
                return Solution(s.df.where(first.isNotNull()), {**s.slots, name: replace(s.slots[name], maybe=False)})
            rest = {n: x for n, x in s.slots.items() if n != name}
            return Solution(s.df.where(first.isNull()).select(*[F.col(f"`{c}`") for x in rest.values() for c in x.columns] or [F.lit(1).alias("__one")]), rest)

        x, y = a.slots[name].maybe, b.slots[name].maybe
        parts = [self.join(bound(a, True), bound(b, True))]
        if x:
            parts.append(self.join(bound(a, False), b))
        if y:
            parts.append(self.join(bound(a, True), bound(b, False)))
        return functools.reduce(union, parts)

    def join(self, a: Solution, b: Solution, how: str = "inner", on: Column | None = None) -> Solution:
        common = [n for n in a.slots if n in b.slots]
        loose = [n for n in common if a.slots[n].maybe or b.slots[n].maybe]
        if how == "inner" and on is None and loose and len(loose) == len(common):
            return self._split_join(a, b, loose[0])
        right, shared, pairs = self._sides(a, b)
        test = self._condition(a, b, pairs)
        if on is not None:
            test = test & on
        if shared or on is not None or how == "left":
            df = a.df.join(right, test, how)
        else:
            df = self._product(a.df, right)
        slots, cols = {}, []
        for n, slot in a.slots.items():
            if n in shared and slot.maybe:
                x, y = pairs[n]
                merged = _first(x, y)
                slots[n], c = put(n, merged, slot.maybe and (b.slots[n].maybe or how == "left"))
                cols += c
            else:
                slots[n] = slot
                cols += [F.col(f"`{c}`") for c in slot.columns]
        for n, slot in b.slots.items():
            if n not in shared:
                slots[n] = replace(slot, maybe=slot.maybe or how == "left")
                cols += [F.col(f"`{c}`") for c in slot.columns]
        return Solution(df.select(*(cols or [F.lit(1).alias("__one")])), slots)

    def keep(self, a: Solution, b: Solution, how: str, on: Column | None = None) -> Solution:
        """Semi or anti join."""
        right, shared, pairs = self._sides(a, b)
        test = self._condition(a, b, pairs)
        return Solution(a.df.join(right, test & on if on is not None else test, how), a.slots)

    # -- patterns
    def bgp(self, triples: list[S.Triple], graph: object) -> Solution:
        """Joins the groups of patterns that the source answers at once, cheapest first, always along a shared variable if there is one."""
        plain, paths = [], []
        for t in triples:
            for u in self._expand(t):
                (paths if isinstance(u.p, S.Path) else plain).append(u)
        groups = self.source.groups(plain, graph)
        parts = [(self.source.cost(g), lambda g=g: self.source.scan(g, graph), S.variables(g)) for g in groups]
        parts += [(1e7, lambda t=t: self.path(t, graph), S.variables(t)) for t in paths]
        parts.sort(key=lambda p: p[0])
        out, seen = None, set()
        while parts:
            i = next((i for i, p in enumerate(parts) if p[2] & seen), 0) if out is not None else 0
            _, scan, names = parts.pop(i)
            part = scan()
            out = part if out is None else self.join(out, part)
            seen |= names
        return out or self.unit()

    def _expand(self, t: S.Triple) -> list[S.Triple]:
        """Sequences and inverses as plain patterns over hidden variables."""
        if isinstance(t.p, S.Path) and t.p.kind == "seq":
            nodes = [t.s, *[self.fresh() for _ in t.p.args[1:]], t.o]
            return [u for a, p, b in zip(nodes, t.p.args, nodes[1:]) for u in self._expand(S.Triple(a, p, b))]
        if isinstance(t.p, S.Path) and t.p.kind == "inv":
            return self._expand(S.Triple(t.o, t.p.args[0], t.s))
        return [t]

    def path(self, t: S.Triple, graph: object) -> Solution:
        kind = t.p.kind
        if kind == "alt":
            return functools.reduce(union, [self.bgp([S.Triple(t.s, p, t.o)], graph) for p in t.p.args])
        a, b = S.Var("__a"), S.Var("__b")
        if kind == "not":
            p = self.fresh()
            parts = []
            for inverse in (False, True):
                banned = [x for x, i in t.p.args if i == inverse]
                if banned or (not inverse and not any(i for _, i in t.p.args)):
                    s = self.bgp([S.Triple(b, p, a) if inverse else S.Triple(a, p, b)], graph)
                    parts.append(Solution(s.df.where(~s.slots[p.name].expr().lex().isin(*banned)), s.slots))
            pairs = functools.reduce(union, parts)
        else:
            step = self.bgp([S.Triple(a, t.p.args[0], b)], graph)
            term = lambda n: F.struct(*[c.alias(x) for c, x in zip((step.slots[n].expr().general().col, step.slots[n].expr().general().k, step.slots[n].expr().general().d, step.slots[n].expr().general().l), ("v", "k", "d", "l"))])
            edges = step.df.select(term("__a").alias("src"), term("__b").alias("dst")).distinct()
            fixed = lambda end: None if isinstance(end, S.Var) else self._constant_term(end)
            if kind == "opt":
                reached = edges
            elif (start := fixed(t.s)) is not None:  # a bound end: only what it reaches, or what reaches it
                reached = reachable(edges, start)
            elif (start := fixed(t.o)) is not None:
                turned = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
                reached = turned.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            else:
                reached = transitive_closure(edges)
            if kind in ("star", "opt"):
                every = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()
                for end in (t.s, t.o):  # a named end reaches itself even if no edge touches it
                    if not isinstance(end, S.Var):
                        every = every.unionByName(self._constant_term(end)).distinct()
                reached = reached.unionByName(every.select("src", F.col("src").alias("dst"))).distinct()
            cols, slots = [], {}
            for n, c in (("__a", "src"), ("__b", "dst")):
                slots[n], x = put(n, Expr("term", F.col(f"{c}.v"), k=F.col(f"{c}.k"), d=F.col(f"{c}.d"), l=F.col(f"{c}.l")))
                cols += x
            pairs = Solution(reached.select(*cols), slots)
        return self._ends(pairs, t)

    def _constant_term(self, end: object) -> DataFrame:
        g = constant(end).general()
        return self.spark.range(1).select(F.struct(g.col.cast("string").alias("v"), g.k.cast("string").alias("k"), g.d.cast("string").alias("d"), g.l.cast("string").alias("l")).alias("src"))

    def _ends(self, pairs: Solution, t: S.Triple) -> Solution:
        """The pairs' ends named as, or compared with, the pattern's subject and object."""
        tests, cols, slots = [], [], {}
        for want, n in ((t.s, "__a"), (t.o, "__b")):
            have = pairs.slots[n].expr()
            if not isinstance(want, S.Var):
                tests.append(F.coalesce(same_term(have, constant(want)), F.lit(False)))
            elif want.name in slots:
                tests.append(same_term(pairs.slots["__a"].expr(), have))
            else:
                slots[want.name], c = put(want.name, have)
                cols += c
        return Solution(pairs.df.where(conjunction(tests)).select(*(cols or [F.lit(1).alias("__one")])), slots)

    def values(self, v: S.Values) -> Solution:
        slots, columns, data = {}, [], []
        for i, n in enumerate(v.names):
            terms = [r[i] for r in v.rows]
            bound = [t for t in terms if t is not None]
            maybe = len(bound) < len(terms)
            if all(isinstance(t, S.Iri) for t in bound):
                slots[n], columns = Slot(n, "iri", maybe=maybe), [*columns, [(n, [t.value if t else None for t in terms], "string")]]
            elif all(isinstance(t, S.Lit) and t.datatype == S.XSD + "string" and not t.lang for t in bound):
                slots[n], columns = Slot(n, "str", S.XSD + "string", maybe=maybe), [*columns, [(n, [t.value if t else None for t in terms], "string")]]
            elif all(isinstance(t, S.Lit) and t.datatype == S.XSD + "integer" for t in bound):
                slots[n], columns = Slot(n, "num", S.XSD + "integer", maybe=maybe), [*columns, [(n, [int(t.value) if t else None for t in terms], "bigint")]]
            else:
                slots[n] = Slot(n, "term", maybe=maybe)
                kind = lambda t: None if t is None else "iri" if isinstance(t, S.Iri) else "lit"
                columns.append([(n, [t and t.value for t in terms], "string"), (f"{n}__k", [kind(t) for t in terms], "string"), (f"{n}__d", [getattr(t, "datatype", None) for t in terms], "string"), (f"{n}__l", [getattr(t, "lang", None) for t in terms], "string")])
        flat = [c for cs in columns for c in cs]
        data = list(zip(*[c[1] for c in flat])) if flat else [(1,)] * len(v.rows)
        schema = ", ".join(f"`{c[0]}` {c[2]}" for c in flat) or "__one int"
        return Solution(self.spark.createDataFrame(data, schema), slots)

    def group(self, g: S.Group, graph: object = DEFAULT) -> Solution:
        inner, filters = self._group(g, graph)
        return self._filter(inner, filters, graph)

    def _group(self, g: S.Group, graph: object) -> tuple[Solution, list]:
        """The group without its own filters, and those filters."""
        out, filters, block = None, [], []

        def settle() -> Solution:
            nonlocal out, block
            if block:
                part = self.bgp(block, graph)
                out, block = part if out is None else self.join(out, part), []
            return out if out is not None else self.unit()

        for item in g.items:
            if isinstance(item, S.Triple):
                block.append(item)
            elif isinstance(item, S.Filter):
                filters.append(item.expr)
            elif isinstance(item, S.Optional_):
                left = settle()
                right, inner = self._group(item.group, graph)
                if any(isinstance(f, S.Exists) for f in inner):
                    right, inner = self._filter(right, [f for f in inner if isinstance(f, S.Exists)], graph), [f for f in inner if not isinstance(f, S.Exists)]
                own = [f for f in inner if S.variables(f) <= set(right.slots)]
                right = self._filter(right, own, graph)
                rest = [f for f in inner if f not in own]
                scope = {**right.slots, **left.slots}
                on = conjunction([F.coalesce(compile_expr(f, scope).ebv(), F.lit(False)) for f in rest]) if rest else None
                out = self.join(left, right, "left", on)
            elif isinstance(item, S.Minus_):
                left, right = settle(), self.group(item.group, graph)
                out = self.keep(left, right, "left_anti") if set(left.slots) & set(right.slots) else left
            elif isinstance(item, S.Bind):
                left = settle()
                if item.var in left.slots:
                    raise S.SparqlError(f"BIND to ?{item.var}, which is in use")
                slot, cols = put(item.var, compile_expr(item.expr, left.slots), True)
                out = Solution(left.df.select("*", *cols), {**left.slots, item.var: slot})
            else:
                if isinstance(item, S.Union_):
                    part = self._union(item, graph)
                elif isinstance(item, S.Graph_):
                    part = self.group(item.group, item.name)
                elif isinstance(item, S.Values):
                    part = self.values(item)
                    here = settle() if block or out is not None else None
                    if here is not None and len(item.names) == 1 and len(item.rows) <= SMALL and item.names[0] in here.slots and not here.slots[item.names[0]].maybe and len({repr(r) for r in item.rows}) == len(item.rows) and all(r[0] is not None for r in item.rows):
                        have = here.slots[item.names[0]].expr()
                        out = Solution(here.df.where(functools.reduce(lambda a, b: a | b, [F.coalesce(same_term(have, constant(r[0])), F.lit(False)) for r in item.rows], F.lit(False))), here.slots)
                        continue
                elif isinstance(item, S.Select):
                    part = self.select(item, graph)
                else:
                    part = self.group(item, graph)
                here = settle() if block or out is not None else None
                out = part if here is None else self.join(here, part)
        return settle(), filters

    def _union(self, item: S.Union_, graph: object) -> Solution:
        """Branches that are single patterns with the same ends and constant predicates become one scan over a set of predicates."""
        single = [b.items[0] for b in item.branches if len(b.items) == 1 and isinstance(b.items[0], S.Triple)]
        if len(single) == len(item.branches) > 1 and len({(t.s, t.o) for t in single}) == 1 and all(isinstance(t.p, S.Iri) for t in single) and hasattr(self.source, "df"):
            wanted = [t.p.value for t in single]
            if len(set(wanted)) == len(wanted):
                p = self.fresh()
                s = self.source.scan([S.Triple(single[0].s, p, single[0].o)], graph)
                slots = {n: x for n, x in s.slots.items() if n != p.name}
                return Solution(s.df.where(F.col(p.name).isin(*wanted)).drop(p.name), slots)
        return functools.reduce(union, [self.group(b, graph) for b in item.branches])

    def _filter(self, s: Solution, filters: list, graph: object) -> Solution:
        for f in filters:
            if isinstance(f, S.Exists):
                s = self._exists(s, f, graph)
            elif isinstance(f, S.Call) and f.name == "&&":
                s = self._filter(s, f.args, graph)
            elif isinstance(f, S.Call) and f.name == "!" and isinstance(f.args[0], S.Exists):
                s = self._exists(s, S.Exists(f.args[0].group, not f.args[0].negated), graph)
            else:
                flags: list[str] = []
                holder = [s]

                def mark(e: S.Exists) -> Column:
                    name = f"__e{len(flags)}"
                    flags.append(name)
                    holder[0] = self._mark(holder[0], e, graph, name)
                    return F.col(name)

                test = compile_expr(f, s.slots, mark).ebv()
                s = Solution(holder[0].df.where(F.coalesce(test, F.lit(False))).drop(*flags), s.slots)
        return s

    def _exists(self, s: Solution, e: S.Exists, graph: object) -> Solution:
        inner, filters = self._group(e.group, graph)
        own = [f for f in filters if isinstance(f, S.Exists) or S.variables(f) <= set(inner.slots) or not S.variables(f) & set(s.slots)]
        inner = self._filter(inner, own, graph)
        rest = [f for f in filters if f not in own]  # they speak of the outer row: part of the condition
        on = None
        if rest:
            scope = {**inner.slots, **s.slots}
            on = conjunction([F.coalesce(compile_expr(f, scope).ebv(), F.lit(False)) for f in rest])
        how = "left_anti" if e.negated else "left_semi"
        if not set(s.slots) & set(inner.slots) and on is None:
            none = inner.df.isEmpty()
            return Solution(s.df.where(F.lit(none == e.negated)), s.slots)
        return self.keep(s, inner, how, on)

    def _mark(self, s: Solution, e: S.Exists, graph: object, name: str) -> Solution:
        """The solutions with a flag column: EXISTS inside an OR or another expression."""
        inside = S.variables(e.group)
        slots = {n: x for n, x in s.slots.items() if n in inside}
        columns = [c for x in slots.values() for c in x.columns]
        if not columns:
            found = not self.group(e.group, graph).df.isEmpty()
            return Solution(s.df.withColumn(name, F.lit(found != e.negated)), s.slots)
        asked = Solution(s.df.select(*[F.col(f"`{c}`") for c in columns]).distinct(), slots)  # the answer depends on these bindings alone
        hit = self._exists(asked, S.Exists(e.group, False), graph).df.select(*[F.col(f"`{c}`").alias(f"__h_{c}") for c in columns]).withColumn(name, F.lit(True))
        same = conjunction([F.col(f"`{c}`").eqNullSafe(F.col(f"`__h_{c}`")) for c in columns])
        df = s.df.join(hit, same, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)) != F.lit(e.negated)).drop(*[f"__h_{c}" for c in columns])
        return Solution(df, s.slots)

    # -- solution modifiers
    def select(self, q: S.Select, graph: object = DEFAULT) -> Solution:
        s = self.group(q.where, graph)
        if q.values:
            s = self.join(s, self.values(q.values))
        items = q.items
        grouped = bool(q.group_by) or any(_has_aggregate(e) for _, e in items or []) or any(_has_aggregate(e) for e in q.having)
        if items is None:
            items = [(n, None) for n in s.slots if not n.startswith(("_h", "_p", "_b"))]
        order = list(q.order_by)
        if grouped:
            s, items, having, order = self._aggregate(s, q, items, order)
            for h in having:
                s = Solution(s.df.where(F.coalesce(compile_expr(h, s.slots).ebv(), F.lit(False))), s.slots)
        for n, e in items:
            if e is not None:
                slot, cols = put(n, compile_expr(e, s.slots), True)
                taken = {c.lower() for c in slot.columns}
                s = Solution(s.df.select(*[F.col(f"`{c}`") for c in s.df.columns if c.lower() not in taken], *cols), {**s.slots, n: slot})
        names = [n for n, _ in items]
        slots = {}
        for n in names:
            if n not in s.slots:
                s = Solution(s.df.withColumn(n, F.lit(None).cast("string")), {**s.slots, n: Slot(n, "str", maybe=True)})
            slots[n] = s.slots[n]
        keys = [k for e, up in order for k in order_keys(compile_expr(e, s.slots), up)]
        columns = [c for n in names for c in slots[n].columns]
        pick = lambda df: df.select(*[F.col(f"`{c}`") for c in columns])
        if q.distinct:  # sort keys are among the selected variables
            df = pick(s.df).distinct()
            df = df.orderBy(*keys) if keys else df
        else:
            df = pick(s.df.orderBy(*keys) if keys else s.df)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solution(df, slots)

    def _aggregate(self, s: Solution, q: S.Select, items: list, order: list) -> tuple[Solution, list, list, list]:
        """Groups; aggregates become variables and expressions over them keep their shape."""
        keys, key_slots, cols = [], {}, []
        renamed: list[tuple[object, S.Var]] = []
        for i, (n, e) in enumerate(q.group_by):
            name = n or f"__g{i}"
            slot, c = put(name, compile_expr(e, s.slots), True)
            if n is None:
                renamed.append((e, S.Var(name)))
            key_slots[name] = slot
            cols += c
            keys += slot.columns
        aggregates: list[tuple[S.Call, str]] = []

        def lift(e: object) -> object:
            for old, new in renamed:
                if e == old:
                    return new
            if isinstance(e, S.Call):
                if e.name in S.AGGREGATES:
                    for known, name in aggregates:
                        if known == e:
                            return S.Var(name)
                    name = f"__agg{len(aggregates)}"
                    aggregates.append((e, name))
                    return S.Var(name)
                return S.Call(e.name, [lift(a) for a in e.args], e.distinct, e.separator)
            return e

        items = [(n, lift(e) if e is not None else None) for n, e in items]
        having = [lift(e) for e in q.having]
        order = [(lift(e), up) for e, up in order]
        outputs, slots = [], dict(key_slots)
        for call, name in aggregates:
            made = _aggregate_column(call, s.slots)
            slot, c = put(name, made, True)
            slots[name] = slot
            outputs += c
        base = s.df.select(*[F.col(f"`{c}`") for c in s.df.columns if c not in keys], *cols)
        df = base.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*(outputs or [F.lit(1).alias("__one")]))
        return Solution(df, slots), items, having, order


def _first(x: Expr, y: Expr) -> Expr:
    if x.kind != "term":
        return Expr(x.kind, F.coalesce(x.col, y.col), x.dt, x.template)
    have = x.col.isNotNull()
    pick = lambda a, b: F.when(have, a).otherwise(b)
    return Expr("term", pick(x.col, y.col), k=pick(x.k, y.k), d=pick(x.d, y.d), l=pick(x.l, y.l))


def _has_aggregate(e: object) -> bool:
    return isinstance(e, S.Call) and (e.name in S.AGGREGATES or any(map(_has_aggregate, e.args)))


def _aggregate_column(call: S.Call, scope: dict[str, Slot]) -> Expr:
    n = call.name
    if not call.args:
        if call.distinct:
            cols = [F.col(f"`{c}`") for s in scope.values() for c in s.columns]
            return Expr("num", F.count_distinct(F.struct(*cols)), S.XSD + "integer")
        return Expr("num", F.count(F.lit(1)), S.XSD + "integer")
    e = compile_expr(call.args[0], scope)
    identity = e.col if e.kind != "term" else F.when(e.col.isNotNull(), F.struct(e.col, e.k, e.d, e.l))
    if n == "COUNT":
        return Expr("num", F.count_distinct(identity) if call.distinct else F.count(e.col), S.XSD + "integer")
    if n in ("SUM", "AVG"):
        x = e.num()
        bad = F.max((e.col.isNotNull() & x.isNull()).cast("int"))  # one value that is no number makes the sum an error
        total = F.sum_distinct(x) if call.distinct else F.sum(x)
        made = total if n == "SUM" else total / F.nullif(F.count_distinct(x) if call.distinct else F.count(x), F.lit(0))
        whole = n == "SUM" and e.dt and e.dt.endswith(("integer", "int", "long"))
        return Expr("num", F.when(F.coalesce(bad, F.lit(0)) == 0, F.coalesce(made, F.lit(0))), S.XSD + ("integer" if whole else "double"))
    if n in ("MIN", "MAX", "SAMPLE"):
        f = F.max if n == "MAX" else F.min  # SAMPLE: the smallest, so that every run gives the same
        if e.kind != "term":
            return Expr(e.kind, f(e.col), e.dt, e.template)
        rank = F.when(e.k == "bnode", 1).when(e.k == "iri", 2).otherwise(3)
        best = f(F.when(e.col.isNotNull(), F.struct(rank.alias("r"), F.coalesce(e.num(), e.year().cast("double")).alias("n"), e.col.alias("v"), e.k.alias("k"), e.d.alias("d"), e.l.alias("l"))))
        return Expr("term", best["v"], k=best["k"], d=best["d"], l=best["l"])
    if n == "GROUP_CONCAT":
        text = F.coalesce(e.text(), e.lex())
        gathered = F.sort_array(F.collect_set(text) if call.distinct else F.collect_list(text))
        return Expr("str", F.array_join(gathered, call.separator), S.XSD + "string")
    raise S.SparqlError(f"unknown aggregate {n}")


def bind_expr(text: str, scope: dict[str, Slot]) -> Expr:
    """An expression given as text, for callers that build plans by hand."""
    return compile_expr(S.Parser(text).expr(), scope)


__all__ = ["Compiler", "compare", "bind_expr"]
