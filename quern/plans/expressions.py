"""SPARQL expressions as columns; an error is null."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.syntax import RDF, XSD, Call, Exists, Iri, Lit, SparqlError, Var
from quern.plans.terms import BOOLEAN, INTEGERS, STRING, Expr, Slot, compare, constant, same_term

Scope = dict[str, Slot]


def _str(c: Column) -> Expr:
    return Expr("str", c, STRING)


def _bool(c: Column) -> Expr:
    return Expr("bool", c, BOOLEAN)


def _num(c: Column, dt: str = XSD + "double") -> Expr:
    return Expr("num", c, dt)


def _merge(parts: list[Expr], pick: Callable[[list[Column]], Column]) -> Expr:
    """Several expressions as one of a common kind: the same native kind, else general terms."""
    kinds = {(p.kind, p.template) for p in parts}
    if len(kinds) == 1 and parts[0].kind != "term":
        dt = parts[0].dt if len({p.dt for p in parts}) == 1 else XSD + "double" if parts[0].kind == "num" else parts[0].dt
        cols = [p.col for p in parts]
        return Expr(parts[0].kind, pick(cols), dt, parts[0].template)
    g = [p.general() for p in parts]
    return Expr("term", pick([x.col for x in g]), k=pick([x.k for x in g]), d=pick([x.d for x in g]), l=pick([x.l for x in g]))


_SIMPLE_STR = {"LCASE": F.lower, "UCASE": F.upper, "ENCODE_FOR_URI": lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), "MD5": lambda c: F.md5(c.cast("binary")), "SHA1": lambda c: F.sha1(c.cast("binary"))}
_MATH = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + F.lit(0.5))}
_PAIRS = {"CONTAINS": lambda a, b: a.contains(b), "STRSTARTS": lambda a, b: a.startswith(b), "STRENDS": lambda a, b: a.endswith(b)}
_DATES = {"MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5, "SECONDS": 6}
_DATE = r"^(-?\d+)-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?"


def compile_expr(e: object, scope: Scope, exists: Callable[[Exists], Column] | None = None) -> Expr:
    """``scope``: the slots of the variables in sight; a variable out of sight is unbound.  ``exists`` answers EXISTS inside expressions."""
    go = functools.partial(compile_expr, scope=scope, exists=exists)
    if isinstance(e, Var):
        return scope[e.name].expr() if e.name in scope else _str(F.lit(None).cast("string"))
    if isinstance(e, (Iri, Lit)):
        return constant(e)
    if isinstance(e, Exists):
        if exists is None:
            raise SparqlError("EXISTS is allowed in FILTER only")
        return _bool(exists(e))
    assert isinstance(e, Call)
    n = e.name
    if n in ("||", "&&"):
        a, b = (go(x).ebv() for x in e.args)
        return _bool(a | b if n == "||" else a & b)
    if n == "!":
        return _bool(~go(e.args[0]).ebv())
    if n in ("=", "!=", "<", "<=", ">", ">="):
        return _bool(compare(n, go(e.args[0]), go(e.args[1])))
    if n in ("IN", "NOT IN"):
        left = go(e.args[0])
        hits = [compare("=", left, go(x)) for x in e.args[1:]]
        found = functools.reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
        return _bool(found if n == "IN" else ~found)
    if n in ("+", "-", "*", "/"):
        a, b = go(e.args[0]), go(e.args[1])
        whole = a.kind == b.kind == "num" and a.dt in INTEGERS and b.dt in INTEGERS and n != "/"
        x, y = a.num(), b.num()
        out = {"+": lambda: F.try_add(x, y), "-": lambda: F.try_subtract(x, y), "*": lambda: F.try_multiply(x, y), "/": lambda: F.try_divide(x.cast("double"), y.cast("double"))}[n]()
        return _num(out, XSD + ("integer" if whole else "double"))
    if n == "neg":
        a = go(e.args[0])
        return _num(-a.num(), a.dt or XSD + "double")
    if n.startswith("CAST:"):
        return _cast(n[5:], go(e.args[0]))
    if n == "IF":
        test = go(e.args[0]).ebv()
        return _merge([go(e.args[1]), go(e.args[2])], lambda c: F.when(test, c[0]).when(~test, c[1]))
    if n == "COALESCE":
        return _merge([go(x) for x in e.args], lambda c: F.coalesce(*c))
    if n == "BOUND":
        v = go(e.args[0])
        return _bool(v.col.isNotNull())
    args = [go(x) for x in e.args]
    a = args[0] if args else None
    if n == "STR":
        return _str(a.lex())
    if n in _SIMPLE_STR:
        return _str(_SIMPLE_STR[n](a.text()))
    if n in ("SHA256", "SHA384", "SHA512"):
        return _str(F.sha2(a.text().cast("binary"), int(n[3:])))
    if n == "STRLEN":
        return _num(F.char_length(a.text()).cast("bigint"), XSD + "integer")
    if n == "SUBSTR":
        start = args[1].num().cast("int")
        length = args[2].num().cast("int") if len(args) > 2 else F.lit(2**31 - 1)
        return _str(F.substring(a.text(), start, length))
    if n == "CONCAT":
        return _str(F.concat(*[x.text() for x in args]) if args else F.lit(""))
    if n == "REPLACE":
        flags = e.args[3].value if len(e.args) > 3 else ""
        pattern = F.concat(F.lit(f"(?{flags})" if flags else ""), args[1].text())
        return _str(F.regexp_replace(a.text(), pattern, args[2].text()))
    if n in ("STRBEFORE", "STRAFTER"):
        x, y = a.text(), args[1].text()
        at = F.position(y, x)
        found = F.substring(x, F.lit(1), at - 1) if n == "STRBEFORE" else F.substring(x, at + F.char_length(y), F.char_length(x))
        return _str(F.when(at > 0, found).when(at == 0, F.lit("")))
    if n in _PAIRS:
        return _bool(_PAIRS[n](a.text(), args[1].text()))
    if n == "REGEX":
        flags = e.args[2].value if len(e.args) > 2 else ""
        if isinstance(e.args[1], Lit):
            return _bool(a.text().rlike((f"(?{flags})" if flags else "") + e.args[1].value))
        return _bool(F.regexp_like(a.text(), F.concat(F.lit(f"(?{flags})" if flags else ""), args[1].text())))
    if n == "LANG":
        return _str(F.when(a.kind_col() == "lit", F.coalesce(a.lang_col(), F.lit(""))))
    if n == "LANGMATCHES":
        tag, want = F.lower(a.text()), F.lower(args[1].text())
        return _bool(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))
    if n == "DATATYPE":
        plain = F.when(a.lang_col().isNotNull(), F.lit(RDF + "langString")).otherwise(F.coalesce(a.dt_col(), F.lit(STRING)))
        return Expr("iri", F.when(a.kind_col() == "lit", plain))
    if n in ("IRI", "URI"):
        return Expr("iri", a.lex())
    if n == "SAMETERM":
        return _bool(same_term(a, args[1]))
    if n in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
        return _bool(a.kind_col() == {"ISIRI": "iri", "ISURI": "iri", "ISLITERAL": "lit", "ISBLANK": "bnode"}[n])
    if n == "ISNUMERIC":
        return _bool(F.when(a.kind_col().isNotNull(), a.num().isNotNull()))
    if n in _MATH:
        return _num(_MATH[n](a.num()), a.dt or XSD + "double")
    if n == "RAND":
        return _num(F.rand())
    if n == "YEAR":
        return _num(a.year().cast("bigint"), XSD + "integer")
    if n in _DATES:
        part = F.regexp_extract(a.lex(), _DATE, _DATES[n])
        return _num(part.try_cast("double") if n == "SECONDS" else part.try_cast("bigint"), XSD + ("decimal" if n == "SECONDS" else "integer"))
    if n == "NOW":
        return Expr("time", F.current_timestamp(), XSD + "dateTime")
    if n == "UUID":
        return Expr("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))
    if n == "STRUUID":
        return _str(F.uuid())
    if n == "BNODE":
        return Expr("term", F.concat(F.lit("_:"), F.uuid() if a is None else F.md5(a.lex().cast("binary"))), k=F.lit("bnode"), d=F.lit(None).cast("string"), l=F.lit(None).cast("string"))
    if n == "STRDT":
        return Expr("term", a.text(), k=F.when(a.text().isNotNull(), F.lit("lit")), d=args[1].lex(), l=F.lit(None).cast("string"))
    if n == "STRLANG":
        return Expr("term", a.text(), k=F.when(a.text().isNotNull(), F.lit("lit")), d=F.lit(RDF + "langString"), l=F.lower(args[1].text()))
    raise SparqlError(f"{n} is not allowed here")


def _cast(target: str, a: Expr) -> Expr:
    text = F.trim(a.lex())
    if target in INTEGERS:
        number = a.num().cast("double")
        return _num(F.coalesce(text.try_cast("bigint"), F.when(number.isNotNull() & ~F.isnan(number), number.try_cast("bigint"))), XSD + "integer")
    if target in (XSD + "double", XSD + "float", XSD + "decimal"):
        return _num(text.try_cast("double"), target)
    if target == STRING:
        return _str(a.lex())
    if target == BOOLEAN:
        return _bool(F.coalesce(a.boolean(), F.lower(text).try_cast("boolean"), a.num() != 0))
    return Expr("term", a.lex(), k=F.when(a.lex().isNotNull(), F.lit("lit")), d=F.lit(target), l=F.lit(None).cast("string"))
