"""Forward-chaining inference: RDFS by default, more OWL rules on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.closure import transitive_closure
from quern.plans.syntax import OWL, RDFS, TYPE
from quern.runtime import durable

SUB_PROPERTY, SUB_CLASS = RDFS + "subPropertyOf", RDFS + "subClassOf"
_COLUMNS = ["g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]


#: Axioms up to so many pairs are closed on the driver, and their predicates and classes become filters that reach the scan.
FEW = 2000


def has_axioms(quads: DataFrame) -> bool:
    return not quads.where(F.col("p").isin(SUB_PROPERTY, SUB_CLASS)).isEmpty()


def _axioms(quads: DataFrame, p: str) -> DataFrame:
    return quads.where((F.col("p") == p) & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def materialize(quads: DataFrame, owl: bool = False, rounds: int = 64) -> DataFrame:
    """The new triples that follow, none that are there; languages and datatypes are kept.  Empty without sub-property or sub-class axioms.

    The axioms are closed first (a small graph); then one join on the predicate and one on the class carry every fact to all of
    its super-properties and super-classes.  Only facts whose predicate or class occurs in an axiom are read, and compared with what is there only
    facts of the predicates that can be new; nothing of the rest is written or shuffled.
    ``owl`` adds symmetric, inverse and transitive properties, domains and ranges, repeated until nothing new follows; a fix-point that is not
    reached in ``rounds`` rounds is an error.
    """
    quads = quads.select(*_COLUMNS)
    empty = quads.limit(0)
    if not owl and not has_axioms(quads):
        return empty
    known = durable(quads.distinct()) if owl else quads
    new = None
    for _ in range(rounds):
        every = known if new is None else known.unionByName(new)
        if owl:
            fresh = durable(_minus(_rdfs(every)[0].unionByName(_owl(every)).distinct(), every))
        else:
            found, touched = _rdfs(every)
            fresh = durable(_minus(found.distinct(), touched))
        if fresh.isEmpty():
            return empty if new is None else new
        new = fresh if new is None else durable(new.unionByName(fresh))
        if not owl and not _feeds_axioms(fresh):
            return new
    raise RuntimeError(f"inference is not complete after {rounds} rounds")


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    test = None
    right = b.select(*[F.col(c).alias(f"__{c}") for c in _COLUMNS])
    for c in _COLUMNS:
        same = F.col(c).eqNullSafe(F.col(f"__{c}")) if c in ("g", "o_dt", "o_lang") else F.col(c) == F.col(f"__{c}")
        test = same if test is None else test & same
    return a.join(right, test, "left_anti")


def _feeds_axioms(fresh: DataFrame) -> bool:
    return not fresh.where(F.col("p").isin(SUB_PROPERTY, SUB_CLASS)).isEmpty()


def _closed(axioms: DataFrame) -> tuple[DataFrame, list[tuple[str, str]] | None]:
    """The pairs of the axioms' closure, and as a list if they are few."""
    rows = axioms.distinct().limit(FEW + 1).collect()
    if len(rows) > FEW:
        return transitive_closure(axioms).where("src <> dst"), None
    up: dict[str, set[str]] = {}
    for r in rows:
        up.setdefault(r["src"], set()).add(r["dst"])
    pairs = []
    for start in up:
        seen, ahead = set(), list(up[start])
        while ahead:
            node = ahead.pop()
            if node not in seen:
                seen.add(node)
                ahead += up.get(node, ())
        pairs += [(start, n) for n in sorted(seen - {start})]
    return axioms.sparkSession.createDataFrame(pairs, "src string, dst string"), pairs


def _of(quads: DataFrame, column: str, axioms: DataFrame, pairs: list[tuple[str, str]] | None, side: int) -> DataFrame:
    """The quads whose column holds one of the axioms' ends: by a filter if they are few, else by a semi-join."""
    if pairs is not None and len({p[side] for p in pairs}) <= FEW:
        return quads.where(F.col(column).isin(*sorted({p[side] for p in pairs})))
    return quads.join(axioms.select(F.col(("src", "dst")[side]).alias(column)).distinct(), column, "left_semi").select(*_COLUMNS)


def _rdfs(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What follows by the two rules, and the facts that are there of the predicates and classes that can follow."""
    (up_p, few_p), (up_c, few_c) = _closed(_axioms(quads, SUB_PROPERTY)), _closed(_axioms(quads, SUB_CLASS))
    typed = quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri"))
    small = lambda df, few: F.broadcast(df) if few is not None else df
    facts, kinds = _of(quads, "p", up_p, few_p, 0), _of(typed, "o", up_c, few_c, 0)
    by_property = facts.join(small(up_p, few_p), facts["p"] == up_p["src"]).select("g", "s", "s_kind", F.col("dst").alias("p"), "o", "o_kind", "o_dt", "o_lang")
    by_class = kinds.join(small(up_c, few_c), kinds["o"] == up_c["src"]).select("g", "s", "s_kind", "p", F.col("dst").alias("o"), "o_kind", "o_dt", "o_lang")
    touched = _of(quads, "p", up_p, few_p, 1).unionByName(_of(typed, "o", up_c, few_c, 1))
    return by_property.unionByName(by_class), touched


def _owl(quads: DataFrame) -> DataFrame:
    of_type = lambda t: quads.where((F.col("p") == TYPE) & (F.col("o") == OWL + t)).select(F.col("s").alias("ax")).distinct()
    facts = quads.where("o_kind <> 'lit'")
    turned = lambda p: [F.col("g"), F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), p.alias("p"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")]
    sym = of_type("SymmetricProperty")
    out = facts.join(sym, facts["p"] == sym["ax"]).select(*turned(F.col("p")))
    inv = _axioms(quads, OWL + "inverseOf")
    both = inv.unionByName(inv.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = out.unionByName(facts.join(both, facts["p"] == both["src"]).select(*turned(F.col("dst"))))
    trans = of_type("TransitiveProperty")
    chain = facts.join(trans, facts["p"] == trans["ax"]).select("g", "s", "s_kind", "p", "o", "o_kind")
    nxt = chain.select(F.col("g").alias("g2"), F.col("s").alias("mid"), F.col("p").alias("p2"), F.col("o").alias("o2"), F.col("o_kind").alias("k2"))
    step = chain.join(nxt, (F.col("o") == F.col("mid")) & (F.col("p") == F.col("p2")) & F.col("g").eqNullSafe(F.col("g2")))
    none = [F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")]
    out = out.unionByName(step.select("g", "s", "s_kind", "p", F.col("o2").alias("o"), F.col("k2").alias("o_kind"), *none))
    typed = [F.lit(TYPE).alias("p"), F.col("dst").alias("o"), F.lit("iri").alias("o_kind"), *none]
    dom, rng = _axioms(quads, RDFS + "domain"), _axioms(quads, RDFS + "range")
    out = out.unionByName(quads.join(dom, quads["p"] == dom["src"]).select("g", "s", "s_kind", *typed))
    return out.unionByName(facts.join(rng, facts["p"] == rng["src"]).select("g", F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), *typed))
