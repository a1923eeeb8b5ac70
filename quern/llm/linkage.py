"""Matching entities across sources without keys: loopy belief propagation over candidate pairs."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.people import candidate_pairs, date_agrees, parsed
from quern.runtime import discard, durable, settles

#: Messages are exchanged until none moves a log-odds by more than TOLERANCE.  DAMPING keeps part of the old message, more of it from the rounds
#: on at which loops have not come to rest; after ROUNDS the pairs that still move are marked as such.
TOLERANCE, ROUNDS, DAMPING = 1e-3, 200, {0: 0.1, 8: 0.5, 60: 0.9}
#: Log-odds are cut off here, where a probability is settled anyway, so that a rival's share is never lost in a sum.
MOST = 20.0
#: Parts over which the pairs of a record are spread when the totals of its factors come back.
SPREAD = 8

# Log-odds of what speaks for or against a pair; what contradicts it outright never becomes a candidate.
PRIOR = 3.0
EDITS = (0.0, -0.8, -2.2, -4.0, -6.0)
FORENAME, FATHER, DATE, OFFICE = 1.5, 1.0, 1.5, 0.4
#: Against a pair of which only one side has a surname.
BARE = -2.5
SCORED = 1.5
#: Against two contexts of different fathers, or forenames, that name one person.
CONTRADICTS = -3.0


def propagate(pairs: DataFrame, left: str, right: str, log_odds: str, one_left: bool = True, one_right: bool = True, facets: Sequence[str] = (), contradicts: float = CONTRADICTS) -> DataFrame:
    """``(left, right, confidence, converged)``: marginal probability that a pair is a match.

    Factor graph: a binary variable for each pair with its own log-odds, and factors between which messages go back and forth.

    * A left record, and a right one, is in at most one true pair (``one_left``, ``one_right``; without, in any number).  The message of such a
      factor to a pair is 1 / (1 + the odds of its rivals).
    * ``facets`` are columns that say something about the left record which all left records of one right record must share (a father, a
      forename): one-to-one between right records and *individuals*, where one individual may be behind many left records.  For each right record
      and facet a hidden value is the true one; true pairs of another value cost ``contradicts`` each; null says nothing.  The message
      compares the hidden value's weight with that of all others.

    A round is one sum by left record and one by right record and facet value (both combined map-side), joined back to the messages once a side;
    rounds go on until the messages stand still, so evidence travels from pair to pair through both kinds of records.  Pairs that no factor with a rival touches are
    settled at once and leave the loop.  ``converged`` is false for a pair whose messages still moved after ROUNDS rounds.

    Null ids or log-odds are dropped; repeated pairs count once with their best log-odds; no pairs give an empty result.
    """
    base = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(log_odds).isNotNull())
    names = [f"f{i}" for i in range(len(facets))]
    base = durable(base.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.max(F.col(log_odds).cast("double")).alias("u"), *[F.max(F.col(c).cast("string")).alias(n) for c, n in zip(facets, names)]))
    held = []
    for side, on in (("l", one_left), ("r", one_right)):
        if on:
            many = base.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(side)
            held.append(base.join(many, side, "left_semi").select("l", "r"))
    if names:
        differ = functools.reduce(lambda a, b: a | b, [F.col(f"lo{n}") < F.col(f"hi{n}") for n in names])
        split = base.groupBy("r").agg(*[f(n).alias(f"{x}{n}") for n in names for f, x in ((F.min, "lo"), (F.max, "hi"))]).where(differ).select("r")
        held.append(base.where(F.coalesce(*names).isNotNull()).join(split, "r", "left_semi").select("l", "r"))
    sides = {"ml": one_left, "mr": one_right}
    out = lambda df, p, rest: df.select(F.col("l").alias(left), F.col("r").alias(right), p.alias("confidence"), rest.alias("converged"))
    odds = F.exp(F.least(F.greatest(F.col("u"), F.lit(-MOST)), F.lit(MOST)))
    if not held:
        return out(base, odds / (1 + odds), F.lit(True))
    rivals = durable(functools.reduce(DataFrame.unionByName, held).distinct())
    free = base.join(rivals, ["l", "r"], "left_anti").select("l", "r", (odds / (1 + odds)).alias("p"), F.lit(True).alias("rest"))
    messages = [m for m, on in sides.items() if on] + [f"m{n}" for n in names]
    salt = F.pmod(F.xxhash64("l"), F.lit(SPREAD)).cast("int").alias("part")
    first = base.join(rivals, ["l", "r"]).select("l", "r", odds.alias("o"), *names, salt, *[F.lit(1.0).alias(m) for m in messages], F.lit(1.0).alias("moved"))
    state = durable(first)
    soft = math.exp(contradicts)

    def cavity(m: str) -> Column:
        """A pair's odds from all but one of its factors."""
        return functools.reduce(lambda a, b: a * b, [F.col(x) for x in messages if x != m], F.col("o"))

    weigh = lambda c: F.log1p(c) - F.log1p(soft * c)
    for k in range(ROUNDS):
        damping = next(d for at, d in sorted(DAMPING.items(), reverse=True) if k >= at)
        step = state
        if one_left:
            step = step.join(state.groupBy("l").agg(F.sum(cavity("ml")).alias("tl")), "l")
        if one_right or names:
            # by right record: the rivals' odds, and for each facet the weight of each of its values (the facet's categories, so a short list)
            cells = F.explode(F.array(*([F.struct(F.lit("mr").alias("m"), F.lit("").alias("v"), cavity("mr").alias("w"))] if one_right else []), *[F.struct(F.lit(f"m{n}").alias("m"), F.col(n).alias("v"), weigh(cavity(f"m{n}")).alias("w")) for n in names])).alias("c")
            sums = state.select("r", cells).where("c.v is not null").groupBy("r", "c.m", "c.v").agg(F.sum("c.w").alias("w"))
            tr = sums.groupBy("r").agg(F.collect_list(F.struct("m", "v", "w")).alias("tr"))
            tr = tr.select("r", "tr", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))  # a record with very many pairs stays spread
            step = step.join(tr, ["r", "part"], "left")
        fresh = {}
        if one_left:
            fresh["ml"] = 1 / (1 + F.greatest(F.col("tl") - cavity("ml"), F.lit(0.0)))
        if one_right:
            fresh["mr"] = 1 / (1 + F.greatest(_total(lambda x: x["m"] == "mr", lambda x: x["w"]) - cavity("mr"), F.lit(0.0)))
        for n in names:
            fresh[f"m{n}"] = _facet_message(n, weigh(cavity(f"m{n}")), soft)
        damped = {m: F.exp(damping * F.log(F.col(m)) + (1 - damping) * F.log(x)) for m, x in fresh.items()}
        step = step.select("l", "r", "o", *names, "part", *[F.col(m).alias(f"old_{m}") for m in messages], *[x.alias(m) for m, x in damped.items()])
        moved = functools.reduce(lambda a, b: a + b, [F.abs(F.log(F.col(m)) - F.log(F.col(f"old_{m}"))) for m in messages])
        following = durable(step.select("l", "r", "o", *names, "part", *messages, moved.alias("moved")))
        discard(state)
        state = following
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= TOLERANCE:
            break
    belief = functools.reduce(lambda a, b: a * b, [F.col(m) for m in messages], F.col("o"))
    settled = state.select("l", "r", (belief / (1 + belief)).alias("p"), (F.col("moved") <= TOLERANCE).alias("rest"))
    return out(free.unionByName(settled), F.col("p"), F.col("rest"))


def _total(which: Callable[[Column], Column], amount: Callable[[Column], Column]) -> Column:
    """A sum over the entries of ``tr`` that a test picks."""
    return F.aggregate(F.filter("tr", lambda x: which(x)), F.lit(0.0), lambda a, x: a + amount(x))


def _facet_message(name: str, mine: Column, soft: float) -> Column:
    """What a facet tells a pair: the weight of all other values against that of its own, the pair itself aside."""
    message, value = f"m{name}", F.col(name)
    own = _total(lambda x: (x["m"] == message) & (x["v"] == value), lambda x: x["w"]) - mine
    others = _total(lambda x: (x["m"] == message) & (x["v"] != value), lambda x: F.exp(F.least(x["w"] - own, F.lit(50.0))))
    return F.when(value.isNull(), F.lit(1.0)).otherwise((1 + soft * others) / (1 + others))


def _edits() -> Column:
    d = F.col("d1") + F.col("d2")
    return F.element_at(F.array(*[F.lit(x) for x in EDITS]), F.least(d, F.lit(len(EDITS) - 1)) + 1)


def pair_log_odds() -> Column:
    """What the attributes of a candidate pair say together; missing ones say nothing."""
    said = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    office = F.lower(F.trim("l_office")) == F.lower(F.trim("r_office"))
    scored = F.coalesce((F.col("score") - 0.4) * SCORED, F.lit(0.0))
    return F.lit(PRIOR) + _edits() + said(F.col("bare").isNotNull(), BARE) + said(F.col("prae"), FORENAME) + said(F.col("father"), FATHER) + said(F.col("dated"), DATE) + said(office, OFFICE) + scored


@settles
def match_people(contexts: DataFrame, persons: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """``(context_id, dprr_uri, confidence, converged)``: contexts and the reference persons they may name.

    Candidates come from :func:`quern.llm.people.candidate_pairs` (no shared key: names within two edits a part, by metric cells); a pair is out
    if forename, gender, father, or date and era, where given, contradict.  A surname may be missing on one side; then forename, father or date
    must support the pair, and it weighs less.  Its log-odds sum what the attributes say, with the best of
    ``scored`` (``context_id, dprr_uri, score``; only scores from 0 to 1) as weak evidence.  Loopy belief propagation then weighs rivals on both
    sides: a context names at most one person; a person may be named by many contexts, but these are one individual, so contexts whose
    fathers, or forenames, differ from each other (where the reference has none to tell) are rivals for it.

    Nulls in any column say nothing; null ids are dropped; repeated rows count once; empty tables give an empty result; other columns are ignored.
    """
    fields = {"name": "name", "praenomen": "praenomen", "nomen": "nomen", "cognomen": "cognomen", "filiation": "filiation"}
    left = parsed(contexts, "context_id", fields, {"d0": F.col("date_start"), "d1": F.col("date_end"), "office": F.col("office")})
    left = durable(left.withColumns({"forename": F.col("prae"), "sire": F.col("father")}).distinct())
    ref = {"name": "dprr_label", "praenomen": "praenomen", "nomen": "nomen", "cognomen": "cognomen", "filiation": "filiation"}
    right = durable(parsed(persons, "dprr_uri", ref, {"low": F.col("era_from"), "high": F.col("era_to"), "office": F.col("highest_office")}).distinct())
    pairs = candidate_pairs(left, right).withColumn("dated", date_agrees("l_d0", "l_d1", "r_low", "r_high")).where(F.coalesce("dated", F.lit(True)))
    pairs = durable(pairs)
    if scored is None:
        pairs = pairs.withColumn("score", F.lit(None).cast("double"))
    else:
        wanted = scored.where(F.col("score").between(0, 1)).select(F.col("context_id").alias("l_id"), F.col("dprr_uri").alias("r_id"), "score")
        best = wanted.join(pairs.select("l_id", "r_id"), ["l_id", "r_id"], "left_semi").groupBy("l_id", "r_id").agg(F.max("score").alias("score"))
        pairs = pairs.join(best, ["l_id", "r_id"], "left")
    weighed = pairs.select("l_id", "r_id", pair_log_odds().alias("u"), "l_forename", "l_sire")
    matched = propagate(weighed, "l_id", "r_id", "u", one_left=True, one_right=False, facets=("l_forename", "l_sire"))
    return matched.withColumnsRenamed({"l_id": "context_id", "r_id": "dprr_uri"})
