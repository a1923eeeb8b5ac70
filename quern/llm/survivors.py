"""Best representative of each duplicate group: a latent two-sided quality model of the sources, and survivors by field."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import durable, settles

# The origins, most trusted first; every other origin and null come last, as one source.
TRUST = ("curated", "concordance", "derived")
OTHER = len(TRUST)

# What stands in a field that holds nothing.
FILLERS = ("unknown", "incertus", "incerta", "ignotus", "ignota", "anonymous", "anonymus", "none", "null", "n/a", "na", "nan", "tbd", "todo", "stub", "placeholder", "untitled", "no description", "nn", "n.n.", "s.d.", "uncertain", "undated", "no date")

FIELDS = ("canonical_name", "date_range", "description")

#: Beta priors (successes, failures) of a source's sensitivity and specificity and of a value being true, for each fact counted: a prior
#: on the scale of the data keeps "false values are rare in every source" from being swapped with its mirror image.
SENSITIVITY, SPECIFICITY, TRUTH = (0.6, 0.4), (0.95, 0.05), (0.6, 0.4)


def is_filler(value: Column) -> Column:
    """Null, blank, without any letter or digit, or one of FILLERS, brackets and case aside."""
    bare = F.lower(F.regexp_replace(F.trim(value), r"^[\s\[\](){}<>.…?\-–—]+|[\s\[\](){}<>…?\-–—]+$", ""))
    return F.coalesce(~value.rlike(r"[\p{L}\p{N}]") | bare.isin(*FILLERS) | F.rtrim(bare, F.lit(".")).isin(*FILLERS), F.lit(True))


def real_name(name: Column) -> Column:
    """A name has a letter outside square brackets and is no filler."""
    outside = F.regexp_replace(name, r"\[[^\]]*\]", "")
    return F.coalesce(~is_filler(name) & outside.rlike(r"\p{L}"), F.lit(False))


def real_value(field: str) -> Column:
    """Whether the column of that name holds a real value: a name, a range with at least one year, or a description."""
    value = F.col(field)
    if field == "canonical_name":
        return real_name(value)
    if field == "date_range":
        return F.coalesce(value.rlike(r"\p{Nd}"), F.lit(False))
    return ~is_filler(value)


def claims(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, field_name, value, id, source, updated_at)``: the real values of each record; repeated rows once."""
    kept = records.where("id is not null").select("id", *FIELDS, "origin", "updated_at").distinct()
    trust = F.lit(OTHER)
    for rank, name in reversed(list(enumerate(TRUST))):
        trust = F.when(F.lower(F.trim("origin")) == name, F.lit(rank)).otherwise(trust)
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(real_value(f), F.col(f)).alias("value")) for f in FIELDS])
    long = kept.select("id", trust.alias("source"), "updated_at", F.explode(cells).alias("c")).select("id", "source", "updated_at", "c.*").where("value is not null")
    return long.join(groups, "id").select("group_id", "field_name", "value", "id", "source", "updated_at")


@dataclass
class Quality:
    """What EM found: sensitivity and specificity of each source by field, and the truth of every pattern of claims."""

    sensitivity: dict[tuple[str, int], float]
    specificity: dict[tuple[str, int], float]
    truth: list[tuple[str, int, int, float]]
    rounds: int


def value_key(value: Column) -> Column:
    """Two spellings of a value that differ only in case and spacing are one claim."""
    return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))


def facts(claimed: DataFrame) -> DataFrame:
    """``(group_id, field_name, value_key, said, covers)``: by value, the sources (as bits) that state it and those that state any."""
    bit = F.expr("shiftleft(1, source)")
    stated = claimed.groupBy("group_id", "field_name", value_key(F.col("value")).alias("value_key")).agg(F.bit_or(bit).alias("said"))
    covers = claimed.groupBy("group_id", "field_name").agg(F.bit_or(bit).alias("covers"))
    return stated.join(covers, ["group_id", "field_name"])


def infer_quality(fact: DataFrame, sources: int = OTHER + 1, tolerance: float = 1e-6, rounds: int = 200) -> Quality:
    """Expectation-maximisation of the two-sided latent truth model.

    A source that says anything about a field of a group either states a value or, by not stating it, denies it.  Values stated
    by the same sources out of the same covering sources are alike for the model, so its sufficient statistics are the counts of those
    patterns: at most ``len(FIELDS) * 4 ** sources`` rows (768), whatever the size of the table.  They are counted by Spark over every
    row, and EM runs on the counts.
    """
    counted = fact.groupBy("field_name", "said", "covers").agg(F.count(F.lit(1)).alias("n")).collect()
    sens, spec, truth, most = {}, {}, [], 0
    for field in sorted({r["field_name"] for r in counted}):
        rows = sorted((r for r in counted if r["field_name"] == field), key=lambda r: (r["said"], r["covers"]))
        said = np.array([[r["said"] >> s & 1 for s in range(sources)] for r in rows], float)
        covers = np.array([[r["covers"] >> s & 1 for s in range(sources)] for r in rows], float)
        n = np.array([r["n"] for r in rows], float)
        a, b, prior, total = np.full(sources, 0.7), np.full(sources, 0.9), 0.75, n.sum()
        for most_here in range(1, rounds + 1):
            yes = np.log(prior) + (covers * (said * np.log(a) + (1 - said) * np.log(1 - a))).sum(1)
            no = np.log(1 - prior) + (covers * (said * np.log(1 - b) + (1 - said) * np.log(b))).sum(1)
            p = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
            w, v = (n * p)[:, None], (n * (1 - p))[:, None]
            a2 = ((w * covers * said).sum(0) + SENSITIVITY[0] * total) / ((w * covers).sum(0) + total)
            b2 = ((v * covers * (1 - said)).sum(0) + SPECIFICITY[0] * total) / ((v * covers).sum(0) + total)
            prior2 = ((n * p).sum() + TRUTH[0] * total) / (2 * total)
            moved = max(np.abs(a2 - a).max(), np.abs(b2 - b).max(), abs(prior2 - prior))
            a, b, prior = a2, b2, prior2
            if moved < tolerance:
                break
        most = max(most, most_here)
        sens |= {(field, s): float(a[s]) for s in range(sources)}
        spec |= {(field, s): float(b[s]) for s in range(sources)}
        truth += [(field, int(r["said"]), int(r["covers"]), float(q)) for r, q in zip(rows, p)]
    return Quality(sens, spec, truth, most)


def judged(fact: DataFrame, quality: Quality) -> DataFrame:
    """The facts with ``truth``, the posterior probability that the value is right."""
    table = fact.sparkSession.createDataFrame(quality.truth or [("", 0, 0, 0.0)], "field_name string, said int, covers int, truth double")
    return fact.join(F.broadcast(table), ["field_name", "said", "covers"], "left").select("group_id", "field_name", "value_key", "truth")


@settles
def survivors(records: DataFrame, groups: DataFrame, retain: float = 0.5) -> DataFrame:
    """``(group_id, field_name, id, value, truth, retained, likeliest, likeliest_truth)`` for each group of two or more records and each field with a real value.

    ``id`` is the record whose value survives.  Names and ranges: the most trusted origin, then the latest ``updated_at`` (null is
    the oldest), then the smallest id.  Descriptions: the longest in characters, then the same.  ``truth`` is the quality model's
    posterior of the surviving value and ``retained`` the number of values of the field that it judges true (``truth >= retain``);
    the values themselves are the rows of :func:`retained_values`.  ``likeliest`` is the value that the model holds to be most probably true (equal
    ones: the smaller): where it differs, the stated order, which is what decides, keeps another value than the sources' quality speaks for.

    Groups without any real value of a field have no row for it; null ids are dropped; empty tables give an empty result.  A group's
    winner is a partial aggregate (a minimum of a sort key), so a group with a third of all records costs one row per map task.
    """
    claimed = durable(claims(records, groups))
    several = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    fact = durable(facts(claimed))
    true = durable(judged(fact, infer_quality(fact)))
    longest = F.when(F.col("field_name") == "description", -F.char_length("value")).otherwise(F.lit(0))
    age = -F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62)))
    best = claimed.groupBy("group_id", "field_name").agg(F.min(F.struct(longest.alias("l"), F.col("source").alias("s"), age.alias("t"), F.col("id"), F.col("value"))).alias("b"))
    won = best.select("group_id", "field_name", "b.id", "b.value", value_key(F.col("b.value")).alias("value_key")).join(several, "group_id")
    best_value = F.min(F.struct((-F.col("truth")).alias("t"), F.col("value_key").alias("v"))).alias("m")
    kept = true.groupBy("group_id", "field_name").agg(F.sum((F.col("truth") >= retain).cast("long")).alias("retained"), best_value)
    out = won.join(true, ["group_id", "field_name", "value_key"]).join(kept, ["group_id", "field_name"])
    return out.select("group_id", "field_name", "id", "value", "truth", "retained", F.col("m.v").alias("likeliest"), (-F.col("m.t")).alias("likeliest_truth"))


@settles
def retained_values(records: DataFrame, groups: DataFrame, retain: float = 0.5) -> DataFrame:
    """``(group_id, field_name, value_key, truth)``: every value judged true, one row each; fields may keep several."""
    fact = durable(facts(claims(records, groups)))
    return judged(fact, infer_quality(fact)).where(F.col("truth") >= retain)


def source_quality(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``(field_name, origin, sensitivity, specificity)`` as inferred; a handful of rows."""
    q = infer_quality(durable(facts(claims(records, groups))))
    names = [*TRUST, "other"]
    rows = [(f, names[s], q.sensitivity[f, s], q.specificity[f, s]) for f, s in sorted(q.sensitivity)]
    return records.sparkSession.createDataFrame(rows, "field_name string, origin string, sensitivity double, specificity double")
