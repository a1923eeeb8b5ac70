"""Record linkage with explainable scores: evidence signals, weighting, ranking, name matching, date disambiguation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.onomastics import is_greek, normalize_office, normalize_praenomen, parse_filiation, parse_office, parse_roman_name, transliterate
from quern.functions.text import attestation_to_inscription, era_label
from quern.operators.relational import era_distance, rank_with_gap, weighted_score

# Weights of the signals, and least ages for offices.
WEIGHTS = {"filiation": 0.4, "career": 0.3, "geography": 0.2, "temporal": 0.1}
LEAST_AGE = {"consul": 35, "praetor": 33, "aedilis": 30, "tribunus plebis": 27, "quaestor": 25, "legatus": 25, "proconsul": 35, "propraetor": 33}
OLDEST, DEFAULT_AGE, OPEN_START, OPEN_END = 80, 25, -500, 100


def signal(score: Column | float, absent: Column | bool, weight: float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(score).cast("double").alias("score"), F.lit(weight).alias("weight"), lit(absent).alias("is_absent"))


def _cases(weight: float, *cases: tuple[Column, float | None], otherwise: float | None = 0.0) -> Column:
    """The first case that holds; a score of None is an absent signal."""
    made = lambda s: signal(s or 0.0, s is None, weight)
    out = made(otherwise)
    for test, score in reversed(cases):
        out = F.when(F.coalesce(test, F.lit(False)), made(score)).otherwise(out)
    return out


def temporal_signal(era_from: Column, era_to: Column, start: Column, end: Column) -> Column:
    """1 if the middle of the date lies in the era, .5 if they overlap, else 0; absent without an era or a date."""
    mid = F.coalesce((start + end) / 2, start.cast("double"), end.cast("double"))
    low, high = F.coalesce(era_from, F.lit(OPEN_START)), F.coalesce(era_to, F.lit(OPEN_END))
    return _cases(WEIGHTS["temporal"], (era_from.isNull() & era_to.isNull(), None), (mid.isNull(), None), (mid.between(low, high), 1.0), (~((end < low) | (start > high)), 0.5))


def career_signal(offices: Column, era_from: Column, office: Column, at: Column) -> Column:
    """``offices``: ``array<struct<office, date_start>>``.  Held near the date scores by years apart; an age that rules it out scores 0."""
    age = at - era_from
    least = F.lit(DEFAULT_AGE)
    for name, years in LEAST_AGE.items():
        least = F.when(office == name, F.lit(years)).otherwise(least)
    have = F.coalesce(offices, F.array().cast("array<struct<office:string,date_start:int>>"))
    held = F.filter(have, lambda o: F.contains(F.lower(F.coalesce(o["office"], F.lit(""))), office))
    nearest = F.array_min(F.transform(held, lambda o: F.struct(F.abs(F.coalesce(o["date_start"], F.lit(0)) - at).alias("gap"), o["date_start"].alias("at"))))
    gap = nearest["gap"]
    return _cases(
        WEIGHTS["career"],
        (office.isNull(), None),
        ((age < 0) | (age < least) | (age > OLDEST), 0.0),
        ((F.size(held) == 0) & (F.size(have) > 0), 0.3),
        (F.size(held) == 0, 0.0),
        (at.isNull() | nearest["at"].isNull(), 0.5),
        (gap <= 5, 1.0),
        (gap <= 10, 0.7),
        (gap <= 20, 0.5),
        otherwise=0.3,
    )


def filiation_signal(father: Column, grandfather: Column, known_father: Column, known_grandfather: Column) -> Column:
    """Both agree 1, one of them differs 0, only the father can be told .5; absent where a father is unknown."""
    return _cases(
        WEIGHTS["filiation"],
        (father.isNull() | known_father.isNull(), None),
        (father != known_father, 0.0),
        (grandfather == known_grandfather, 1.0),
        (grandfather != known_grandfather, 0.0),
        otherwise=0.5,
    )


def geography_signal(provinces: Column, findspot: Column, italian: Column | None = None, italian_career: Column | None = None) -> Column:
    """1 if the findspot is a province served, .3 for Italy with an Italian career; absent without findspot, or provinces."""
    none = F.coalesce(F.size(provinces), F.lit(0)) <= 0
    italy = (italian if italian is not None else F.lit(False)) & (italian_career if italian_career is not None else F.lit(False))
    return _cases(WEIGHTS["geography"], (findspot.isNull(), None), (none & italy, 0.3), (none, None), (F.array_contains(provinces, findspot), 1.0), (italy, 0.3))


def disambiguate(contexts: DataFrame, persons: DataFrame, posts: DataFrame, family: DataFrame, provinces: DataFrame, k: int = 10) -> DataFrame:
    """Ranked candidates for every context at once: ``context_id, person, label, score, gap, confidence, rank, signals``.

    ``contexts(context_id, nomen, filiation, office, date_start, date_end, findspot)``, ``persons(person, label, nomen, era_from, era_to)``,
    ``posts(person, office, date_start)``, ``family(person, father, grandfather)`` (forenames), ``provinces(person, place)``.
    Candidates share the nomen, case aside.  Offices, family and provinces are aggregated once by person and joined; there is no
    look-up per candidate.
    """
    offices = posts.groupBy("person").agg(F.collect_list(F.struct("office", "date_start")).alias("offices"))  # the posts of one person
    places = provinces.groupBy("person").agg(F.collect_set("place").alias("places"))
    kin = family.groupBy("person").agg(F.min("father").alias("kf"), F.min("grandfather").alias("kg"))
    people = persons.select("person", "label", F.lower("nomen").alias("__n"), "era_from", "era_to").join(offices, "person", "left").join(places, "person", "left").join(kin, "person", "left")
    asked = contexts.where("nomen is not null").withColumn("__n", F.lower("nomen")).withColumn("__f", parse_filiation(F.col("filiation"))).withColumn("__o", normalize_office(F.col("office")))
    pairs = asked.join(people, "__n")
    signals = F.create_map(
        F.lit("filiation"), filiation_signal(F.col("__f.father"), F.col("__f.grandfather"), F.col("kf"), F.col("kg")),
        F.lit("career"), career_signal(F.col("offices"), F.col("era_from"), F.col("__o"), F.col("date_start")),
        F.lit("geography"), geography_signal(F.col("places"), F.col("findspot")),
        F.lit("temporal"), temporal_signal(F.col("era_from"), F.col("era_to"), F.col("date_start"), F.col("date_end")),
    )
    scored = pairs.withColumn("signals", signals).withColumn("score", weighted_score(F.map_values("signals")))
    ranked = rank_with_gap(scored, ["context_id"], "score", [F.col("person").asc()], k)
    return ranked.select("context_id", "person", "label", "score", "gap", "confidence", "rank", "signals")


def family_forenames(people: DataFrame, parents: DataFrame) -> DataFrame:
    """``(person, father, grandfather)``: forenames over two hops of ``parents(child, parent)``; the second may be missing.  The
    smallest parent counts where there are several."""
    one = parents.groupBy("child").agg(F.min("parent").alias("parent"))
    name = people.select(F.col("person").alias("p"), normalize_praenomen(F.col("praenomen")).alias("forename"))
    up = one.join(name, one["parent"] == name["p"]).select("child", "parent", F.col("forename").alias("father"))
    second = up.select(F.col("child").alias("parent"), F.col("father").alias("grandfather"))
    return up.join(second, "parent", "left").select(F.col("child").alias("person"), "father", "grandfather")


def nomen_keys(nomen: Column) -> Column:
    """The nomen and, for one in -ia, its masculine form: the keys under which it is looked up."""
    low = F.lower(nomen)
    return F.when(low.endswith("ia"), F.array(low, F.concat(F.substring(low, F.lit(1), F.char_length(low) - 1), F.lit("us")))).otherwise(F.array(low))


def match_names(left: DataFrame, right: DataFrame, least: int = 5, strict_praenomen: bool = True) -> DataFrame:
    """Pairs by nomen with a score: nomen 1, forename 2, surname 2 if equal, 1 if one holds the other; what contradicts is out.

    Both sides: ``id, praenomen, nomen, cognomen``.  Nomina of one or two letters are not looked up.  With ``strict_praenomen`` off, a
    different forename is tolerated where the surnames are equal (and counts nothing).  An equi-join on exploded keys; the rest is residual.
    """
    l = left.select(F.col("id").alias("l_id"), F.lower("praenomen").alias("lp"), F.lower("cognomen").alias("lc"), F.col("nomen").alias("l_nomen")).where(F.char_length("l_nomen") > 2)  # noqa: E741
    r = right.select(F.col("id").alias("r_id"), F.lower("praenomen").alias("rp"), F.lower("cognomen").alias("rc"), F.lower("nomen").alias("key"))
    pairs = l.withColumn("key", F.explode(nomen_keys(F.col("l_nomen")))).join(r, "key")
    equal = F.col("lc") == F.col("rc")
    part = F.col("lc").contains(F.col("rc")) | F.col("rc").contains(F.col("lc"))
    surname = F.when(F.col("lc").isNull() | F.col("rc").isNull(), 0).when(equal, 2).when(part, 1)
    same = F.col("lp") == F.col("rp")
    forename = F.when(F.col("lp").isNull() | F.col("rp").isNull(), 0).when(same, 2)
    if not strict_praenomen:
        forename = F.coalesce(forename, F.when(F.coalesce(equal, F.lit(False)), 0))
    scored = pairs.withColumn("score", F.lit(1) + forename + surname).where(F.col("score") >= least)
    return scored.groupBy("l_id", "r_id").agg(F.max("score").alias("score"))


def split_unambiguous(pairs: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Pairs whose ends occur once each, and the others."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    marked = pairs.withColumn("__one", (n(left) == 1) & (n(right) == 1))
    return marked.where("__one").drop("__one"), marked.where("not __one").drop("__one")


def disambiguate_by_date(pairs: DataFrame, key: str, target: str, at: str, low: str, high: str, most: float = 30, margin: float = 20, lone: float = 50) -> DataFrame:
    """For each key the candidate whose era is nearest to the date, if it is near and well ahead of the second (a lone dated one: within
    ``lone``); then targets picked by several keys are dropped."""
    dated = pairs.withColumn("distance", era_distance(F.col(at), F.col(low), F.col(high))).where("distance is not null")
    w = Window.partitionBy(key).orderBy("distance", target)
    best = dated.withColumn("__n", F.row_number().over(w)).withColumn("second", F.lead("distance").over(w)).where("__n = 1").drop("__n")
    clear = F.when(F.col("second").isNull(), F.col("distance") <= lone).otherwise((F.col("distance") <= most) & (F.col("second") - F.col("distance") >= margin))
    picked = best.where(clear)
    return picked.withColumn("__t", F.count(F.lit(1)).over(Window.partitionBy(target))).where("__t = 1").drop("__t")


CONTEXT = ("context_id", "name", "normalized_name", "praenomen", "nomen", "cognomen", "filiation", "office", "date_start", "date_end", "findspot")


def context_from_fields(rows: DataFrame) -> DataFrame:
    """Contexts from typed fields ``(context_id, name, filiation, office, date, province)``: the name in Latin spelling and taken apart, the office by
    its usual name, one date as both ends."""
    latin = F.when(is_greek(F.col("name")), transliterate(F.col("name"))).otherwise(F.col("name"))
    named = rows.withColumn("normalized_name", latin).withColumn("__p", parse_roman_name(F.col("normalized_name")))
    return named.select(
        "context_id", "name", "normalized_name", "__p.praenomen", "__p.nomen", "__p.cognomen", "filiation", normalize_office(F.col("office")).alias("office"),
        F.col("date").alias("date_start"), F.col("date").alias("date_end"), F.col("province").alias("findspot"),
    )


def context_from_inscriptions(persons: DataFrame, inscriptions: DataFrame) -> DataFrame:
    """Contexts of people named on inscriptions: ``persons(context_id, name, attestation)``, ``inscriptions(inscription, text, start, end, findspot)``.

    An attestation's URI without its number is its inscription's; the text tells filiation and office; dates that are no numbers are missing; of several
    attestations, or editions, of one person the smallest counts.  All look-ups are joins, for any number of people at once.
    """
    first = persons.groupBy("context_id").agg(F.min(F.struct("name", "attestation")).alias("a")).select("context_id", "a.name", attestation_to_inscription(F.col("a.attestation")).alias("inscription"))
    edition = inscriptions.groupBy("inscription").agg(F.min(F.struct("text", "start", "end", "findspot")).alias("e")).select("inscription", "e.*")
    joined = first.join(edition, "inscription", "left")
    latin = F.when(is_greek(F.col("name")), transliterate(F.col("name"))).otherwise(F.col("name"))
    named = joined.withColumn("normalized_name", latin).withColumn("__p", parse_roman_name(F.col("normalized_name")))
    year = lambda c: F.col(c).cast("string").try_cast("int")
    return named.select(
        "context_id", "name", "normalized_name", "__p.praenomen", "__p.nomen", "__p.cognomen", F.col("text").alias("filiation"), parse_office(F.col("text")).alias("office"),
        year("start").alias("date_start"), year("end").alias("date_end"), "findspot",
    )


def provinces_served(persons: DataFrame, links: DataFrame, gazetteer: str = "pleiades.stoa.org") -> DataFrame:
    """``(person, place)``: the places of the gazetteer that the provinces of ``persons(person, province)`` are linked to."""
    places = links.where(F.contains("target", F.lit(gazetteer))).select(F.col("source").alias("province"), F.col("target").alias("place")).distinct()
    return persons.select("person", "province").dropna().distinct().join(places, "province").select("person", "place").distinct()


def person_text(label: Column, offices: Column, start: Column, end: Column, most: int = 5) -> Column:
    """What a person is compared by: label, up to ``most`` offices (distinct, sorted), era."""
    held = F.slice(F.array_sort(F.array_distinct(F.filter(offices, lambda o: o.isNotNull()))), 1, most)
    return F.concat_ws(". ", label, F.when(F.size(held) > 0, F.array_join(held, ", ")), era_label(start, end))


def flag_matches(matches: DataFrame, known: DataFrame) -> DataFrame:
    """``matches(left_id, right_id, left_nomen, right_nomen, ...)`` that are not among ``known(left_id, right_id)``, with ``new``: whether the nomina differ."""
    rest = matches.join(known.select("left_id", "right_id").distinct(), ["left_id", "right_id"], "left_anti")
    return rest.withColumn("new", ~F.lower("left_nomen").eqNullSafe(F.lower("right_nomen")))
