"""Variant spellings of names typed by people: metric-space partitioning and exact radius joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.metric import RADIUS
from quern.llm.people import candidate_pairs, date_agrees, parsed
from quern.llm.survivors import real_name
from quern.runtime import durable, settles

_FIELDS = {"name": "name", "praenomen": "praenomen", "nomen": "nomen", "cognomen": "cognomen", "filiation": "filiation"}


def range_years(text: Column) -> Column:
    """``struct<low, high>`` of a written range such as ``10 BC–24 AD``, ``109 - 108 BC``, ``185 BC–?`` or ``-00010/00024``."""
    iso = F.regexp_extract(text, r"^\s*(-?\d{4,6})/(-?\d{4,6})?\s*$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*(-?\d{4,6})/(-?\d{4,6})\s*$", 2).try_cast("int")
    both = r"(?i)^[^\d?]*(\d+)?\??\s*(BC|AD|BCE|CE)?\s*(?:[-–—/]|to)\s*[^\d?]*(\d+)?\??\s*(BC|AD|BCE|CE)?"
    a, ea = F.regexp_extract(text, both, 1).try_cast("int"), F.upper(F.regexp_extract(text, both, 2))
    b, eb = F.regexp_extract(text, both, 3).try_cast("int"), F.upper(F.regexp_extract(text, both, 4))
    sign = lambda n, e: F.when(e.startswith("B"), -n).otherwise(n)
    low, high = sign(a, F.when(ea == "", eb).otherwise(ea)), sign(b, F.when(eb == "", ea).otherwise(eb))
    is_iso = text.rlike(r"^\s*-?\d{4,6}/")
    return F.struct(F.when(is_iso, iso[0]).otherwise(low).alias("low"), F.when(is_iso, iso[1]).otherwise(high).alias("high"))


def _one_person(pairs: DataFrame, bare: str) -> DataFrame:
    """Of the pairs whose ``bare`` side lacks a surname, those with the one person that fits it best; of persons that fit alike, none.

    Persons differ if their surnames lie more than RADIUS edits apart or their forenames differ.  A person is out if the dates of some of its
    pairs contradict and those of none agree: then the undated ones mean somebody else, too.
    """
    ident, other = f"{bare}_id", "r_forename" if bare == "l" else "l_forename"
    here = Window.partitionBy(ident)
    weight = sum(F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0) for c, w in (("prae", 3), ("father", 2), ("dated", 3))) - F.col("d1")
    open_ = F.coalesce("dated", F.lit(True))
    best = pairs.where(F.col("bare") == bare).withColumn("weight", F.when(open_, weight))
    best = best.withColumn("best", F.max(F.when(open_, F.struct("weight", "surname", other))).over(here))
    same = (F.levenshtein("surname", "best.surname") <= RADIUS) & F.coalesce(F.col(other) == F.col(f"best.{other}"), F.lit(True))
    best = best.withColumn("same", same)
    rival = F.max(F.when(~F.col("same"), F.col("weight"))).over(here)
    agrees = F.max(F.when(F.col("same"), F.col("dated"))).over(here)
    best = best.withColumns({"rival": rival, "agrees": agrees})
    return best.where(F.col("same") & open_ & F.coalesce("agrees", F.lit(True)) & F.coalesce(F.col("rival") < F.col("best.weight"), F.lit(True))).select(*pairs.columns)


@settles
def link_variants(contexts: DataFrame, entities: DataFrame, most_edits: int = 3) -> DataFrame:
    """``(context_id, id, edits)``: each written name and the person records whose name means the same individual.

    Names agree if nomen and surname (spelling keys: case, accents, script, v/u, doubled letters, endings and pet forms aside) are each within
    two edits, three together; a nomen cut short agrees with one that it begins; reordered parts, restored letters and numbers don't
    matter.  Forename, gender, father and date must not contradict where both sides have them.  Where the context has no
    forename and records of several forenames fit, a record whose dates are known to fit excludes those not known to.  A surname may be
    missing on one side; then forename, father or date must support the pair, and no other person may fit as well.

    Only entities of type person with a real name take part; null, blank and unreadable names match nothing; repeated rows count once;
    empty tables give an empty result; other columns are ignored.
    """
    left = parsed(contexts, "context_id", _FIELDS, {"d0": F.col("date_start"), "d1": F.col("date_end")}).distinct()
    people = entities.where((F.lower(F.trim("entity_type")) == "person") & real_name(F.col("canonical_name")))
    years = range_years(F.col("date_range"))
    right = parsed(people, "id", {"name": "canonical_name"}, {"low": years["low"], "high": years["high"]}).withColumn("forename", F.col("prae")).distinct()
    left = left.withColumn("forename", F.col("prae"))
    right = durable(right)
    numbers = durable(right.select("id").distinct().withColumn("r_id", F.monotonically_increasing_id()))  # pairs carry numbers: ids are long
    right = right.join(numbers, "id").drop("id").withColumnRenamed("r_id", "id")
    pairs = candidate_pairs(durable(left), durable(right)).where(F.col("d1") + F.col("d2") <= most_edits)
    dated = durable(pairs.withColumn("dated", date_agrees("l_d0", "l_d1", "r_low", "r_high")))
    dated = dated.where("bare is null").where(F.coalesce("dated", F.lit(True))).unionByName(_one_person(dated, "l")).unionByName(_one_person(dated, "r"))
    known = F.col("l_forename").isNull() & F.col("r_forename").isNotNull()
    here = Window.partitionBy("l_id")
    rivals = F.when(known, F.min("r_forename").over(here) != F.max("r_forename").over(here))
    fits = F.max(F.when(F.col("dated"), 1).otherwise(0)).over(here)
    kept = dated.select("*", rivals.alias("rivals"), fits.alias("fits")).where(~F.coalesce(F.col("rivals") & (F.col("fits") == 1) & F.col("dated").isNull(), F.lit(False)))
    return kept.select("r_id", F.col("l_id").alias("context_id"), (F.col("d1") + F.col("d2")).alias("edits")).join(numbers, "r_id").select("context_id", "id", "edits")
