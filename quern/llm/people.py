"""People as points of the name space: parsing, candidate pairs by metric cells, and what contradicts a match."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import names
from quern.llm.metric import near_points, near_words
from quern.runtime import durable, ship

#: Letters of a nomen cut short from which a slip, or a missing surname, is allowed; and the least that match anything.
HEAD, LEAST = 4, 2
#: Years by which a date may lie outside a range before it contradicts it.
SLACK = 2

_FIELDS = ("name", "praenomen", "nomen", "cognomen", "filiation")
_FORM = "struct<nomen: string, first: string, cut: boolean, second: string>"


def _forms(row: tuple) -> tuple[str | None, str | None, str | None, list[dict]]:
    name, praenomen, nomen, cognomen, filiation = row
    n = names.parse(name)
    first = names.praenomen(praenomen) or n.praenomen
    father = n.filiation
    if not father and filiation:
        father = names.praenomen(filiation.split(" ")[0])
    raw = names._marks.sub("", names._bracket.sub(" ", nomen or "")).strip()
    short = raw.endswith(".")
    field = names.spelling(raw, not short)
    stems = [(n.nomen, n.cut)] if n.nomen else []
    if field and (field, short) not in stems:
        stems.append((field, short))
    surname = names.spelling(names._marks.sub("", names._bracket.sub(" ", cognomen or "")))
    seconds = list(dict.fromkeys(names.cognomen_key(c) for c in (n.cognomen, surname) if c)) or [""]
    gender = next((g for x, cut in stems if not cut and (g := names.gender(x))), None)
    forms = [{"nomen": x, "first": None if cut else names.nomen_key(x), "cut": cut, "second": s} for x, cut in stems for s in seconds]
    return first, gender, father, list({(f["nomen"], f["cut"], f["second"]): f for f in forms}.values())


def parsed(df: DataFrame, ident: str, columns: dict[str, str], keep: dict[str, Column]) -> DataFrame:
    """One row for each spelling of a person: ``id``, praenomen, gender, father, nomen, first, cut, second, and ``keep``.

    ``columns`` says which column holds the name, praenomen, nomen, cognomen and filiation; what a field lacks is taken from
    the name and the other way round; where both are there and differ, both spellings count.
    """
    ship(df.sparkSession)
    cols = [(F.col(columns[f]) if f in columns else F.lit(None)).cast("string").alias(f) for f in _FIELDS]
    source = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), *cols, *[c.alias(k) for k, c in keep.items()])
    kept = source.select("id", *keep).schema
    labels = ["id", "prae", "gender", "father", "forms", *keep]
    form_type = pa.list_(pa.struct([("nomen", pa.string()), ("first", pa.string()), ("cut", pa.bool_()), ("second", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_forms(r) for r in zip(*(b.column(i).to_pylist() for i in range(1, 6)))]
            head = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            extra = [b.column(i) for i in range(6, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), *head, pa.array([r[3] for r in rows], form_type), *extra], names=labels)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name != "id")
    out = source.mapInArrow(parse, f"id {kept['id'].dataType.simpleString()}, prae string, gender string, father string, forms array<{_FORM}>" + (f", {types}" if types else ""))
    return out.select("id", "prae", "gender", "father", F.explode("forms").alias("f"), *keep).select("id", "prae", "gender", "father", "f.*", *keep)


def _heads(nomen: Column, cut: bool) -> Column:
    """Keys of which a nomen cut short shares one with any that begins like it, a slip aside: the first two letters, or, if the slip is there,
    the next two, which it may move by a letter."""
    part = lambda tag, i: F.concat(F.lit(tag), F.substring(nomen, i, 2))
    return F.explode(F.array_distinct(F.array(part("a", 1), *[part("b", i) for i in ((3,) if cut else (2, 3, 4))]))).alias("head")


def _begin(short: Column, long: Column) -> Column:
    """The edits between a nomen cut short and the beginning of another; null if they are too many for its length."""
    n = F.char_length(short)
    edits = F.least(*[F.levenshtein(short, F.substring(long, F.lit(1), n + k)) for k in (-1, 0, 1)])
    return F.when((n >= LEAST) & (edits <= F.when(n >= HEAD, 1).otherwise(0)), edits)


def candidate_points(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of spellings that may mean one person: ``l_nomen, l_cut, l_second, r_nomen, r_cut, r_second, d1, d2``.

    Both parts within RADIUS edits (see :mod:`quern.llm.metric`); a nomen cut short agrees with one that begins like it, a slip aside.
    A surname that only one side has is missing on the other: for such names the second table has pairs of nomina alone, ``l_nomen,
    l_cut, r_nomen, r_cut, d1``.
    """
    cols = ["nomen", "first", "cut", "second"]
    a = durable(left.select(*cols).distinct())
    b = durable(right.select(*cols).distinct())

    def axis(column: str) -> DataFrame:
        return near_words(a.select(F.col(column).alias("word")).dropna().distinct(), b.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(F.count(F.lit(1)).alias("n")))

    words1, words2 = axis("first"), axis("second")
    out = ["l_nomen", "l_cut", "l_second", "r_nomen", "r_cut", "r_second", "d1", "d2"]
    l, r = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in cols]) for df, p in ((a, "l"), (b, "r")))  # noqa: E741
    point = lambda df, p: df.where(f"not {p}_cut").withColumnsRenamed({f"{p}_first": f"{p}1", f"{p}_second": f"{p}2"})
    whole = near_points(point(l, "l"), point(r, "r"), words1, words2).withColumnsRenamed({"l2": "l_second", "r2": "r_second"}).select(*out)

    longer = F.char_length("l_nomen") >= F.char_length("r_nomen")

    def one_cut(x: DataFrame, y: DataFrame, near: DataFrame | None = None) -> DataFrame:
        """Rows of which the left nomen is cut short, and those of which the right one is, both with ``d1``; of two cut ones the shorter is.
        With ``near``, their surnames are of its pairs: the rows cut short are copied to them, the others stand at their own."""
        key = lambda df, c, cut: df.select("*", _heads(F.col(c), cut))
        cut_l, cut_r = x.where("l_cut"), y.where("r_cut")
        on_l, on_r = ["head"], ["head"]
        if near is not None:
            cut_l, cut_r = cut_l.join(near, "l_second"), cut_r.join(near, "r_second")
            on_l, on_r = ["head", "r_second"], ["head", "l_second"]
        by_l = key(cut_l, "l_nomen", True).join(key(y, "r_nomen", False), on_l).where(~F.col("r_cut") | ~longer).withColumn("d1", _begin(F.col("l_nomen"), F.col("r_nomen")))
        by_r = key(x, "l_nomen", False).join(key(cut_r, "r_nomen", True), on_r).where(~F.col("l_cut") | longer).withColumn("d1", _begin(F.col("r_nomen"), F.col("l_nomen")))
        return by_l.unionByName(by_r).where("d1 is not null")

    surnames = words2.where("l <> ''").select(F.col("l").alias("l_second"), F.col("r").alias("r_second"), F.col("d").alias("d2"))
    short = one_cut(l.where("l_second <> ''"), r.where("r_second <> ''"), surnames).select(*out).distinct()

    kinds = lambda df, p: df.groupBy(*[F.col(c).alias(f"{p}_{c}") for c in cols[:3]]).agg(F.max(F.col("second") == "").alias(f"{p}_bare"), F.max(F.col("second") != "").alias(f"{p}_named"))
    one_bare = F.expr("l_bare and r_named or l_named and r_bare")
    la, ra = kinds(a, "l"), kinds(b, "r")
    nomina = la.where("not l_cut").join(words1.select(F.col("l").alias("l_first"), F.col("r").alias("r_first"), F.col("d").alias("d1")), "l_first")
    nomina = nomina.join(ra.where("not r_cut"), "r_first").where(one_bare).select("l_nomen", "l_cut", "r_nomen", "r_cut", "d1")
    enough = F.least(F.char_length("l_nomen"), F.char_length("r_nomen")) >= HEAD
    begun = one_cut(la, ra).where(F.expr("l_bare or r_bare") & enough).select("l_nomen", "l_cut", "r_nomen", "r_cut", "d1").distinct()
    nomina = nomina.unionByName(begun)
    return whole.unionByName(short), nomina


def agree(a: str, b: str) -> Column:
    """True if both are there and equal, false if they differ, null if one is missing."""
    return F.col(a) == F.col(b)


def date_agrees(start: str, end: str, low: str, high: str) -> Column:
    """Whether a date (its end may be missing) meets a range (either end may be missing); null if one side has no year."""
    first, last = F.coalesce(start, end), F.coalesce(end, start)
    return F.when(first.isNotNull() & F.coalesce(low, high).isNotNull(), (last >= F.coalesce(low, F.col(high) - 100) - SLACK) & (first <= F.coalesce(high, F.col(low) + 100) + SLACK))


def _bare_rows(l: DataFrame, r: DataFrame, nomina: DataFrame) -> DataFrame:  # noqa: E741
    """Rows of both sides whose nomina agree and of which only one has a surname, or neither where a nomen is cut short, from ``nomina``.

    The forename, which must not differ, is part of the key: it splits the rows of a large family.
    """
    some = F.array(*[F.lit(p) for p in (*names.PRAENOMINA, "")])
    asked = lambda c: F.explode(F.when(F.col(c).isNull(), some).otherwise(F.array(F.col(c), F.lit("")))).alias("k")
    own = lambda c: F.coalesce(F.col(c), F.lit("")).alias("k")
    parts = [("l_second = ''", asked, "true", own), ("l_second <> ''", own, "r_second = ''", asked)]
    near = [l.where(x).select("*", kx("l_prae")).join(nomina, ["l_nomen", "l_cut"]).join(r.where(y).select("*", ky("r_prae")), ["r_nomen", "r_cut", "k"]) for x, kx, y, ky in parts]
    return near[0].where("l_cut or r_cut or r_second <> ''").unionByName(near[1]).drop("k")


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of people whose names agree but for spelling and missing parts, and whose forename, gender and father don't contradict.

    ``(l_id, r_id, bare, surname, d1, d2, prae, father)`` and the kept columns of both sides, prefixed, among them ``d0, d1`` of the left and ``low, high``
    of the right; the closest spellings of a pair count.  ``bare`` is ``l`` or ``r`` if that side alone lacks a surname (``l``, too, if both do and a nomen is cut short), else null, and ``surname`` the other's; as the
    nomen says little by itself, the forename, the father or the date must support such a pair.
    """
    points, nomina = candidate_points(left, right)
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "first"])
    l, r = side(left, "l"), side(right, "r")  # noqa: E741
    rows = l.join(durable(points), ["l_nomen", "l_cut", "l_second"]).join(r, ["r_nomen", "r_cut", "r_second"]).withColumns({"bare": F.lit(None).cast("string"), "surname": F.lit(None).cast("string")})
    dated = date_agrees("l_d0", "l_d1", "r_low", "r_high")
    said = lambda c: F.coalesce(c, F.lit(False))
    supported = said(agree("l_prae", "r_prae")) | said(agree("l_father", "r_father")) | said(dated)
    bare = _bare_rows(l, r, durable(nomina)).where(supported).withColumns({"bare": F.when(F.col("l_second") == "", "l").otherwise("r"), "surname": F.greatest("l_second", "r_second"), "d2": F.lit(0)})
    fits = F.coalesce(agree("l_prae", "r_prae"), F.lit(True)) & F.coalesce(agree("l_gender", "r_gender"), F.lit(True)) & F.coalesce(agree("l_father", "r_father"), F.lit(True))
    kept = [c for c in [*l.columns, *r.columns] if c not in ("l_id", "r_id") and c[2:] not in ("nomen", "cut", "second", "prae", "gender", "father")]
    near = F.min(F.struct(F.col("bare").isNotNull().alias("lacks"), (F.col("d1") + F.col("d2")).alias("d"), "d1", "d2", "bare", "surname")).alias("d")
    both = rows.unionByName(bare).where(fits).groupBy("l_id", "r_id").agg(near, F.max(agree("l_prae", "r_prae")).alias("prae"), F.max(agree("l_father", "r_father")).alias("father"), *[F.max(c).alias(c) for c in kept])
    return both.select("l_id", "r_id", "d.bare", "d.surname", F.col("d.d1").alias("d1"), F.col("d.d2").alias("d2"), "prae", "father", *kept)
