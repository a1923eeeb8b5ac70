"""Each operator against brute force on small fixtures, and on nulls, blanks, ties, repeats, empty tables and clashing columns."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import components, leakage, linkage, mixture, names, neighbours, sentences, survivors, topn, variants
from quern.llm.metric import near_points, radius_join
from quern.runtime import durable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1: top n
def test_top_n(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(400), rng.choice([0.0, -0.0, 0.5, 1.0, 1.5, -1.0, math.nan, None])) for _ in range(3000)]
    data += data[:200] + [("copies", 7, 0.5)] * 500 + [("one", 1, 1.0), ("none", 2, math.nan)]
    best = defaultdict(dict)
    for g, i, s in data:
        if g is not None and s is not None and 0 <= s <= 1:
            best[g][i] = max(best[g].get(i, -1), s)
    want = sorted((g, i) for g, m in best.items() for i, _ in sorted(m.items(), key=lambda kv: (-kv[1], kv[0]))[:10])
    df = spark.createDataFrame(data, "g string, i int, s double").repartition(7).withColumn("rank", F.lit("x")).withColumn("__g", F.lit(1)).withColumn("score", F.lit(None).cast("int"))
    got = topn.top_n(df, "g", "s", "i")
    assert sorted((r["g"], r["i"]) for r in got.collect()) == want
    assert topn.top_n(df.limit(0), "g", "s", "i").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_top_n_of_items_with_several_scores(spark):
    many = [("g", 1, 0.9 + k / 1000) for k in range(12)] + [("g", 100 + k, 0.5) for k in range(12)] + [("h", 5, 0.4)]
    for parts in (1, 3):
        df = spark.createDataFrame(many, "g string, i int, s double").repartition(parts)
        assert [(r["g"], r["i"]) for r in sorted(topn.top_n(df, "g", "s", "i").collect(), key=lambda r: (r["g"], r["rank"]))] == [("g", 1)] + [("g", 100 + k) for k in range(9)] + [("h", 5)]


# -- 2: belief propagation
def _exact(pairs, one_left, one_right):
    """Marginals by listing all worlds."""
    total, marginal = 0.0, Counter()
    for world in range(1 << len(pairs)):
        on = [p for k, p in enumerate(pairs) if world >> k & 1]
        if one_left and len({p[0] for p in on}) < len(on) or one_right and len({p[1] for p in on}) < len(on):
            continue
        w = math.exp(sum(p[2] for p in on))
        total += w
        for p in on:
            marginal[p[:2]] += w
    return {p[:2]: marginal[p[:2]] / total for p in pairs}


def test_propagation_is_exact_on_trees(spark):
    pairs = [("a", 1, 2.0), ("a", 2, 1.0), ("b", 2, 0.5), ("b", 3, -1.0), ("c", 4, 0.3)]
    df = spark.createDataFrame([*pairs, ("a", 1, 0.1), (None, 1, 1.0), ("z", None, 1.0), ("y", 9, None)], "l string, r int, u double")
    for sides in ((True, True), (True, False), (False, False)):
        got = {(r["l"], r["r"]): r["confidence"] for r in linkage.propagate(df, "l", "r", "u", *sides).collect()}
        want = _exact(pairs, *sides)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 5e-3 for k in want)
    assert linkage.propagate(df.limit(0), "l", "r", "u").count() == 0


def test_propagation_with_loops(spark):
    pairs = [(i, j, 4.0 if i == j else 1.0) for i in range(3) for j in range(3)]
    got = {(r["l"], r["r"]): r["confidence"] for r in linkage.propagate(spark.createDataFrame(pairs, "l int, r int, u double"), "l", "r", "u").collect()}
    want = _exact(pairs, True, True)
    assert all(abs(got[k] - want[k]) < 0.1 for k in want) and all(got[i, i] > 0.5 > got[i, (i + 1) % 3] for i in range(3))


def _exact_facets(pairs, contradicts):
    """Marginals by listing all worlds and hidden values: at most one pair a left record; pairs of another value than the hidden one cost."""
    total, marginal = 0.0, Counter()
    values = {r: sorted({v for _, q, _, v in pairs if q == r and v is not None}) or [None] for _, r, _, _ in pairs}
    for world in range(1 << len(pairs)):
        on = [p for k, p in enumerate(pairs) if world >> k & 1]
        if len({p[0] for p in on}) < len(on):
            continue
        w = math.exp(sum(p[2] for p in on))
        for r, vs in values.items():
            w *= sum(math.exp(contradicts * sum(p[1] == r and p[3] is not None and p[3] != v for p in on)) for v in vs)
        total += w
        for p in on:
            marginal[p[:2]] += w
    return {p[:2]: marginal[p[:2]] / total for p in pairs}


def test_propagation_with_facets(spark):
    schema = "l string, r int, u double, father string"
    tree = [("a", 1, 1.0, "C"), ("b", 1, 2.0, "M"), ("c", 1, 0.5, "M"), ("d", 1, -0.5, None), ("c", 2, 0.3, "M"), ("e", 3, 1.0, "Q"), ("f", 3, 1.0, "Q")]
    got = {(r["l"], r["r"]): (r["confidence"], r["converged"]) for r in linkage.propagate(spark.createDataFrame(tree, schema), "l", "r", "u", True, False, ["father"], -2.0).collect()}
    want = _exact_facets(tree, -2.0)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) < 5e-3 and got[k][1] for k in want)
    loops = tree + [("a", 2, 0.9, "C"), ("b", 2, 0.2, "M")]
    got = {(r["l"], r["r"]): r["confidence"] for r in linkage.propagate(spark.createDataFrame(loops, schema), "l", "r", "u", True, False, ["father"], -2.0).collect()}
    want = _exact_facets(loops, -2.0)
    assert all(abs(got[k] - want[k]) < 0.1 for k in want)
    alone = {(r["l"], r["r"]): r["confidence"] for r in linkage.propagate(spark.createDataFrame(loops, schema), "l", "r", "u", True, False).collect()}
    assert abs(alone["a", 1] - got["a", 1]) > 0.05  # the loop changes what is reported


CONTEXT = "context_id long, name string, praenomen string, nomen string, cognomen string, filiation string, office string, date_start int, date_end int"
PERSON = "dprr_uri string, dprr_label string, praenomen string, nomen string, cognomen string, filiation string, sex string, highest_office string, era_from int, era_to int"
PEOPLE = [
    ("u1", "GAMO0001 L. Gamosevius M. f. Grevoplutus", "L.", "Gamosevius", "Grevoplutus", "M. f.", "male", None, -250, -190),
    ("u2", "GAMO0002 Q. Gamosevius P. f. Grevoplutus", "Q.", "Gamosevius", "Grevoplutus", None, None, "praetor", 10, 60),
    ("u3", "SETU0003 Setupacia M. f. Pebrugila", None, "Setupacia", "Pebrugila", None, "female", None, None, None),
    ("u1", "GAMO0001 L. Gamosevius M. f. Grevoplutus", "L.", "Gamosevius", "Grevoplutus", "M. f.", "male", None, -250, -190),
    (None, None, None, None, None, None, None, None, None, None),
]


@pytest.mark.parametrize(
    "context, uri",
    [
        (("Lucius Gamosevius Grevoplutus", "Lucius", None, None, None, None, None, None), "u1"),
        (("Gamosevius Grevoplutus", None, None, None, None, None, -220, -215), "u1"),
        (("Gamosevius Grevoplutus", None, None, None, None, None, 30, None), "u2"),
        (("Gamosevius Grevoplutus", None, None, None, None, None, None, None), None),
        (("Sex. Gamosevius Grevoplutus", "Sex.", None, None, None, None, None, None), None),
        (("L. Gamosevius Grevoplutus", "L.", None, None, None, None, 100, 110), None),
        (("Λούκιος Γαμοσεουιος Γρεουοπλουτος", None, None, None, None, None, None, None), "u1"),
        (("GREVOPLVTVS, Q. GAMOSEVIVS", None, None, None, None, None, None, None), "u2"),
        (("L. Gamos. Grevoplutus?", None, None, None, None, None, None, None), "u1"),
        (("L. Gamsevius Grevopultus", None, None, None, None, None, None, None), "u1"),
        (("Setupacia Pebrug[ila]", None, None, None, None, None, None, None), "u3"),
        (("Setupacius Pebrugilus", None, None, None, None, None, None, None), None),
        (("Somebody Else", None, None, None, None, None, None, None), None),
        (("", None, None, None, None, None, None, None), None),
        ((None, None, "Setupacia", "Pebrugila", None, None, None, None), "u3"),
    ],
)
def test_match_people_cases(spark, context, uri, _matched={}):
    if not _matched:  # all cases in one run
        marks = [m for m in test_match_people_cases.pytestmark if m.name == "parametrize"][0].args[1]
        cases = [(i, *c) for i, (c, _) in enumerate(marks)]
        df = spark.createDataFrame([*cases, cases[0], (None, *cases[0][1:])], CONTEXT).withColumn("nomen_key", F.lit(1)).withColumn("id", F.lit("x"))
        got = linkage.match_people(df, spark.createDataFrame(PEOPLE, PERSON)).where("confidence >= 0.5")
        _matched |= {marks[r["context_id"]][0]: r["dprr_uri"] for r in got.collect()} | {"ran": True}
    assert _matched.get(context) == uri


def test_match_people_evidence_and_empty(spark):
    c = spark.createDataFrame([(1, "Gamosevius Grevoplutus", None, None, None, None, None, None, None)], CONTEXT)
    p = spark.createDataFrame(PEOPLE, PERSON)
    scored = spark.createDataFrame([(1, "u2", 0.95), (1, "u2", math.nan), (1, "u1", 7.0), (1, None, 0.9)], "context_id long, dprr_uri string, score double")
    got = {r["dprr_uri"]: r["confidence"] for r in linkage.match_people(c, p, scored).collect()}
    assert got["u2"] > 0.5 > got["u1"]
    assert linkage.match_people(c.limit(0), p).count() == 0 and linkage.match_people(c, p.limit(0)).count() == 0


def test_match_people_without_surname(spark):
    blank = (None,) * 3
    c = [
        (1, "Lucius Gamosevius", "Lucius", *blank, None, -220, None), (2, "Gamosevius M. f.", None, *blank, None, -220, None), (3, "Gamosevius", None, *blank, None, None, None), (4, "L. Gamosevius", "L.", *blank, None, 30, None),
        (5, "C. Gamosevius", "C.", *blank, None, -220, None), (6, "T. Rosinagius Nemunurus", "T.", *blank, None, 10, None), (7, "Rosinagius Nemunurus", None, *blank, None, None, None), (8, "L. Gamsevius", None, *blank, None, -220, None),
        (9, "Q. Pleminosius", "Q.", *blank, None, None, None), (10, "Q. Pleminosius", "Q.", *blank, None, 50, None),
    ]
    p = [
        *PEOPLE, ("u4", "ROSI0004 T. Rosinagius", "T.", "Rosinagius", None, None, "male", None, -19, 27),
        ("u5", "PLEM0005 Q. Pleminosius Davasorus", "Q.", "Pleminosius", "Davasorus", None, "male", None, 30, 70), ("u6", "PLEM0006 Q. Pleminosius Toplasodio", "Q.", "Pleminosius", "Toplasodio", None, "male", None, -90, -50),
    ]
    got = linkage.match_people(spark.createDataFrame([*c, c[0]], CONTEXT), spark.createDataFrame(p, PERSON)).where("confidence >= 0.5")
    assert rows(got.select("context_id", "dprr_uri")) == sorted([(1, "u1"), (2, "u1"), (6, "u4"), (8, "u1"), (10, "u5")], key=repr)


# -- 3: neighbours
def _clusters(n=900, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, 128))
    return (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, 128))) * rng.uniform(0.1, 9, (n, 1))


def test_neighbours_recall_and_unusable(spark):
    x = _clusters().astype(np.float32)
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(9001, None), (9002, [1.0] * 64), (9003, [0.0] * 128), (9004, [math.nan] + [1.0] * 127), (9005, [math.inf] + [1.0] * 127), (None, data[0][1]), (9006, [None] + [1.0] * 127)]
    df = spark.createDataFrame([*data, *bad, *data[:9]], "doc_id long, vec array<float>").withColumn("id", F.lit("x")).withColumn("cell", F.lit(0))
    got = {(r["id"], r["neighbour"]) for r in neighbours.top_similar(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(got) == len(want) and len(got & want) / len(want) > 0.97
    pairs = rows(neighbours.similar_pairs(df))
    assert all(a < b for a, b in pairs) and len(pairs) == len(set(pairs))


def test_neighbours_copies_ties_and_empty(spark):
    x = _clusters(60).astype(float)
    data = [(i, [float(v) for v in x[0]]) for i in range(30)] + [(100 + i, [float(v) for v in r]) for i, r in enumerate(x[1:])]
    df = spark.createDataFrame(data, "doc_id long, vec array<float>")
    got = defaultdict(list)
    for r in neighbours.top_similar(df, probes=50).collect():
        got[r["id"]].append(r["neighbour"])
    assert sorted(got[0]) == [1, 2, 3, 4, 5] and sorted(got[3]) == [0, 1, 2, 4, 5] and sorted(got[29]) == [0, 1, 2, 3, 4] and all(len(v) == 5 for v in got.values())
    assert neighbours.top_similar(df.limit(0)).count() == 0 and neighbours.top_similar(df.where("doc_id = 0")).count() == 0
    two = neighbours.top_similar(df.where("doc_id in (0, 100)"))
    assert {(r["id"], r["neighbour"]) for r in two.collect()} == {(0, 100), (100, 0)}
    assert {(r["id"], r["neighbour"]) for r in neighbours.top_similar(df.where("doc_id < 2")).collect()} == {(0, 1), (1, 0)}


def test_blocks_give_the_same(spark, monkeypatch):
    x = _clusters(300, 5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, vec array<float>")
    whole = rows(neighbours.similar_pairs(df, probes=40))
    monkeypatch.setattr(neighbours, "ITEM_BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 11)
    assert len(set(whole) ^ set(rows(neighbours.similar_pairs(df, probes=40)))) <= 0.02 * len(whole)


def test_table_scan_approximates_products():
    x = neighbours._unit(_clusters(1500))
    book = neighbours.fit(x, 8)
    c = neighbours.assign(x, book.centres, 1)[:, 0]
    own = x[c == c[0]]
    codes = neighbours.encode(own, own - book.centres[c[0]], book)
    approx = neighbours.scan(x[:50], book.centres[c[0]], codes[:, 0::2] + (codes[:, 1::2] << 4), book)
    assert codes.max() < 16 and np.abs(approx - own @ x[:50].T).mean() < 0.05


# -- 4: components
def _union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cycle", "zigzag"])
def test_components(spark, kind):
    rng = random.Random(kind)
    n = 60
    order = rng.sample(range(n), n)
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)],
        "chain": [(i, i + 1) for i in range(n - 1)],
        "star": [(30, i) for i in range(n)],
        "cycle": [(i, (i + 1) % n) for i in range(n)],
        "zigzag": [(a, b) for a, b in zip(order, order[1:])],
    }[kind]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 1), (1, None)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)] + [(None,), (0,)], "id int")
    assert dict(rows(components.connected_components(df, "a", "b", nodes))) == _union_find(edges, range(n + 3))


def test_components_with_hubs(spark, monkeypatch):
    """Hubs are joined apart: the same result, and no more hubs than the bound."""
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 100) for i in range(1, 50)] + [(5, 105), (200, 201), (201, 202)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = rows(components.connected_components(df, "a", "b"))
    held = [(i, "k" if i < 40 else f"m{i // 2}") for i in range(80)]
    keys = spark.createDataFrame(held, "id int, key string")
    tied = rows(components.shared_key_edges(keys, "id", "key"))
    monkeypatch.setattr(components, "HOT", 5)
    monkeypatch.setattr(components, "HUBS", 8)
    found = components.hubs(durable(df), "a")
    assert found == [0] and rows(components.connected_components(df, "a", "b")) == want and len({c for _, c in want}) == 2
    assert rows(components.shared_key_edges(keys, "id", "key")) == tied and len(tied) == 39 + 20


def test_components_empty(spark):
    e = spark.createDataFrame([], "a string, b string")
    assert components.connected_components(e, "a", "b").count() == 0
    assert rows(components.connected_components(e, "a", "b", spark.createDataFrame([("x",)], "id string"))) == [("x", "x")]


ENTITY = "id string, canonical_name string, entity_type string, description string, date_range string, uris map<string, array<string>>, uris_json string, wikidata_qid string, origin string, updated_at timestamp"


def entity(i, name=None, desc=None, era=None, uris=None, js=None, qid=None, origin=None, at=None, kind="person"):
    return (i, name, kind, desc, era, uris, js, qid, origin, at)


def test_entity_groups(spark):
    data = [
        entity("a", uris={"x": ["http://www.X.org/1#this"]}), entity("b", js='{"x": "https://x.org/1/"}'), entity("c", js='{"y": ["http:\\/\\/x.org\\/1", "http://y.org/2"]}', qid="wd:Q5"), entity("d", qid="http://wd.org/entity/Q5"),
        entity("e", qid="Q?"), entity("f", qid="unknown"), entity("g", js='{"x": ["http://y.org/2"'), entity("h", uris={"x": None, "z": [None]}), entity("a", uris={"x": ["http://www.X.org/1#this"]}), entity(None, qid="Q5"), entity("i", qid="", js=""),
    ]
    df = spark.createDataFrame(data, ENTITY).withColumn("key", F.lit(1)).withColumn("group_id", F.lit("x"))
    assert rows(components.entity_groups(df)) == sorted([("a", x) for x in "abcd"] + [(x, x) for x in "efghi"])
    assert components.entity_groups(df.limit(0)).count() == 0
    hot = spark.createDataFrame([entity(f"h{i}", qid="Q1") for i in range(400)], ENTITY)
    assert {r["group_id"] for r in components.entity_groups(hot).collect()} == {"h0"}


# -- 5: variants
def test_spelling_and_parsing():
    same = ["Trigrusurius", "TRIGRVSVRIVS", "Τριγρουσουριος", "trigruſurius".replace("ſ", "s"), "Trigrusurjus", "Triggrusurius"]
    assert len({names.nomen_key(names.spelling(w)) for w in same}) == 1
    p = names.parse("GRUC0015 Q. Grucivitius M. f. Tabreremus")
    assert (p.praenomen, p.nomen, p.cognomen, p.filiation, p.cut) == ("Q", "grucitius".replace("ci", "ciui"), "tabreremus", "M", False)
    assert names.parse("Tabreremus, Q. Grucivitius")[:4] == names.parse("Grucivitius Tabreremus, Quintus")[:4] == p[:4]
    assert names.parse("Ser. Rosen. Nebramudex?").cut and names.parse("[---]").nomen is None and names.parse(None).nomen is None and names.parse("  ").nomen is None
    assert names.cognomen_key(names.spelling("Mucogritillus")) == names.cognomen_key(names.spelling("Mucogritor"))
    assert names.praenomen("Τίτος") == "T" and names.praenomen("SP") == "Sp" and names.praenomen("Gamosevius") is None


def test_distances_are_a_metric():
    rng = random.Random(2)
    ws = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(14)]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [(a, b) for a in ws for b in ws]
    d = dict(zip(pairs, names.distances([a for a, _ in pairs], [b for _, b in pairs]).tolist()))
    assert all(d[p] == lev(*p) for p in pairs) and all(d[a, c] <= d[a, b] + d[b, c] for a in ws for b in ws for c in ws)


def test_radius_join_is_exact(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeiors") for _ in range(n))

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i:], w[:i] + rng.choice("abz") + w[i + 1 :]])

    firsts, seconds = [word(8) for _ in range(12)], [word(7) for _ in range(9)]
    points = [(a, b) for a in firsts for b in seconds if rng.random() < 0.4]
    side = lambda: list({(slip(a) if rng.random() < 0.6 else a, slip(slip(b)) if rng.random() < 0.3 else b) for a, b in points for _ in range(3)})
    long = [word(n) for n in (20, 21, 22, 23, 24, 25, 26, 27, 28, 37, 39, 40, 41, 42, 43, 60, 300)]
    left, right = [*side(), ("", "x"), (None, "x"), *[(slip(slip(w)), "x") for w in long for _ in range(6)]], [*side(), ("", "x"), ("ab", None), *[(w, "x") for w in long]]
    got = {(r["a1"], r["a2"], r["b1"], r["b2"]) for r in radius_join(spark.createDataFrame(left, "f string, s string"), spark.createDataFrame(right, "f string, s string"), "f", "s").collect()}
    ok = [(p, q) for p in left for q in right if None not in (*p, *q)]
    d1, d2 = (names.distances([p[k] for p, _ in ok], [q[k] for _, q in ok]) for k in (0, 1))
    want = {(*p, *q) for (p, q), x, y in zip(ok, d1, d2) if x <= 2 and y <= 2 and (p[0] == "") == (q[0] == "")}
    assert got == want and len(want) > 50


def test_points_of_dense_words_are_not_copied_to_products_of_cells(spark):
    rng = random.Random(11)
    words = ["".join(w) for w in itertools.product("abc", repeat=4)]
    left, right = ([(rng.choice(words), rng.choice(words)) for _ in range(300)] for _ in "lr")
    right += [(words[0], w) for w in words] + [(w, words[0]) for w in words]  # (0, 0) is frequent on both axes
    left.append((words[0], words[0]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written = lambda: sum(s.shuffleWriteRecords() for s in map(stages().apply, range(stages().size())))
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    store = spark.sparkContext._jsc.sc().statusStore()
    try:
        began = written()
        got = {tuple(r)[:4] for r in radius_join(spark.createDataFrame(left, "f string, s string"), spark.createDataFrame(right, "f string, s string"), "f", "s").collect()}
        copies = written() - began
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ok = [(p, q) for p in set(left) for q in set(right)]
    d1, d2 = (names.distances([p[k] for p, _ in ok], [q[k] for _, q in ok]) for k in (0, 1))
    assert got == {(*p, *q) for (p, q), x, y in zip(ok, d1, d2) if x <= 2 and y <= 2}
    assert copies < 100_000


def test_points_frequent_on_both_axes(spark):
    x, y, u, z = "xxxxxx", "yyyyyy", "uuuuuu", "zzzzzz"
    left = spark.createDataFrame([*[(f"l{k}", x, y) for k in range(3)], ("l3", x, z)], "name string, l1 string, l2 string")
    right = spark.createDataFrame([(f"r{k}", x if k % 2 else u, u if k % 2 else y) for k in range(40)] + [("both", x, y)], "other string, r1 string, r2 string")
    near = lambda *ws: spark.createDataFrame([(w, w, w, 0) for w in ws], "l string, r string, pivot string, d int")
    got = near_points(left, right, near(x), near(y, z)).collect()
    assert sorted((r["name"], r["other"], r["d1"], r["d2"]) for r in got) == [(f"l{k}", "both", 0, 0) for k in range(3)]


def test_durable_leaves_no_shuffle_files(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = held()
    made = durable(spark.range(5000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    assert held() <= before and made.count() == 7


def test_link_variants(spark):
    people = [entity("r1", "L. Gamosevius Grevoplutus", era="250 BC–190 BC"), entity("r2", "Lucius GAMOSEVIVS M. f. Grevoplutus"), entity("r3", "Grevoplutus, Q. Gamosevius", era="10 AD to 60 AD"), entity("r4", "Gamos. Grevoplutus"), entity("r5", "[---]"), entity("r6", "L. Gamosevius Grevoplutus", kind="place"), entity("r7", None), entity("r8", "Gamosevius Grevoplutillus", era="00010/00060"), entity("r1", "L. Gamosevius Grevoplutus", era="250 BC–190 BC")]
    ctx = [(1, "L. Gamosevius Grevoplutus", "L.", None, None, None, None, -220, None), (2, "Gamosevius Grevoplutus", None, None, None, None, None, 30, 40), (3, None, None, None, None, None, None, None, None), (4, "Γαμοσεουιος Γρεουοπλουτος, Κόιντος", "Q.", None, None, None, None, None, None), (5, "x" * 5000, None, None, None, None, None, None, None)]
    c, e = spark.createDataFrame([*ctx, ctx[0]], CONTEXT).withColumn("id", F.lit("clash")), spark.createDataFrame(people, ENTITY).withColumn("context_id", F.lit(0))
    got = rows(variants.link_variants(c, e).select("context_id", "id"))
    assert got == [(1, "r1"), (1, "r2"), (1, "r4"), (2, "r3"), (2, "r4"), (2, "r8"), (4, "r3"), (4, "r4"), (4, "r8")]
    assert variants.link_variants(c.limit(0), e).count() == 0 and variants.link_variants(c, e.limit(0)).count() == 0
    y = lambda t: tuple(spark.createDataFrame([(t,)], "t string").select(variants.range_years(F.col("t")).alias("y")).first()["y"])
    assert [y(t) for t in ("10 BC–24 AD", "109 - 108 BC", "185 BC–?", "-00010/00024", "c. 10 AD - 20 AD", "s.d.", "?–?", "98 BC to 3 AD")] == [(-10, 24), (-109, -108), (-185, None), (-10, 24), (10, 20), (None, None), (None, None), (-98, 3)]


# -- 6: survivors
def test_nomen_cut_short(spark):
    ctx = ["Cor. Sullaticus", "Nisen. Nebramudex", "osen. Nebramudex", "Rrosen. Nebramudex", "Rsen. Nebramudex", "Kosan. Nebramudex", "Ro. Nebramudex", "R. Nebramudex", "Cur. Sullaticus"]
    c = [(i, n, *(None,) * 7) for i, n in enumerate(ctx)] + [(20, None, "Ser.", "Rsen.", None, None, None, 5, None), (21, None, None, "Rosen.", None, None, None, None, None)]
    people = [("u1", "Cornelius Sullaticus", None, "Cornelius", "Sullaticus", None, "male", None, None, None), ("u2", "Ser. Rosenagius Nebramudex", "Ser.", "Rosenagius", "Nebramudex", None, "male", None, -20, 30)]
    got = linkage.match_people(spark.createDataFrame(c, CONTEXT), spark.createDataFrame(people, PERSON)).where("confidence >= 0.5")
    assert rows(got.select("context_id", "dprr_uri")) == sorted([(0, "u1"), (2, "u2"), (3, "u2"), (4, "u2"), (6, "u2"), (20, "u2")], key=repr)


def test_link_variants_without_surname(spark):
    people = [
        entity("r1", "Titus Trabrebimius Fotrabatus", era="-0262/-0213"), entity("r2", "T. TRABREBIMIVS Fotrabatus"), entity("r3", "Spurius Rosinagius (2)", era="-0019/00027"), entity("r4", "L. Rumerocius Difotrolio", era="122-67 BC"),
        entity("r5", "L. Rumerocius Calidinus", era="130-70 BC"), entity("r6", "Gn. Pleminosius Davasorus"),
    ]
    blank = (None,) * 5
    ctx = [
        (1, "Titus Trabrebimius", *blank, -240, None), (2, "Sp. Rosinagius Nemunurus", *blank, 5, None), (3, "L. Rumerocius Ti. f.", *blank, -100, None), (4, "L. Rumerocius", *blank, -69, None), (5, "Trabrebimius", *blank, None, None),
        (6, "Titus Trabrebimius", *blank, 90, None), (7, "Q. Trabrebimius", *blank, -240, None), (8, "Gn. Pleminosius", *blank, None, None),
    ]
    got = rows(variants.link_variants(spark.createDataFrame([*ctx, ctx[0]], CONTEXT), spark.createDataFrame(people, ENTITY)).select("context_id", "id"))
    assert got == [(1, "r1"), (1, "r2"), (2, "r3"), (8, "r6")]


def test_survivors(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2026, 1, d)
    data = [
        entity("a", "unknown", "short", "uncertain", origin="curated", at=t(9)), entity("b", "B name", "much longer text", "10 BC–?", origin="derived", at=t(1)), entity("c", "C name", "much longer tex2", "s.d.", origin="concordance", at=None),
        entity("d", "D name", "stub", None, origin="concordance", at=t(2)), entity("e", "[---]", None, "20 AD", origin=None, at=t(5)), entity("b", "B name", "much longer text", "10 BC–?", origin="derived", at=t(1)), entity("z", "Alone", "x", "5 AD", origin="curated"),
        entity("q1", "", "-", "", origin="curated"), entity("q2", "?", "n/a", "?–?", origin="curated"), entity(None, "x"),
    ]
    df = spark.createDataFrame(data, ENTITY).withColumn("value", F.lit(1)).withColumn("source", F.lit(2)).withColumn("truth", F.lit(3))
    groups = spark.createDataFrame([("a", x) for x in "abcde"] + [("z", "z"), ("q1", "q1"), ("q1", "q2")], "group_id string, id string")
    got = survivors.survivors(df, groups)
    assert rows(got.select("group_id", "field_name", "id")) == [("a", "canonical_name", "d"), ("a", "date_range", "b"), ("a", "description", "c")]
    assert all(0 <= r["truth"] <= r["likeliest_truth"] <= 1 and r["retained"] <= 4 for r in got.collect())
    values = {(r["group_id"], r["field_name"], r["value_key"]) for r in survivors.retained_values(df, groups, 0.0).collect()}
    assert {v for g, f, v in values if (g, f) == ("a", "canonical_name")} == {"b name", "c name", "d name"}
    assert survivors.survivors(df.limit(0), groups.limit(0)).count() == 0 and survivors.source_quality(df.limit(0), groups).count() == 0


def test_quality_model_recovers_sources(spark):
    rng = random.Random(6)
    sens, spec = [0.95, 0.8, 0.6, 0.5], [0.99, 0.95, 0.8, 0.7]
    facts, truth = [], []
    for g in range(4000):
        value = rng.random() < 0.6
        said = sum(1 << s for s in range(4) if rng.random() < (sens[s] if value else 1 - spec[s]))
        if said:
            facts.append((str(g), "canonical_name", f"v{g}", said, 15))
            truth.append(value)
    q = survivors.infer_quality(spark.createDataFrame(facts, "group_id string, field_name string, value_key string, said int, covers int"))
    s = [q.sensitivity["canonical_name", i] for i in range(4)]
    assert s == sorted(s, reverse=True) and q.specificity["canonical_name", 0] > q.specificity["canonical_name", 3]
    judged = {(r["value_key"]): r["truth"] for r in survivors.judged(spark.createDataFrame(facts, "group_id string, field_name string, value_key string, said int, covers int"), q).collect()}
    right = sum((judged[f[2]] >= 0.5) == v for f, v in zip(facts, truth)) / len(facts)
    assert right > 0.85


# -- 7: leakage
ITEM = "Under a reused threshold the guild that Xanthius led lent against harvest the keys of one hundred storerooms when grain failed around Portum while the harbour at Nova silted up and nobody spoke of it again"
STOCK = "Read the following passage and answer the question below."


def test_leaks(spark):
    w = ITEM.split()
    swap = lambda ks: " ".join("CHANGED" if i in ks else x for i, x in enumerate(w))
    docs = {
        1: ITEM, 2: "Intro. " + " ".join(w[3:23]) + " outro", 3: " ".join(w[3:22]) + " other words", 4: ITEM.upper().replace(" ", ",\n  "), 5: swap({6, 12, 18, 24}), 6: swap({9, 10, 19, 20, 29, 30}),
        7: STOCK + " " + STOCK + " nothing", 8: None, 9: "", 10: ITEM.replace("guild", "gui­ld").replace("harvest", "har-\nvest").replace("e", "é"), 11: "filler " * 40_000 + ITEM, 12: " ".join(w[:10]) + " x " + " ".join(w[20:30]),
    }
    items = [(100, f"{STOCK} {ITEM}.", "t", "en"), (101, f"{STOCK} Another text that shares nothing with the first one at all but its instruction sentence and is long enough to count as a row.", "t", "en"), (102, f"{STOCK} Third of them.", "t", "en"), (103, "Which office did he hold?", "t", "en"), (104, None, "t", "en"), (None, ITEM, "t", "en")]
    d = spark.createDataFrame([*docs.items(), (1, ITEM), (None, ITEM)], "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(0))
    i = spark.createDataFrame([*items, items[0]], "item_id long, text string, task string, lang string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in leakage.leaks(d, i).collect()}
    assert set(got) == {(k, 100) for k in (1, 2, 4, 5, 10, 11)} and got[2, 100] == 20 and got[1, 100] == len(w)
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_leak_passes_and_block_guarantee(spark, monkeypatch):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(40))) for k in range(30)]
    docs = [(k, " ".join([*(rng.choice(vocab) for _ in range(15)), *items[k % 30][1].split()[5:30], "end"])) for k in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = rows(leakage.leaks(d, i))
    monkeypatch.setattr(leakage, "PASS", 800)
    assert rows(leakage.leaks(d, i)) == whole and {(a, b) for a, b, *_ in whole} == {(k, k % 30) for k in range(60)}
    index = leakage.Index.build([(k, t.split()) for k, t in items])
    prints = index.prints.copy()
    for n in range(len(prints)):
        for b in rng.sample(range(64), rng.randrange(0, 4)):
            prints[n] ^= np.uint64(1) << np.uint64(b)
    a, b = index.near(prints)
    assert {(int(x), int(x)) for x in range(len(prints))} <= set(zip(a.tolist(), b.tolist()))


def test_leaks_with_many_single_changes(spark):
    w = ITEM.split()[:21]
    change = lambda ks: "intro words " + " ".join(f"changed{i}" if i in ks else x for i, x in enumerate(w)) + " outro"
    docs = {1: change({4, 8, 12, 16}), 2: change(range(1, 20, 2)), 3: change(range(2, 20, 3)), 4: change({4, 8, 9, 13, 17})}
    d = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    i = spark.createDataFrame([(100, ITEM, "t", "en")], "item_id long, text string, task string, lang string")
    assert {(r["doc_id"], r["words"]) for r in leakage.leaks(d, i).collect()} == {(1, 21), (2, 21), (3, 21)}
    legal = [m for m in range(1 << 18) if not m & (m << 1)]
    assert min(sum(not (m << 1) >> j & 5 for j in range(18)) for m in legal) == leakage.least_pairs(20)


def test_majority_bits():
    h = np.array([leakage._hash(str(k)) for k in range(12)], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    want = [np.packbits((bits[k : k + 5].sum(0) >= 3).astype(np.uint8)).view(np.uint64)[0] for k in range(8)]
    assert leakage.fingerprints(h, 5).tolist() == [int(x) for x in want]


def test_fingerprints_of_item_sized_windows():
    h = np.array([leakage._hash(str(k)) for k in range(90)], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    want = [int(np.packbits((bits[k : k + 20].sum(0) > 10).astype(np.uint8)).view(np.uint64)[0]) for k in range(71)]
    for size in (1, 2, 3, 7, 16, 31):
        assert leakage.fingerprints(h, size).tolist() == [int(np.packbits((2 * bits[k : k + size].sum(0, dtype=int) > size).astype(np.uint8)).view(np.uint64)[0]) for k in range(91 - size)]
    assert leakage.fingerprints(h).tolist() == want and len(leakage.fingerprints(h[:19])) == 0


@pytest.mark.parametrize("every", [2, 3, 4, 5, 6, 100])
def test_leaks_of_changed_copies(spark, every):
    rng = random.Random(every)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    text = " ".join(w if k % every or not k or k == 39 else f"new{k}" for k, w in enumerate(words))
    d = spark.createDataFrame([(1, text), (2, " ".join(words)), (3, " ".join(words[:19]))], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: (r["words"], r["similarity"]) for r in leakage.leaks(d, i).collect()}
    assert set(got) == {1, 2} and got[2] == (40, 1.0) and got[1][0] == 40 and (got[1][1] < 1) == (every < 100)


# -- 8: mixture
def test_allocation():
    def leaf(path, w, tokens, repeats=1):
        return mixture.Node(path, Fraction(w), repeats, tokens)

    root = mixture.Node((), Fraction(1), children=[mixture.Node(("x",), Fraction(1, 2), children=[leaf(("x", "a"), 1, 10), leaf(("x", "b"), 1, 1000)]), leaf(("y",), Fraction(1, 2), 1000)])
    assert mixture.allocate(root, Fraction(200)) == 0
    x, y = root.children
    assert [c.budget for c in x.children] == [10, 90] and y.budget == 100  # the sibling takes the shortage, not the other domain
    root = mixture.Node((), Fraction(1), children=[mixture.Node(("x",), Fraction(1, 2), children=[leaf(("x", "a"), 1, 10), leaf(("x", "b"), 1, 20)]), leaf(("y",), Fraction(1, 2), 1000)])
    assert mixture.allocate(root, Fraction(200)) == 0 and root.children[1].budget == 170
    assert mixture.allocate(leaf((), 1, 10, 3), Fraction(50)) == 20


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(k, ["a", "b", "c", None, "d"][rng.randrange(5)], rng.choice(["en", "de", None]), rng.randrange(0, 50)) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, tokens long").withColumn("epoch", F.lit("clash"))
    targets = [(("a",), 0.6, 2), (("b",), 0.2, 1), (("c",), 0.1, 1), (("absent",), 0.1, 5)]
    m = mixture.mix(df, targets, ["source", "lang"], seed=3)
    report = {r["source"]: r for r in m.report.collect()}
    total = sum(t for *_, t in docs)
    have = Counter()
    for _, s, _, t in docs:
        have[s] += t
    assert {s: r["short"] for s, r in report.items()} == {s[0]: have[s[0]] * k < w * total for s, w, k in targets}
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    uses = Counter((r["doc_id"], r["epoch"]) for r in m.selected.collect())
    assert max(uses.values()) == 1
    per = Counter(i for i, _ in uses)
    size, source = {k: t for k, *_, t in docs}, {k: s for k, s, *_ in docs}
    assert all(per[i] <= {"a": 2, "b": 1, "c": 1}[source[i]] for i in per) and not any(size[i] == 0 for i in per)
    got = Counter()
    for i, n in per.items():
        got[source[i]] += n * size[i]
    assert all(got[s] == r["chosen_tokens"] for s, r in report.items())
    again = mixture.mix(df.repartition(5), targets, ["source", "lang"], seed=3)
    assert rows(again.selected) == rows(m.selected)
    part = [rows(mixture.mix(df, targets, ["source", "lang"], size=total // 4, seed=k).selected) for k in (3, 3, 4)]
    assert part[0] == part[1] != part[2] and sum(r[2] for r in part[0]) <= total // 4
    empty = mixture.mix(df.limit(0), targets, ["source", "lang"])
    assert empty.selected.count() == 0 and empty.report.count() == 4


def test_token_counts(spark):
    texts = ["Hello world, twice.", None, "", "word " * 30_000, "x" * 120_000, "日本語"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.coalesce(1).select(mixture.token_count()("text")).collect()]
    enc = mixture._encoding(f"{mixture.TOKENIZERS}/{mixture.VOCABULARY}")
    assert got[1] == got[2] == 0 and got[0] == len(enc.encode_ordinary(texts[0])) and got[3] == len(enc.encode_ordinary(texts[3])) and got[5] == len(enc.encode_ordinary(texts[5]))


@pytest.mark.parametrize("unit", ["漢字かなที่นี่", "word  \n\n and\t'll 12,", "a.b-c_", " \n"])
def test_pieces_have_the_tokens_of_the_whole(unit, monkeypatch):
    monkeypatch.setattr(mixture, "PIECE", 97)
    enc = mixture._encoding(f"{mixture.TOKENIZERS}/{mixture.VOCABULARY}")
    text = unit * 60
    pieces = list(mixture._pieces(text))
    assert "".join(pieces) == text and [t for p in pieces for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_languages_and_leaves(spark, monkeypatch):
    df = spark.createDataFrame([("EN",), ("en-GB",), ("eng",), ("Latin ",), (None,), ("xx",), ("",)], "lang string")
    assert [r[0] for r in df.coalesce(1).select(mixture.language(F.col("lang"))).collect()] == ["en", "en", "en", "la", None, "other", "other"]
    monkeypatch.setattr(mixture, "MOST_LEAVES", 2)
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "doc_id long, source string, tokens long")
    with pytest.raises(ValueError):
        mixture.mix(docs, [(("a",), 1.0, 1)], ["source"])


def test_three_levels(spark):
    docs = spark.createDataFrame([(k, ["a", "b"][k % 2], ["x", "y", None][k % 3], ["en", "de"][k % 5 % 2], k % 7) for k in range(200)], "doc_id long, source string, domain string, lang string, tokens long")
    m = mixture.mix(docs, [(("a",), 0.9, 1), (("b",), 0.1, 1)], ["source", "domain", "lang"])
    report = {r["source"]: r for r in m.report.collect()}
    assert report["a"]["short"] and report["a"]["chosen_tokens"] == report["a"]["tokens"] and not report["b"]["short"]


# -- 9: sentences
@pytest.mark.parametrize(
    "text, parts",
    [
        ("Dr. Smith saw it. Mr. Jones did not.", ["Dr. Smith saw it.", "Mr. Jones did not."]),
        ("It weighs 4.77 g and ca. 8.2 mm. See no. 5, e.g. there.", ["It weighs 4.77 g and ca. 8.2 mm.", "See no. 5, e.g. there."]),
        ('"Is it?" asked he. "No." Then silence!', ['"Is it?" asked he.', '"No."', "Then silence!"]),
        ('It reads "Salus X. Fides." in two lines. End', ['It reads "Salus X. Fides." in two lines.', "End"]),
        ("'Leave it!' he said. Why so small?! (Upside down.) So.", ["'Leave it!' he said.", "Why so small?!", "(Upside down.)", "So."]),
        ("Held in 124 B.C. The file lies at https://x.org/a.b.jpg and ends.", ["Held in 124 B.C.", "The file lies at https://x.org/a.b.jpg and ends."]),
        ("From 160 B.C. to A.D. 7, they say.", ["From 160 B.C. to A.D. 7, they say."]),
        ("A heading\n\nText one. Text\ntwo.\n\n• item a\n• item b\n1. first\n2. second", ["A heading", "Text one.", "Text\ntwo.", "• item a", "• item b", "1. first", "2. second"]),
        ("(a) one\n(b) two", ["(a) one", "(b) two"]),
        ("Am 21. Mai 2020 kam es. Die Grabung endete am 13. 8. 1898 dort. „Ist das so?“ fragte er.", ["Am 21. Mai 2020 kam es.", "Die Grabung endete am 13. 8. 1898 dort.", "„Ist das so?“ fragte er."]),
        ("Um 204 v. Chr. Der Rand sagt: „Nichts.“ Im 19. Jh. v. Chr. war es.", ["Um 204 v. Chr.", "Der Rand sagt: „Nichts.“", "Im 19. Jh. v. Chr. war es."]),
        ("« Est-ce lui ? » demanda-t-il. Rien ! L'atelier ferma en 91 av. J.-C. Fin.", ["« Est-ce lui ? » demanda-t-il.", "Rien !", "L'atelier ferma en 91 av. J.-C.", "Fin."]),
        ("Ποιος είναι; Ο Α ήταν άρχοντας· το όνομα είναι βέβαιο. Το 38 π.Χ. από εκεί.", ["Ποιος είναι;", "Ο Α ήταν άρχοντας· το όνομα είναι βέβαιο.", "Το 38 π.Χ. από εκεί."]),
        ("旁注写道：“此处无物。”（此图颠倒。）编者问：“是吗？”然后走了。重5.80克……其余不明。", ["旁注写道：“此处无物。”", "（此图颠倒。）", "编者问：“是吗？”然后走了。", "重5.80克……其余不明。"]),
        ("「これですか。」と尋ねた。「何もない。」年代は不明。", ["「これですか。」と尋ねた。", "「何もない。」", "年代は不明。"]),
        ("هل كان هنا يوما؟ الوزن 6.13 غ، انظر رقم 389. تاريخ النقش غير مؤكد.", ["هل كان هنا يوما؟", "الوزن 6.13 غ، انظر رقم 389.", "تاريخ النقش غير مؤكد."]),
        ("डॉ. X ने देखा। किसने काटा? भार 4.66 है।", ["डॉ. X ने देखा।", "किसने काटा?", "भार 4.66 है।"]),
        ("หนัก3.84กรัม ไม่มีใครรู้\nปี1869 จบ", ["หนัก3.84กรัม", "ไม่มีใครรู้", "ปี1869", "จบ"]),
        ("no mark at all", ["no mark at all"]),
        ("It was lost.The rest is gone.(So it seems.) M'. Aquillius M'. f. Florus held it.", ["It was lost.", "The rest is gone.", "(So it seems.)", "M'. Aquillius M'. f. Florus held it."]),
        ("", []),
        (None, []),
        (" \n\t ", []),
    ],
)
def test_sentences(text, parts):
    ends = sentences.sentence_ends(["Before. ", text, "After."])[1]
    cut, at = [], 0
    for e in ends:
        cut.append(text[at:e].strip())
        at = e
    assert cut == parts


def test_scan_equals_one_state_machine():
    rng = np.random.default_rng(9)
    step, cut = sentences.transducer()
    for n in (0, 1, 63, 64, 1000, 40_001):
        labels = rng.integers(0, sentences.CLASSES, n).astype(np.uint8)
        state, want = 0, []
        for c in labels:
            want.append(bool(cut[state * sentences.CLASSES + int(c)]))
            state = int(step[state * sentences.CLASSES + int(c)])
        assert sentences.scan(labels).tolist() == want


def test_sentences_table(spark):
    long = "One sentence here. " * 30_000
    df = spark.createDataFrame([(1, "Ab cd. Ef gh."), (2, None), (3, ""), (4, long), (None, "X.")], "doc_id long, text string").withColumn("end_pos", F.lit("clash"))
    got = Counter(r["doc_id"] for r in sentences.sentences(df).collect())
    assert got == {1: 2, 4: 30_000} and sentences.sentences(df.limit(0)).count() == 0
    assert sorted(map(tuple, sentences.sentences(df.where("doc_id = 1")).collect())) == [(1, 6), (1, 13)]


def test_sentences_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, "One.")], "doc_id long, text string")
    assert rows(sentences.sentences(df)) == [(1, 4), (1, 9), (2, 4)]


@pytest.mark.parametrize("unit", ["it's 'a b ", " 'x", "\n1. a", "\n- item"])
def test_long_texts_take_time_in_proportion(unit):
    began = time.perf_counter()
    sentences.sentence_ends([unit * (1_000_000 // len(unit))])
    assert time.perf_counter() - began < 5


def test_same_at_any_batch_size():
    texts = ["Dr. A. B. saw it. He left.", "x", "", "« Non ? » dit-il. Oui !"] * 7
    assert sentences.sentence_ends(texts) == [sentences.sentence_ends([t])[0] for t in texts]


def test_durable(spark):
    assert rows(durable(spark.range(3))) == [(0,), (1,), (2,)]
