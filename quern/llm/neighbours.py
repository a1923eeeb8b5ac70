"""Most similar vectors for every vector: partitions, score-aware four-bit codes, table scans, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import durable, settles, ship

#: Rows that the partition centres and the code books are fitted on; every row is indexed.
SAMPLE = 65_536
#: Most partitions, so that the centres sent to the executors stay below 16 MB (32,768 x 128 floats).
MOST_CELLS = 32_768
#: Least partitions searched for each vector, candidates reranked exactly in each, entries of a code book (four bits).
PROBES, RERANK, CODES = 6, 48, 16
#: Share of the true neighbours of HELD_OUT vectors, found among all rows by brute force, that the searched partitions must hold.
WANTED, HELD_OUT = 0.985, 256
#: Centres are fitted in one go up to so many; more are fitted in two levels, so that the driver's work grows with the root of their number.
FLAT = 1024
#: Parts over which the rows of a group of copies are spread before they are joined.
SPREAD = 8
#: Most items and queries of a task's block: larger partitions are searched in blocks, exactly as if whole.
ITEM_BLOCK, QUERY_BLOCK = 4096, 16_384
#: Inner products above this share of the norms matter: the anisotropic loss weighs the parallel residual by it.
THRESHOLD = 0.2


def usable(column: str, dims: int):
    """A vector of ``dims`` finite entries, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0)


@dataclass
class Codebook:
    """Partition centres (unit vectors), and by sub-space of two dimensions the 16 points that stand for residuals."""

    centres: np.ndarray
    books: np.ndarray
    weight: float

    @property
    def parts(self) -> int:
        return self.books.shape[0]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.float32(1e-38))  # so that squares neither overflow nor vanish
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))


def assign(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, best first."""
    out = np.empty((len(x), k), np.int32)
    for lo in range(0, len(x), 2048):
        s = x[lo : lo + 2048] @ centres.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), (len(s), s.shape[1])).copy()
        out[lo : lo + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)[:, :k]
    return out


def encode(x: np.ndarray, residual: np.ndarray, book: Codebook, rounds: int = 1) -> np.ndarray:
    """Codes that minimise the score-aware loss |r|^2 + (w - 1) <r, x>^2 of each residual: nearest first, then by coordinate descent."""
    n, parts = len(x), book.parts
    sub, direction = residual.reshape(n, parts, -1), x.reshape(n, parts, -1)
    codes = np.empty((n, parts), np.uint8)
    along = np.empty((n, parts), np.float32)
    for m in range(parts):
        gap = sub[:, m, None, :] - book.books[m][None]
        c = (gap * gap).sum(2).argmin(1)
        codes[:, m] = c
        along[:, m] = ((sub[:, m] - book.books[m][c]) * direction[:, m]).sum(1)
    total = along.sum(1)
    for _ in range(rounds):
        for m in range(parts):
            gap = sub[:, m, None, :] - book.books[m][None]
            par = (gap * direction[:, m, None, :]).sum(2)
            rest = total - along[:, m]
            c = ((gap * gap).sum(2) + (book.weight - 1) * (rest[:, None] + par) ** 2).argmin(1)
            codes[:, m] = c
            along[:, m] = np.take_along_axis(par, c[:, None], 1)[:, 0]
            total = rest + along[:, m]
    return codes


def _cluster(x: np.ndarray, cells: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    centres = x[np.sort(rng.choice(len(x), cells, replace=False))].copy()
    for _ in range(rounds):
        a = assign(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, a, x)
        filled = np.bincount(a, minlength=cells) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def _centres(x: np.ndarray, cells: int, rng: np.random.Generator) -> np.ndarray:
    """Up to FLAT centres at once; more by clustering the rows of each of about sqrt(cells) coarse clusters, in proportion to its rows."""
    if cells <= FLAT:
        return _cluster(x, cells, rng)
    coarse = assign(x, _cluster(x, round(math.sqrt(cells)), rng), 1)[:, 0]
    groups = [np.flatnonzero(coarse == c) for c in np.unique(coarse)]
    share = [max(1, round(cells * len(g) / len(x))) for g in groups]
    return np.concatenate([_cluster(x[g], min(n, len(g)), rng) for g, n in zip(groups, share)])[:MOST_CELLS]


def enough_probes(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The fewest partitions a query must visit so that WANTED of its true neighbours lie in them.

    The ``queries`` (a bounded sample) look for their ``k`` neighbours among all rows, exactly, in one pass; the ranks of these neighbours'
    partitions, in each query's own order, are what has to be covered.  So the share of partitions that is searched follows from the data, not
    from their number.
    """
    if len(centres) <= PROBES:
        return len(centres)
    q = _unit(queries)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q, centres))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, centres = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _unit(_matrix(b.column(1), q.shape[1])), b.column(0).to_numpy()
            s = q @ x.T
            s[ids[:, None] == own[None]] = -2
            take = min(k, len(own))
            top = np.argpartition(-s, take - 1, axis=1)[:, :take]
            far = -np.take_along_axis(s, top, 1).reshape(-1)
            cell = assign(x[top.reshape(-1)], centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), take)), pa.array(far.astype(np.float32)), pa.array(own[top.reshape(-1)]), pa.array(cell)], names=["q", "far", "n", "cell"])

    found = vectors.select("id", "vec").mapInArrow(nearest, "q int, far float, n long, cell int")
    best = Window.partitionBy("q").orderBy("far", "n")
    rows = found.withColumn("r", F.row_number().over(best)).where((F.col("r") <= k) & (F.col("far") < 2)).select("q", "cell").collect()  # k a query
    if not rows:
        return PROBES
    at, cell = np.array([r["q"] for r in rows]), np.array([r["cell"] for r in rows])
    score = q @ centres.T
    rank = (score[at] > score[at, cell][:, None]).sum(1) + 1
    return int(min(len(centres), max(PROBES, np.quantile(rank, WANTED, method="higher"))))


def fit(sample: np.ndarray, cells: int, seed: int = 11) -> Codebook:
    """Spherical k-means for the centres, then code books by alternating score-aware encoding and weighted least squares."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    n, dims = x.shape
    centres = _centres(x, max(1, min(cells, n)), rng)
    part = 2 if dims % 2 == 0 else 1
    parts = dims // part
    weight = max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    few = x[np.sort(rng.choice(n, min(n, 8192), replace=False))]
    residual = few - centres[assign(few, centres, 1)[:, 0]]
    sub, direction = residual.reshape(len(few), parts, part), few.reshape(len(few), parts, part)
    books = np.stack([sub[rng.choice(len(few), CODES, replace=len(few) < CODES), m] for m in range(parts)]).astype(np.float32)
    book = Codebook(centres, books, weight)
    eye = np.eye(part, dtype=np.float32)
    for _ in range(5):
        codes = encode(few, residual, book)
        gaps = sub - np.stack([book.books[m][codes[:, m]] for m in range(parts)], 1)
        along = (gaps * direction).sum(2)
        total = along.sum(1)
        for m in range(parts):
            d, s = direction[:, m], (total - along[:, m])[:, None]
            outer = eye + (weight - 1) * d[:, :, None] * d[:, None, :]
            rhs = sub[:, m] + (weight - 1) * d * (s + (sub[:, m] * d).sum(1, keepdims=True))
            left, right = np.zeros((CODES, part, part), np.float32), np.zeros((CODES, part), np.float32)
            np.add.at(left, codes[:, m], outer)
            np.add.at(right, codes[:, m], rhs)
            used = np.bincount(codes[:, m], minlength=CODES) > 0
            if used.any():
                book.books[m][used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
    return book


def scan(queries: np.ndarray, centre: np.ndarray, packed: np.ndarray, book: Codebook) -> np.ndarray:
    """Approximate scores ``(items, queries)`` by table look-ups: a byte holds two four-bit codes, so a look-up serves two sub-spaces."""
    part = book.books.shape[2]
    sub = queries.reshape(len(queries), book.parts, part)
    tables = np.einsum("qmd,mcd->mcq", sub, book.books, optimize=True)
    scores = np.repeat((queries @ centre)[None], len(packed), 0)
    for b in range(packed.shape[1]):
        low, high = tables[2 * b], tables[2 * b + 1]
        both = (high[:, None] + low[None]).reshape(CODES * CODES, -1)
        scores += both[packed[:, b]]
    return scores


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, centre: np.ndarray, book: Codebook, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query its ``k`` best items of the block and their cosines (missing: id -1, cosine -2); never itself."""
    codes = encode(x, x - centre, book)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
        book = Codebook(book.centres, np.concatenate([book.books, np.zeros((1, CODES, book.books.shape[2]), np.float32)]), book.weight)
        q_wide = np.pad(q, ((0, 0), (0, book.books.shape[2])))
        c_wide = np.pad(centre, (0, book.books.shape[2]))
    else:
        q_wide, c_wide = q, centre
    packed = codes[:, 0::2] + (codes[:, 1::2] << 4)
    take = min(RERANK, len(x))
    best_ids, best = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -2, np.float32)
    for lo in range(0, len(q), 512):
        rough = scan(q_wide[lo : lo + 512], c_wide, packed, book).T
        rough[query_ids[lo : lo + 512, None] == ids[None]] = -9
        top = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(len(x)), rough.shape)
        exact = np.einsum("qrd,qd->qr", x[top], q[lo : lo + 512], optimize=True)
        exact = np.where(ids[top] == query_ids[lo : lo + 512, None], -2, exact)
        order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
        best[lo : lo + 512, : order.shape[1]] = np.take_along_axis(exact, order, 1)
        best_ids[lo : lo + 512, : order.shape[1]] = np.take_along_axis(ids[top], order, 1)
    best_ids[best <= -2] = -1
    return best_ids, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


@settles
def top_similar(vectors: DataFrame, ident: str = "doc_id", vec: str = "vec", k: int = 5, dims: int = 128, probes: int | None = None) -> DataFrame:
    """``(id, neighbour, similarity)``: for each usable vector the ``k`` others with the largest cosine, equal ones by smaller id.

    A vector takes part if it has ``dims`` finite entries that are not all zero; null ids are dropped, repeated rows count once, and of
    an id with several vectors the smallest counts.  Fewer than ``k`` other vectors give fewer rows; an empty table gives none; other columns are
    ignored.  Exact copies of a vector (a third of all rows may be one) are searched once, as one representative, and get their
    neighbours from it; within a group of copies, the smallest ids are the neighbours.

    Steps: centres and code books are fitted on a bounded sample; a map assigns every vector, as an item, to its partition and, as a query, to its
    ``probes`` nearest ones (unless given, as many as :func:`enough_probes` finds necessary); one shuffle brings them together; each task encodes its items with the score-aware (anisotropic) four-bit
    code, scans the code tables for all its queries, and reranks the best RERANK by exact cosine; a query's partial lists are merged by an aggregation. Partitions
    too large for a task are searched block by block.  The search is approximate: tests measure its recall (at least 0.9 demanded).
    """
    spark = vectors.sparkSession
    ship(spark)
    one = vectors.where(F.col(ident).isNotNull() & usable(vec, dims)).groupBy(F.col(ident).cast("long").alias("id")).agg(F.min(F.col(vec).cast("array<float>")).alias("vec"))
    keyed = one.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    rows = durable(keyed)
    copies = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    counts = copies.agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).first()
    total, doubled = counts["n"] or 0, (counts["most"] or 0) > 1
    result = "id long, neighbour long, similarity float"
    if total < 2 and not doubled:
        return spark.createDataFrame([], result)
    part = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(SPREAD)).cast("int").alias("part")
    several = copies.where("copies > 1").select("h1", "h2", "rep", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    if doubled:  # rows of copies know their representative; a group of copies is joined in SPREAD parts
        rows = durable(rows.select("*", part).join(several.hint("merge"), ["h1", "h2", "part"], "left").select("id", "vec", F.coalesce("rep", "id").alias("rep"), F.col("rep").isNotNull().alias("copied")))
    reps = rows.where("rep = id").select("id", "vec") if doubled else rows
    cells = int(min(MOST_CELLS, max(1, round(0.8 * math.sqrt(total)))))
    rate = max(1, total // max(1, min(SAMPLE, max(4096, 48 * cells))))
    drawn = reps.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(rate)) == 0).select("id", "vec").orderBy(F.xxhash64(F.lit(4), "id"), "id").limit(SAMPLE).toArrow()
    if not drawn.num_rows:
        drawn = reps.select("id", "vec").orderBy("id").limit(SAMPLE).toArrow()
    drawn = drawn.sort_by("id")
    sample = _matrix(drawn.column("vec"), dims)
    fitted = fit(sample, cells)
    ids = drawn.column("id").to_numpy()
    held_out = np.sort(np.random.default_rng(12).choice(len(ids), min(HELD_OUT, len(ids)), replace=False))
    near = min(probes or enough_probes(reps, ids[held_out], sample[held_out], fitted.centres, k), fitted.centres.shape[0])
    book = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(1), dims))
                cell = assign(x, book.value.centres, near)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(np.ndarray.tobytes, x)), pa.binary()), pa.array(cell.tolist(), pa.list_(pa.int32()))], names=["id", "x", "cells"])

    placed = durable(reps.select("id", "vec").mapInArrow(place, "id long, x binary, cells array<int>"))
    here, own = F.col("cell"), F.col("cells")[0]
    blocks = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    counted = placed.select(F.explode("cells").alias("cell"), own.alias("own")).groupBy("cell").agg(F.count(F.lit(1)).alias("q"), F.sum(F.when(here == F.col("own"), 1).otherwise(0)).alias("i"))
    sizes = F.broadcast(counted.select("cell", blocks(F.col("i"), ITEM_BLOCK).alias("ni"), blocks(F.col("q"), QUERY_BLOCK).alias("nq")))  # at most MOST_CELLS rows
    salt = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)).cast("int")
    items = placed.select("id", "x", F.lit(True).alias("item"), own.alias("cell")).join(sizes, "cell")
    items = items.select("id", "x", "item", "cell", (salt % F.col("ni")).alias("ib"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"))
    asked = placed.select("id", "x", F.lit(False).alias("item"), F.explode("cells").alias("cell")).join(sizes, "cell")
    asked = asked.select("id", "x", "item", "cell", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("ib"), (salt % F.col("nq")).alias("qb"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        is_item = group.column("item").to_numpy()
        ids = group.column("id").to_numpy()
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), np.float32).reshape(-1, dims)
        at = np.flatnonzero(is_item)
        at = at[np.argsort(ids[at])]
        to = np.flatnonzero(~is_item)
        if not len(at) or not len(to):
            return pa.table({"id": pa.array([], pa.int64()), "found": pa.array([], found_type)})
        n, s = search_block(ids[at], x[at], ids[to], x[to], book.value.centres[key[0].as_py()], book.value, k)
        ok = n >= 0
        flat = pa.StructArray.from_arrays([pa.array(-s[ok], pa.float32()), pa.array(n[ok], pa.int64())], names=["far", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)), flat)
        return pa.table({"id": pa.array(ids[to], pa.int64()), "found": lists})

    found_type = pa.list_(pa.struct([("far", pa.float32()), ("n", pa.int64())]))
    parts = items.unionByName(asked).groupBy("cell", "ib", "qb").applyInArrow(search, "id long, found array<struct<far: float, n: bigint>>")
    # a query has at most probes x blocks lists of k entries
    merged = parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    if not doubled:
        return merged.select("id", F.explode("found").alias("f")).select("id", F.col("f.n").alias("neighbour"), (-F.col("f.far")).cast("float").alias("similarity"))

    # within a group of copies the nearest are its smallest ids: at most k + 1 of them matter to anyone
    spread = Window.partitionBy("rep", "part").orderBy("id")
    copied = rows.where("copied").select("id", "rep", part)
    first = copied.withColumn("r", F.row_number().over(spread)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("few"))  # of at most SPREAD x (k + 1) ids
    few = rows.where("not copied").select("rep", F.array("id").alias("few"), F.lit(False).alias("copied")).unionByName(first.withColumn("copied", F.lit(True)))
    others = merged.select(F.col("id").alias("rep"), F.explode("found").alias("f")).select("rep", F.col("f.far").alias("far"), F.col("f.n").alias("n"))
    spread_out = others.join(few.withColumnRenamed("rep", "n"), "n").select("rep", "far", F.explode("few").alias("n"), F.lit(False).alias("copied"))
    own = few.select("rep", F.lit(-1.0).cast("float").alias("far"), F.explode("few").alias("n"), "copied")
    pool = own.unionByName(spread_out).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "n"))), 1, (k + 1) * (k + 1)).alias("pool"), F.max("copied").alias("copied"))
    pool = pool.select("rep", "pool", F.explode(F.sequence(F.lit(0), F.when(F.col("copied"), SPREAD - 1).otherwise(0))).alias("part"))
    mine = rows.select("id", "rep", F.when(F.col("copied"), part).otherwise(F.lit(0)).alias("part")).join(pool.hint("merge"), ["rep", "part"]).select("id", F.slice(F.filter("pool", lambda f: f["n"] != F.col("id")), 1, k).alias("found"))
    return mine.select("id", F.explode("found").alias("f")).select("id", F.col("f.n").alias("neighbour"), (-F.col("f.far")).cast("float").alias("similarity"))


def similar_pairs(vectors: DataFrame, ident: str = "doc_id", vec: str = "vec", k: int = 5, dims: int = 128, probes: int | None = None) -> DataFrame:
    """``(a, b)``, a < b, once: at least one of the two is among the ``k`` most similar of the other."""
    n = top_similar(vectors, ident, vec, k, dims, probes)
    return n.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
