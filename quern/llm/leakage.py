"""Evaluation texts leaking into training text: SimHash windows, a multi-index of Hamming blocks, exact verification."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sentences import sentence_ends
from quern.runtime import ship

#: Words in a row that make a leak, single changed words between them included.
ROW = 20
#: Windows have the size of the smallest passage that counts, ROW words, and their fingerprints find copies and near-copies.  A changed word
#: moves about a tenth of a fingerprint's bits, more than any block index can guarantee and still select; rows with changed words are
#: guaranteed by pairs of words with one between them (see ``least_pairs``), of which every legal row keeps a third on one alignment.
#: Fingerprints of 64 bits in four blocks: two that differ in at most three bits agree in a block, so none within the radius is missed.
BLOCKS, RADIUS = 4, 3
#: A sentence that stands in so many different items is a stock instruction.
STOCK = 3
#: Windows of items searched in one pass over the documents; more items take more passes, so what is sent to the executors is bounded (about 60 MB).
PASS = 2_000_000

_hyphen = re.compile(r"(?<=\w)[-‐­]\s*\n\s*(?=\w)")
_word = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_぀-ヿ㐀-鿿฀-๿]+")


def words(text: str | None) -> list[str]:
    """The words of a text, whatever their case, accents, punctuation, spacing and line breaks; scripts without spaces by character."""
    if not text:
        return []
    text = _hyphen.sub("", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf", "Me"))
    return _word.findall(text.casefold())


@functools.lru_cache(maxsize=1_000_000)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_hash, ws), np.uint64, len(ws))


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of two numbers for each of the 64 bits of each word; numbers are kept as words of their binary digits, lowest first."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        x = [v for v in (a[k] if k < len(a) else None, b[k] if k < len(b) else None, carry) if v is not None]
        if len(x) == 3:
            half = x[0] ^ x[1]
            out.append(half ^ x[2])
            carry = (x[0] & x[1]) | (x[2] & half)
        elif len(x) == 2:
            out.append(x[0] ^ x[1])
            carry = x[0] & x[1]
        else:
            out.append(x[0])
            carry = None
    return out if carry is None else [*out, carry]


def fingerprints(h: np.ndarray, size: int = ROW) -> np.ndarray:
    """SimHash of each window of ``size`` word hashes: every bit is the majority of the words' bits (a draw is 0).

    The counts of all 64 bits are added side by side: windows of 1, 2, 4, ... words are doubled, and those that make up ``size`` are added.
    """
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, width, total, at = [h], 1, None, 0
    while width <= size:
        if size & width:
            part = [d[at : at + n] for d in power]
            total, at = (part if total is None else _plus(total, part)), at + width
        if 2 * width <= size:
            power = _plus([d[:-width] for d in power], [d[width:] for d in power])
        width *= 2
    more, same = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
    for k in range(len(total) - 1, -1, -1):  # more than half of the words
        if size // 2 >> k & 1:
            same = same & total[k]
        else:
            more = more | (same & total[k])
            same = same & ~total[k]
    return more


def pair_keys(h: np.ndarray) -> np.ndarray:
    """A key for each word and the next but one."""
    return h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[2:] ^ (h[2:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def least_pairs(row: int) -> int:
    """How many pairs (a word and the next but one) any row of at least ``row`` words keeps, however many single words are changed.

    Each of c changes spoils at most two of the row - 2 pairs, and the pair around it is whole, as no two changed words are neighbours: at
    least max(c, row - 2 - 2c) are left.
    """
    return max(1, -(-(row - 2) // 3))


def shingle_weights(ws: list[str | None]) -> np.ndarray:
    """The weight of the shingle (a word and the next but one) that starts at each word: its letters, so that long words, which are rare, say
    more; 0 where none starts.  Weights don't depend on what else is searched."""
    n = np.array([len(w) if w is not None else 0 for w in ws], np.int64)
    out = np.zeros(len(n), np.int64)
    if len(n) > 2:
        out[:-2] = np.where((n[:-2] > 0) & (n[2:] > 0), n[:-2] + n[2:], 0)
    return out


@dataclass
class Index:
    """The items of one pass: their word hashes end to end, and their windows by the value of each block."""

    ids: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    order: list[np.ndarray]
    starts: list[np.ndarray]
    pairs: np.ndarray
    pair_item: np.ndarray
    pair_offset: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, items: list[tuple]) -> Index:
        """``items``: (id, words), where None marks words that don't count."""
        barrier = 0
        hashes, begins, prints, item, offset = [], [0], [], [], []
        pairs, pair_item, pair_offset = [], [], []
        for i, (_, ws) in enumerate(items):
            h = np.fromiter((_hash(w) if w is not None else (barrier := barrier + 1) for w in ws), np.uint64, len(ws))
            f = fingerprints(h)
            gaps = np.concatenate([[0], np.cumsum([w is None for w in ws])]).astype(np.int64)
            keep = gaps[ROW:] == gaps[:-ROW] if len(f) else np.zeros(0, bool)
            hashes.append(h)
            begins.append(begins[-1] + len(h))
            prints.append(f[keep])
            item.append(np.full(int(keep.sum()), i))
            offset.append(np.flatnonzero(keep))
            whole = np.array([ws[j] is not None and ws[j + 2] is not None for j in range(len(ws) - 2)], bool)
            pairs.append(pair_keys(h)[whole])
            pair_item.append(np.full(int(whole.sum()), i))
            pair_offset.append(np.flatnonzero(whole))
        join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        p = join(prints, np.uint64)
        order, starts = [], []
        for b in range(BLOCKS):
            v = (p >> np.uint64(16 * b)).astype(np.uint16)
            order.append(np.argsort(v, kind="stable"))
            starts.append(np.concatenate([[0], np.cumsum(np.bincount(v, minlength=65536))]))
        keys, holder = join(pairs, np.uint64), join(pair_item, np.int64)
        o = np.argsort(keys, kind="stable")
        weights = join([shingle_weights(ws) for _, ws in items], np.int64)
        return cls(np.array([i for i, _ in items], dtype=object), join(hashes, np.uint64), np.array(begins), p, join(item, np.int64), join(offset, np.int64), order, starts, keys[o], holder[o], join(pair_offset, np.int64)[o], weights)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) whose fingerprints differ in at most RADIUS bits, some more than once."""
        left, right = [], []
        for b in range(BLOCKS):
            v = (prints >> np.uint64(16 * b)).astype(np.uint16).astype(np.int64)
            first, count = self.starts[b][v], self.starts[b][v + 1] - self.starts[b][v]
            for lo in range(0, len(v), 100_000):
                c, f = count[lo : lo + 100_000], first[lo : lo + 100_000]
                w = np.repeat(np.arange(lo, lo + len(c)), c)
                at = np.repeat(f - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(len(w))
                x = self.order[b][at]
                ok = np.bitwise_count(prints[w] ^ self.prints[x]) <= RADIUS
                left.append(w[ok])
                right.append(x[ok])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


    def aligned(self, h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """``(item, shift)`` of the alignments of a document's words with an item along which at least ``least`` pairs agree."""
        keys = pair_keys(h)
        first = np.searchsorted(self.pairs, keys, "left")
        count = np.searchsorted(self.pairs, keys, "right") - first
        hit = np.flatnonzero(count)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        span, codes, times = len(h) + int(self.begins[-1]) + 1, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, len(hit), 20_000):
            at = hit[lo : lo + 20_000]
            c = count[at]
            x = np.repeat(first[at] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
            code, n = np.unique(self.pair_item[x] * span + np.repeat(at, c) - self.pair_offset[x] + int(self.begins[-1]), return_counts=True)
            codes, inverse = np.unique(np.concatenate([codes, code]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([times, n])).astype(np.int64)
        code = codes[times >= least]
        return code // span, code % span - int(self.begins[-1])


def find_rows(index: Index, docs: list[list[str]], row: int = ROW) -> list[tuple[int, int, int, float]]:
    """``(document, item, words, similarity)``: the longest row of the item's words that the document holds, if it has at least ``row`` words,
    and the weight of the item's shingles in it that agree, out of all of them."""
    if not len(index.pairs):
        return []
    h = [_hashes(ws) for ws in docs]
    sizes = np.array([len(x) for x in h], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
    prints = fingerprints(flat)
    owner = np.searchsorted(begins, np.arange(len(prints)), "right") - 1
    whole = np.flatnonzero(np.arange(len(prints)) + ROW <= begins[owner + 1])  # windows inside one document
    w, x = index.near(prints[whole])
    w = whole[w]
    more = [(np.full(len(i), d), i, s) for d, ws in enumerate(h) if len(ws) >= row for i, s in [index.aligned(ws, least_pairs(row))] if len(i)]
    seeds = np.concatenate([np.stack([owner[w], index.item[x], w - begins[owner[w]] - index.offset[x]]), *map(np.stack, more)], axis=1)
    if not seeds.shape[1]:
        return []
    seeds = np.unique(seeds, axis=1)
    found: dict[tuple[int, int], tuple[int, float]] = {}
    for lo in range(0, seeds.shape[1], 20_000):
        d, i, shift = seeds[:, lo : lo + 20_000]
        n_item = index.begins[i + 1] - index.begins[i]
        a = np.maximum(0, -shift)  # first word of the item that lies on the document
        n = np.minimum(n_item, sizes[d] - shift) - a
        keep = n >= row
        d, i, shift, a, n = d[keep], i[keep], shift[keep], a[keep], n[keep]
        if not len(n):
            continue
        seg = np.repeat(np.arange(len(n)), n + 2)  # a mismatch before and after each overlap
        pos = np.arange(len(seg)) - np.repeat(np.concatenate([[0], np.cumsum(n + 2)[:-1]]), n + 2) - 1
        inner = (pos >= 0) & (pos < n[seg])
        j = a[seg] + np.clip(pos, 0, n[seg] - 1)
        place = index.begins[i[seg]] + j
        same = inner & (flat[begins[d[seg]] + j + shift[seg]] == index.hashes[place])
        off = ~same
        stop = off & (np.concatenate([off[1:], [True]]) | np.concatenate([[True], off[:-1]]) | ~inner)
        weight = np.where(inner, index.weights[place], 0)
        agree = np.where(same & np.concatenate([same[2:], [False, False]]), weight, 0)
        total, held = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, agree))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], stop, [True]]).astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= row:
                key = (int(d[seg[s]]), int(i[seg[s]]))
                last = max(s, e - 2)  # shingles that start later leave the row
                found[key] = max(found.get(key, (0, 0.0)), (int(e - s), float((held[last] - held[s]) / max(total[last] - total[s], 1))))
    return [(a, b, *v) for (a, b), v in sorted(found.items())]


def _normal_sentences(text: str | None) -> list[list[str]]:
    out, at = [], 0
    for end in sentence_ends([text])[0]:
        out.append(words((text or "")[at:end]))
        at = end
    return out


def stock_sentences(items: DataFrame, text: str = "text", least: int = STOCK) -> set[str]:
    """The sentences that stand in at least ``least`` items of different text: instructions, not contents."""

    ship(items.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(" ".join(s), _hash(t or "") >> 1) for t in b.column(0).to_pylist() for s in _normal_sentences(t) if s]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["s", "t"])

    counted = items.select(text).mapInArrow(split, "s string, t long").groupBy("s").agg(F.count_distinct("t").alias("n"))
    return {r["s"] for r in counted.where(F.col("n") >= least).collect()}


def leaks(documents: DataFrame, items: DataFrame, ident: str = "doc_id", item: str = "item_id", text: str = "text", row: int = ROW) -> DataFrame:
    """``(ident, item, words, similarity)``: every document that holds a row of at least ``row`` words of an item, with the longest such row.

    Words are compared without case, accents, punctuation, spacing and line breaks (hyphenation included); a single changed word
    between words that agree belongs to the row, two changed words in a row end it, and it starts and ends with words that agree.
    Stock instructions (sentences that several items share) belong to no row.  Items of fewer than ``row`` words, null and empty texts never match; repeated
    rows count once; empty tables give an empty result; other columns are ignored.  ``similarity`` is that of the weighted shingles (a word and
    the next but one, by their letters) of the row: 1 for a copy, less for each changed word.

    Every window of ROW words of every whole document is fingerprinted (SimHash); the items' windows, the stated query set, are sent to
    the executors in passes of bounded size, as a multi-index whose four blocks guarantee every fingerprint within three bits: copies and
    near-copies.  Rows with changed words, which no such radius can guarantee, are found by shingles: every row keeps at least a third of
    its own on one alignment.  Each hit fixes an alignment, along which the row is then verified word by word and its similarity taken exactly.
    Documents are never shuffled; only leaks are.
    """
    spark = documents.sparkSession
    ship(spark)
    stock = stock_sentences(items, text)
    kind, item_kind = documents.schema[ident].dataType.simpleString(), items.schema[item].dataType.simpleString()
    held = items.where(f"`{item}` is not null and `{text}` is not null").select(item, text)
    size = held.agg(F.sum(F.char_length(text)).alias("n")).first()["n"] or 0
    passes = max(1, -(-int(size) // (2 * PASS)))  # a word has two characters at least, with its space
    out = None
    for k in range(passes):
        rows = held.where(F.pmod(F.xxhash64(item), F.lit(passes)) == k).collect()
        prepared = []
        for r in rows:
            ws: list[str | None] = []
            for s in _normal_sentences(r[text]):
                ws += [None] * 2 if " ".join(s) in stock else s
            prepared.append((r[item], ws))
        index = spark.sparkContext.broadcast(Index.build(prepared))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, at = b.column(1).to_pylist(), 0
                while at < len(texts):  # about two million characters at a time
                    to, chars = at, 0
                    while to < len(texts) and (to == at or chars < 2_000_000):
                        chars += len(texts[to] or "")
                        to += 1
                    hits = find_rows(index.value, [words(t) for t in texts[at:to]], row)
                    names = [index.value.ids[i] for _, i, *_ in hits]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([at + d for d, *_ in hits], pa.int64())), pa.array(names).cast(_arrow(item_kind)) if names else pa.array([], _arrow(item_kind)), pa.array([n for *_, n, _ in hits], pa.int32()), pa.array([x for *_, x in hits], pa.float64())], names=[ident, item, "words", "similarity"])
                    at = to

        part = documents.select(ident, text).where(f"`{ident}` is not null and `{text}` is not null").mapInArrow(search, f"`{ident}` {kind}, `{item}` {item_kind}, words int, similarity double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(ident, item).agg(F.max(F.struct("words", "similarity")).alias("__b"))
    return best.select(ident, item, "__b.words", "__b.similarity")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]
