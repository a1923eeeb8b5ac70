"""Retrieval: inverted index, BM25 with prefix terms, vector search, rank fusion, document building."""

from __future__ import annotations

import functools
import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.stem import plain_tokens, stemmed_tokens, tokens
from quern.operators.relational import top_k
from quern.runtime import checkpoint_dir, durable, path_exists, ship

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Vectors of a query set sent to the executors at once.
QUERY_BLOCK = 4096


class TextIndex:
    """Postings ``(term, id, tf)`` and document lengths, as tables; build once, ask often."""

    def __init__(self, docs: DataFrame, ident: str = "id", text: str = "text", stemmed: bool = True, keep: tuple[str, ...] = ()):
        self.stemmed, self.keep = stemmed, keep
        made, postings = self._tables(docs, ident, text, stemmed, keep)
        self._settle(durable(made), durable(postings))

    @staticmethod
    def _tables(docs: DataFrame, ident: str, text: str, stemmed: bool, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        words = stemmed_tokens(F.col(text)) if stemmed else plain_tokens(F.col(text))
        base = docs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), *keep, words.alias("words"))
        postings = base.select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")).repartitionByRange("term")
        return base.select("id", *keep, F.size("words").alias("len")), postings

    def _settle(self, docs: DataFrame, postings: DataFrame) -> None:
        self.docs, self.postings = docs, postings
        row = self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
        self.n, self.average = row["n"] or 0, row["avg"] or 0.0

    @classmethod
    def stored(cls, docs: DataFrame, ident: str = "id", text: str = "text", stemmed: bool = True, keep: tuple[str, ...] = ()) -> TextIndex:
        """The index of these documents, built only if none was stored under their fingerprint in the shared folder.

        The fingerprint covers every row that is indexed (ids, texts, kept columns) and the way it is; reading it is one pass without a shuffle.
        """
        cols = [ident, text, *keep]
        row = docs.select(F.xxhash64(*cols).alias("h"), F.hash(*cols).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum("k").alias("s")).first()
        key = hashlib.md5(f"{cols}|{stemmed}|{row['n']}|{row['x']}|{row['s']}".encode()).hexdigest()
        spark = docs.sparkSession
        root = f"{checkpoint_dir(spark)}/quern-index/{key}"
        if not path_exists(spark, f"{root}/done"):
            for name, rows in zip(("docs", "postings"), cls._tables(docs, ident, text, stemmed, keep)):
                rows.write.mode("overwrite").parquet(f"{root}/{name}")
            spark.range(1).write.mode("overwrite").parquet(f"{root}/done")  # written last: a half-written index is never read
        out = cls.__new__(cls)
        out.stemmed, out.keep = stemmed, keep
        out._settle(spark.read.parquet(f"{root}/docs"), spark.read.parquet(f"{root}/postings"))
        return out

    def without(self, where: Column) -> TextIndex:
        """The index without the documents that a condition on the kept columns picks (one dataset's, say); its statistics follow."""
        out = type(self).__new__(type(self))
        out.stemmed, out.keep = self.stemmed, self.keep
        gone = self.docs.where(where).select("id")
        docs = durable(self.docs.where(~F.coalesce(where, F.lit(False))))
        out._settle(docs, durable(self.postings.join(gone, "id", "left_anti").repartitionByRange("term")))
        return out

    def terms(self, query: str) -> list[str]:
        """The query's terms, each to be matched as a prefix; stemmed like the index."""
        out = [t for w in query.split() for t in (tokens(w) if self.stemmed else w.lower().split())]
        return list(dict.fromkeys(out))

    def search(self, query: str, k: int = 10, every: bool = False, where: Column | None = None) -> DataFrame:
        """``(id, score)``: the best ``k`` by BM25, equal scores by smaller id; ``every`` demands all terms."""
        return self.scores(query, every, where).select("id", "score").orderBy(F.col("score").desc(), "id").limit(k)

    def scores(self, query: str, every: bool = False, where: Column | None = None) -> DataFrame:
        """``(id, score)`` and the kept columns of every document that has a term of the query.

        ``where`` filters documents before the cut; the statistics are those of the whole corpus.  A query without terms finds nothing.
        The postings are stored by term range, so the prefix filters prune files.
        """
        terms = self.terms(query)
        if not terms or not self.n:
            return self.docs.select("id", F.lit(0.0).alias("score"), *self.keep).limit(0)
        hits = None
        for i, t in enumerate(terms):
            part = self.postings.where(F.col("term").startswith(t)).groupBy("id").agg(F.sum("tf").alias("tf")).withColumn("q", F.lit(i))
            hits = part if hits is None else hits.unionByName(part)
        df = hits.groupBy("q").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        idf = F.greatest(F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        found = hits.join(F.broadcast(df.select("q", idf.alias("idf"))), "q").join(self.docs, "id")
        if where is not None:
            found = found.where(where)
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / self.average))
        scored = found.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("terms"), *[F.first(c).alias(c) for c in self.keep])
        if every:
            scored = scored.where(F.col("terms") == len(terms))
        return scored.select("id", "score", *self.keep)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))


def knn(vectors: DataFrame, query: list[float], k: int, ident: str = "id", vec: str = "vec", where: Column | None = None) -> DataFrame:
    """``(id, distance)``: the ``k`` nearest by cosine distance, equal ones by smaller id; TakeOrderedAndProject, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.where(where)
    return rows.where(F.col(vec).isNotNull()).select(F.col(ident).alias("id"), (1 - cosine(F.col(vec), q)).alias("distance")).orderBy("distance", "id").limit(k)


def fuse(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists ``(id, rank0)``: sum of 1 / (60 + rank)."""
    out = None
    for part in lists:
        scored = part.select("id", (1 / (F.lit(float(constant)) + F.col("rank0"))).alias("s"))
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def hybrid(index: TextIndex, vectors: DataFrame | None, query: str, query_vector: list[float] | None, k: int = 10, where: Column | None = None, ident: str = "id", vec: str = "vec") -> DataFrame:
    """Text and vector search fused over the best 3k of each; the filter applies to the text list before, to the vector list after its cut.
    Without vectors: plain BM25."""
    text = index.search(query, 3 * k, where=where)
    if vectors is None or query_vector is None:
        return text.limit(k)
    from quern.operators.relational import with_rank0

    near = knn(vectors, query_vector, 3 * k, ident, vec)
    near = with_rank0(near, [F.col("distance").asc(), F.col("id").asc()])
    if where is not None:
        near = near.join(index.docs.where(where).select("id"), "id", "left_semi")
    ranked = with_rank0(text, [F.col("score").desc(), F.col("id").asc()])
    return fuse([ranked.select("id", "rank0"), near.select("id", "rank0")], k)


def similarity_join(left: DataFrame, right: DataFrame, k: int = 10, least: float = 0.85, ident: str = "id", vec: str = "vec") -> DataFrame:
    """``(left_id, right_id, similarity)``: for every left vector its ``k`` most similar right ones of at least ``least``; exact.

    The left side is the query set: it is sent to the executors in blocks of bounded size, each block is multiplied with every Arrow batch of the
    right side, and the partial lists are merged.  Zero vectors have similarity 0; nulls are dropped; equal similarities by smaller id.
    """
    import numpy as np
    import pyarrow as pa

    spark = left.sparkSession
    ship(spark)
    l = durable(left.where(F.col(ident).isNotNull() & F.col(vec).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec")))  # noqa: E741
    blocks = max(1, math.ceil(l.count() / QUERY_BLOCK))
    out = None
    for b in range(blocks):
        rows = l.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column("id").to_numpy()
        x = np.array(rows.column("vec").to_pylist(), np.float32)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sent = spark.sparkContext.broadcast((ids, x))

        def multiply(batches, sent=sent):
            ids, x = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                r = batch.column(0).to_numpy()
                y = np.array(batch.column(1).to_pylist(), np.float32)
                y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                s = x @ y.T
                keep = min(k, len(r))
                kth = np.partition(s, len(r) - keep, axis=1)[:, len(r) - keep]
                i, j = np.nonzero((s >= np.maximum(kth, least)[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(r[j]), pa.array(s[i, j].astype(np.float64))], names=["left_id", "right_id", "similarity"])

        cand = right.where(F.col(ident).isNotNull() & F.col(vec).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
        part = cand.mapInArrow(multiply, "left_id long, right_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "left_id long, right_id long, similarity double")
    return top_k(out, ["left_id"], [F.col("similarity").desc(), F.col("right_id").asc()], k)


# Kinds of documents that get a vector.
EMBEDDED_TYPES = ("dataset", "example", "tip", "schema_label", "schema_comment", "shex_shape")


def build_documents(dataset: str, title: str, examples: DataFrame, tips: DataFrame, schema: DataFrame, labelled: DataFrame, concepts: DataFrame, chunk: int = 50) -> DataFrame:
    """``(dataset, doc_type, text)``: everything that can be searched, one row a document; vocabularies in chunks of ``chunk`` labels."""
    from quern.operators.relational import chunks

    spark = examples.sparkSession
    doc = lambda df, kind, text: df.select(F.lit(dataset).alias("dataset"), F.lit(kind).alias("doc_type"), text.alias("text"))
    vocabulary = chunks(concepts, ["scheme"], [F.col("label").asc()], "label", chunk)
    parts = [
        doc(spark.range(1), "dataset", F.lit(title)),
        doc(examples, "example", F.col("question")),
        doc(tips, "tip", F.concat_ws(". ", "title", "body")),
        doc(schema, "schema_label", F.col("class")),
        doc(schema.where("comment is not null"), "schema_comment", F.concat_ws(": ", "class", "comment")),
        doc(labelled, "entity_label", F.col("label")),
        doc(vocabulary, "skos_vocab", F.concat_ws(": ", "scheme", "text")),
        doc(concepts, "skos_concept", F.col("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("text is not null and text <> ''")


def fingerprint(catalog: DataFrame) -> str:
    """A digest of (dataset, version, triple_count) rows: an index built under the same one can be reused."""
    rows = catalog.select(F.concat_ws("|", "dataset", "version", F.col("triple_count").cast("string")).alias("x"))
    return rows.agg(F.md5(F.array_join(F.sort_array(F.collect_list("x")), "\n").cast("binary")).alias("h")).first()["h"]  # a row a dataset


def related_by_class(items: DataFrame, classes: list[str], k: int, tie: str) -> DataFrame:
    """Examples or tips by how many of ``classes`` they share; those without classes concern all and come last."""
    shared = F.size(F.array_intersect("classes", F.array(*[F.lit(c) for c in classes]).cast("array<string>")))
    return items.withColumn("overlap", shared).where((F.col("overlap") > 0) | (F.size("classes") == 0)).orderBy(F.col("overlap").desc(), tie).limit(k)


def search_entities(index: TextIndex, entities: DataFrame, query: str, per_dataset: int = 10, share: float = 0.3) -> DataFrame:
    """``(dataset, id, score)``: text hits by dataset (all words of a query of several), each cut at a share of its dataset's best, then
    entities whose name holds the query that no hit named."""
    from quern.operators.relational import append_unseen, score_cutoff

    found = index.scores(query, every=len(query.split()) > 1)  # ranked within each dataset: none is hidden by another one's hits
    cut = score_cutoff(top_k(found, ["dataset"], [F.col("score").desc(), F.col("id").asc()], per_dataset), ["dataset"], "score", share)
    named = entities.where(F.contains(F.lower("name"), F.lit(query.lower()))).select("dataset", "id", F.lit(0.0).alias("score"))
    return append_unseen(cut.select("dataset", "id", "score"), named, ["id"])


def embed_text(text: Column, dims: int = 384, n: int = 3) -> Column:
    """A unit vector of a text without any model: its character n-grams hashed into ``dims`` signed counts.  Null and empty texts give zeros.

    It stands where a model's function would, in Arrow batches; any function from a text column to an ``array<float>`` column may be used instead.
    """
    import re
    import zlib

    import numpy as np

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims, np.float32)
            bare = f" {re.sub(r'\W+', ' ', (t or '').lower()).strip()} "
            if bare.strip():
                h = np.array([zlib.crc32(bare[i : i + n].encode()) for i in range(max(1, len(bare) - n + 1))], np.int64)
                np.add.at(v, h % dims, np.where(h >> 16 & 1, 1.0, -1.0).astype(np.float32))
                v /= max(float(np.linalg.norm(v)), 1e-12)
            out.append(v.tolist())
        return pd.Series(out)

    return vectors(text)


def discover(index: TextIndex, catalog: DataFrame, topic: str, k: int = 10, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """The rows of ``catalog(dataset, description, ...)`` that a topic concerns: the datasets of the ``k`` best hits; if there is no hit, those whose
    description holds any of its words.  The index keeps ``dataset``."""
    hits = hybrid(index, vectors, topic, query_vector, k)
    found = hits.join(index.docs.select("id", "dataset"), "id").select("dataset").distinct()
    if not found.isEmpty():
        return catalog.join(found, "dataset", "left_semi")
    words = topic.lower().split()
    return catalog.where(F.lit(False) if not words else functools.reduce(lambda a, b: a | b, [F.contains(F.lower("description"), F.lit(w)) for w in words]))
