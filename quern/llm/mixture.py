"""Mixing sources to target weights: hierarchical token budgets, filled from seeded epochs."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import discard, durable, ship

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longer texts are tokenised in pieces of about so many characters that end where the tokenizer's own pattern ends a match.
PIECE = 50_000
#: Most leaves of a target tree; its levels are categories, and more values than this are an error, never a cut.
MOST_LEAVES = 200_000
#: Languages that are told apart, by ISO 639 code; everything else is one class, so that free text in that column cannot grow the tree.
LANGUAGES = ("en", "la", "de", "it", "fr", "el", "zh", "ja", "ar", "hi", "th", "es", "pt", "ru", "tr", "he")
# Longer codes and names of these languages.
LANGUAGE_NAMES = {
    "eng": "en", "english": "en", "lat": "la", "latin": "la", "latina": "la", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "ita": "it", "italian": "it", "italiano": "it",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "ell": "el", "gre": "el", "grc": "el", "greek": "el", "zho": "zh", "chi": "zh", "chinese": "zh", "jpn": "ja", "japanese": "ja",
    "ara": "ar", "arabic": "ar", "hin": "hi", "hindi": "hi", "tha": "th", "thai": "th", "spa": "es", "spanish": "es", "por": "pt", "rus": "ru", "russian": "ru", "tur": "tr", "heb": "he",
}
#: Slices of the hash range in which a leaf's prefix is searched; one slice of a leaf of 10**12 documents has 15 million.
SLICES = 65_536

# Fixed value: the pre-tokenisation pattern that the public vocabularies were made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces whose tokens, taken together, are those of the whole: a cut is made only between two matches of the pattern, which
    looks ahead no further than one character of white space."""
    if len(text) <= PIECE:
        yield text
        return
    at = 0
    for m in _pattern().finditer(text):
        if m.end() - at >= PIECE:
            yield text[at : m.end()]
            at = m.end()
    if at < len(text):
        yield text[at:]


def language(column: Column) -> Column:
    """The code of a language however it is written (``EN``, ``en-GB``, ``eng``, ``English``); ``other`` for the rest, null for null."""
    first = F.regexp_extract(F.lower(F.trim(column)), r"^(\p{L}+)", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv]), first)
    return F.when(column.isNotNull(), F.coalesce(F.when(first.isin(*LANGUAGES), first), named, F.lit("other")))


def token_count(tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A vectorised function of a text column: its number of tokens; 0 for null and empty texts."""
    ship()
    path = os.path.join(tokenizers, vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for texts in batches:
            yield pd.Series([sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in texts], dtype="int64")

    return count


@dataclass
class Node:
    """A node of the target tree.  ``weight`` is its share of its parent; ``supply`` all tokens below it, ``limit`` those with repeats."""

    path: tuple
    weight: Fraction
    repeats: int = 1
    tokens: int = 0
    children: list["Node"] = field(default_factory=list)
    budget: Fraction = Fraction(0)
    wanted: Fraction = Fraction(0)

    @property
    def limit(self) -> int:
        return sum(c.limit for c in self.children) if self.children else self.tokens * self.repeats


def allocate(node: Node, budget: Fraction) -> Fraction:
    """Spread ``budget`` over the tree below ``node``; what cannot be placed anywhere below comes back.

    Every child first gets its share.  A child whose whole subtree has less keeps what it has, and its shortage goes to its
    siblings that still have room, by their weights, until nothing is left or all are full; only then does the rest go up, where the same
    happens among the parent's siblings.  Fractions are exact, so no token is lost to rounding here.
    """
    node.wanted = max(node.wanted, budget)
    placed = min(budget, Fraction(node.limit))
    node.budget = placed
    if node.children:
        total = sum(c.weight for c in node.children)
        for c in node.children:
            c.wanted = placed * c.weight / total if total else Fraction(0)
        given = dict.fromkeys(range(len(node.children)), Fraction(0))
        rest, open_ = placed, {i for i, c in enumerate(node.children) if c.limit and (c.weight or not total)}
        while rest > 0 and open_:
            weight = sum(node.children[i].weight for i in open_)
            full = set()
            spread = Fraction(0)
            for i in open_:
                c = node.children[i]
                share = rest * (c.weight / weight if weight else Fraction(1, len(open_)))
                got = min(share, c.limit - given[i])
                given[i] += got
                spread += got
                if given[i] == c.limit:
                    full.add(i)
            rest -= spread
            open_ -= full
            if not full:
                break
        if rest > 0:  # only children without weight have room
            for i, c in enumerate(node.children):
                got = min(rest, c.limit - given[i])
                given[i] += got
                rest -= got
        for i, c in enumerate(node.children):
            wanted = c.wanted
            allocate(c, given[i])
            c.wanted = wanted
    return budget - placed


def _leaves(node: Node) -> Iterator[Node]:
    if node.children:
        for c in node.children:
            yield from _leaves(c)
    else:
        yield node


def build_tree(targets: list[tuple[tuple, float, int]], supply: dict[tuple, int]) -> Node:
    """The tree of ``targets``: (path, share, repeats), where a path is a tuple such as (domain, language, source).

    Targets weigh their own level.  Below the deepest target of a path the leaves of ``supply`` weigh by their tokens; an inner
    node without a target of its own weighs as its children together.
    """
    exact = lambda x: Fraction(str(x))
    root = Node((), Fraction(1))
    nodes: dict[tuple, Node] = {(): root}
    given = {tuple(p): (exact(s), r) for p, s, r in targets if s is not None}

    def at(path: tuple) -> Node:
        if path not in nodes:
            share, repeats = given.get(path, (None, nodes_repeats(path)))
            nodes[path] = Node(path, share if share is not None else Fraction(-1), repeats)
            at(path[:-1]).children.append(nodes[path])
        return nodes[path]

    def nodes_repeats(path: tuple) -> int:
        return next((given[path[:k]][1] for k in range(len(path), 0, -1) if path[:k] in given), 1)

    for path in sorted(given, key=repr):
        at(path)
    for path, tokens in sorted(supply.items(), key=repr):
        if any(path[:k] in given for k in range(1, len(path) + 1)):
            at(path).tokens += tokens

    def weigh(node: Node) -> Fraction:
        below = sum((weigh(c) for c in node.children), Fraction(0))
        if node.weight < 0:
            node.weight = below if any(c.path in given for c in node.children) else Fraction(sum(x.tokens for x in _leaves(node)))
        return node.weight

    weigh(root)
    return root


@dataclass
class Mixture:
    report: DataFrame
    selected: DataFrame
    total: int


def _tally(docs: DataFrame, levels: list[str]) -> dict[tuple, int]:
    """Tokens by leaf: one row for each combination of the levels' values, which are categories; more than MOST_LEAVES raise."""
    rows = docs.groupBy(*levels).agg(F.sum("tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"the levels have more than {MOST_LEAVES} combinations of values")
    return {tuple(r[k] for k in levels): r["n"] for r in rows}


def mix(docs: DataFrame, targets: list[tuple[tuple, float, int]], levels: list[str], ident: str = "doc_id", size: int | None = None, seed: int = 7) -> Mixture:
    """Combine ``docs`` (``ident``, ``tokens`` and the level columns) so that every node of the target tree gets its share.

    The mixture holds ``size`` tokens (default: as many as all documents together), or fewer if all sources together cannot fill it.
    ``report`` has one row for each first-level node: its target share, available tokens, cap on repeats, whether it stays below its
    share even when repeated that often (``short``: what the allocation could give it is less), the tokens chosen and the share reached.  ``selected`` has (ident, epoch) for each use
    of a document: full epochs use every document of a leaf once; the last, partial epoch the documents that come first in the order of
    a hash of (seed, epoch, id), as many as fit into the remaining tokens.  The same seed gives the same choice at any parallelism.

    Documents without tokens (null or empty texts) are never chosen; documents without a target count for the size only; a target without
    documents is short.  No leaf is sorted as a whole: its hash range is cut into SLICES, their tokens are summed, and only the slice
    in which the budget ends is ordered.
    """
    levels_ = [f"__l{i}" for i in range(len(levels))]
    rows = durable(docs.select(F.col(ident).alias("__id"), *[F.col(c).alias(a) for c, a in zip(levels, levels_)], F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens")))
    spark = docs.sparkSession
    supply = _tally(rows, levels_)
    total = sum(supply.values()) if size is None else size
    root = build_tree(targets, supply)
    allocate(root, Fraction(total))
    first = sorted(root.children, key=lambda n: repr(n.path))
    whole = sum((n.weight for n in first), Fraction(0)) or Fraction(1)

    plan = []
    for leaf in _leaves(root):
        if leaf.tokens and leaf.path:
            budget = int(leaf.budget)
            epochs, rest = divmod(budget, leaf.tokens)
            plan.append((*leaf.path, *[None] * (len(levels) - len(leaf.path)), min(epochs, leaf.repeats), rest if epochs < leaf.repeats else 0))
    schema = ", ".join(f"{a} string" for a in levels_) + ", __full int, __rest long"
    quota = spark.createDataFrame(plan, schema)
    keys = [rows[a].eqNullSafe(quota[a]) for a in levels_]
    used = rows.where("tokens > 0").join(F.broadcast(quota), functools.reduce(lambda a, b: a & b, keys)).select("__id", rows["tokens"], *[rows[a] for a in levels_], "__full", "__rest")
    full = used.where("__full > 0").select("__id", "tokens", F.explode(F.sequence(F.lit(0), F.col("__full") - 1)).alias("epoch"), "__l0")

    order = F.xxhash64(F.lit(seed), F.col("__full"), F.col("__id"))
    part = durable(used.where("__rest > 0").withColumn("__h", order).withColumn("__slice", F.pmod(F.shiftrightunsigned("__h", 40), F.lit(SLICES))))
    slices = part.groupBy(*levels_, "__slice").agg(F.sum("tokens").alias("__t"))
    before = Window.partitionBy(*levels_).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(*[F.col(a).alias(f"{a}s") for a in [*levels_, "__slice"]], "__t", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    same = [F.col(a).eqNullSafe(F.col(f"{a}s")) for a in [*levels_, "__slice"]]
    placed = part.join(starts, functools.reduce(lambda a, b: a & b, same))
    inside = placed.where("__before + __t <= __rest")
    edge = placed.where("__before < __rest and __before + __t > __rest")
    running = Window.partitionBy(*levels_, "__slice").orderBy("__h", "__id").rowsBetween(Window.unboundedPreceding, 0)
    ends = edge.withColumn("__run", F.col("__before") + F.sum("tokens").over(running)).where("__run <= __rest")
    columns = ["__id", "tokens", F.col("__full").alias("epoch"), "__l0"]
    chosen = durable(full.unionByName(inside.select(*columns)).unionByName(ends.select(*columns)))

    reached = {r["__l0"]: r["n"] for r in chosen.groupBy("__l0").agg(F.sum("tokens").alias("n")).collect()}
    mixed = sum(reached.values()) or 1
    discard(rows)
    discard(part)
    lines = []
    for n in first:
        share = n.weight / whole
        tokens = sum(x.tokens for x in _leaves(n))
        got = reached.get(n.path[0], 0)
        short = n.budget < share * total  # redistribution fills every source with room to its share at least
        if short and got != n.budget:
            raise RuntimeError(f"{n.path[0]}: {got} tokens chosen of {n.budget}, though all of it must be used")
        lines.append((n.path[0], float(share), tokens, n.repeats, short, got, got / mixed))
    report = spark.createDataFrame(lines, "source string, target_share double, tokens long, max_repeats int, short boolean, chosen_tokens long, actual_share double")
    return Mixture(report, chosen.select(F.col("__id").alias(ident), "epoch", "tokens", F.col("__l0").alias("source")), total)


def document_mixture(documents: DataFrame, mix_targets: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = 7) -> Mixture:
    """The mixture of TESTDATA's problem 8: sources weighed by ``mix_targets``; within a source domains (``doc_type``), and within these
    languages, by their tokens.  Targets exist for sources only, so sources stand at the top of the tree.

    ``mix_targets`` is a configuration table of one row a source and is read on the driver.  Documents of other sources count for the size.
    """
    wanted = [((r["source"],), r["target_share"], int(r["max_repeats"] or 1)) for r in mix_targets.distinct().collect() if r["source"] is not None]
    known = [p[0] for p, _, _ in wanted]
    source = F.when(F.col("source").isin(*known), F.col("source"))
    counted = documents.select("doc_id", source.alias("source"), F.col("doc_type").alias("domain"), language(F.col("lang")).alias("lang"), token_count(tokenizers, vocabulary)("text").alias("tokens"))
    return mix(counted, wanted, ["source", "domain", "lang"], seed=seed)
