"""Metric-space partitioning of words: pivots, cells, replication by the triangle inequality, exact radius joins.

Joins on keys are hinted as merges: the keys are made from small files, whose size says nothing about theirs, and would be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import default_parallelism, durable

#: Every word of the indexed side lies within COVER edits of its pivot; pairs within RADIUS edits are found.
COVER, RADIUS = 1, 2
#: Words of more letters are compared by parts instead of deletions, whose number grows with a power of the length.
LONG = 24
#: A copy of a point, which is written, sorted and read, counts as so many points that are measured where they meet.
COPY = 4


def _deletions(word: Column) -> Column:
    """The word and all words that lack one of its letters: words within one edit share one of them.  Of a long word, itself."""
    less = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.char_length(word).between(1, LONG + RADIUS + COVER), less).otherwise(F.array().cast("array<string>"))))


def _spread(words: DataFrame) -> DataFrame:
    """Words over all tasks: they are few bytes, which readers and AQE would put into one task, but each becomes hundreds of keys."""
    spark = words.sparkSession
    return words.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), default_parallelism(spark)))  # by turns: hashing would be merged with the shuffle before


def pivots(words: DataFrame) -> DataFrame:
    """``(word, pivot, gap)`` for ``(word, n)``: the pivot of each word, at most COVER edits away, and the distance.

    A word is a pivot if no word within one edit is more frequent (ties: smaller first), so the usual spelling stands for its slips; a word
    that is no pivot and has none near becomes its own.
    """
    words = durable(words)
    spread = _spread(words).select("word", "n", F.explode(_deletions(F.col("word"))).alias("v"))
    other = spread.select(F.col("word").alias("other"), F.col("n").alias("m"), "v")
    near = spread.join(other.hint("merge"), "v").where("word <> other").select("word", "n", "other", "m").distinct()
    near = durable(near.where(F.levenshtein("word", "other", COVER) >= 0))
    beaten = near.where("m > n or (m = n and other < word)").select("word").distinct()
    top = durable(words.join(beaten, "word", "left_anti").select("word"))
    held = near.join(top.withColumnRenamed("word", "other"), "other", "left_semi").join(top, "word", "left_anti")
    assigned = held.groupBy("word").agg(F.min("other").alias("pivot"))
    return words.join(assigned, "word", "left").select("word", F.coalesce("pivot", "word").alias("pivot"), F.when(F.col("pivot").isNull(), 0).otherwise(COVER).cast("int").alias("gap"))


def _segments(length: Column, word: Column, edits: int, shift: Column | int = 0) -> Column:
    """Keys of ``edits`` + 1 parts of a word as if it had ``length`` letters, read ``shift`` letters further on."""
    part = (length / (edits + 1)).cast("int")
    return F.array(*[F.concat_ws("|", F.lit(edits), length, F.lit(i), F.substring(word, part * i + 1 + shift, part if i < edits else length)) for i in range(edits + 1)])


def _keys(word: Column, asked: bool, edits: int) -> Column:
    """Keys such that any two words within so many edits share one: what is left after as many deletions, for long words one of the parts.

    ``asked`` words, compared with held ones, carry the keys of both kinds near the limit, and the parts for each length and shift.
    """
    n = F.char_length(word)
    none = F.array().cast("array<string>")
    short = F.array(word)
    for _ in range(edits):
        short = F.array_distinct(F.flatten(F.transform(short, _deletions)))
    if not asked:
        return F.when(n <= LONG, short).otherwise(_segments(n, word, edits))
    lengths = F.sequence(n - edits, n + edits)
    moved = F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(F.sequence(F.lit(-edits), F.lit(edits)), lambda k: _segments(m, word, edits, k)))))
    return F.concat(F.when(n <= LONG + edits, short).otherwise(none), F.when(n > LONG - edits, F.array_distinct(moved)).otherwise(none))


def near_cells(words: DataFrame, own: DataFrame) -> DataFrame:
    """``(word, pivot, far)``: the cells to which each word is copied, and its distance from their pivots.

    By the triangle inequality a word within RADIUS of any word of a cell lies within RADIUS + the cell's own radius of its pivot; it is copied
    to every cell of which that is true, and to no other.  Words are compared with pivots only, never with the words of the cells: those are
    met and measured inside the cells.  Pivots that near are found by shared keys (an equi-join that grows with the words, not with the product
    of words and pivots) and measured exactly.
    """
    cells = durable(own.groupBy("pivot").agg(F.max("gap").alias("reach")))
    widths = [r["reach"] for r in cells.select("reach").distinct().collect()]  # 0 to COVER
    keys = lambda c, asked, reach: _keys(F.col(c), asked, RADIUS + reach)
    asked = _spread(words).select("word", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[keys("word", True, w) for w in widths]))).alias("v"))
    own_keys = F.array().cast("array<string>")
    for w in widths:  # a cell of one word is looked for within RADIUS only
        own_keys = F.when(F.col("reach") == w, keys("pivot", False, w)).otherwise(own_keys)
    held = _spread(cells).select("pivot", "reach", F.explode(own_keys).alias("v"))
    met = asked.join(held.hint("merge"), "v").select("word", "pivot", "reach").distinct()
    near = met.withColumn("far", F.levenshtein("word", "pivot", RADIUS + COVER)).where("far >= 0")
    return near.where(F.col("far") <= F.col("reach") + RADIUS).select("word", "pivot", "far")


def near_words(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``(l, r, pivot, d)``: each asked ``word`` and the held ones (``word, n``) within RADIUS edits, and the cell in which they met and were measured.

    Empty words only equal empty words.
    """
    own = durable(pivots(held))
    met = near_cells(asked, own).select(F.col("word").alias("l"), "pivot").join(own.select(F.col("word").alias("r"), "pivot"), "pivot")
    return durable(met.withColumn("d", F.levenshtein("l", "r", RADIUS)).where("d >= 0 and (l = '') = (r = '')").select("l", "r", "pivot", "d"))


def near_points(left: DataFrame, right: DataFrame, words1: DataFrame, words2: DataFrame) -> DataFrame:
    """All pairs of a point ``l1, l2`` and a point ``r1, r2`` both of whose words are near, with ``d1, d2`` and the other columns of both sides.

    ``words1`` and ``words2`` are those of :func:`near_words`.  A point is copied to the near words of one axis, that on which fewer points wait,
    and the other axis is measured where they meet.  The cells of both axes at once would take copies as the product of its cells, nearly all of
    them to places where nothing is; only a point frequent on both axes, for which the product is less than what waits on either, is sent there.
    """
    ways = left
    for i, words in (("1", words1), ("2", words2)):
        there = right.groupBy(F.col(f"r{i}").alias("r")).agg(F.count(F.lit(1)).alias("points"))
        cost = words.join(there, "r").groupBy(F.col("l").alias(f"l{i}")).agg(F.sum(F.col("points") + COPY).alias(f"cost{i}"), F.countDistinct("pivot").alias(f"cells{i}"))
        ways = ways.join(cost, f"l{i}")
    way = F.when(F.least("cost1", "cost2") > COPY * F.col("cells1") * F.col("cells2"), 0).when(F.col("cost1") <= F.col("cost2"), 1).otherwise(2)
    ways = durable(ways.select(*left.columns, way.alias("way")))
    kept = [*left.columns, *right.columns, "d1", "d2"]

    def measured(pairs: DataFrame, i: str) -> DataFrame:
        return pairs.withColumn(f"d{i}", F.levenshtein(f"l{i}", f"r{i}", RADIUS)).where(f"d{i} >= 0 and (l{i} = '') = (r{i} = '')")

    def along(way: int, i: str, words: DataFrame, other: str) -> DataFrame:
        copies = ways.where(F.col("way") == way).join(words.select(F.col("l").alias(f"l{i}"), F.col("r").alias(f"r{i}"), F.col("d").alias(f"d{i}")), f"l{i}")
        return measured(copies.join(right, f"r{i}"), other).select(*kept)

    crossed, cells = ways.where("way = 0"), right
    for i, words in (("1", words1), ("2", words2)):
        crossed = crossed.join(words.select(F.col("l").alias(f"l{i}"), F.col("pivot").alias(f"p{i}")).distinct(), f"l{i}")
        cells = cells.join(words.select(F.col("r").alias(f"r{i}"), F.col("pivot").alias(f"p{i}")).distinct(), f"r{i}")
    crossed = measured(measured(crossed.join(cells, ["p1", "p2"]), "1"), "2").select(*kept)
    return along(1, "1", words1, "2").unionByName(along(2, "2", words2, "1")).unionByName(crossed)


def radius_join(left: DataFrame, right: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct ``(left first, left second, right first, right second, d1, d2)`` with both words within RADIUS edits.

    Points are pairs of words under the larger of the two edit distances, a metric.  On each axis the words near to each other meet in the cells of
    their pivots (see :func:`near_cells`), and points meet by their words (see :func:`near_points`).  No pair within the radius is missed; no other
    is returned.  Null words are dropped; empty words only equal empty words.
    """
    a = durable(left.select(F.col(first).alias("l1"), F.col(second).alias("l2")).dropna().distinct())
    b = durable(right.select(F.col(first).alias("r1"), F.col(second).alias("r2")).dropna().distinct())
    words = [near_words(a.select(F.col(f"l{i}").alias("word")).distinct(), b.groupBy(F.col(f"r{i}").alias("word")).agg(F.count(F.lit(1)).alias("n"))) for i in "12"]
    return near_points(a, b, *words).toDF("a1", "a2", "b1", "b2", "d1", "d2")
