"""The queries of the training-data problems, over their whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import entity_groups
from quern.llm.leakage import leaks
from quern.llm.linkage import match_people
from quern.llm.mixture import document_mixture
from quern.llm.neighbours import similar_pairs
from quern.llm.sentences import sentences
from quern.llm.survivors import retained_values, source_quality, survivors
from quern.llm.topn import top_n
from quern.llm.variants import link_variants

#: A pair is reported as a match from this marginal probability.
MATCH = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_table(spark, d, "candidate_matches"), "dprr_uri", "score", "match_id", 10).select("dprr_uri", "match_id")


def p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    return match_people(_table(spark, d, "person_contexts"), _table(spark, d, "dprr_persons"), _table(spark, d, "candidate_matches"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_confidence(spark, d).where(F.col("confidence") >= MATCH).select("context_id", "dprr_uri")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_table(spark, d, "doc_vectors")).toDF("doc_id_a", "doc_id_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_groups(_table(spark, d, "meta_entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return link_variants(_table(spark, d, "person_contexts"), _table(spark, d, "meta_entities")).select("context_id", "id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    records = _table(spark, d, "meta_entities")
    return survivors(records, entity_groups(records)).select("group_id", "field_name", "id")


def p6_quality(spark: SparkSession, d: str) -> DataFrame:
    records = _table(spark, d, "meta_entities")
    return source_quality(records, entity_groups(records))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of a field that the quality model judges true."""
    records = _table(spark, d, "meta_entities")
    return retained_values(records, entity_groups(records))


def p6_differs(spark: SparkSession, d: str) -> DataFrame:
    """Where the stated order keeps a value that the quality model holds to be less probably true than another one."""
    records = _table(spark, d, "meta_entities")
    return survivors(records, entity_groups(records)).where("truth < likeliest_truth").select("group_id", "field_name", "id", "truth", "likeliest", "likeliest_truth")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return document_mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets")).report


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p2_found": p2_found, "p2_confidence": p2_confidence, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found,
        "p6_found": p6_found, "p6_quality": p6_quality, "p6_values": p6_values, "p6_differs": p6_differs, "p7_found": p7_found, "p8_found": p8_found, "p8_shares": p8_shares, "p9_found": p9_found,
    }


_GROUPS = r"""
WITH RECURSIVE u AS (
  SELECT id, trim(x) AS u FROM (
    SELECT id, unnest(flatten(map_values(uris))) AS x FROM meta_entities WHERE uris IS NOT NULL
    UNION ALL
    SELECT id, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract_string(v, '$[*]') ELSE [json_extract_string(v, '$')] END) AS x
    FROM (SELECT id, unnest(json_extract(uris_json, '$.*')) AS v FROM meta_entities WHERE json_valid(uris_json) AND json_type(uris_json) = 'OBJECT')
  ) WHERE x IS NOT NULL),
r AS (
  SELECT id, regexp_replace(regexp_replace(replace(u, '%23', '#'), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/*(#(this|self|it))?/*$', '', 'i') AS rest
  FROM u WHERE regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/#?]')),
k AS (
  SELECT DISTINCT id, 'u:' || replace(regexp_replace(lower(regexp_extract(rest, '^([^/#?]*)', 1)), '^www\.', ''), 'edh.ub.uni-heidelberg.de', 'edh-www.adw.uni-heidelberg.de') || regexp_replace(rest, '^[^/#?]*', '') AS k FROM r
  UNION
  SELECT id, 'q:' || q FROM (SELECT id, regexp_extract(wikidata_qid, '(?:^|[^\pL\pN])[Qq]0*([1-9][0-9]*)(?:$|[^\pL\pN])', 1) AS q FROM meta_entities) WHERE q <> ''),
f AS (SELECT k, min(id) AS lo FROM k GROUP BY k),
e AS (SELECT DISTINCT k.id AS a, f.lo AS b FROM k JOIN f USING (k) WHERE k.id <> f.lo),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, g) AS (
  SELECT DISTINCT id, id FROM meta_entities WHERE id IS NOT NULL
  UNION
  SELECT x.b, reach.g FROM reach JOIN both_ways x ON x.a = reach.id WHERE reach.g < x.b),
grouped AS (SELECT id, min(g) AS group_id FROM reach GROUP BY id)
"""

_SURVIVORS = r""",
m AS (SELECT DISTINCT id, canonical_name, date_range, description, updated_at,
        CASE origin WHEN 'curated' THEN 0 WHEN 'concordance' THEN 1 WHEN 'derived' THEN 2 ELSE 3 END AS t FROM meta_entities),
c AS (
  SELECT id, t, updated_at, 'canonical_name' AS field_name, canonical_name AS v, 0 AS l FROM m
    WHERE regexp_matches(canonical_name, '\pL') AND canonical_name NOT IN ('unknown', 'incertus', 'n/a') AND regexp_matches(regexp_replace(canonical_name, '\[[^\]]*\]', '', 'g'), '\pL')
  UNION ALL SELECT id, t, updated_at, 'date_range', date_range, 0 FROM m WHERE regexp_matches(date_range, '[0-9]')
  UNION ALL SELECT id, t, updated_at, 'description', description, -length(description) FROM m WHERE regexp_matches(description, '[\pL\pN]') AND description NOT IN ('n/a', 'stub')),
big AS (SELECT group_id FROM grouped GROUP BY group_id HAVING count(*) > 1),
w AS (
  SELECT group_id, field_name, id, row_number() OVER (PARTITION BY group_id, field_name ORDER BY l, t, updated_at DESC NULLS LAST, id) AS n
  FROM c JOIN grouped USING (id) JOIN big USING (group_id))
SELECT group_id, field_name, id FROM w WHERE n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT dprr_uri, match_id FROM (
              SELECT dprr_uri, match_id, row_number() OVER (PARTITION BY dprr_uri ORDER BY score DESC, match_id) AS n
              FROM (SELECT DISTINCT dprr_uri, match_id, score FROM candidate_matches
                    WHERE dprr_uri IS NOT NULL AND match_id IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1)) WHERE n <= 10""",
        "p4_found": _GROUPS + "SELECT group_id, id FROM grouped",
        "p6_found": _GROUPS + _SURVIVORS,
        "p8_found": """
            WITH s AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS n FROM s)
            SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = m.source, t WHERE coalesce(s.n, 0) * m.max_repeats < m.target_share * t.n""",
    }
