"""Session logs: JSON lines, read whole or in part, and what their payloads mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import is_known_uri, uris_in_text
from quern.runtime import durable

EVENT = "session_id string, seq long, type string, dataset string, timestamp timestamp, data string, _corrupt_record string"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files; a line that is no JSON is kept in ``_corrupt_record``, never fatal."""
    return spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("file", F.input_file_name())


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line)``: what could not be read, collected and not fatal."""
    return durable(read_sessions(spark, path)).where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"))


def session_summary(events: DataFrame, key: str = "session_id", at: str = "timestamp") -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def event_uris(kind: Column, data: Column) -> Column:
    """Distinct known URIs of an event's payload, by its type; sorted."""
    texts = lambda path: F.from_json(F.get_json_object(data, path), T.ArrayType(T.StringType()))
    none = F.array().cast("array<string>")
    rows = F.flatten(F.transform(F.from_json(F.get_json_object(data, "$.rows"), "array<map<string,string>>"), lambda m: F.map_values(m)))
    field = lambda path, name: F.transform(F.from_json(F.get_json_object(data, path), f"array<struct<{name}: string>>"), lambda x: x[name])
    one = F.array(F.get_json_object(data, "$.uri"))
    each = lambda *xs: F.concat(*[F.coalesce(x, none) for x in xs])
    found = F.when(kind == "query", each(rows)).when(kind == "search", each(field("$.results", "uri"))).when(kind == "entity", each(one, field("$.properties", "obj"), field("$.xrefs", "target"))).when(kind == "links", each(one, field("$.links", "target")))
    known = F.array_sort(F.array_distinct(F.filter(found, lambda u: u.isNotNull() & is_known_uri(u))))
    return F.when(kind == "report", uris_in_text(F.get_json_object(data, "$.markdown"))).otherwise(F.coalesce(known, none))


def feed_filter(events: DataFrame, types: list[str] | None = None, datasets: list[str] | None = None, bookmarked: DataFrame | None = None, hide_empty: bool = False) -> DataFrame:
    """Events to show: of some types, of some datasets (those without one always), bookmarked ones, those with rows."""
    out = events
    if types is not None:
        out = out.where(F.col("type").isin(*types))
    if datasets is not None:
        out = out.where(F.col("dataset").isNull() | F.col("dataset").isin(*datasets))
    if bookmarked is not None:
        out = out.join(bookmarked.select("session_id", "seq").distinct(), ["session_id", "seq"], "left_semi")
    if hide_empty:
        out = out.where(F.coalesce(F.get_json_object("data", "$.row_count").try_cast("int") > 0, F.lit(True)))
    return out


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
