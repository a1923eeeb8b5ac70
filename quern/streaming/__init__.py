"""Session feeds as streams: file source, deduplication, incremental resolution, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.sessions import EVENT, event_uris


def read_feed(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New log files as they come; a late reader starts with the oldest."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(path)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (session, seq) once; the state of a session's numbers is dropped when the watermark has passed."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["session_id", "seq"])


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes", at: str = "timestamp", kind: str = "type") -> DataFrame:
    """Counts by event-time window and type; events later than ``delay`` are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessionized(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", at: str = "timestamp", key: str = "session_id") -> DataFrame:
    w = F.session_window(at, gap)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def resolve_new_uris(events: DataFrame, known_path: str, resolve: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls ``resolve`` with the (session_id, uri) rows not seen before; what was seen is a Parquet table.

    A batch that is run again after a failure finds its own rows by their batch number and leaves them out of the comparison, so it resolves the
    same rows as before.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = batch.select("session_id", F.explode(event_uris(F.col("type"), F.col("data"))).alias("uri")).distinct()
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(known_path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            known = spark.read.parquet(known_path).where(F.col("batch") != number)
            found = found.join(known, ["session_id", "uri"], "left_anti")
        found = found.persist()
        resolve(found)
        found.write.mode("overwrite").parquet(f"{known_path}/batch={number}")
        found.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
