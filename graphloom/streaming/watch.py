"""Change streams: debounced rebuilds and ordered folds, for batches and for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions whose changes start a rebuild.
WATCHED = [".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".rb", ".go", ".rs", ".java", ".kt", ".php", ".yml", ".yaml", ".sql", ".prisma"]


def watched(events: DataFrame, path: str = "path") -> DataFrame:
    return events.where(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*WATCHED))


def debounced(events: DataFrame, gap: str = "1 second", late: str | None = None) -> DataFrame:
    """(key, started, fires, events): each event restarts the timer of its key; a quiet gap fires once.

    On a stream a watermark (late) lets finished sessions be emitted and their state be dropped."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.session_window("ts", gap)
    out = rows.groupBy("key", w).agg(F.count("*").alias("events"))
    return out.select("key", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("fires"), "events")


def source_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Changed source files of a folder as a stream of (key, ts): one key, the folder's own rebuild."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return watched(files).select(F.lit(folder).alias("key"), F.col("modificationTime").alias("ts"), "path")


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[], None], checkpoint: str, every: str = "1 second"):
    """Starts a query that calls rebuild once for every batch of changes."""

    def fire(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rebuild()

    return changes.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
