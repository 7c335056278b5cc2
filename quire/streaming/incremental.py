"""Streams: an extension, as outlines are built in batches otherwise.

New page or Markdown files are indexed as they arrive; events are counted in tumbling and
session windows with a watermark for late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import markdown


def index_markdown(docs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the nodes of every arriving document ``(doc_id, text)`` to ``path``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so nothing is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        markdown.nodes(markdown.lines(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped by the engine."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
