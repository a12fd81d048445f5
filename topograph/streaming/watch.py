"""A feed of file changes: filter, debounce by session windows, and a handler for each flush."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import EXTENSIONS, IGNORED_DIRECTORIES


def watched(events: DataFrame) -> DataFrame:
    """Events (path, ts) of source files and of project configuration, outside ignored directories."""
    path = F.translate("path", "\\", "/")
    parts = F.split(path, "/")
    ignored = F.exists(parts, lambda p: p.isin(*IGNORED_DIRECTORIES) | (p.startswith(".") & (F.length(p) > 1)))
    known = F.lit(False)
    for e in EXTENSIONS:
        known = known | F.lower(path).endswith(e)
    return events.filter(~ignored & (known | path.endswith("tsconfig.json")))


def debounce(events: DataFrame, gap: str = "100 milliseconds", *keys: str) -> DataFrame:
    """(keys, start, end, paths, events): bursts with no pause of gap, each with its set of paths. Works on batches and, with a watermark, on streams."""
    w = F.session_window("ts", gap)
    return events.groupBy(*keys, w).agg(F.collect_set("path").alias("paths"), F.count("*").alias("events")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "paths", "events")


def on_changes(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "100 milliseconds", late: str = "1 second", **trigger) -> StreamingQuery:
    """Start the feed: handler gets each micro-batch of flushed bursts. Stop it with the query's stop(); bursts not yet flushed are dropped."""
    feed = F.substring("path", 1, 0)  # session windows of a stream need a key; this one is empty for all, and not a literal
    flushed = debounce(watched(events).withWatermark("ts", late).withColumn("feed", feed), gap, "feed").drop("feed")
    writer = flushed.writeStream.outputMode("append").foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
