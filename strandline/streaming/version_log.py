"""A stream of changes into version tables, and counts over event time (beyond batch parity).

Changes arrive as rows (key, changed_at, properties); each micro-batch is appended to a change log in Parquet, and the
version chain is a window over that log, so late changes find their place whenever they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.temporal import chain
from strandline.sources.catalog import NodeTable


def append_log(changes: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append a stream of changes to a log. A batch writes its own folder and overwrites it if it runs again, so each
    change is in the log once, whatever fails."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def versions(spark: SparkSession, path: str, key: str, at: str, label: str, schema: str) -> NodeTable:
    """The log as the versions of a node table: each change is valid until the next one of its key."""
    log = spark.read.schema(schema).parquet(f"{path}/batch=*")
    return NodeTable(chain(log, key, at).drop(at), key, (label,))


def windowed_counts(events: DataFrame, at: str, by: str, *, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """start, end, by, n: events per window of event time; a window is final when the watermark passes its end."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, lateness).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
