"""Streaming counterparts: degrees over time windows, edge deduplication, late data by watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import checkpoint_dir


def edge_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    """A directory of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_degree(events: DataFrame, key: str, ts: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(window, key, n): events of a key in tumbling (or sliding) windows; rows later than `late` are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("window"), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    """(window, key, n): runs of events of a key with pauses below `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), key).agg(F.count(F.lit(1)).alias("n"))


def distinct_edges(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key combination once within the watermark: state is dropped when it is past."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there (availableNow) and return the result as a table in the shared folder.

    `complete` keeps the last state of all groups; `append` keeps every emitted row.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
