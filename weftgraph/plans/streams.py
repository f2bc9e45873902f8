"""Queries of the streaming operators over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.registry import Registry
from weftgraph.streaming import windows as W

R = Registry()
Spark = SparkSession


def events(spark: Spark, d: str) -> DataFrame:
    """`ts` as an instant: a time without zone is UTC, whatever the session's zone."""
    schema = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # A stream watches a folder: the table's own, or the one that its only file lies in.
    reader = spark.readStream.schema(schema)
    s = reader.parquet(f"{d}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    if schema["ts"].dataType.typeName() == "timestamp_ntz":
        s = s.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))
    return s


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.unix_timestamp("window.start").alias("start"), "user_id", "n")


@R.query("stream_degree_tumbling", "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_degree_tumbling(spark: Spark, d: str) -> DataFrame:
    return _flat(W.run_to_table(W.windowed_degree(events(spark, d), "user_id", "ts", "1 day")))


@R.query(
    "stream_degree_sliding",
    "SELECT CAST(start AS BIGINT) AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([floor(epoch(ts) / 43200) * 43200, floor(epoch(ts) / 43200) * 43200 - 43200]) AS start FROM events) GROUP BY ALL",
)
def stream_degree_sliding(spark: Spark, d: str) -> DataFrame:
    return _flat(W.run_to_table(W.windowed_degree(events(spark, d), "user_id", "ts", "1 day", "12 hours")))


@R.query(
    "stream_sessions",
    "SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, user_id, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g",
)
def stream_sessions(spark: Spark, d: str) -> DataFrame:
    return _flat(W.run_to_table(W.sessions(events(spark, d), "user_id", "ts", "6 hours")))


@R.query(
    "stream_degree_closed",
    "SELECT * FROM (SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, user_id, count(*) AS n FROM events GROUP BY ALL) "
    "WHERE start + 86400 <= (SELECT floor(epoch(max(ts)) * 1000) / 1000 - 43200 FROM events)",
)
def stream_degree_closed(spark: Spark, d: str) -> DataFrame:
    """Windows are given out once, when the watermark (12 hours behind) has passed them, and their state is dropped."""
    return _flat(W.run_to_table(W.windowed_degree(events(spark, d), "user_id", "ts", "1 day", late="12 hours"), "append"))


@R.query("stream_distinct_edges", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct_edges(spark: Spark, d: str) -> DataFrame:
    return W.run_to_table(W.distinct_edges(events(spark, d), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), "append")
