"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.plans.common import Registry
from loam.session import read_table, shared_dir
from loam.streaming import jobs

R = Registry()


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of its files."""
    schema = read_table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(s: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    out = f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"
    schema = stream.schema
    query = jobs.run(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows/batch={n}" if mode == "append" else f"{out}/rows"), f"{out}/checkpoint", mode)
    query.awaitTermination()
    return s.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


@R.add("stream_rollup", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    out = _finish(s, jobs.rollup_windows(_stream(s, d)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@R.add("stream_first_sight", "SELECT CAST(user_id AS VARCHAR) AS session, event_type AS path, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def _(s, d):
    e = _stream(s, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("path"), "ts")
    return _finish(s, jobs.first_in_session(e, "60 days")).groupBy("session", "path").agg(F.count(F.lit(1)).alias("n"))


@R.add("stream_unseen", """WITH e AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM events)
SELECT CAST(user_id AS VARCHAR) AS session, event_type AS path, count(*) AS n FROM (SELECT DISTINCT user_id, seg, event_type FROM e WHERE event_type <> 'purchase') GROUP BY 1, 2""")
def _(s, d):
    e = _stream(s, d).select(F.col("user_id").cast("string").alias("session"), F.when(F.col("event_type") == "purchase", "start").otherwise("prompt").alias("event"), F.col("event_type").alias("path"), "ts")
    return _finish(s, jobs.unseen(e)).groupBy("session", "path").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = R.queries, R.sql
