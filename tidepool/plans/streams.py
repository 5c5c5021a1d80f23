"""Streaming queries over the same tables, run to their end, or their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as S
from ..sources.store import new_path
from ..streaming import ingest as O
from ..streaming import machines
from .registry import query

#: Rows of a file that a stream is fed, at most about.
FILE_ROWS = 500_000


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS \"start\", event_type AS action, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    w = O.windows(S.events(spark, d), "t", "1 hour", keys=["action"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "action", "n", F.round("total", 4).alias("total"))


@query("sliding_time_windows", "SELECT TIMESTAMP '2024-01-01' + CAST(floor(epoch(ts) / 1800) - 946684800 * 0 - 1704067200 / 1800 - k AS BIGINT) * INTERVAL 30 MINUTE AS \"start\", count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def sliding_time_windows(spark: SparkSession, d: str) -> DataFrame:
    w = O.windows(S.events(spark, d), "t", "1 hour", "30 minutes")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("session_windows", "WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(ts) AS \"start\", count(*) AS n FROM g GROUP BY user_id, s")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    w = O.sessions(S.events(spark, d), "t", "6 hours", ["user_id"])
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("commits_once", "SELECT min(event_id) AS id, user_id, event_type AS action FROM events GROUP BY 2, 3")
def commits_once(spark: SparkSession, d: str) -> DataFrame:
    """The first commit of each key. The batch form takes the smallest id, as a batch has no order of arrival."""
    return S.events(spark, d).groupBy("user_id", "action").agg(F.min("id").alias("id")).select("id", "user_id", "action")


@query("session_cursor", "SELECT conv_id AS session_id, max(turn) AS last_turn FROM conversations GROUP BY 1")
def session_cursor(spark: SparkSession, d: str) -> DataFrame:
    return S.turns(spark, d).groupBy("session_id").agg(F.max("idx").alias("last_turn"))


@query("job_retention", "SELECT event_id AS id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-10' AND event_id % 4 <> 0")
def job_retention(spark: SparkSession, d: str) -> DataFrame:
    """Finished jobs older than a time and without a retry ahead."""
    return S.parquet(spark, d, "events", "event_id", "event_type", "ts").filter("event_type = 'error' AND ts < TIMESTAMP_NTZ '2024-01-10' AND event_id % 4 <> 0").select(F.col("event_id").alias("id"))


@query("state_stream", """WITH o AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS b FROM events)
 SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS id, CASE WHEN b IS NULL THEN 'created' WHEN b = event_type THEN 'touched' ELSE 'updated' END AS status, CASE WHEN b <> event_type THEN b END AS before FROM o""")
def state_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events in files whose order has nothing to do with time, as a stream of observations: the log of each user's state is that of the whole table in order of time."""
    rows = S.events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.col("action").alias("value"), F.col("t").cast("timestamp").alias("t"))
    files, log, at = new_path(spark, "observations"), new_path(spark, "state-log"), new_path(spark, "state-checkpoint")
    parts = max(1, -(-rows.count() // (3 * FILE_ROWS)))
    rows.repartition(3 * parts, F.xxhash64("id")).write.parquet(files)
    end = rows.agg(F.max("t").alias("t")).select(F.lit("").alias("key"), F.lit("end").alias("id"), F.lit(None).cast("string").alias("value"), (F.col("t") + F.make_dt_interval(days=F.lit(800))).alias("t"))
    end.coalesce(1).write.mode("append").parquet(files)
    out = machines.state_log(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * parts).parquet(files), delay="400 days")
    out.writeStream.format("parquet").option("path", log).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(log).filter("key <> ''").select("key", "id", "status", "before")
