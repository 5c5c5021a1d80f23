"""Windows: chains, states, islands, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import seconds, timestamp
from ..operators import intervals as I
from ..operators import state as St
from ..sources import tables as S
from .registry import query

OBS = "o AS (SELECT user_id, event_type AS v, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"
CHAIN = f"{OBS}, c AS (SELECT user_id, v AS value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - INTERVAL 1 MILLISECOND AS valid_to, b AS value_before, event_id AS source_event_id FROM o WHERE b IS NULL OR b <> v)"


def chain(spark: SparkSession, d: str) -> DataFrame:
    return St.chain(S.events(spark, d).select("user_id", F.col("action").alias("value"), "t", "id"), ["user_id"])


@query("state_chain", f"WITH {CHAIN} SELECT * FROM c")
def state_chain(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d)


@query("state_current", f"WITH {CHAIN} SELECT user_id, value, valid_from FROM c WHERE valid_to IS NULL")
def state_current(spark: SparkSession, d: str) -> DataFrame:
    return St.current(chain(spark, d), ["user_id"]).select("user_id", "value", "valid_from")


@query("state_as_of", f"WITH {CHAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, source_event_id DESC) AS k FROM c WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00') SELECT user_id, value, valid_from FROM r WHERE k = 1")
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    return St.as_of(chain(spark, d), ["user_id"], timestamp("2024-01-15 12:00:00")).select("user_id", "value", "valid_from")


@query("state_as_of_gap", f"WITH {CHAIN} SELECT user_id, value, valid_from FROM c WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')")
def state_as_of_gap(spark: SparkSession, d: str) -> DataFrame:
    return St.as_of(chain(spark, d), ["user_id"], timestamp("2024-01-15 12:00:00"), gap=True).select("user_id", "value", "valid_from")


@query("state_changes", f"WITH {CHAIN} SELECT user_id, value, valid_from FROM c WHERE valid_from BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11' ORDER BY valid_from DESC, source_event_id LIMIT 200")
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    return St.changes(chain(spark, d), timestamp("2024-01-10"), timestamp("2024-01-11")).orderBy(F.desc("valid_from"), "source_event_id").limit(200).select("user_id", "value", "valid_from")


@query("state_time_since", f"WITH {CHAIN} SELECT user_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(valid_from)) / 1e6, 3) AS seconds FROM c WHERE valid_to IS NULL")
def state_time_since(spark: SparkSession, d: str) -> DataFrame:
    c = St.current(chain(spark, d), ["user_id"])
    return c.select("user_id", F.round(F.greatest(F.lit(0.0), seconds(timestamp("2024-02-01"), F.col("valid_from"))), 3).alias("seconds"))


@query("state_late", "SELECT id, user_id FROM (SELECT event_id AS id, user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE ts < m")
def state_late(spark: SparkSession, d: str) -> DataFrame:
    """Observations that come out of order, given an order of arrival."""
    e = S.events(spark, d).withColumn("arrival", F.struct((F.col("id") * 7919 % 10007).alias("a"), "id"))
    return St.late(e, ["user_id"], "arrival").select("id", "user_id")


@query("next_event_chain", "SELECT user_id, event_id AS src_id, n AS dst_id FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL")
def next_event_chain(spark: SparkSession, d: str) -> DataFrame:
    return I.next_in_order(S.events(spark, d), ["user_id"], "t")


@query("causes_candidates", "SELECT src_id, dst_id, 0.3 AS confidence FROM (SELECT event_id AS src_id, event_type AS x, lead(event_id) OVER w AS dst_id, lead(event_type) OVER w AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x = y")
def causes_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in time at the same place may be cause and effect."""
    n = I.next_in_order(S.events(spark, d), ["user_id"], "t", extra=["action"])
    return n.filter("src_action = dst_action").select("src_id", "dst_id", F.lit(0.3).alias("confidence"))


@query("next_segment", "SELECT conv_id AS session_id, turn AS src_id, n AS dst_id FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n IS NOT NULL")
def next_segment(spark: SparkSession, d: str) -> DataFrame:
    return I.next_in_order(S.turns(spark, d), ["session_id"], "idx", key="idx")


SPANS = "s AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 - 1704067200 AS a, epoch_us(ts) / 1e6 - 1704067200 + value AS b FROM events)"


def micros(seconds_column: str) -> Column:
    """Whole microseconds, which both engines round alike."""
    return F.round(F.col(seconds_column) * 1e6).cast("long")


def spans(spark: SparkSession, d: str) -> DataFrame:
    s = seconds(F.col("t"), timestamp("2024-01-01"))
    return S.events(spark, d).select("user_id", "id", "action", s.alias("start"), (s + F.col("value")).alias("end"))


@query("span_islands", f"WITH {SPANS}, m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), g AS (SELECT *, sum(CASE WHEN e IS NULL OR a - e > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT user_id, CAST(round(min(a) * 1e6) AS BIGINT) AS \"start\", CAST(round(max(b) * 1e6) AS BIGINT) AS \"end\", count(*) AS spans FROM g GROUP BY user_id, i")
def span_islands(spark: SparkSession, d: str) -> DataFrame:
    out = I.islands(spans(spark, d), ["user_id"], 3600.0, tie=["id"])
    return out.select("user_id", micros("start").alias("start"), micros("end").alias("end"), "spans")


@query("same_track_merge", f"WITH {SPANS}, m AS (SELECT *, lag(event_type) OVER w AS p, lag(b) OVER w AS e FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b, event_id)), g AS (SELECT *, sum(CASE WHEN p = event_type AND a - e <= 7200 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT user_id, event_type AS action, CAST(round(min(a) * 1e6) AS BIGINT) AS \"start\", CAST(round(max(b) * 1e6) AS BIGINT) AS \"end\", count(*) AS turns FROM g GROUP BY user_id, event_type, i")
def same_track_merge(spark: SparkSession, d: str) -> DataFrame:
    out = I.merge_neighbours(spans(spark, d), ["user_id"], "action", 7200.0, tie=["id"])
    return out.select("user_id", "action", micros("start").alias("start"), micros("end").alias("end"), "turns")


@query("sliding_windows", "WITH m AS (SELECT c_custkey AS id, greatest(1.0, abs(c_acctbal) / 10) AS dur FROM customer), n AS (SELECT id, dur, unnest(range(0, greatest(1, CAST(ceil((dur - 2) / 6) AS BIGINT)))) AS w FROM m) SELECT id, CAST(w AS INTEGER) AS \"window\", CAST(w * 6.0 AS DOUBLE) AS \"start\", CAST(least(w * 6.0 + 8, dur) AS DOUBLE) AS \"end\" FROM n")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    m = S.parquet(spark, d, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("id"), F.greatest(F.lit(1.0), F.abs("c_acctbal") / 10).alias("duration"))
    return I.sliding(m, 8.0, 2.0)


@query("adaptive_windows", """WITH m AS (SELECT c_custkey AS id, greatest(1.0, abs(c_acctbal) / 15) AS dur FROM customer), c AS (SELECT *, CASE WHEN 1 + ceil(round((dur - 8) / 6, 9)) > 32 THEN 1.0 ELSE 2.0 END AS o FROM m),
 g AS (SELECT *, list_filter(range(8, 21), lambda s: s = 20 OR dur <= s OR 1 + ceil(round((dur - s) / (s - o), 9)) <= 32)[1] AS size FROM c), w AS (SELECT *, unnest(range(0, CASE WHEN dur <= size THEN 1 ELSE 1 + CAST(ceil(round((dur - size) / (size - o), 9)) AS BIGINT) END)) AS w FROM g)
 SELECT id, CAST(w AS INTEGER) AS "window", CAST(round(w * (size - o), 6) AS DOUBLE) AS "start", CAST(round(least(w * (size - o) + size, dur), 6) AS DOUBLE) AS "end", CAST(size AS DOUBLE) AS size FROM w""")
def adaptive_windows(spark: SparkSession, d: str) -> DataFrame:
    m = S.parquet(spark, d, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("id"), F.greatest(F.lit(1.0), F.abs("c_acctbal") / 15).alias("duration"))
    return I.adaptive(m, 8.0, 2.0)


@query("frame_cap", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 10 OR i IN (SELECT i FROM (SELECT unnest(range(0, 10)) AS k) WHERE floor(k * n / 10.0) = i)")
def frame_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most ten evenly spaced frames of each: index floor(k * n / 10)."""
    w = Window.partitionBy("user_id")
    r = S.parquet(spark, d, "events", "user_id", "event_id").withColumns({"i": F.row_number().over(w.orderBy("event_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    first = F.ceil(F.col("i") * 10 / F.col("n"))  # the only k whose index can be i
    return r.filter((F.col("n") <= 10) | ((first < 10) & (F.floor(first * F.col("n") / 10) == F.col("i")))).select("user_id", "event_id")


@query("near_duplicate_frames", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type AS h, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> h")
def near_duplicate_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "id")
    e = S.events(spark, d).withColumn("p", F.lag("action").over(w)).filter("p IS NULL OR p <> action")
    return e.select("user_id", F.col("id").alias("event_id"))


@query("longest_in_order", "SELECT user_id, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3)")
def longest_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The three longest of each, numbered by time."""
    w = Window.partitionBy("user_id")
    k = S.events(spark, d).withColumn("k", F.row_number().over(w.orderBy(F.desc("value"), "id"))).filter("k <= 3")
    return k.select("user_id", F.col("id").alias("event_id"), F.row_number().over(w.orderBy("t", "id")).alias("n"))


@query("rank_unit", "SELECT event_id AS id, round(CASE WHEN n = 1 THEN 1 ELSE 1 - (r - 1) / (n - 1) END, 6) AS u FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def rank_unit(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = S.events(spark, d).withColumns({"r": F.row_number().over(w.orderBy(F.desc("value"), "id")), "n": F.count(F.lit(1)).over(w)})
    return e.select("id", F.round(F.when(F.col("n") == 1, 1.0).otherwise(1 - (F.col("r") - 1) / (F.col("n") - 1)), 6).alias("u"))


@query("order_consistency", "WITH r AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, CAST(min(CASE WHEN p IS NULL OR p <= value THEN 1 ELSE 0 END) AS INTEGER) AS consistent FROM r GROUP BY 1")
def order_consistency(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "id")
    e = S.events(spark, d).withColumn("p", F.lag("value").over(w))
    return e.groupBy("user_id").agg(F.min(F.when(F.col("p").isNull() | (F.col("p") <= F.col("value")), 1).otherwise(0)).alias("consistent"))


@query("compact_map", f"WITH {SPANS} SELECT user_id, event_id, CAST(round(1e6 * (coalesce(sum(b - a) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * (row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) - 1))) AS BIGINT) AS compact_start, CAST(round(a * 1e6) AS BIGINT) AS original_start FROM s")
def compact_map(spark: SparkSession, d: str) -> DataFrame:
    """Speech spans laid end to end with half a second between, and where they came from."""
    w = Window.partitionBy("user_id").orderBy("start", "id")
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return spans(spark, d).select("user_id", F.col("id").alias("event_id"), F.round(1e6 * (before + 0.5 * (F.row_number().over(w) - 1))).cast("long").alias("compact_start"), micros("start").alias("original_start"))


@query("remap_times", "WITH p AS (SELECT c_nationkey AS k, c_custkey * 10.0 AS a, c_custkey * 10.0 + 7 AS b, c_custkey * 13.0 AS o FROM customer) SELECT event_id AS id, CAST(round((o + z - a) * 1000) AS BIGINT) AS ms FROM (SELECT event_id, event_id % 25 AS k, event_id % 1501 + 0.5 AS z FROM events) JOIN p USING (k) WHERE z >= a AND z < b")
def remap_times(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey").cast("double")
    pieces = S.parquet(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").cast("long").alias("k"), (c * 10).alias("compact_start"), (c * 10 + 7).alias("compact_end"), (c * 13).alias("original_start"))
    points = S.events(spark, d).select("id", (F.col("id") % 25).cast("long").alias("k"), (F.col("id") % 1501 + 0.5).alias("at"))
    return I.remap(points, pieces, ["k"]).select("id", F.round(F.col("original") * 1000).cast("long").alias("ms"))
