"""Aggregates over the graph and tables derived from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entities_overview(involves: DataFrame, events: DataFrame) -> DataFrame:
    """How often each entity is in an event, first and last."""
    return involves.join(events.select(F.col("id").alias("event_id"), "t"), "event_id").groupBy("entity_id").agg(F.count_distinct("event_id").alias("mentions"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def topics_overview(events: DataFrame, least: int = 1) -> DataFrame:
    return events.filter("topic_path IS NOT NULL").groupBy("topic_path").agg(F.count(F.lit(1)).alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).filter(F.col("events") >= least)


def time_slices(events: DataFrame, modes: dict[str, str]) -> DataFrame:
    """(granularity, slice, events): slices of several lengths from one pass. modes: name to truncation unit."""
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("granularity"), F.date_trunc(u, "t").alias("slice")) for n, u in modes.items())))
    return events.select("id", kinds.alias("k")).groupBy("k.granularity", "k.slice").agg(F.count(F.lit(1)).alias("events"))


#: Ranks are sought between approximate quantiles so far to both sides; their own error is a tenth of that. Of fewer values all are counted.
SLACK, ACCURACY, FEW_VALUES = 0.001, 10_000, 10_000


def _at_ranks(rows: DataFrame, keys: list[str], value: str, points: list[float], index: Callable[[float, Column], Column]) -> DataFrame:
    """(keys, point, i, low, high): the values at the whole ranks around i = index(point, n) of a key's n sorted values, exactly; nulls don't count.

    Approximate quantiles bracket each rank. Values below a bracket are only counted, those in it are counted by value, and
    just these are put in order, so no task orders a key's values."""
    v, cuts = F.col(value), [c for p in points for c in (max(p - SLACK, 0.0), min(p + SLACK, 1.0))]
    ends = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(value, cuts, ACCURACY).alias("_cuts")).filter("_n > 0")
    few = F.col("_n") < FEW_VALUES
    marks = [
        F.struct(
            F.lit(p).alias("point"), index(p, F.col("_n")).alias("i"),
            F.when(~few & F.lit(p > SLACK), F.col("_cuts")[2 * k]).alias("lo"), F.when(~few & F.lit(p < 1 - SLACK), F.col("_cuts")[2 * k + 1]).alias("hi"),
        )
        for k, p in enumerate(points)
    ]
    asked = ends.select(*keys, F.explode(F.array(*marks)).alias("_m")).select(*keys, "_m.*")
    met = rows.filter(v.isNotNull()).select(*keys, v.alias("_v")).join(asked, keys).filter("hi IS NULL OR _v <= hi")
    counted = met.groupBy(*keys, "point", "i", F.when(F.col("lo").isNull() | (F.col("_v") >= F.col("lo")), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, "point").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_c").over(order))
    least = lambda at: F.min(F.when(F.col("_upto") > at, F.col("_v")))
    return upto.groupBy(*keys, "point", "i").agg(least(F.floor("i")).alias("low"), least(F.ceil("i")).alias("high"))


def percentiles(rows: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Linearly interpolated percentiles; null where a key has no values."""
    found = _at_ranks(rows, keys, value, points, lambda p, n: p * (n - 1))
    between = F.col("low") + (F.col("high") - F.col("low")) * (F.col("i") - F.floor("i"))
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("point") == p, between)).alias(f"p{round(p * 100)}") for p in points))
    return rows.select(*keys).distinct().join(wide, keys, "left")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at index round(p * (n - 1)) of a key's sorted values."""
    return _at_ranks(rows, keys, value, [p], lambda q, n: F.rint(q * (n - 1))).select(*keys, F.col("low").alias("value"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(le, n): the first edge that isn't below a value; null for those beyond all."""
    le = F.lit(None).cast("double")
    for e in reversed(edges):
        le = F.when(F.col(value) <= e, float(e)).otherwise(le)
    return rows.groupBy(le.alias("le")).agg(F.count(F.lit(1)).alias("n"))


def coverage(events: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row: the share of events that have each thing, to four digits."""
    return events.agg(F.count(F.lit(1)).alias("events"), *(F.round(F.count_if(c) / F.count(F.lit(1)), 4).alias(n) for n, c in columns.items()))


def rule_hits(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(property, hits): texts that match each rule's pattern, in one pass."""
    counted = texts.agg(*(F.count_if(F.col("text").rlike(p)).alias(n) for n, p in rules.items()))
    return counted.unpivot([], list(rules), "property", "hits")


def usage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Token and cost sums: a missing total is prompt plus completion; cost stays null if none was seen."""
    total = F.coalesce(F.nullif("total_tokens", F.lit(0)), F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    return rows.groupBy(*keys).agg(F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.sum(total).alias("total_tokens"), F.sum("cost").alias("cost"))


def merged_ttl(ttl: Column) -> Column:
    """The least positive lifetime; zero (for ever) if all are that; null if there is none."""
    return F.when(F.count(ttl) > 0, F.coalesce(F.min(F.when(ttl > 0, ttl)), F.lit(0)))


#: Which forgetting policy wins when facts merge, first to last.
POLICIES = ("until_changed", "permanent", "temporary")


def merged_policy(policy: Column) -> Column:
    rank = F.lit(len(POLICIES))
    for i, p in enumerate(POLICIES):
        rank = F.when(policy == p, i).otherwise(rank)
    return F.min_by(policy, rank)


def clip_summary(hits: DataFrame, k: int) -> DataFrame:
    """Per clip: span, the first k texts in order, how long. Tasks send k texts of a clip, however many it has."""
    first = hits.withColumn("_k", F.row_number().over(Window.partitionBy("clip").orderBy("t", "id"))).filter(F.col("_k") <= k)
    texts = first.groupBy("clip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda x: x["text"]), " | ").alias("summary"))
    return hits.groupBy("clip").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("hits")).join(texts, "clip")


def build_session_graph(turns: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """Dialogue turns (session_id, idx, speaker, text) as nodes and edges of the typed graph.

    mentions: (session_id, idx, entity). Every table is a projection of the turns; nothing is collected."""
    key = lambda *p: F.concat_ws("|", *p)
    sid, uid = F.sha1(key(F.lit("segment"), F.col("session_id").cast("string"))), F.sha1(key(F.lit("utterance"), F.col("session_id").cast("string"), F.col("idx").cast("string")))
    u = turns.select(uid.alias("id"), sid.alias("segment_id"), F.col("session_id"), "idx", F.initcap(F.btrim("speaker")).alias("speaker"), F.col("text").alias("raw_text"))
    segments = turns.groupBy("session_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("turns")).withColumn("id", sid)
    speakers = u.select(F.sha1(key(F.lit("entity"), F.lower("speaker"))).alias("id"), F.col("speaker").alias("name")).distinct()
    edge = lambda df, a, b, rel: df.select(a.alias("src_id"), b.alias("dst_id"), F.lit(rel).alias("rel_type"))
    w = Window.partitionBy("session_id").orderBy("idx")
    following = u.select("session_id", "idx", "id", F.lead("id").over(w).alias("next")).filter("next IS NOT NULL")
    named = mentions.select(uid.alias("utterance_id"), F.sha1(key(F.lit("entity"), F.lower("entity"))).alias("entity_id"), "entity").distinct()
    edges = edge(u, F.col("segment_id"), F.col("id"), "CONTAINS").unionByName(edge(u, F.col("id"), F.sha1(key(F.lit("entity"), F.lower("speaker"))), "SPOKEN_BY"))
    edges = edges.unionByName(edge(following, F.col("id"), F.col("next"), "NEXT_EVENT")).unionByName(edge(named, F.col("utterance_id"), F.col("entity_id"), "MENTIONS"))
    entities = speakers.unionByName(named.select(F.col("entity_id").alias("id"), F.col("entity").alias("name"))).dropDuplicates(["id"])
    return {"utterance": u, "media_segment": segments, "entity": entities, "edge": edges}
