"""Profiles of entities and timelines of topics: all asked ones in one plan.

Each branch is cut to its k best rows of an entity before anything is joined, by a window whose limit is pushed below the shuffle, so
an entity with a third of all events is no more than k rows a task; counts are partial aggregates. Lists are structs in order.

Cases: an entity or topic that nothing is known of has counts of 0 and empty lists; repeated ids and edges count once; null times
come last; ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days after which a topic is paused, and after which it is over.
ONGOING_DAYS, PAUSED_DAYS = 14, 90


def _newest(rows: DataFrame, key: str, k: int, order: list[Column], item: Column, name: str) -> DataFrame:
    """(key, name): structs of the first k rows of each key."""
    best = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_k") <= k)
    return best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", item.alias("v")))), lambda x: x["v"]).alias(name))


def _with(out: DataFrame, branches: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), branches, out)


def _filled(rows: DataFrame, counts: list[str], lists: list[str]) -> DataFrame:
    none = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in lists}
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | none)


def entity_profiles(asked: DataFrame, edges: DataFrame, events: DataFrame, utterances: DataFrame, states: DataFrame, k: int = 5) -> DataFrame:
    """For entities (id): events, first_t, last_t, recent (id, t), related (id, events), quotes (id, text), facts, states (property, value).

    edges: src_id, dst_id, rel_type of INVOLVES (event to entity), SPOKEN_BY (utterance to entity) and STATED_BY (fact to entity). events: id, t. utterances: id, t, text. states: subject, property, value,
    valid_from, id; the latest of each property holds."""
    ids = asked.select("id").distinct()
    to = lambda rel: edges.filter(F.col("rel_type") == rel).select(F.col("src_id").alias("item"), F.col("dst_id").alias("id")).distinct()
    involved = to("INVOLVES").join(events.select(F.col("id").alias("item"), "t"), "item")
    own = involved.join(ids, "id", "left_semi")
    seen = own.groupBy("id").agg(F.count(F.lit(1)).alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    recent = _newest(own, "id", k, [F.col("t").desc_nulls_last(), F.col("item")], F.struct(F.col("item").alias("id"), "t"), "recent")
    # pairs are made for asked entities alone, and summed before they are ranked
    beside = own.select("id", "item").join(to("INVOLVES").withColumnRenamed("id", "other"), "item").filter("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("n"))
    related = _newest(beside, "id", k, [F.desc("n"), F.col("other")], F.struct(F.col("other").alias("id"), F.col("n").alias("events")), "related")
    said = to("SPOKEN_BY").join(ids, "id", "left_semi").join(utterances.select(F.col("id").alias("item"), "t", "text"), "item")
    quotes = _newest(said, "id", k, [F.col("t").desc_nulls_last(), F.col("item")], F.struct(F.col("item").alias("id"), "text"), "quotes")
    facts = to("STATED_BY").join(ids, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("facts"))
    now = states.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").groupBy(F.col("subject").alias("id"), "property").agg(F.max_by("value", F.struct("valid_from", "id")).alias("value"))
    holds = now.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("property", "value"))).alias("states"))
    return _filled(_with(ids, [seen, recent, related, quotes, facts, holds], "id"), ["events", "facts"], ["recent", "related", "quotes", "states"])


def topic_status(last_t: Column, now: Column) -> Column:
    days = F.datediff(now.cast("date"), last_t.cast("date"))
    return F.when(last_t.isNull(), "unknown").when(days <= ONGOING_DAYS, "ongoing").when(days <= PAUSED_DAYS, "paused").otherwise("over")


def topic_timelines(asked: DataFrame, events: DataFrame, edges: DataFrame, utterances: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """For topics (topic_path): events, first_t, last_t, status, timeline (id, t; the newest k in order of time), entities (id, events), quotes (id, text).

    events: id, t, topic_path; an event is of a topic if its path is that or lies below it. edges: src_id, dst_id, rel_type of INVOLVES and SUPPORTED_BY (event to utterance)."""
    ids = asked.select("topic_path").distinct()
    # an event's path and each of the paths above it
    steps = F.split("topic_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    own = events.filter("topic_path IS NOT NULL").select(F.col("id").alias("item"), "t", F.explode(above).alias("topic_path")).distinct().join(ids, "topic_path", "left_semi")
    seen = own.groupBy("topic_path").agg(F.count(F.lit(1)).alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    line = _newest(own, "topic_path", k, [F.col("t").desc_nulls_last(), F.col("item")], F.struct("t", F.col("item").alias("id")), "timeline")
    to = lambda rel, name: edges.filter(F.col("rel_type") == rel).select(F.col("src_id").alias("item"), F.col("dst_id").alias(name)).distinct()
    people = own.join(to("INVOLVES", "who"), "item").groupBy("topic_path", "who").agg(F.count(F.lit(1)).alias("n"))
    entities = _newest(people, "topic_path", k, [F.desc("n"), F.col("who")], F.struct(F.col("who").alias("id"), F.col("n").alias("events")), "entities")
    said = own.select("topic_path", "item").join(to("SUPPORTED_BY", "utterance"), "item").select("topic_path", "utterance").distinct().join(utterances.select(F.col("id").alias("utterance"), "t", "text"), "utterance")
    quotes = _newest(said, "topic_path", k, [F.col("t").desc_nulls_last(), F.col("utterance")], F.struct(F.col("utterance").alias("id"), "text"), "quotes")
    out = _filled(_with(ids, [seen, line, entities, quotes], "topic_path"), ["events"], ["timeline", "entities", "quotes"])
    return out.withColumns({"timeline": F.sort_array("timeline"), "status": topic_status(F.col("last_t"), now)})
