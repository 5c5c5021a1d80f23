"""Predicates of the memory model, as Columns that reach the scan, and filters that look at a whole result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources of internal indexes, hidden unless one of them is asked for.
INTERNAL_SOURCES = ("tkg_dialog_utterance_index_v1", "tkg_dialog_event_index_v1")


def visible(as_of: Column, expires: str = "expires_at", published: str = "published") -> Column:
    """Not expired and not withdrawn."""
    return (F.col(expires).isNull() | (F.col(expires) > as_of)) & F.coalesce(F.col(published), F.lit(True))


def published_is(flag: bool | None, column: str = "published") -> Column:
    """True: all but explicit false; False: only explicit false; None: everything."""
    if flag is None:
        return F.lit(True)
    return F.coalesce(F.col(column), F.lit(True)) if flag else F.coalesce(~F.col(column), F.lit(False))


def users_match(wanted: list[str], mode: str = "any", column: str = "user_id") -> Column:
    want, have = F.array(*map(F.lit, wanted)), F.coalesce(F.col(column), F.array().cast("array<string>"))
    if mode == "all":
        return F.size(F.array_except(want, have)) == 0
    return F.arrays_overlap(have, want)


def in_range(start: Column | None, end: Column | None, *columns: str) -> Column:
    """Bounds included, on the first of the columns that isn't null; rows with none of them drop out when a bound is given."""
    t = F.coalesce(*map(F.col, columns))
    out = F.lit(True)
    if start is not None:
        out = out & (t >= start)
    if end is not None:
        out = out & (t <= end)
    return F.coalesce(out, F.lit(False))


def contains_text(query: str, *columns: str) -> Column:
    """Any of the columns has the query, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(query))), F.lit(False))
    return out


def any_of(wanted: list[str], column: str) -> Column:
    return F.arrays_overlap(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(*map(F.lit, wanted)))


def topic_prefix(prefix: str, column: str = "topic_path") -> Column:
    return F.coalesce(F.col(column).startswith(prefix), F.lit(False))


def external(column: str = "source", asked: list[str] | None = None) -> Column:
    if set(asked or []) & set(INTERNAL_SOURCES):
        return F.lit(True)
    return ~F.coalesce(F.col(column).isin(*INTERNAL_SOURCES), F.lit(False))


@dataclass(frozen=True)
class Filters:
    """Conditions that must all hold; a missing one doesn't filter. Lists of one condition are alternatives."""

    tenant_id: str | None = None
    published: bool | None = None
    modality: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    source: list[str] = field(default_factory=list)
    users: list[str] = field(default_factory=list)
    user_match: str = "any"
    memory_domain: str | None = None
    run_id: str | None = None
    memory_scope: str | None = None
    entities: list[str] = field(default_factory=list)
    topic_prefix: str | None = None
    start: Column | None = None
    end: Column | None = None

    def column(self) -> Column:
        out = published_is(self.published)
        for name in ("tenant_id", "memory_domain", "run_id", "memory_scope"):
            if (v := getattr(self, name)) is not None:
                out = out & (F.col(name) == v)
        if self.modality:  # structured entries count as text
            wanted = [*self.modality, "structured"] if "text" in self.modality else self.modality
            out = out & F.col("modality").isin(*wanted)
        for name in ("kind", "source"):
            if v := getattr(self, name):
                out = out & F.col(name).isin(*v)
        if self.users:
            out = out & users_match(self.users, self.user_match)
        if self.entities:
            out = out & any_of(self.entities, "entities")
        if self.topic_prefix:
            out = out & topic_prefix(self.topic_prefix)
        if self.start is not None or self.end is not None:
            out = out & in_range(self.start, self.end, "timestamp", "created_at")
        return out


def ladder(rows: DataFrame, steps: list[Column]) -> DataFrame:
    """Rows of the first step that any row meets, with its number: a fallback from narrow to wide scopes."""
    rank = F.coalesce(*(F.when(c, i) for i, c in enumerate(steps)))
    tagged = rows.withColumn("scope_rank", rank).filter("scope_rank IS NOT NULL")
    best = tagged.agg(F.min("scope_rank").alias("best"))  # one row
    return tagged.join(F.broadcast(best), F.col("scope_rank") == F.col("best")).drop("best")


def at_least(rows: DataFrame, threshold: float, relax: bool, score: str = "score") -> DataFrame:
    """Rows with a sufficient score; or, if relaxed and there is none, all rows."""
    if not relax:
        return rows.filter(F.col(score) >= threshold)
    best = rows.agg(F.max(score).alias("_best"))
    return rows.join(F.broadcast(best), F.lit(True)).filter((F.col(score) >= threshold) | (F.col("_best") < threshold)).drop("_best")


def floor_named(rows: DataFrame, ids: list[str], key: str = "id", score: str = "score") -> DataFrame:
    """Only the named rows; a score of zero or less becomes one, as being named is a match."""
    return rows.filter(F.col(key).isin(*ids)).withColumn(score, F.when(F.col(score) <= 0, 1.0).otherwise(F.col(score)))


def strongest_edges(edges: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """At most k edges of each source and relation: by weight, else confidence, else zero; ties by target."""
    value = F.coalesce(*(F.col(c) for c in ("weight", "confidence") if c in edges.columns), F.lit(0.0))
    w = Window.partitionBy("src_id", "rel_type").orderBy(F.desc("_value"), "dst_id")
    kept = edges.withColumn("_value", value)
    if "confidence" in edges.columns:
        kept = kept.filter(F.coalesce("confidence", F.lit(1.0)) >= least)
    return kept.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank", "_value")


def event_policy(events: DataFrame, least: float, top_turns: int = 5) -> DataFrame:
    """Confident events, at most the first turns each, and a lifetime by how well they are supported."""
    ttl = F.when(F.col("evidence_status") == "mapped", F.lit(0.0)).when(F.col("evidence_status") == "weak", F.lit(30.0 * 86400)).otherwise(F.lit(7.0 * 86400))
    return events.filter(F.coalesce("event_confidence", F.lit(0.0)) >= least).withColumns({"source_turn_ids": F.slice("source_turn_ids", 1, top_turns), "ttl": ttl})


def contained(rows: DataFrame, start: float, end: float, a: str = "t_media_start", b: str = "t_media_end") -> DataFrame:
    return rows.filter((F.col(a) >= start) & (F.col(b) <= end))


def clean_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes of positive length, one of each rounded interval and modality, in order."""
    ok = scenes.filter("t_end_s > t_start_s")
    return ok.groupBy(F.round("t_start_s", 3).alias("a"), F.round("t_end_s", 3).alias("b"), "modality").agg(F.min_by(F.struct("t_start_s", "t_end_s"), F.struct("t_start_s", "t_end_s")).alias("s")).select("s.*", "modality")


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, rule) for each row that breaks one of the named rules."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))
