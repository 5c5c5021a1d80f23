"""Whole searches as one plan each: routes of a dialog fused into ranked evidence, and a hybrid search over entries.

Scores are rounded to nine digits before rows are ordered by them, so the order doesn't depend on the order in which parts were added."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import seconds
from . import graph as G
from . import scoring as O
from .nearest import nearest

#: The five routes, and what a route, a signal and the blend of rank and score count.
ROUTES = ["event_vec", "vec", "knowledge", "entity", "time"]
WEIGHTS = {"event_vec": 0.6, "vec": 0.6, "knowledge": 0.9, "entity": 0.15, "time": 0.15, "match": 1.0, "recency": 0.0, "signal": 0.0, "score_blend_alpha": 0.7}
#: Names under which routes and signals can be switched off.
ROUTE_NAMES = {"event": "event_vec", "evidence": "vec", "knowledge": "knowledge", "entity": "entity", "time": "time"}
SIGNAL_NAMES = [*ROUTE_NAMES, "timestamp", "recency", "graph_signal"]


@dataclass(frozen=True)
class Ablation:
    """What a search does without: `routes` give no candidates, and `signals` count nothing (a route's signal is its weight)."""

    routes: list[str] = field(default_factory=list)
    signals: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if unknown := sorted({*self.routes} - {*ROUTE_NAMES} | {*self.signals} - {*SIGNAL_NAMES}):
            raise ValueError(f"neither a route nor a signal: {unknown}")

    def weights(self, given: dict[str, float]) -> dict[str, float]:
        off = {ROUTE_NAMES[s] for s in self.signals if s in ROUTE_NAMES}
        if {"timestamp", "recency"} & {*self.signals}:
            off.add("recency")
        if "graph_signal" in self.signals:
            off.add("signal")
        return {k: 0.0 if k in off else v for k, v in (WEIGHTS | given).items()}


@dataclass(frozen=True)
class Rerank:
    """How outside scores of the first `pool` candidates count: alone, not at all, or beside the search's own ("blend")."""

    mode: str = "rerank_only"
    pool: int = 80
    base: float = 0.25
    model: float = 0.75

    def __post_init__(self) -> None:
        if self.mode not in ("rerank_only", "base_only", "blend"):
            raise ValueError(f"no such mode: {self.mode}")

    def score(self, own: Column, other: Column) -> Column:
        return {"rerank_only": other, "base_only": own, "blend": self.base * own + self.model * other}[self.mode]


def _place(order: list[Column], by: str = "query_id") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def _exact(score: Column) -> Column:
    return F.round(score, 9)


def reranked(candidates: DataFrame, outside: DataFrame, how: Rerank) -> DataFrame:
    """Candidates (query_id, id, preselect) with `head` (1: of the first `pool`) and `selection`, from outside scores (query_id, id, model).

    Both scores of a head are brought to [0, 1]; if all outside scores are equal, their order counts, and a candidate without one is last.
    Behind the head the search's own score stays."""
    all_of, head_of = Window.partitionBy("query_id"), Window.partitionBy("query_id", "head")
    c = candidates.join(outside.groupBy("query_id", "id").agg(F.max("model").alias("model")), ["query_id", "id"], "left")
    c = c.withColumn("head", (F.row_number().over(all_of.orderBy(F.desc("preselect"), "id")) <= how.pool).cast("int"))
    n, scored = F.count(F.lit(1)).over(head_of), F.count("model").over(head_of)
    at = F.when(F.col("model").isNull(), n).otherwise(F.row_number().over(head_of.orderBy(F.desc_nulls_last("model"), "id")))
    by_rank = F.when(n == 1, 1.0).otherwise(1 - (at - 1) / (n - 1))
    flat = (scored == 0) | (F.round(F.max("model").over(head_of), 8) == F.round(F.min("model").over(head_of), 8))
    other = F.when(flat | F.col("model").isNull(), by_rank).otherwise(O.minmax_fused(F.col("model"), head_of))
    picked = _exact(how.score(O.minmax_fused(F.col("preselect"), head_of), other))
    return c.withColumn("selection", F.when(F.col("head") == 1, picked).otherwise(F.col("preselect"))).drop("model")


def dialog_search(
    hits: DataFrame, questions: DataFrame, entries: DataFrame, k: int, weights: dict[str, float] | None = None, without: Ablation = Ablation(), aliases: DataFrame | None = None,
    support: DataFrame | None = None, now: Column | None = None, outside: DataFrame | None = None, how: Rerank = Rerank(), keep: int = 50, seeds: int = 15, rank_constant: int = 60,
) -> DataFrame:
    """The k best entries for each question: (query_id, id, rank, final, selection, preselect, fidelity, signal, routes).

    hits (query_id, id, route, score) of the five routes come under one id each (aliases: alias, canonical), the best of a route counts.
    Fused support, fidelity of the text to the question and recency make the score by which `keep` candidates stay, after outside scores
    (query_id, id, model) if there are such; of these the first `seeds` get what is known of them (support: id, utterances, knowledge,
    entities, slices, as counts) as a signal. questions: query_id, question. entries: id, text, and t if `now` is given.

    A hit of an unknown entry has an empty text; one of an unknown question, or of no route of the five, or with a score of zero or less,
    or null ids, is dropped. Repeated questions or entries with one id must not occur. Candidates are what routes give, so the join takes entries
    by the ids of hits; texts of others don't leave the scan where candidates are small enough for a filter."""
    w = without.weights(weights or {})
    off = {ROUTE_NAMES[r] for r in without.routes}
    own = hits.filter(F.col("route").isin(*[r for r in ROUTES if r not in off]) & F.col("id").isNotNull()) if off != {*ROUTES} else hits.filter(F.lit(False))
    if aliases is not None:
        own = own.join(aliases, F.col("id") == F.col("alias"), "left").withColumn("id", F.coalesce("canonical", "id"))
    own = own.groupBy("query_id", "id", "route").agg(F.max("score").alias("score"))
    pool = O.fuse(own, ["query_id"], {r: w[r] for r in ROUTES}, rank_constant, w["score_blend_alpha"])
    c = pool.join(questions.select("query_id", O.profile(F.col("question")).alias("_asked")), "query_id").join(entries, "id", "left")
    fresh = O.recency(seconds(now, F.col("t"))) if now is not None else F.lit(0.0)
    c = c.withColumn("fidelity", O.fidelity(F.col("_asked"), F.col("text")))
    c = c.select("query_id", "id", "routes", "fidelity", _exact(F.col("support") + w["match"] * F.col("fidelity") + w["recency"] * fresh).alias("preselect"))
    c = c.withColumns({"head": F.lit(0), "selection": F.col("preselect")}) if outside is None else reranked(c, outside, how)
    c = c.withColumn("_at", _place([F.desc("head"), F.desc("selection"), F.col("id")])).filter(F.col("_at") <= keep)
    signal = F.lit(0.0)
    if support is not None and w["signal"]:
        c = c.join(support.select("id", "utterances", "knowledge", "entities", "slices"), "id", "left")
        timed = F.lit(0) if {"time", "timestamp"} & {*without.signals} else F.col("slices")
        parts = [F.coalesce(x, F.lit(0)) for x in (F.col("utterances"), F.col("knowledge"), F.col("entities"), timed)]
        signal = F.when(F.col("_at") <= seeds, O.explain_signal(*parts)).otherwise(0.0)
    c = c.withColumn("signal", signal).withColumn("final", _exact(F.col("selection") + w["signal"] * F.col("signal")))
    c = c.withColumn("rank", _place([F.desc("final"), F.col("_at")])).filter(F.col("rank") <= k)
    return c.select("query_id", "id", "rank", "final", "selection", "preselect", "fidelity", "signal", "routes")


def dialog_routes(
    questions: DataFrame, events: DataFrame, utterances: DataFrame, knowledge: DataFrame, edges: DataFrame, k: int = 50, least: float | None = None, without: Ablation = Ablation(), bucket: str = "DAY",
) -> DataFrame:
    """Hits (query_id, id, route, score) of the five routes, each run over the graph and cut to the k best events of a question.

    questions: query_id, qvec, people (array of entity ids), t_from and t_to (null for any time). events: id, vector, t. utterances, knowledge: id, vector. edges: src_id, dst_id, rel_type.
    event_vec: events near the question. vec: events that near utterances support. knowledge: events that near facts derive from. entity: events that involve people of
    the question, by their share. time: events within its time, by how near to the middle; they meet in time buckets. Vectors meet questions in cells."""
    off, parts = {ROUTE_NAMES[r] for r in without.routes}, []

    def cut(rows: DataFrame, route: str) -> None:
        best = rows.groupBy("query_id", "id").agg(F.max(_exact(F.col("score"))).alias("score"))
        parts.append(O.top(best, ["query_id"], k).select("query_id", "id", F.lit(route).alias("route"), "score"))

    def near(rows: DataFrame, most: int) -> DataFrame:
        return O.cosine_top(questions.select("query_id", "qvec"), rows.filter("vector IS NOT NULL").select("id", "vector"), most, least).select("query_id", F.col("id").alias("hit"), "score")

    to = lambda rel, a, b: edges.filter(F.col("rel_type") == rel).select(F.col(a).alias("hit"), F.col(b).alias("id"))
    if "event_vec" not in off:
        cut(near(events, k).withColumnRenamed("hit", "id"), "event_vec")
    if "vec" not in off:
        cut(near(utterances, k).join(to("SUPPORTED_BY", "dst_id", "src_id"), "hit").join(events.select("id"), "id", "left_semi"), "vec")
    if "knowledge" not in off:
        cut(near(knowledge, k).join(to("DERIVED_FROM", "src_id", "dst_id"), "hit"), "knowledge")
    if "entity" not in off:
        # questions of the same people have the same events
        asked = questions.select("query_id", F.array_sort(F.array_distinct("people")).alias("people"))
        people = asked.select("people").distinct().select("people", F.explode("people").alias("hit"), F.size("people").alias("n"))
        met = people.join(to("INVOLVES", "dst_id", "src_id").distinct(), "hit").groupBy("people", "id", "n").agg(F.count(F.lit(1)).alias("c"))
        best = O.top(met.select("people", "id", _exact(F.col("c") / F.col("n")).alias("score")), ["people"], k).drop("rank")
        cut(asked.join(best, "people").select("query_id", "id", "score"), "entity")
    if "time" not in off:
        first, last = F.date_trunc(bucket, "t_from"), F.date_trunc(bucket, "t_to")
        asked = questions.filter("t_from <= t_to").select("query_id", "t_from", "t_to", F.explode(F.sequence(first, last, F.expr(f"INTERVAL 1 {bucket}"))).alias("slot"))
        at = events.filter("t IS NOT NULL").select("id", "t", F.date_trunc(bucket, "t").alias("slot")).join(asked, "slot").filter("t BETWEEN t_from AND t_to")
        half = seconds(F.col("t_to"), F.col("t_from")) / 2
        cut(at.select("query_id", "id", F.when(half > 0, 1 - 0.5 * F.abs(seconds(F.col("t"), F.col("t_from")) - half) / half).otherwise(1.0).alias("score")), "time")
    return reduce(DataFrame.unionByName, parts) if parts else questions.select("query_id", F.lit(None).cast("string").alias("id"), F.lit("").alias("route"), F.lit(0.0).alias("score")).limit(0)


def scoped(scored: DataFrame, queries: DataFrame, scopes: list[list[str]], k: int, threshold: float | None = None, relax: bool = False) -> DataFrame:
    """For each query the k best rows of its first scope with a row: (query_id, id, score, scope).

    A scope is a list of columns in which row (name) and query (q_name) agree; scored has query_id, id, score and both. Rows below the threshold
    don't count; if relaxed, they do for queries for which no row reaches it."""
    rank = F.coalesce(*(F.when(_agree(s), i) for i, s in enumerate(scopes)))
    c = scored.withColumn("scope", rank).filter("scope IS NOT NULL")
    ok = F.lit(True) if threshold is None else F.col("score") >= threshold
    c = (c if relax else c.filter(ok)).withColumn("_low", F.when(ok, 0).otherwise(1))
    best = c.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_low", "scope", F.desc("score"), "id"))).filter(F.col("_n") <= k)  # tasks send k rows a query
    first = F.min(F.struct("_low", "scope")).over(Window.partitionBy("query_id"))
    return best.withColumn("_first", first).filter("_low = _first._low AND scope = _first.scope").select("query_id", "id", "score", "scope")


def _agree(scope: list[str]) -> Column:
    out = F.lit(True)
    for name in scope:
        out = out & (F.col(name) == F.col(f"q_{name}"))
    return out


def hybrid_search(
    queries: DataFrame, entries: DataFrame, edges: DataFrame, k: int, scopes: list[list[str]], now: Column, weights: O.HybridWeights = O.HybridWeights(), threshold: float | None = None,
    relax: bool = False, lexical: int = 50, hops: int = 2, cap: int = 25,
) -> DataFrame:
    """The k best entries for each query: (query_id, id, rank, score, v, b, g, rec, scope).

    queries: query_id, qvec, text and for each column of a scope q_<column>; entries: id, vector, text, t and these columns; edges: src_id, dst_id,
    rel_type, weight between ids. The k nearest vectors of the first scope that has any, and the `lexical` best texts of that scope, make one pool (a query
    that no scope serves has none); a vector's score is brought to [0, 1] among the nearest, a text's (its logarithm) to parts of the best's. Neighbours of a candidate within some hops add their weights,
    and age takes off. An entry without a vector has a cosine of 0, and is found by its words. Word statistics are those of all entries. Queries meet vectors in cells."""
    names = list(dict.fromkeys(x for s in scopes for x in s))
    asked, own = queries.select("query_id", "qvec", *(f"q_{x}" for x in names)), entries.select("id", "vector", *names)
    # the k nearest of each scope: where it is a query's first with a row that counts, the narrower ones' rows don't count and are behind
    near = reduce(DataFrame.unionByName, [nearest(asked, own, k, s) for s in scopes]).withColumn("score", _exact(F.col("cos"))).drop("cos").distinct()
    dense = scoped(near, queries, scopes, k, threshold, relax)
    used = dense.groupBy("query_id").agg(F.min("scope").alias("scope"))
    # each different text is weighed once, and its best are cut once for what queries of a scope have in common
    said = F.coalesce("text", F.lit("")).alias("said")
    words = O.bm25(entries.select("id", "text"), queries.select(said).distinct().select(F.col("said").alias("query_id"), F.col("said").alias("text")))
    words = words.select(F.col("query_id").alias("said"), "id", _exact(F.col("score")).alias("b")).filter("b > 0")
    asking = queries.select("query_id", said, *(f"q_{x}" for x in names)).join(used, "query_id")
    asked = dense.select("query_id", "id", "scope").join(asking.select("query_id", "said"), "query_id").join(words, ["said", "id"]).select("query_id", "id", "b", "scope")
    placed = words.join(entries.select("id", *names), "id")
    for i, s in enumerate(scopes):
        best = O.top(placed, ["said", *s], lexical, "b").drop("rank")
        asked = asked.unionByName(asking.filter(F.col("scope") == i).join(best, "said").filter(_agree(s)).select("query_id", "id", "b", "scope"))
    hits = dense.select("query_id", "id", F.col("score").alias("v"), F.lit(None).cast("double").alias("b"), "scope").unionByName(asked.withColumn("v", F.lit(None).cast("double")))
    both = hits.groupBy("query_id", "id").agg(F.max("v").alias("v"), F.max("b").alias("b"), F.min("scope").alias("scope"))
    near = O.graph_score(G.expand(edges, both.select(F.col("id").alias("seed")).distinct(), hops, cap)).withColumnRenamed("seed", "id")
    c = both.join(near, "id", "left").join(entries.select("id", "t", *names), "id").join(queries.select("query_id", *(f"q_{x}" for x in names)), "query_id")
    w = Window.partitionBy("query_id")
    top_b = F.max(F.log1p("b")).over(w)
    c = c.withColumns({"v": F.coalesce(O.minmax(F.col("v"), w), F.lit(0.0)), "b": F.coalesce(F.log1p("b") / top_b, F.lit(0.0)), "g": F.coalesce("g", F.lit(0.0)), "rec": O.recency(seconds(now, F.col("t")))})
    boost = {x: F.coalesce(F.col(x) == F.col(f"q_{x}"), F.lit(False)) for x in ("user", "domain", "session") if x in names}
    c = c.withColumn("score", _exact(O.hybrid(weights, **boost)))
    return O.top(c, ["query_id"], k).select("query_id", "id", "rank", "score", "v", "b", "g", "rec", "scope")

