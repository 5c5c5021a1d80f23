"""Dialogues as a typed graph, and what the graph knows of an event.

A session is a media segment and a time slice; its turns are utterances; events rest on some of its turns, facts on events
and turns. Every relation is a projection or an equi-join of the given tables, and ids are made from keys, so no
table is looked up to name a node, and the same rows give the same ids.

event_bundle() goes the other way: all that is one or two edges from an event. Each branch gives (event, item) rows; one
aggregate over their union makes the lists, so branches never multiply each other and nothing is joined after it.

Cases: rows without a session or number are dropped; repeated rows give an edge once; a participant's name is squeezed and
compared in lower case; an event of turns that aren't there is supported by none of them; lists are in order of ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from . import intervals

EDGE = ["src_id", "dst_id", "rel_type", "src_type", "dst_type"]
#: Branches of a bundle.
BRANCHES = ["segments", "entities", "places", "evidences", "utterances", "speakers", "voices", "slices", "knowledge", "next", "causes"]


def node_id(label: str, *parts: str | Column) -> Column:
    return F.concat_ws("|", F.lit(label), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))


def person_id(name: Column) -> Column:
    return F.concat(F.lit("entity|"), F.lower(squeeze(name)))


def _edge(rows: DataFrame, a: Column, b: Column, rel: str, kinds: tuple[str, str]) -> DataFrame:
    return rows.select(a.alias("src_id"), b.alias("dst_id"), F.lit(rel).alias("rel_type"), F.lit(kinds[0]).alias("src_type"), F.lit(kinds[1]).alias("dst_type"))


def dialog_edges(turns: DataFrame, events: DataFrame, facts: DataFrame, voices: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """The edges of sessions' graphs: src_id, dst_id, rel_type, src_type, dst_type.

    turns: session_id, idx, speaker. events: session_id, n, turn_idx (array), participants (array of names), place (or null). facts: session_id, k, events (array of n), turn_idx
    (array), speaker, about (array of names). voices: session_id, idx, evidence_id of an utterance. frames: session_id, n, evidence_id of an event."""
    t = turns.filter("session_id IS NOT NULL AND idx IS NOT NULL").select("session_id", "idx", "speaker")
    e = events.filter("session_id IS NOT NULL AND n IS NOT NULL")
    f = facts.filter("session_id IS NOT NULL AND k IS NOT NULL")
    seg, ts, utt, ev, fact = node_id("segment", "session_id"), node_id("slice", "session_id"), node_id("utterance", "session_id", "idx"), node_id("event", "session_id", "n"), node_id("fact", "session_id", "k")
    named = F.coalesce(squeeze(F.col("name")) != "", F.lit(False))
    people = e.select("session_id", "n", F.explode("participants").alias("name")).filter(named)
    # an event's turns as they are there, with who spoke
    own = e.select("session_id", "n", F.explode("turn_idx").alias("idx")).join(t, ["session_id", "idx"])
    spoke = t.withColumn("name", F.col("speaker")).filter(named)
    order = Window.partitionBy("session_id").orderBy("n")
    following = e.select("session_id", "n").distinct().withColumn("after", F.lead("n").over(order)).filter("after IS NOT NULL")
    parts = [
        _edge(t, seg, utt, "CONTAINS_EVIDENCE", ("media_segment", "utterance")), _edge(t, ts, utt, "TEMPORALLY_CONTAINS", ("time_slice", "utterance")), _edge(spoke, utt, person_id(F.col("name")), "SPOKEN_BY", ("utterance", "entity")),
        _edge(t, ts, seg, "COVERS_SEGMENT", ("time_slice", "media_segment")), _edge(e, ts, ev, "COVERS_EVENT", ("time_slice", "event")), _edge(e, ev, ts, "OCCURS_AT", ("event", "time_slice")), _edge(e, ev, seg, "SUMMARIZES", ("event", "media_segment")),
        _edge(e.filter("place IS NOT NULL"), ev, node_id("place", "place"), "OCCURS_AT", ("event", "place")), _edge(own, ev, utt, "SUPPORTED_BY", ("event", "utterance")), _edge(people, ev, person_id(F.col("name")), "INVOLVES", ("event", "entity")),
        _edge(own.withColumn("name", F.col("speaker")).filter(named), ev, person_id(F.col("name")), "INVOLVES", ("event", "entity")), _edge(following, ev, node_id("event", "session_id", "after"), "NEXT_EVENT", ("event", "event")),
        _edge(f, ts, fact, "CONTAINS", ("time_slice", "knowledge")), _edge(f.select("session_id", "k", F.explode("events").alias("n")), fact, ev, "DERIVED_FROM", ("knowledge", "event")),
        _edge(f.select("session_id", "k", F.explode("turn_idx").alias("idx")).join(t, ["session_id", "idx"], "left_semi"), fact, utt, "SUPPORTED_BY", ("knowledge", "utterance")),
        _edge(f.withColumn("name", F.col("speaker")).filter(named), fact, person_id(F.col("name")), "STATED_BY", ("knowledge", "entity")),
        _edge(f.select("session_id", "k", F.explode("about").alias("name")).filter(named), fact, person_id(F.col("name")), "MENTIONS", ("knowledge", "entity")),
    ]
    if voices is not None:
        parts.append(_edge(voices, utt, node_id("evidence", "evidence_id"), "SUPPORTED_BY", ("utterance", "evidence")))
    if frames is not None:
        parts.append(_edge(frames, ev, node_id("evidence", "evidence_id"), "SUPPORTED_BY", ("event", "evidence")))
    return reduce(DataFrame.unionByName, parts).distinct()


def media_edges(windows: DataFrame, tracks: DataFrame, utterances: DataFrame, width: float = 60.0) -> DataFrame:
    """The edges of media sources' graphs. A window is a segment, a slice and an event; tracks are evidence of an entity; what overlaps a window in time belongs to it.

    windows: source_id, window, start, end. tracks: source_id, track, entity (or null), start, end. utterances: source_id, n, start, end, track (of its speaker, or null). Overlaps are equi-joins on
    time buckets of `width` seconds, so a source isn't paired with itself."""
    seg, ts, ev = (node_id(k, "source_id", "window") for k in ("segment", "slice", "event"))
    evd, utt, who = node_id("evidence", "source_id", "track"), node_id("utterance", "source_id", "n"), F.concat(F.lit("entity|"), F.col("entity").cast("string"))
    w = windows.select("source_id", "window", "start", "end").distinct()
    a = w.select("source_id", "window", F.col("start").cast("double").alias("a_start"), F.col("end").cast("double").alias("a_end"))
    over = lambda rows, *c: intervals.overlap_join(a, rows.select("source_id", *c, F.col("start").cast("double").alias("b_start"), F.col("end").cast("double").alias("b_end")), width, ["source_id"])
    seen, said = over(tracks, "track", "entity"), over(utterances, "n")
    order = Window.partitionBy("source_id").orderBy("start", "window")
    nexts = w.withColumn("after", F.lead("window").over(order)).filter("after IS NOT NULL")
    spoke = utterances.filter("track IS NOT NULL").select("source_id", "n", "track").join(tracks.select("source_id", "track", "entity").distinct(), ["source_id", "track"])
    parts = [
        _edge(w, ev, seg, "SUMMARIZES", ("event", "media_segment")), _edge(w, ts, seg, "COVERS_SEGMENT", ("time_slice", "media_segment")), _edge(w, ts, ev, "COVERS_EVENT", ("time_slice", "event")),
        _edge(nexts, seg, node_id("segment", "source_id", "after"), "NEXT_SEGMENT", ("media_segment", "media_segment")), _edge(nexts, ev, node_id("event", "source_id", "after"), "NEXT_EVENT", ("event", "event")),
        _edge(seen, seg, evd, "CONTAINS_EVIDENCE", ("media_segment", "evidence")), _edge(seen, ev, evd, "SUPPORTED_BY", ("event", "evidence")), _edge(seen.filter("entity IS NOT NULL"), ev, who, "INVOLVES", ("event", "entity")),
        _edge(tracks.filter("entity IS NOT NULL"), evd, who, "BELONGS_TO_ENTITY", ("evidence", "entity")), _edge(said, ev, utt, "SUPPORTED_BY", ("event", "utterance")), _edge(spoke, utt, evd, "SUPPORTED_BY", ("utterance", "evidence")),
        _edge(spoke.filter("entity IS NOT NULL"), utt, who, "SPOKEN_BY", ("utterance", "entity")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def event_bundle(edges: DataFrame, events: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Events (id) with a list of ids for each of BRANCHES, from typed edges; entities and utterances are also those of what is known of the event.

    hidden (id): nodes that are expired or not published; nothing is found on or through them."""
    e = edges.select(*EDGE)
    if hidden is not None:
        off = hidden.select("id")
        e = e.join(off, F.col("src_id") == F.col("id"), "left_anti").join(off, F.col("dst_id") == F.col("id"), "left_anti")
    of = lambda rel, a, b: e.filter((F.col("rel_type") == rel) & (F.col("src_type") == a) & (F.col("dst_type") == b))
    out = lambda rel, kind, branch: of(rel, "event", kind).select(F.col("src_id").alias("event"), F.lit(branch).alias("branch"), F.col("dst_id").alias("item"))
    into = lambda rel, kind, branch: of(rel, kind, "event").select(F.col("dst_id").alias("event"), F.lit(branch).alias("branch"), F.col("src_id").alias("item"))
    known, said = into("DERIVED_FROM", "knowledge", "knowledge"), out("SUPPORTED_BY", "utterance", "utterances")
    beyond = lambda rows, rel, a, b, branch: rows.select("event", F.col("item").alias("src_id")).join(of(rel, a, b).select("src_id", "dst_id"), "src_id").select("event", F.lit(branch).alias("branch"), F.col("dst_id").alias("item"))
    rows = [
        out("SUMMARIZES", "media_segment", "segments"), out("INVOLVES", "entity", "entities"), out("OCCURS_AT", "place", "places"), out("SUPPORTED_BY", "evidence", "evidences"), said, into("COVERS_EVENT", "time_slice", "slices"), known,
        out("NEXT_EVENT", "event", "next"), out("CAUSES", "event", "causes"), beyond(said, "SPOKEN_BY", "utterance", "entity", "speakers"), beyond(said, "SUPPORTED_BY", "utterance", "evidence", "voices"),
        beyond(known, "STATED_BY", "knowledge", "entity", "entities"), beyond(known, "SUPPORTED_BY", "knowledge", "utterance", "utterances"),
    ]
    ids = events.select("id").distinct()
    found = reduce(DataFrame.unionByName, rows).join(ids.withColumnRenamed("id", "event"), "event", "left_semi")
    lists = found.groupBy(F.col("event").alias("id")).agg(*(F.sort_array(F.collect_set(F.when(F.col("branch") == b, F.col("item")))).alias(b) for b in BRANCHES))
    none = F.array().cast("array<string>")
    return ids.join(lists, "id", "left").select("id", *(F.coalesce(b, none).alias(b) for b in BRANCHES))


def choose_events(bundles: DataFrame, segment: str | None = None, entity: str | None = None, place: str | None = None, relation: str | None = None) -> DataFrame:
    """Bundles whose lists have what is asked for; relation: NEXT_EVENT or CAUSES."""
    wanted = [("segments", segment), ("entities", entity), ("places", place)]
    for name, v in wanted:
        bundles = bundles.filter(F.array_contains(name, v)) if v is not None else bundles
    return bundles if relation is None else bundles.filter(F.size({"NEXT_EVENT": "next", "CAUSES": "causes"}[relation]) > 0)
