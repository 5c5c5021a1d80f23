"""Tracks, utterances and frames of media: association, alignment, stitching, clustering.

Stitching folds blocks of time. Matching and clustering are folds over a source's rows in pandas, grouped by source; sources
are clips, so a group is small, and no group meets another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import dropped, stored
from . import intervals
from .scoring import cosine


def associate(speakers: DataFrame, faces: DataFrame, least: float = 0.4, width: float = 5.0) -> DataFrame:
    """Speaker turns (source_id, speaker, a_start, a_end) with visual tracks (source_id, track, b_start, b_end): overlap of at least so many seconds, scored by how much of the turn it covers and how many turns meet the track."""
    pairs = intervals.overlap_join(speakers, faces, width, ["source_id"])
    o = intervals.overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    kept = pairs.withColumn("seconds", o).filter(F.col("seconds") >= least).withColumn("length", F.col("a_end") - F.col("a_start"))
    own = kept.groupBy("source_id", "speaker", "track").agg(F.sum("seconds").alias("seconds"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("turns"))
    most = F.max("turns").over(Window.partitionBy("source_id", "speaker"))
    return own.select("source_id", "speaker", "track", F.round("seconds", 6).alias("seconds"), F.round(0.75 * F.least(F.lit(1.0), F.col("seconds") / F.col("length")) + 0.25 * F.col("turns") / most, 6).alias("score"))


def confidence(time_score: Column, asd_score: Column) -> Column:
    """Face-voice confidence: without the speaking face's score at most 0.59, with it a fused value."""
    return F.when(asd_score.isNull(), F.least(F.lit(0.59), time_score)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 + 0.25 * time_score + 0.5 * asd_score)))


def match_once(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matches of a source: by verified, score and names, each side used once."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["verified", "score", "speaker", "track"], ascending=[False, False, True, True])
        left, right, keep = set(), set(), []
        for i, r in ordered.iterrows():
            if r.speaker not in left and r.track not in right:
                left.add(r.speaker)
                right.add(r.track)
                keep.append(i)
        return ordered.loc[keep, ["source_id", "speaker", "track", "score"]]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("source_id", "speaker", "track", "score"))
    return pairs.select("source_id", "speaker", "track", "score", "verified").groupBy("source_id").applyInPandas(fold, schema)


def _fold(rows: pd.DataFrame, entry: tuple | None, least: float, gap: float) -> tuple[list[list], tuple]:
    """Pieces [start, end, tracks, goes on] of rows in order of time, and (sum, n, end) of the last one; entry: that of the rows before."""
    total, n, last = entry if entry else (None, 0, None)
    pieces: list[list] = []
    for start, end, v in zip(rows["start"], rows["end"], rows["embedding"], strict=True):
        v = np.asarray(v, float)
        if total is not None:
            m = total / n
            norm = np.linalg.norm(m) * np.linalg.norm(v) if len(m) == len(v) else 0
            if start - last <= gap or (norm > 0 and float(m @ v) / norm >= least):
                last = max(last, end)
                if len(m) == len(v):
                    total, n = total + v, n + 1
                if pieces:
                    pieces[-1][1], pieces[-1][2] = max(pieces[-1][1], end), pieces[-1][2] + 1
                else:
                    pieces.append([start, end, 1, True])
                continue
        total, n, last = v, 1, end
        pieces.append([start, end, 1, False])
    return pieces, (total, n, last)


def stitch(tracks: DataFrame, least: float = 0.75, gap: float = 2.0, width: float = 600.0) -> DataFrame:
    """Tracklets of a seed in order of time, joined to the one being built if alike or close; its vector is the mean so far.

    A seed's time is cut into blocks of `width` seconds that are folded apart, each from the state that the block before it ends in. Blocks whose first
    state turns out to be another one are folded again, until none is: a block that begins a new tracklet anywhere mostly ends as it did, so few rounds
    are needed, and never more than blocks. Pieces of a tracklet in several blocks are then added up. A task holds a block's rows."""
    kind, label = tracks.schema["seed"].dataType.simpleString(), ["seed", "block"]
    rows = stored(tracks.select("seed", "track", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("block", F.floor(F.col("start") / width)), "tracklets")
    made = f"seed {kind}, block long, k int, start double, end double, tracks long, joins boolean, total array<double>, n int, last double, entry long"
    state = F.struct("total", "n", "last")

    def fold(key: tuple, own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        known = len(before) and before["total"][0] is not None
        entry = (np.asarray(before["total"][0], float), int(before["n"][0]), float(before["last"][0])) if known else None
        pieces, (total, n, last) = _fold(own.sort_values(["start", "end", "track"]), entry, least, gap)
        mark = before["entry"][0] if len(before) else 0
        return pd.DataFrame([(*key, k, a, b, c, j, total if k == len(pieces) - 1 else None, n, last, mark) for k, (a, b, c, j) in enumerate(pieces)], columns=[*label, "k", "start", "end", "tracks", "joins", "total", "n", "last", "entry"])

    def folded(some: DataFrame, entries: DataFrame) -> DataFrame:
        return stored(some.groupBy(*label).cogroup(entries.groupBy(*label)).applyInPandas(fold, made), "pieces")

    nothing = rows.select(*label).distinct().select(*label, F.lit(None).cast("array<double>").alias("total"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("long").alias("entry"))
    pieces = folded(rows, nothing)
    while True:
        ends = pieces.groupBy(*label).agg(F.max_by(state, "k").alias("s"), F.max("entry").alias("entry"))
        before = ends.withColumn("b", F.lag("s").over(Window.partitionBy("seed").orderBy("block"))).withColumn("now", F.coalesce(F.xxhash64("b.total", "b.n", "b.last"), F.lit(0)))
        wrong = stored(before.filter("b IS NOT NULL AND now <> entry").select(*label, "b.total", "b.n", "b.last", F.col("now").alias("entry")), "entries")
        if wrong.isEmpty():
            break
        again = folded(rows.join(wrong.select(*label), label, "left_semi"), wrong)
        after = stored(pieces.join(wrong.select(*label), label, "left_anti").unionByName(again), "pieces")
        dropped(pieces, again, wrong)
        pieces = after
    order = Window.partitionBy("seed").orderBy("block", "k")
    whole = pieces.withColumn("part", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order) - 1)
    return whole.groupBy("seed", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("tracks").alias("tracks")).select("seed", "part", "start", "end", "tracks")


def similar_faces(detections: DataFrame, least: float, detection: float = 0.8, quality: float = 20.0) -> DataFrame:
    """Clusters of a source's good detections: connected by cosines of at least so much; others are cluster -1."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        good = np.flatnonzero((pdf.detection_confidence >= detection) & (pdf.quality_score >= quality))
        top = list(range(len(pdf)))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        if len(good):
            m = np.stack([np.asarray(pdf.embedding[i], float) for i in good])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            for i in range(len(good)):
                for j in np.flatnonzero(m[i + 1 :] @ m[i] >= least) + i + 1:
                    a, b = sorted((find(good[i]), find(good[j])))
                    top[b] = a
        mark = np.full(len(pdf), -1)
        mark[good] = [find(i) for i in good]
        return pd.DataFrame({"source_id": pdf.source_id, "id": pdf.id, "cluster": [int(pdf.id[c]) if c >= 0 else -1 for c in mark]})

    kinds = {f.name: f.dataType.simpleString() for f in detections.schema}
    return detections.groupBy("source_id").applyInPandas(fold, f"source_id {kinds['source_id']}, id {kinds['id']}, cluster long")


def align(turns: DataFrame, events: DataFrame, least: float = 0.35, k: int = 3) -> DataFrame:
    """For each event the k turns of its session that are alike and lie closest together; with fewer hits it is weak, with none unmapped.

    turns: session_id, idx, vector; events: session_id, event_id, vector. Pairs are made within sessions alone."""
    t = turns.select("session_id", "idx", F.col("vector").alias("tv"))
    hits = events.join(t, "session_id").withColumn("score", cosine(F.col("vector"), F.col("tv"))).filter(F.col("score") >= least).select("session_id", "event_id", "idx", "score")
    w = Window.partitionBy("session_id", "event_id").orderBy("idx")
    spans = hits.withColumn("far", F.lead("idx", k - 1).over(w))
    per = spans.groupBy("session_id", "event_id").agg(F.count(F.lit(1)).alias("hits"), F.min_by(F.struct(F.col("idx").alias("first"), F.col("far").alias("last")), F.when(F.col("far").isNotNull(), F.struct(F.col("far") - F.col("idx"), "idx"))).alias("s"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    status = F.when(F.col("hits") >= k, "mapped").when(F.col("hits") > 0, "weak").otherwise("unmapped")
    out = events.select("session_id", "event_id").join(per, ["session_id", "event_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select("session_id", "event_id", "hits", status.alias("status"), F.when(F.col("hits") >= k, F.col("s.first")).otherwise(F.col("low")).alias("first"), F.when(F.col("hits") >= k, F.col("s.last")).otherwise(F.col("high")).alias("last"))


def frame_times(clips: DataFrame, fps: Column, most: int) -> DataFrame:
    """(id, frame, at): evenly from the start, no further than the end. clips: id, start, end."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) * fps))).cast("int")
    f = clips.withColumn("frame", F.explode(F.sequence(F.lit(0), n - 1)))
    return f.select("id", "frame", F.round(F.least(F.col("start") + F.col("frame") / fps, F.col("end")), 3).alias("at"))


def speaker_tracks(turns: DataFrame, speech: DataFrame, width: float = 10.0) -> DataFrame:
    """Turns (source_id, speaker, a_start, a_end) with recognised speech (b_start, b_end, text) clipped to them; a turn without any is '(audio)' of at least a second."""
    hit = intervals.overlap_join(turns, speech, width, ["source_id"]).select("source_id", "speaker", F.col("a_start").alias("turn_start"), F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"), "text")
    rest = turns.join(hit.select("source_id", "speaker", F.col("turn_start").alias("a_start")).distinct(), ["source_id", "speaker", "a_start"], "left_anti")
    silent = rest.select("source_id", "speaker", F.col("a_start").alias("turn_start"), F.col("a_start").alias("start"), F.greatest("a_end", F.col("a_start") + 1).alias("end"), F.lit("(audio)").alias("text"))
    return hit.unionByName(silent)


def window_payload(windows: DataFrame, items: DataFrame, width: float, most: int) -> DataFrame:
    """Per window (source_id, window, a_start, a_end) the first items (b_start, b_end, item) that touch it, bounds included."""
    hits = intervals.overlap_join(windows, items, width, ["source_id"], bounds="closed")
    w = Window.partitionBy("source_id", "window").orderBy("b_start", "item")
    kept = hits.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    return kept.groupBy("source_id", "window").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))
