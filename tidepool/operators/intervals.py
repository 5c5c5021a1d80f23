"""Intervals: overlap joins by buckets, islands, windows, chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import small

#: Pairs of a partition, most of a piece of a bucket, and made at once, about; partitions at most; buckets in pieces are broadcast up to so many.
DEALT, PIECE, MADE, MOST_DEALT, MOST_PIECED = 1 << 26, 1 << 28, 1 << 20, 2000, 100_000


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How long [a, b] and [c, d] overlap; zero if they don't."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def overlap_join(left: DataFrame, right: DataFrame, width: float, keys: list[str] | None = None, bounds: str = "half") -> DataFrame:
    """Pairs of rows whose intervals (a_start, a_end) and (b_start, b_end) overlap: an equi-join on buckets of a width.

    A pair meets in every bucket that both cover and is kept only in the first, so nothing is deduplicated.
    bounds: half (touching ends don't overlap), closed (they do)."""
    keys = keys or []
    bucket = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    x = left.withColumn("_bucket", F.explode(bucket(F.col("a_start"), F.col("a_end"))))
    y = right.withColumn("_bucket", F.explode(bucket(F.col("b_start"), F.col("b_end"))))
    meets = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) if bounds == "closed" else (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    first = F.col("_bucket") == F.floor(F.greatest("a_start", "b_start") / width)
    return x.join(y, ["_bucket", *keys]).filter(meets & first).drop("_bucket")


def overlap_pairs(rows: DataFrame, width: float) -> DataFrame:
    """(a, b, overlap): pairs of rows (id, key, start, end) of different keys that overlap in part, the smaller key first, where pairs are far more than rows.

    A row is shuffled to each bucket of a width that it covers, and no pair is. A bucket's pairs are made in the order of time, batch by batch,
    in the one where the later row begins: each row with a run of those that begin while it lasts. So one of a pair's columns repeats
    a value and the other one a sequence, and files of pairs are small. A bucket with very many pairs is made in pieces, by several tasks."""
    spans = rows.select("id", "key", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).filter("id IS NOT NULL AND key IS NOT NULL")
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    pairs = F.col("count") * (F.col("count") - 1) / 2
    counts = spans.groupBy("_bucket").count()
    total, most = counts.agg(F.coalesce(F.sum(pairs), F.lit(0)), F.coalesce(F.max(pairs), F.lit(0))).first()
    spans = spans.withColumns({"_pieces": F.lit(1), "_piece": F.lit(0)})
    if most > PIECE:
        _, large = small(counts.filter(pairs > PIECE).select("_bucket", F.ceil(pairs / PIECE).cast("int").alias("_n")), MOST_PIECED)
        spans = spans.join(large, "_bucket", "left").withColumn("_pieces", F.coalesce("_n", F.lit(1))).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_n")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(batches)
        bucket, piece, pieces = (own[c][0].as_py() for c in ("_bucket", "_piece", "_pieces"))
        key, name = (pc.rank(own[c], tiebreaker="dense").to_numpy() for c in ("key", "id"))
        start, end = own["start"].to_numpy(), own["end"].to_numpy()
        order = np.lexsort((end, name, key, start))
        key, start, end, ids = key[order], start[order], end[order], own["id"].to_numpy()[order]
        here = np.flatnonzero(np.floor(start / width) == bucket)
        if not len(here):
            return
        # those that begin here and while a row lasts, after it in the order
        first = np.maximum(np.arange(len(start)) + 1, here[0])
        many = np.maximum(np.minimum(np.searchsorted(start, end), here[-1] + 1) - first, 0)
        done = np.cumsum(many)
        at, stop = (np.searchsorted(done, done[-1] * x / pieces, "right") if x < pieces else len(done) for x in (piece, piece + 1))
        while at < stop:
            # a batch of whole rows, or a part of one that has very many
            upto = max(at + 1, min(stop, int(np.searchsorted(done, done[at] - many[at] + MADE, "right"))))
            for skip in range(0, int(many[at : upto].max()), MADE):
                n = np.clip(many[at:upto] - skip, 0, MADE)
                x = np.repeat(np.arange(at, upto), n)
                y = np.repeat(first[at:upto] + skip - np.cumsum(n) + n, n) + np.arange(len(x))
                on = (start[x] < end[y]) & (key[x] != key[y])
                x, y = x[on], y[on]
                # for each row those of larger keys, then those of smaller ones
                turn = np.argsort(2 * x + (key[x] > key[y]), kind="stable")
                x, y = x[turn], y[turn]
                back = key[x] > key[y]
                a, b = (pa.array(ids[np.where(back, *ends)], own.schema.field("id").type) for ends in ((y, x), (x, y)))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(np.minimum(end[x], end[y]) - start[y])], ["a", "b", "overlap"])
            at = upto

    # buckets are work, not bytes, so they aren't left to be put together by their size
    dealt = spans.repartition(min(MOST_DEALT, max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(total) // DEALT))), "_bucket", "_piece").groupBy("_bucket", "_piece")
    return dealt.applyInArrow(run, f"a {kind}, b {kind}, overlap double")


def assign_first(spans: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """For each span (span_id) the first segment (segment_index) that it overlaps."""
    pairs = overlap_join(spans.withColumnsRenamed({"start": "a_start", "end": "a_end"}), segments.withColumnsRenamed({"start": "b_start", "end": "b_end"}), width)
    return pairs.groupBy("span_id").agg(F.min("segment_index").alias("segment_index"))


def islands(spans: DataFrame, keys: list[str], gap: float, start: str = "start", end: str = "end", tie: list[str] | None = None) -> DataFrame:
    """Spans of a key merged where the next begins within a gap of the furthest end so far."""
    w = Window.partitionBy(*keys).orderBy(start, end, *(tie or []))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    numbered = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("spans")).drop("_island")


def merge_neighbours(turns: DataFrame, scope: list[str], track: str, gap: float, tie: list[str] | None = None) -> DataFrame:
    """Turns merged with the one right before, if it is of the same track and close."""
    w = Window.partitionBy(*scope).orderBy("start", "end", *(tie or []))
    new = F.when((F.lag(track).over(w) == F.col(track)) & (F.col("start") - F.lag("end").over(w) <= gap), 0).otherwise(1)
    numbered = turns.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*scope, track, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("turns")).drop("_run")


def sliding(media: DataFrame, size: float, overlap_s: float) -> DataFrame:
    """Windows over [0, duration]: each a step after the last, the last clipped. media: id, duration."""
    step = size - overlap_s
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - overlap_s) / step)).cast("int")
    w = media.withColumn("n", F.explode(F.sequence(F.lit(0), n - 1)))
    return w.select("id", F.col("n").alias("window"), (F.col("n") * step).alias("start"), F.least(F.col("n") * step + size, F.col("duration")).alias("end"))


def _window_count(duration: Column, size: Column, overlap_s: Column) -> Column:
    return F.when(duration <= size, 1).otherwise(1 + F.ceil(F.round((duration - size) / F.greatest(size - overlap_s, F.lit(0.1)), 9))).cast("int")


def adaptive(media: DataFrame, size: float, overlap_s: float, most: int = 32, widest: float = 20.0) -> DataFrame:
    """sliding(), but where more than `most` windows would come out they overlap by a second at most, and if that isn't enough they grow by whole seconds, as
    few as bring their number down to `most`, until they are `widest`. Also gives the size used. media: id, duration; one that isn't positive has one window."""
    d = F.when(F.col("duration") > 0, F.col("duration").cast("double")).otherwise(size)
    overlap_ = F.when(_window_count(d, F.lit(size), F.lit(overlap_s)) > most, min(overlap_s, 1.0)).otherwise(overlap_s)
    # 1 + (d - s) / (s - o) <= most holds from this size on
    needed = F.ceil(F.round(F.greatest(F.lit(0.0), (d + (most - 1) * F.col("_o")) / most - size), 9))
    grown = size + F.least(needed, F.lit(max(0, -int(-(widest - size) // 1))))
    m = media.withColumns({"_d": d, "_o": overlap_}).withColumn("size", F.when(_window_count(d, F.lit(size), F.col("_o")) > most, grown).otherwise(size))
    m = m.withColumn("n", F.explode(F.sequence(F.lit(0), _window_count(F.col("_d"), F.col("size"), F.col("_o")) - 1)))
    start = F.col("n") * F.greatest(F.col("size") - F.col("_o"), F.lit(0.1))
    return m.select("id", F.col("n").alias("window"), F.round(start, 6).alias("start"), F.round(F.least(start + F.col("size"), F.col("_d")), 6).alias("end"), "size")


def next_in_order(rows: DataFrame, keys: list[str], t: str, key: str = "id", extra: list[str] | None = None) -> DataFrame:
    """(src_id, dst_id) of rows that follow each other within a key; rows without a time come last. extra columns come for both ends."""
    w = Window.partitionBy(*keys).orderBy(F.col(t).asc_nulls_last(), key)
    more = [c for x in (extra or []) for c in (F.col(x).alias(f"src_{x}"), F.lead(x).over(w).alias(f"dst_{x}"))]
    return rows.select(*keys, F.col(key).alias("src_id"), F.lead(key).over(w).alias("dst_id"), *more).filter("dst_id IS NOT NULL")


def remap(points: DataFrame, pieces: DataFrame, keys: list[str] | None = None, bucket: float = 60.0) -> DataFrame:
    """Times on a compacted line (at) moved to the original: pieces of a key have compact_start, compact_end, original_start.

    They meet on buckets of time; a point lies in one bucket, so none meets a piece twice. Points outside all pieces go."""
    of = lambda c: F.floor(F.col(c) / bucket)
    dealt = pieces.filter("compact_end > compact_start").withColumn("_bucket", F.explode(F.sequence(of("compact_start"), of("compact_end"))))
    hit = points.withColumn("_bucket", of("at")).join(dealt, [*(keys or []), "_bucket"]).filter((F.col("at") >= F.col("compact_start")) & (F.col("at") < F.col("compact_end"))).drop("_bucket")
    return hit.withColumn("original", F.col("original_start") + F.col("at") - F.col("compact_start"))


def nearest(points: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (point_id, at) the sample (sample_id, t) of its key that is nearest in time; ties to the earlier.

    The last sample before and the first after are found by windows over the union, so no pair of rows is made."""
    both = points.select(*keys, F.col("at").alias("_t"), "point_id", F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"), F.lit(1).alias("_side"))
    both = both.unionByName(samples.select(*keys, F.col("t").alias("_t"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), "sample_id", F.lit(0).alias("_side")))
    sample = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), "sample_id"))
    up = Window.partitionBy(*keys).orderBy("_t", "_side", "sample_id").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy("_t", "_side", "sample_id").rowsBetween(0, Window.unboundedFollowing)
    near = both.select("*", F.last(sample, ignorenulls=True).over(up).alias("_b"), F.first(sample, ignorenulls=True).over(down).alias("_a")).filter("_side = 1")
    before, after = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    pick = F.when(F.col("_a").isNull() | (before <= after), F.col("_b.sample_id")).otherwise(F.col("_a.sample_id"))
    return near.select(*keys, "point_id", pick.alias("sample_id"))
