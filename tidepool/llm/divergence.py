"""Divergence between the sources of a language, by systolic rotation.

A group is a source of a language. Its kept terms (those in enough documents of the language) get a smoothed share p in
billionths, and two groups diverge by the sum of floor((p - q)^2 / (p + q)) over all kept terms.

1. Texts are tokenised once; tasks add up (language, source, term) counts before anything is shuffled.
2. Groups of a language are dealt into a fixed number of blocks, its terms into slices. A cell is the part of a block's
   vectors that lies in a slice, packed into one compressed value; slices are as many as keep a cell within CELL numbers
   however many sources or terms there are. Packing a cell also ranks each group's own terms in a heap.
3. Round-robin tournament (circle method): in each round every block meets one other. Cells of one block of a pair stay in
   the partition that they have been dealt to, those of the other come as visitors; a round is one join. A meeting gives
   what its slice adds to the value of each pair of groups, in both directions. Pairs within a block meet at home.
4. What slices add is summed up per pair. Terms that neither group has are all alike, so their share is one product.

All arithmetic is on whole numbers, so no order of additions matters. Values fit as long as a language has below 2**53 words.

Cases: null text, language and source are ''; repeated rows count each; a group without kept terms takes part with
counts of 0; a language without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs;
ties go to the smaller item in UTF-8 order; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, discard, slices, text_bytes, written
from .words import bounds, running, span

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: An even number of blocks: each meets the others in BLOCKS - 1 rounds.
BLOCKS = 8
#: Terms of a slice, and numbers of a cell, at most on average.
SLICE_TERMS = 2048
CELL = 1 << 18
WORK_BYTES = 1 << 20
#: Counts that a task holds before it sends them on.
HELD = 1 << 19

_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[:0x41] = True
_OUTSIDE[0x5B:0x61] = True
_OUTSIDE[0x7B:0x80] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of all texts; a row with a null term for every group."""
    arrow_limits(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        parts: list[tuple] = []
        held = 0
        words: dict[int, bytes] = {}

        def merged() -> None:
            """One row for each group and term of what is held."""
            nonlocal parts, held
            g, h, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((h, g))
            g, h = g[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
            parts = [(g[new], h[new], np.add.reduceat(c[order], new), np.add.reduceat(d[order], new))]
            held = len(new)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            names = list(groups)
            if parts:
                merged()
            g, h, c, d = parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            parts, held = [], 0
            for at in range(0, max(len(g), 1), 1 << 16):
                s = slice(at, at + (1 << 16))
                terms = pa.array([words[x].decode() for x in h[s].tolist()], pa.string())
                lang, source = (pa.array([n[k] for n in names], pa.string()).take(pa.array(g[s])) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, terms, pa.array(c[s]), pa.array(d[s])], ["lang", "source", "term", "count", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.string()), pa.nulls(len(names), pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([0] * len(names), pa.int64())], ["lang", "source", "term", "count", "docs"])
            groups.clear()
            words.clear()

        for batch in batches:
            mine = np.array([groups.setdefault(k, len(groups)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            body, offsets = text_bytes(batch.column(2))
            for a, b in slices(np.diff(offsets), WORK_BYTES):
                part, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if not len(part):
                    continue
                starts, ends = bounds(part, at, _OUTSIDE)
                if not len(starts):
                    continue
                hashes = span(running(part, lower=True), starts, ends)
                doc = np.searchsorted(at, starts, side="right") - 1
                order = np.lexsort((hashes, doc))
                h, d = hashes[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
                count = np.diff(np.append(new, len(h)))
                some, first = np.unique(h[new], return_index=True)
                at_ = order[new[first]]
                raw = part.tobytes()
                for x, s, e in zip(some.tolist(), starts[at_].tolist(), ends[at_].tolist(), strict=True):
                    if x not in words:
                        words[x] = raw[s:e].lower()
                parts.append((mine[a + d[new]], h[new], count.astype(np.int64), np.ones(len(new), np.int64)))
                held += len(new)
                if held > 2 * HELD:
                    merged()
                    if held > HELD or len(words) > HELD:
                        yield from out()
                        mine = np.array([groups.setdefault(k, len(groups)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        if groups:
            yield from out()

    rows = own.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division in steps of 1000 so that nothing overflows."""
    below = total + 2 * terms
    whole, rest = np.divmod(count + 2, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def _diverge(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _packed(*arrays: np.ndarray) -> bytes:
    """Numbers of a cell: ascending ids as differences, everything compressed."""
    return zlib.compress(b"".join(np.asarray(a, "<i8").tobytes() for a in (np.array([len(x) for x in arrays]), *arrays)), 1)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zlib.decompress(data), "<i8")
    return np.split(flat[n:], np.cumsum(flat[:n])[:-1])


def _cell(key: tuple, t: pa.Table, top: int) -> pa.Table:
    """One cell: a row with its vectors, and the best terms of each of its groups."""
    lang, cut, block = (k.as_py() for k in key)
    number, total, terms = (t.column(c).to_numpy() for c in ("number", "total", "terms"))
    roster, first = np.unique(number, return_index=True)
    base = shares(np.zeros(len(roster), np.int64), total[first], terms[first])
    t = t.filter(t.column("id").is_valid())
    number, id_, count, total, terms, all_count, all_total = (t.column(c).to_numpy().astype(np.int64) for c in ("number", "id", "count", "total", "terms", "all_count", "all_total"))
    p, q = shares(count, total, terms), shares(all_count, all_total, terms)
    ids, column = np.unique(id_, return_inverse=True)
    vectors = _packed(roster, base, np.diff(ids, prepend=0), np.searchsorted(roster, number), column, p)
    over = np.flatnonzero(p > q)
    value = _diverge(p[over], q[over])
    names = t.column("term").take(pa.array(over)).to_pylist()
    best: dict[int, list] = {}
    for g, v, name in zip(number[over].tolist(), value.tolist(), names, strict=True):
        best.setdefault(g, []).append((-v, name.encode()))
    rows = [(g, -v, name.decode()) for g, all_ in best.items() for v, name in heapq.nsmallest(top, all_)]
    n = len(rows)
    return pa.Table.from_arrays(
        [pa.array([lang] * (n + 1), pa.string()), pa.array([cut] * (n + 1), pa.int64()), pa.array([block] * (n + 1), pa.int32()), pa.array([None, *(r[0] for r in rows)], pa.int64()),
         pa.array([None, *(r[1] for r in rows)], pa.int64()), pa.array([None, *(r[2] for r in rows)], pa.string()), pa.array([vectors] + [None] * n, pa.binary())],
        ["lang", "cut", "block", "number", "value", "term", "vectors"],
    )


def _dense(roster: np.ndarray, base: np.ndarray, rows: np.ndarray, ids: np.ndarray, p: np.ndarray, union: np.ndarray) -> np.ndarray:
    out = np.repeat(base[:, None], len(union), axis=1)
    out[rows, np.searchsorted(union, ids)] = p
    return out


def meet(home: bytes, visitor: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of two groups and what this slice adds to their value, for all pairs of two cells or within one.

    Over the terms that either cell has, less what these would add if no group had them."""
    g, g0, gd, gr, gc, gp = _unpacked(home, 6)
    h, h0, hd, hr, hc, hp = _unpacked(visitor or home, 6)
    g_ids, h_ids = np.cumsum(gd), np.cumsum(hd)
    union = np.union1d(g_ids, h_ids)
    left = _dense(g, g0, gr, g_ids[gc], gp, union)
    right = left if visitor is None else _dense(h, h0, hr, h_ids[hc], hp, union)
    value = np.empty((len(g), len(h)), np.int64)
    for i in range(len(g)):
        value[i] = _diverge(left[i], right).sum(axis=1) - len(union) * _diverge(g0[i], h0)
    a, b = np.meshgrid(np.arange(len(g)), np.arange(len(h)), indexing="ij")
    keep = (a < b) if visitor is None else np.ones(a.shape, bool)
    return g[a[keep]], h[b[keep]], value[keep]


def _meetings(pairs: DataFrame) -> DataFrame:
    """(lang, a, b, value): both directions of each meeting of (lang, home, visitor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, home, visitor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b, v = meet(home, visitor)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(2 * len(a), np.int64))), pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([v, v]))], ["lang", "a", "b", "value"])

    return pairs.select("lang", "home", "visitor").mapInArrow(run, "lang string, a long, b long, value long")


def opponent(block: Column, turn: int, blocks: int) -> Column:
    """Whom a block meets in a round of the circle method: the last block stands still, the others turn around it."""
    last = F.lit(blocks - 1)
    return F.when(block == last, turn).when(block == turn, last).otherwise(F.pmod(F.lit(2 * turn) - block, last)).cast("int")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, blocks: int = BLOCKS, slice_terms: int = SLICE_TERMS, cell: int = CELL) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the other sources, and the terms it has more of than its language."""
    if blocks % 2:
        raise ValueError("blocks must be even")
    counts = written(term_counts(docs), "term-counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("count").alias("all_count"), F.sum("docs").alias("d")).filter(F.col("d") >= min_docs)
    # ids are drawn once and stored, so each term has one of its own
    kept = written(kept.select("lang", "term", "all_count", F.monotonically_increasing_id().alias("id")), "kept-terms")
    entries = written(counts.filter("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "all_count", "id"), "entries")
    groups = counts.filter("term IS NULL").select("lang", "source").distinct()
    totals = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(groups.select("*", F.monotonically_increasing_id().alias("number"), F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")), "groups")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_count").alias("all_total"))
    langs = langs.join(sizes, "lang", "left").fillna(0, ["terms", "all_total"])
    cuts = F.ceil(F.greatest(F.col("terms") / slice_terms, F.col("terms") * F.col("sources") / blocks / cell, F.lit(1)))
    groups = written(groups.join(langs.withColumn("cuts", cuts), "lang"), "group-facts")

    # every cell has the roster of its block, also where none of its groups has a term of the slice
    some = groups.filter("terms > 0")
    facts = ["lang", "block", "number", "total", "terms", "all_total"]
    roster = some.select(*facts, F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("all_count"), F.lit(None).cast("string").alias("term"))
    own = entries.join(some.select("source", "cuts", *facts), ["lang", "source"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")))
    rows = own.select(*facts, "cut", "id", "count", "all_count", "term").union(roster.select(*facts, "cut", "id", "count", "all_count", "term"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        return _cell(key, t, top_terms)

    packed = rows.groupBy("lang", "cut", "block").applyInArrow(pack, "lang string, cut long, block int, number long, value long, term string, vectors binary")
    packed = written(packed, "cells")
    discard(entries, counts, kept)

    resident = packed.filter("vectors IS NOT NULL").select("lang", "cut", "block", F.col("vectors").alias("home"))
    added = _meetings(resident.select("lang", "home", F.lit(None).cast("binary").alias("visitor")))
    for turn in range(blocks - 1):
        to = opponent(F.col("block"), turn, blocks)
        travelling = packed.filter("vectors IS NOT NULL").where(to < F.col("block")).select("lang", "cut", to.alias("block"), F.col("vectors").alias("visitor"))
        added = added.union(_meetings(resident.join(travelling, ["lang", "cut", "block"])))
    added = written(added.groupBy("lang", "a", "b").agg(F.sum("value").alias("added")), "added")

    # terms that neither group of a pair has, and languages without terms: from the groups alone
    name = groups.select("lang", "number", "source", "total", "terms")
    names = lambda k: name.select("lang", *(F.col(c).alias(c + k) for c in ("number", "source", "total", "terms")))
    pairs = names("").join(names("2"), "lang").filter("number <> number2")
    base = lambda total, terms: F.expr(f"1 + 2 * {SCALE} div ({total} + 2 * {terms})")
    pairs = pairs.withColumns({"p": F.when(F.col("terms") > 0, base("total", "terms")), "q": F.when(F.col("terms") > 0, base("total2", "terms"))})
    f0 = F.coalesce(F.expr("terms * (((p - q) * (p - q)) div (p + q))"), F.lit(0))
    pairs = pairs.join(added.select("lang", F.col("a").alias("number"), F.col("b").alias("number2"), "added"), ["lang", "number", "number2"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("source2").alias("item"), (f0 + F.coalesce("added", F.lit(0))).alias("value"))
    terms = packed.filter("vectors IS NULL").join(name.select("lang", "number", "source"), ["lang", "number"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).union(terms.withColumn("rank", ranked).filter(F.col("rank") <= top_terms))
