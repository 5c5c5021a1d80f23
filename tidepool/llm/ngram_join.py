"""Similarity join on word n-grams with a Jaccard threshold, as a grouped prefix join.

1. A first pass over all texts adds up a fixed-size count sketch of shingles; it only sets the order of shingles (those
   that many documents share come last), which any order could be without changing results.
2. A second pass makes each document's shingle set, its 128-bit signature and, in that order, its prefix: two sets of a
   sufficient overlap share at least one shingle of their prefixes. Equal sets become one representative.
3. Representatives with the same prefix and size form a group. Groups meet on the shingles of their prefixes. Where such
   a posting list holds few members, its group pairs are filtered by sizes and positions, expanded into members, ruled
   out by parity bits and cell counts, which bound what two sets share, and verified.
4. In longer lists a few members are pivots. Bits and sizes tell which members can't be near a pivot; the others are
   compared with it and then described by how they differ from the shingles that most of them have, the centre. By the
   triangle inequality members near the centre are linked with the nearest one without being compared; of the others two
   can only be linked if they share enough of their *differences*, so a prefix join on differences, rarest first, finds
   them. A member that is nearer to a pivot than the bound has met all it can be linked with and leaves the list; what is
   left of lists is expanded like short ones, but for pairs within a component. So a large set of near copies costs a few
   comparisons a member, also where most of them are just below the threshold.
5. Components of links are found by smallest labels. Copies are never expanded into pairs.

Shingles are 64-bit hashes of words; two different ones of a corpus share a hash with a chance of about 2**-60.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; with fewer words than n
the whole sequence is the only shingle; equal sets are linked; ties go to the smaller doc_id; of a repeated doc_id each
row is returned and each text keeps its links: texts of one doc_id are linked, so that all of them have one component (but for
rows without words, which are linked with nothing); rows without doc_id are returned with their own null
component and linked with nothing; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, discard, slices, text_bytes, texts, written
from .components import components
from .words import chain, mix, words

WORK_BYTES = 1 << 20
#: The sketch has 2**SKETCH_BITS counters (a fixed 4 MB), in blocks that are added up and sent to the driver.
SKETCH_BITS = 20
BLOCKS = 64
#: Shingles of a set are counted in so many cells: the smaller counts of two sets bound what they share.
CELLS = 256
#: Bits of a set: whether an odd number of its shingles falls on each. Bits that differ are no more than shingles that do.
PARITY = 768
BITS = [f"b{i}" for i in range(PARITY // 64)]
#: Posting lists of up to so many members are expanded into pairs at once; longer ones have so many pivots.
FEW = 16
PIVOTS = 3
#: Members whose bits and size differ from a pivot's by no more than this share of its size are compared with it, if bits can tell.
REACH, REACH_BITS = 0.9, 300
#: Only shingles in the lowest quarter of hashes are counted: prefixes come from there.
COUNTED = 2


def shingles(body: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    _, _, hashes, at = words(body, offsets, lower=True)
    docs = len(offsets) - 1
    count = np.diff(at)
    owner = np.repeat(np.arange(docs), np.maximum(count - n + 1, 0))
    first = np.cumsum(np.maximum(count - n + 1, 0))
    k = np.arange(len(owner)) - np.repeat(first - np.maximum(count - n + 1, 0), np.maximum(count - n + 1, 0)) + np.repeat(at[:-1], np.maximum(count - n + 1, 0))
    out = np.full(len(k), 7, np.uint64)
    for j in range(n):
        out = chain(out, hashes[k + j])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            more = count[short] > j
            whole[more] = chain(whole[more], hashes[at[short[more]] + j])
        out = np.concatenate([out, mix(whole ^ np.uint64(0xABCDEF))])
        owner = np.concatenate([owner, short])
    order = np.argsort(out, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(docs + 1))


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS - COUNTED)).astype(np.int64)


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counters of all documents' distinct shingles that lie in the counted part; a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            body, offsets = text_bytes(batch.column(0))
            for a, b in slices(np.diff(offsets), WORK_BYTES):
                own, _ = shingles(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                total += np.bincount(_counters(own[own < np.uint64(1 << 64 - COUNTED)]), minlength=len(total))
        if total.any():
            each = len(total) // BLOCKS
            parts = total.astype("<u4") if total.max() < 1 << 32 else np.minimum(total, (1 << 32) - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([parts[i * each : (i + 1) * each].tobytes() for i in range(BLOCKS)], pa.binary())], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // BLOCKS, np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_buffer(), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    rows = docs.select("text").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def _heaviness(counts: np.ndarray) -> np.ndarray:
    """Order class of each counter: 0 up to what chance loads it with, then quarters of doublings of the excess."""
    mean = counts.mean()
    excess = (counts - mean) / (2 * np.sqrt(mean) + 2)
    return np.clip(np.ceil(4 * np.log2(np.maximum(excess, 1))), 0, 255).astype(np.uint8)


def _sets(docs: DataFrame, n: int, percent: int, classes: object) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for batch in batches:
            body, offsets = text_bytes(batch.column(1))
            for a, b in slices(np.diff(offsets), WORK_BYTES):
                own, at = shingles(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                size = np.diff(at)
                heavy = np.zeros(len(own), np.uint8)
                low = own < np.uint64(1 << 64 - COUNTED)
                heavy[low] = table[_counters(own[low])]
                run_ = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own + np.uint64(1)))])
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own ^ np.uint64(0x5DEECE66D)))])
                prefixes, groups = [], []
                spread = np.bincount(np.repeat(np.arange(b - a), size) * CELLS + (own >> np.uint64(24)).astype(np.int64) % CELLS, minlength=(b - a) * CELLS).reshape(b - a, CELLS)
                cells = [x.tobytes() for x in np.minimum(spread, 65535).astype("<u2")]
                odd = np.bincount(np.repeat(np.arange(b - a), size) * PARITY + (own >> np.uint64(37)).astype(np.int64) % PARITY, minlength=(b - a) * PARITY) & 1
                bits = np.packbits(odd.astype(bool)).view("<i8").reshape(b - a, PARITY // 64)
                for i in range(b - a):
                    s = own[at[i] : at[i + 1]]
                    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    h = heavy[at[i] : at[i + 1]]
                    p = s[np.argsort(h, kind="stable")[:keep]] if h.any() else s[:keep]
                    prefixes.append(p.astype("<u8").tobytes())
                    groups.append(int(mix(np.bitwise_xor.reduce(mix(p + np.uint64(3)), keepdims=True) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array((run_[at[1:]] - run_[at[:-1]]).view(np.int64)),
                    pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)), pa.array(groups, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(cells, pa.binary()),
                    *(pa.array(np.ascontiguousarray(x)) for x in bits.T),
                ], ["doc_id", "hash", "n_shingles", "sig1", "sig2", "grp", "prefix", "cells", *BITS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, hash long, n_shingles long, sig1 long, sig2 long, grp long, prefix binary, cells binary, {", ".join(f"{c} long" for c in BITS)}")


def _postings(groups: DataFrame) -> DataFrame:
    """(grp, size, members, token, pos) of each group's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(3)]
            count = np.array([len(x) for x in data], np.int64)
            which = np.repeat(np.arange(len(data)), count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            token = np.concatenate(data) if data else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(which)) for k in range(3)), pa.array(token), pa.array(at)], ["grp", "size", "members", "token", "pos"])

    return groups.select("grp", "size", "members", "prefix").mapInArrow(run, "grp long, size long, members long, token long, pos long")


def _close(percent: int, a: str, b: str) -> str:
    """Size filter for postings with aliases a and b, and the prefix that this pair of sizes needs, which is shorter than for sizes unknown."""
    need = f"{percent} * ({a}.size + {b}.size)"
    within = " AND ".join(f"{100 + percent} * ({x}.size - {x}.pos) >= {need}" for x in (a, b))
    return f"100 * least({a}.size, {b}.size) >= {percent} * greatest({a}.size, {b}.size) AND {within}"


def _alike(percent: int, a: str, b: str, size: str) -> str:
    """Whether the bits of two rows leave room for the threshold: they differ by at most what two such sets may."""
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in BITS)
    return f"{100 + percent} * ({differ}) <= {100 - percent} * ({a}.{size} + {b}.{size})"


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that neither the bits of their sets nor the counts of their cells rule out. A cell at its largest value bounds nothing."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int64) for k in (4, 5))
            low = np.minimum(x, y)
            most = np.where((low == 65535).any(axis=1), sizes, low.sum(axis=1))
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * most >= percent * sizes))

    kind = reps.schema["rep"].dataType.simpleString()
    marks = reps.select("rep", "n_shingles", *BITS)
    one = pairs.join(marks.withColumnRenamed("rep", "a"), "a").alias("x")
    left = one.join(marks.withColumnRenamed("rep", "b").alias("y"), (F.col("x.b") == F.col("y.b")) & F.expr(_alike(percent, "x", "y", "n_shingles"))).select("x.a", "x.b")
    first = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("x"), F.col("cells").alias("p"))
    second = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("y"), F.col("cells").alias("q"))
    return left.join(first, "a").join(second, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(check, f"a {kind}, b {kind}")


def _whole(pairs: list[DataFrame], docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(id, members), stored: whole shingle sets of the representatives in pairs (a, b), made again from a text that has them.

    The ids are stored first: Spark broadcasts them if their file is small, and shuffles texts only if it isn't. Where a
    doc_id has several texts, the text's hash tells which of them is meant."""
    ends = [p.select(c) for p in pairs for c in p.columns]
    for e in ends[1:]:
        ends[0] = ends[0].union(e)
    ids = written(ends[0].toDF("rep").distinct().join(reps.select("rep", "doc_id", "hash"), "rep"), "wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column(1))
            for a, b in slices(np.diff(offsets), WORK_BYTES):
                own, at = shingles(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([own[at[i] : at[i + 1]].astype("<u8").tobytes() for i in range(b - a)], pa.binary())], ["id", "members"])

    # ids alone say which texts leave their place; those are shuffled once, for their numbers and repeated rows
    found = docs.join(ids.select("doc_id"), "doc_id", "left_semi").join(ids, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("rep", "text")
    out = written(found.mapInArrow(whole, "id long, members binary"), "sets")
    discard(ids)
    return out


def _both(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b) with the sizes x and y of their sets and the shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sizes = [], ([], [])
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8")
                sizes[0].append(len(x))
                sizes[1].append(len(y))
                own.append(np.setxor1d(x, y, assume_unique=True))
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            only = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes[0], pa.int64()), pa.array(sizes[1], pa.int64()), only], ["a", "b", "x", "y", "only"])

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return full.mapInArrow(run, f"a {kind}, b {kind}, x long, y long, only array<long>")


def _linked(percent: int) -> str:
    """Whether rows of _both() reach the threshold."""
    return f"{100 + percent} * size(only) <= {100 - percent} * (x + y)"


def _centred(differences: DataFrame, percent: int) -> DataFrame:
    """(p, x, size, d, e) from (p, x, size, only): d are the differences of x from what most of p's members have.

    e is by how much d exceeds the share of the allowed differences that x has by its size: members x and y whose e add
    up to no more than 0 are linked, and others only if d of x and of y share (e of x + e of y) / 2 / (100 + percent) or more."""
    counts = differences.select("p", F.explode("only").alias("token")).groupBy("p", "token").agg(F.count(F.lit(1)).alias("c"))
    sizes = differences.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # no more than twice the mean number of differences of p's members
    most = counts.join(sizes, "p").filter("2 * c > n").groupBy("p").agg(F.collect_list("token").alias("most"))
    d = F.when(F.col("most").isNull(), F.col("only")).otherwise(F.concat(F.array_except("only", "most"), F.array_except("most", "only")))
    out = differences.join(most, "p", "left").select("p", "x", "size", d.alias("d"))
    return out.withColumn("e", F.expr(f"{100 + percent} * size(d) - {100 - percent} * size"))


def _reach(size: str) -> str:
    """How far from a pivot of this size a member may be to be compared with it."""
    return f"least({REACH} * {size}, {REACH_BITS})"


def _leaves(distance: str, size: str, percent: int) -> str:
    """Whether a member at this distance has all that it can be linked with in reach of the pivot.

    Members x and y that are linked differ by (100 - percent) / percent of the size of x at most, and x is no larger than
    the pivot's size and the distance."""
    return f"{percent} * {distance} + {100 - percent} * ({distance} + {size}) <= {percent} * {_reach(size)}"


def _pivots(long: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(token, p) pivots of long lists and (p, x) members in reach of each, from (token, rep, size, bits)."""
    row = F.struct("rep", "size", *BITS)
    far = " + ".join(f"bit_count({c} ^ p.{c})" for c in BITS)
    live, chosen, near = long, [], []
    for k in range(PIVOTS):
        pick = live.groupBy("token").agg(F.min_by(row, F.xxhash64("rep", F.lit(k))).alias("p"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).drop("n")
        met = written(live.join(pick, "token").withColumn("far", F.expr(f"greatest({far}, abs(size - p.size))")), "met")
        chosen.append(met.select("token", F.col("p.rep").alias("p")).distinct())
        near.append(met.where(f"far <= {_reach('p.size')}").select(F.col("p.rep").alias("p"), F.col("rep").alias("x")).distinct())
        live = met.where(f"NOT ({_leaves('far', 'p.size', percent)}) AND rep <> p.rep").select(*long.columns)
    out = chosen[0], near[0]
    for c, m in zip(chosen[1:], near[1:], strict=True):
        out = out[0].union(c), out[1].union(m)
    return written(out[0].distinct(), "chosen"), written(out[1].distinct(), "near")


def _meeting(centred: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components whose differences may share enough, from (p, x, size, d, e, comp, least)."""
    step = 2 * (100 + percent)
    each = centred.select("p", "x", "size", "e", "comp", "least", F.explode("d").alias("token"))
    # members of different components can only share differences that occur in more than one component
    shared = each.groupBy("p", "token").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("p", "token", "c")
    rows = each.join(shared, ["p", "token"]).groupBy("p", "x", "size", "e", "comp", "least").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("d"))
    rows = rows.withColumn("m", F.size("d")).withColumn("keep", F.expr(f"m + 1 - greatest(1, cast(ceil((e + least) / {step}) AS int))")).filter("keep > 0")
    index = written(rows.select("p", "x", "size", "e", "comp", "m", F.posexplode(F.slice("d", F.lit(1), F.col("keep"))).alias("pos", "t")).select("p", "x", "size", "e", "comp", "m", "pos", "t.token"), "differences")
    meets = f"i.x < j.x AND i.comp <> j.comp AND i.e + j.e > 0 AND {step} * least(i.m - i.pos, j.m - j.pos) >= i.e + j.e AND 100 * least(i.size, j.size) >= {percent} * greatest(i.size, j.size)"
    pairs = index.alias("i").join(index.alias("j"), (F.col("i.p") == F.col("j.p")) & (F.col("i.token") == F.col("j.token")) & F.expr(meets))
    return pairs.select(F.col("i.x").alias("a"), F.col("j.x").alias("b"))


def _same_ids(mine: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between representatives of different texts of one doc_id."""
    several = mine.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sig1").alias("low"), F.max("sig1").alias("high")).filter("low <> high").select("doc_id")
    several = written(mine.join(several, "doc_id").select("doc_id", "sig1", "sig2", "n_shingles").distinct(), "repeated")
    each = several.join(reps.select("sig1", "sig2", "n_shingles", "rep"), ["sig1", "sig2", "n_shingles"]).select("doc_id", "rep")
    out = written(each.join(each.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")), "links")
    discard(several)
    return out


def similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links of Jaccard >= percent / 100)."""
    spark: SparkSession = docs.sparkSession
    arrow_limits(spark)
    docs = texts(docs).withColumn("hash", F.xxhash64("text"))
    classes = spark.sparkContext.broadcast(_heaviness(sketch(docs, n)))
    sets = written(_sets(docs, n, percent, classes), "shingles")
    copies = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig1", "sig2", "n_shingles")
    reps = copies.agg(F.min(F.struct("doc_id", "hash")).alias("of"), F.count(F.lit(1)).alias("copies"), F.first("grp").alias("grp"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells"), *(F.first(c).alias(c) for c in BITS))
    # a representative has a number of its own, as several sets may have the same smallest doc_id
    reps = written(reps.select("*", "of.doc_id", "of.hash", F.monotonically_increasing_id().alias("rep")).drop("of"), "representatives")
    mine = written(sets.select("doc_id", "n_shingles", "sig1", "sig2"), "signatures")
    discard(sets)
    groups = written(reps.groupBy("grp", F.col("n_shingles").alias("size")).agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("members"), F.first("prefix").alias("prefix")), "groups")
    member = reps.select("rep", "grp")
    kind = "bigint"

    # posting lists with more than one member
    postings = written(_postings(groups), "postings")
    lists = postings.groupBy("token").agg(F.sum("members").alias("n")).filter("n > 1")
    listed = written(postings.join(lists, "token"), "lists")
    discard(postings)

    # short lists: group pairs, then their members
    short = listed.filter(F.col("n") <= FEW)
    meet = F.expr(f"x.grp < y.grp AND {_close(percent, 'x', 'y')} OR x.grp = y.grp AND x.members > 1")
    near = short.alias("x").join(short.alias("y"), (F.col("x.token") == F.col("y.token")) & meet).select(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).distinct()
    near = near.join(member.select(F.col("grp").alias("g"), F.col("rep").alias("a")), "g").join(member.select(F.col("grp").alias("h"), F.col("rep").alias("b")), "h").where("g <> h OR a < b").select("a", "b")
    pairs = written(_possible(near, reps, percent), "possible")

    # long lists: members in reach of pivots
    long = listed.filter(F.col("n") > FEW).select("token", "grp", "size", "pos").join(reps.select("grp", "rep", *BITS), "grp").drop("grp")
    long = written(long, "long")
    discard(listed, groups)
    chosen, clusters = _pivots(long.drop("pos"), percent)
    sets = _whole([pairs, clusters], docs, reps, n)
    links = written(_both(pairs, sets, kind).where(_linked(percent)).select("a", "b"), "links")
    differences = written(_both(clusters.select(F.col("p").alias("a"), F.col("x").alias("b")), sets, kind), "differences")
    discard(pairs, clusters, sets)
    centred = written(_centred(differences.select(F.col("a").alias("p"), F.col("b").alias("x"), F.col("y").alias("size"), "only"), percent), "centred")
    best = written(centred.groupBy("p").agg(F.min(F.struct("e", "x")).alias("m")).select("p", F.col("m.e").alias("least"), F.col("m.x").alias("first")), "nearest")
    around = centred.join(best, "p").where("x <> first AND e + least <= 0").select(F.col("first").alias("a"), F.col("x").alias("b"))
    more = written(differences.where("a <> b").where(_linked(percent)).select("a", "b").union(around), "links")
    left = differences.where(_leaves("size(only)", "x", percent)).select(F.col("a").alias("p"), F.col("b").alias("rep"))
    rest = written(long.join(chosen.join(left, "p").select("token", "rep").distinct(), ["token", "rep"], "left_anti"), "rest")
    discard(long, chosen, differences)
    found = components(links.union(more))

    # members of different components that share enough of their differences, and those that are left in a list
    named = centred.join(found.withColumnRenamed("id", "x"), "x", "left").withColumn("comp", F.coalesce("component", "x")).join(best, "p").drop("component", "first")
    named = written(named, "named")
    rest_ = rest.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    rest_ = written(rest_, "open")
    discard(centred, best, found, rest)
    mixed = rest_.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    open_ = rest_.join(mixed, "token")
    meets = f"x.rep < y.rep AND x.comp <> y.comp AND {_close(percent, 'x', 'y')} AND {_alike(percent, 'x', 'y', 'size')}"
    others = open_.alias("x").join(open_.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(meets)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    pairs = written(_possible(_meeting(named, percent).union(others).distinct(), reps, percent), "possible")
    discard(named, rest_)
    sets = _whole([pairs], docs, reps, n)
    last = written(_both(pairs, sets, kind).where(_linked(percent)).select("a", "b"), "links")
    discard(pairs, sets)
    same = _same_ids(mine, reps)
    found = components(links.union(more).union(last).union(same))
    least = found.join(reps.select(F.col("rep").alias("id"), "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = reps.select("sig1", "sig2", F.col("n_shingles").alias("size"), F.col("rep").alias("id"), "doc_id", "copies").join(found, "id", "left").join(least, "component", "left")
    named = written(named.filter("copies > 1 OR component IS NOT NULL").select("sig1", "sig2", "size", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    discard(links, more, last, same, found, reps)

    match = (F.col("s.sig1") == F.col("r.sig1")) & (F.col("s.sig2") == F.col("r.sig2")) & (F.col("s.n_shingles") == F.col("r.size")) & F.col("s.doc_id").isNotNull()
    return mine.alias("s").join(named.alias("r"), match, "left").select("s.doc_id", "s.n_shingles", F.coalesce("r.component_id", "s.doc_id").alias("component_id"))
