"""A hierarchical Pitman-Yor language model of word pairs over words over a uniform parent.

Tokens are lower-cased words and one end for each text; a token's context is the token before it (an end, for the
first). Every context is a restaurant whose customers are the training tokens that follow it; all share one parent, the
restaurant of words without context, whose customers are the context restaurants' tables, and whose parent is uniform over
the vocabulary and one unknown. Seating is sampled by Gibbs sweeps: a dish's tables are taken away, in its restaurant and
in the parent, and its customers sit down again, one after the other, by the Chinese-restaurant rule against the parent's
predictive probability; then the parent is seated again. All dishes of a part of the contexts are drawn at once from the
sweep before, and a part sweeps with a parent of its own, over the tables of its own contexts (approximate distributed
sampling); the shared parent is seated, by sweeps too, when the parts' tables meet. A text's score is the logarithm of
the predictive probability averaged over the sampled seatings.

Chunks of documents send their distinct words and pairs, as sorted hashes with counts, to parts; parts answer in the
same order; chunks score their texts. A word or pair meets a row for each chunk, not for each occurrence. Contexts with
many customers are dealt over all parts by the following word. Nothing of the corpus is on the driver but two totals and
at most four contexts for each part. There are as many chunks and parts as the corpus has megabytes for, each a task of
its own, so a task's input doesn't grow; blobs between them are no more than chunks times parts and no more than the
words and pairs of chunks. Rows are dealt to chunks by their place in a stored file, so repeated rows are spread and lost
tasks find the same rows again; rows that don't come from a file are stored first.

Words are 64-bit hashes; in pairs between chunks and parts they are told apart by 48 bits, as pairs are most of what is
stored and shuffled: of a billion words some 1,800 share those with another.

Cases: a null or empty text is its end alone; rows repeat as given (each counts); without training texts counts are
zero and scores come from the uniform parent; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import arrow_limits, fold, slices, sweep, text_bytes, texts, written
from .words import chain, mix, words

MODULUS, HELD_OUT = 5, 1
#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 9_000_000
#: Discounts and strengths: of context restaurants, and of the restaurant of words.
PAIR_D, PAIR_S = 0.8, 1.0
WORD_D, WORD_S = 0.65, 10.0
BURN_IN, SAMPLES = 4, 2
END = np.uint64(0x51ED270B9E3779B1)
#: Bytes by which the words of pairs are told apart between chunks and parts.
PAIR_BYTES = 6
#: Texts are hashed so many bytes at a time.
WORK_BYTES = 1 << 20
BLOBS = "kind int, dest int, src int, a binary, b binary, c binary, d binary, e binary"


def seat(c: np.ndarray, rest: np.ndarray, parent: np.ndarray, s: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers of one dish that come one after the other, with `rest` tables of other dishes around.

    The i-th customer opens the (t + 1)-th table with weight (s + d * (rest + t)) * parent against i - 1 - d * t. Early ones
    are drawn one by one; later those that may open one are drawn at once and thinned out, by the same law."""
    t = (c > 0).astype(np.float64)
    on = np.flatnonzero(c > 1)
    i = 1
    while len(on) and i < 32:
        new = (s + d * (rest[on] + t[on])) * parent[on]
        t[on] += rng.random(len(on)) * (i - d * t[on] + new) < new
        i += 1
        on = on[c[on] > i]
    at = np.full(len(on), float(i))  # customers that sit
    while len(on):
        # the chance of a new table falls with each customer until there is one: draw by the chance now, then thin out
        new = (s + d * (rest[on] + t[on])) * parent[on]
        norm = at - d * t[on] + new
        skipped = np.floor(np.log(1 - rng.random(len(on))) / np.log1p(-np.minimum(new / norm, 1 - 1e-12)))
        opened = (rng.random(len(on)) * (norm + skipped) < norm) & (at + skipped < c[on])
        at += skipped + 1
        t[on[opened]] += 1
        left = at < c[on]
        on, at = on[left], at[left]
    return t


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * PAIR_BYTES) - 1)


def _pack(hashes: np.ndarray) -> bytes:
    """The low bytes of hashes."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES]).tobytes()


def _unpack(blob: pa.Scalar) -> np.ndarray:
    raw = _of(blob, "u1").reshape(-1, PAIR_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :PAIR_BYTES] = raw
    return out.view("<u8").reshape(-1)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(_low(hashes)) % np.uint64(parts)).astype(np.int32)


def _of(blob: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), kind)


def _small(*arrays: np.ndarray) -> bytes:
    """Arrays of one length with counts that are mostly small: a byte each, larger ones apart with their places."""
    out = [np.array([len(arrays[0])], "<u4").tobytes()]
    for x in arrays:
        x = np.minimum(x, (1 << 32) - 1).astype("<u4")
        large = np.flatnonzero(x > 255).astype("<u4")
        out += [np.array([len(large)], "<u4").tobytes(), large.tobytes(), x[large].tobytes(), x.astype("u1").tobytes()]
    return b"".join(out)


def _large(blob: pa.Scalar) -> list[np.ndarray]:
    """What _small() packed."""
    raw = blob.as_buffer()
    n, at, out = int(np.frombuffer(raw, "<u4", 1)[0]), 4, []
    while at < len(raw):
        k = int(np.frombuffer(raw, "<u4", 1, at)[0])
        places, values = np.frombuffer(raw, "<u4", k, at + 4), np.frombuffer(raw, "<u4", k, at + 4 + 4 * k)
        x = np.frombuffer(raw, "u1", n, at + 4 + 8 * k).astype(np.int64)
        x[places] = values
        out.append(x)
        at += 4 + 8 * k + n
    return out


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["kind", "dest", "src", "a", "b", "c", "d", "e"])


class Chunk:
    """The tokens of a chunk's documents, its distinct words and pairs, both in the order in which parts see them."""

    def __init__(self, docs: pa.Table, parts: int):
        body, offsets = text_bytes(docs.column("text").combine_chunks())
        found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in slices(np.diff(offsets), WORK_BYTES):
            _, _, h, at = words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
            found.append(h)
            counts.append(np.diff(at))
        hashes = np.concatenate(found)
        self.docs, self.train = docs.num_rows, docs.column("train").to_numpy()
        self.count = np.concatenate(counts) + 1
        self.owner = np.repeat(np.arange(self.docs), self.count)
        tokens = np.full(len(self.owner), END, np.uint64)
        last = np.cumsum(self.count) - 1
        inner = np.ones(len(tokens), bool)
        inner[last] = False
        tokens[inner] = hashes
        self.last = last
        self.kinds, number = np.unique(tokens, return_inverse=True)
        part = part_of(self.kinds, parts)
        order = np.argsort(part, kind="stable")
        self.kinds, self.part = self.kinds[order], part[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word = place[number]

    def words(self) -> Iterator[tuple[int, slice]]:
        return _runs(self.part)

    def pairs(self, hot: np.ndarray, parts: int) -> None:
        n = np.int64(len(self.kinds))
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[np.concatenate([[0], self.last[:-1] + 1])] = self.word[self.last[0]]
        both, self.pair = np.unique(before * n + self.word, return_inverse=True)
        self.u, self.w = both // n, both % n
        self.pair_part = self.part[self.u]  # words lie in the order of their parts, and so do pairs by context
        salted = np.flatnonzero(np.isin(self.kinds, hot)[self.u])
        if not len(salted):
            return
        part = self.pair_part.copy()
        part[salted] = part_of(chain(self.kinds[self.u[salted]], _low(self.kinds[self.w[salted]])), parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair, self.u, self.w, self.pair_part = place[self.pair], self.u[order], self.w[order], part[order]


def _runs(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(part):
        cut = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(part)]]).tolist(), strict=True):
            yield int(part[a]), slice(a, b)


def _ask_words(parts: int) -> Callable:
    """Of a chunk: (part, chunk, distinct words, training counts)."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs, parts)
        counts = np.bincount(chunk.word, chunk.train[chunk.owner], len(chunk.kinds))
        return _table([(0, p, key[0].as_py(), chunk.kinds[m].astype("<u8").tobytes(), _small(counts[m]), None, None, None) for p, m in chunk.words()])

    return run


def _add_words(key: tuple, asked: pa.Table) -> pa.Table:
    """A part of the vocabulary: words with training counts above zero, ascending."""
    h = np.concatenate([_of(x, "<u8") for x in asked.column("a").combine_chunks()])
    c = np.concatenate([_large(x)[0] for x in asked.column("b").combine_chunks()])
    kinds, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, c, len(kinds)).astype("<i8")
    known = total > 0
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([kinds[known].astype("<u8").tobytes()], pa.binary()), pa.array([total[known].tobytes()], pa.binary()), pa.array([int(known.sum())], pa.int64()), pa.array([int(total.sum())], pa.int64())], ["part", "words", "counts", "kinds", "tokens"])


def _hot(vocabulary: DataFrame, least: float) -> np.ndarray:
    """Contexts with more than `least` customers, with their counts: few, as counts add up to all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column(0), batch.column(1), strict=True):
                w, c = _of(w, "<i8"), _of(c, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(w[c > least]), pa.array(c[c > least])], ["word", "n"])

    rows = vocabulary.select("words", "counts").mapInArrow(run, "word long, n long").collect()
    out = np.array(sorted((r.word & (1 << 64) - 1, r.n) for r in rows), np.uint64).reshape(-1, 2)
    return out


def _ask_pairs(parts: int, hot: np.ndarray) -> Callable:
    """Of a chunk: (part, chunk, contexts, pairs of each, following words, training counts)."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs, parts)
        chunk.pairs(hot[:, 0], parts)
        counts = np.bincount(chunk.pair, chunk.train[chunk.owner], len(chunk.u))
        rows = []
        for p, m in _runs(chunk.pair_part):
            u = chunk.u[m]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1, [len(u)]])
            rows.append((0, p, key[0].as_py(), _pack(chunk.kinds[u[cut[:-1]]]), _small(np.diff(cut)), _pack(chunk.kinds[chunk.w[m]]), _small(counts[m]), None))
        return _table(rows)

    return run


def _seat_pairs(parts: int, distinct: int, hot: np.ndarray) -> Callable:
    """Seat a part's context restaurants. Rows out, by kind: 0 answers to chunks (customers and tables of each pair they
    named), 1 tables of words for the parent, 2 tables of contexts."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        part = key[0].as_py()
        columns = [asked.column(n).combine_chunks() for n in ("a", "b", "c", "d")]
        u = np.concatenate([np.repeat(_unpack(a), _large(b)[0]) for a, b in zip(columns[0], columns[1], strict=True)])
        w = np.concatenate([_unpack(c) for c in columns[2]])
        counts = [_large(d)[0] for d in columns[3]]
        size = [len(x) for x in counts]
        _, first, inverse = np.unique(chain(u, w), return_index=True, return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts), len(first)).astype(np.int64)
        contexts, context = np.unique(u[first], return_inverse=True)
        follow, following = np.unique(w[first], return_inverse=True)
        known = c > 0
        customers = np.bincount(context, c, len(contexts))
        # a context that is dealt over parts has a share of its tables here
        share = np.ones(len(contexts))
        if len(hot):
            order = np.argsort(_low(hot[:, 0]))
            names, total = _low(hot[:, 0])[order], hot[order, 1]
            at = np.minimum(np.searchsorted(names, contexts), len(hot) - 1)
            dealt = names[at] == contexts
            share[dealt] = np.maximum(customers[dealt], 1) / total[at][dealt]
        rng = np.random.default_rng([17, part])
        # a dish of one customer has one table in every seating
        many, once = np.flatnonzero(c > 1), np.flatnonzero(c == 1)
        dish, room, t, samples = following[many], context[many], np.ones(len(many)), []
        below, within = np.bincount(following[once], minlength=len(follow)), np.bincount(context[once], minlength=len(contexts))
        above = ((below + np.bincount(dish, t, len(follow))) > 0).astype(np.float64)
        for sweep in range(BURN_IN + SAMPLES):
            # the parent's customers are these restaurants' tables; it is seated again in each sweep
            guests = below + np.bincount(dish, t, len(follow))
            above = seat(guests.astype(np.int64), above.sum() - above, np.full(len(follow), 1 / (distinct + 1)), WORD_S, WORD_D, rng)
            # a dish's own tables are taken away, here and above, before its customers sit down again
            others = guests[dish] - t
            chance = np.maximum(others - WORD_D * np.minimum(above[dish], others), 0) + (WORD_S + WORD_D * above.sum()) / (distinct + 1)
            chance /= WORD_S + guests.sum() - t
            tables = within + np.bincount(room, t, len(contexts))
            t = seat(c[many], (tables / share)[room] - t, chance, PAIR_S, PAIR_D, rng)
            if sweep >= BURN_IN:
                samples.append(known.astype(np.float64))
                samples[-1][many] = t
        more = [(x - known).astype(np.uint32) for x in samples]
        rows, at = [], 0
        for chunk, n in zip(asked.column("src").to_pylist(), size, strict=True):
            own = inverse[at : at + n]
            rows.append((0, chunk, part, _small(c[own], *(x[own] for x in more)), None, None, None, None))
            at += n
        for kind, names, number in ((1, follow, following), (2, contexts, context)):
            own_part = part_of(names, parts)
            sums = [np.bincount(number, x, len(names)) for x in samples]
            some = sums[0] > 0
            names, own_part, sums = names[some], own_part[some], [x[some] for x in sums]
            order = np.argsort(own_part, kind="stable")
            for p, m in _runs(own_part[order]):
                rows.append((kind, p, part, _pack(names[order][m]), _small(*(x[order][m] for x in sums)), None, None, None))
        return _table(rows)

    return run


def _seat_words(distinct: int) -> Callable:
    """A part of the parent restaurant: for each word its customers (tables of contexts) and tables, and its own tables as a context."""

    def run(key: tuple, known: pa.Table, tables: pa.Table) -> pa.Table:
        if not known.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int32(), *[pa.binary()] * 5, *[pa.list_(pa.float64())] * 2)], ["part", "words", "counts", "customers", "tables", "own", "all_customers", "all_tables"])
        h, c = _of(known.column("words")[0], "<u8"), known.column("counts")[0].as_py()
        order = np.argsort(_low(h))
        low = _low(h)[order]
        sums = np.zeros((2, SAMPLES, len(h)))
        for kind, a, b in zip(tables.column("kind").to_pylist(), tables.column("a").combine_chunks(), tables.column("b").combine_chunks(), strict=True):
            t, names = _large(b), _unpack(a)
            at = np.minimum(np.searchsorted(low, names), max(len(h) - 1, 0))
            hit = low[at] == names if len(h) else np.zeros(len(names), bool)
            for s in range(SAMPLES):
                sums[kind - 1, s] += np.bincount(order[at[hit]], t[s][hit], len(h))
        customers = np.maximum(sums[0], 1)  # a training token has a table somewhere
        rng = np.random.default_rng([19, key[0].as_py()])
        own = []
        for s in range(SAMPLES):
            tables_ = np.ones(len(h))
            for _ in range(BURN_IN):
                # the part holds its share of all words, so it sees that share of the tables of all
                around = (tables_.sum() - tables_) * max(distinct / max(len(h), 1), 1.0)
                tables_ = seat(customers[s].astype(np.int64), around, np.full(len(h), 1 / (distinct + 1)), WORD_S, WORD_D, rng)
            own.append(tables_)
        blob = lambda xs: pa.array([_small(*xs)], pa.binary())
        totals = lambda xs: pa.array([[float(x.sum()) for x in xs]], pa.list_(pa.float64()))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([c], pa.binary()), blob(customers), blob(own), blob(sums[1]), totals(customers), totals(own)],
                        ["part", "words", "counts", "customers", "tables", "own", "all_customers", "all_tables"])

    return run


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int
    customers: tuple[float, ...]  # of the parent restaurant, in each sample
    tables: tuple[float, ...]

    def unknown(self, s: int) -> float:
        return (WORD_S + WORD_D * self.tables[s]) / (WORD_S + self.customers[s]) / (self.distinct + 1)


def _answer_words(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    """(kind 1, chunk, part): each word's training counts, and in each sample its customers and tables in the parent and its tables as a context."""
    h, facts = np.zeros(0, np.uint64), []
    if known.num_rows:
        h, facts = _of(known.column("words")[0], "<u8"), [_of(known.column("counts")[0], "<i8")]
        for own in zip(*(_large(known.column(n)[0]) for n in ("customers", "tables", "own")), strict=True):
            facts += own
    rows = []
    for chunk, a in zip(asked.column("src").to_pylist(), asked.column("a").combine_chunks(), strict=True):
        own = _of(a, "<u8")
        at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
        hit = h[at] == own if len(h) else np.zeros(len(own), bool)
        out = np.zeros((1 + 3 * SAMPLES, len(own)), np.int64)
        for k, x in enumerate(facts):
            out[k, hit] = x[at[hit]]
        rows.append((1, chunk, key[0].as_py(), _small(*out), None, None, None, None))
    return _table(rows)


def _score(parts: int, hot: np.ndarray, totals: Totals) -> Callable:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs, parts)
        chunk.pairs(hot[:, 0], parts)
        kind, src = answers.column("kind").to_numpy(), answers.column("src").to_numpy()
        blobs = answers.column("a").combine_chunks()

        def facts(k: int) -> list[np.ndarray]:
            rows = np.flatnonzero(kind == k)
            parts_ = [_large(blobs[i]) for i in rows[np.argsort(src[rows])].tolist()]
            return [np.concatenate(x).astype(np.float64) for x in zip(*parts_, strict=True)]

        c, *by_word = facts(1)
        customers, *extra = facts(0)
        prob = np.zeros(len(chunk.u))
        for s in range(SAMPLES):
            inner, tables, own_tables = by_word[3 * s : 3 * s + 3]
            parent = np.maximum(inner - WORD_D * tables, 0) / (WORD_S + totals.customers[s]) + totals.unknown(s)
            back = np.minimum((PAIR_S + PAIR_D * own_tables) / (PAIR_S + c), 1)
            seated = extra[s] + (customers > 0)
            prob += np.maximum(customers - PAIR_D * seated, 0) / (PAIR_S + c[chunk.u]) + back[chunk.u] * parent[chunk.w]
        base = np.log10((c + 0.5) / (totals.tokens + 0.5 * (totals.distinct + 1)))
        sums = [np.bincount(chunk.owner, x, chunk.docs) for x in (base[chunk.word], np.log10(prob / SAMPLES)[chunk.pair], (c > 0).astype(np.float64)[chunk.word])]
        return pa.table([docs.column("doc_id"), pa.array(~chunk.train), pa.array(chunk.count), pa.array(sums[2].astype(np.int64)), pa.array(np.full(chunk.docs, totals.tokens)), pa.array(sums[0]), pa.array(sums[1])],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number of each row's place in its file, which is the same whenever the row is read."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")
    try:
        return texts(docs, place)
    except AnalysisException:
        return texts(written(texts(docs), "texts"), place)


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    arrow_limits(spark)
    docs = _placed(docs).withColumn("train", fold(MODULUS) != HELD_OUT)
    size = docs.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first().n or 0
    chunks = parts = max(1, -(-int(size) // chunk_bytes))

    def dealt(rows: DataFrame, key: str) -> GroupedData:
        """Groups by chunk or part, over as many tasks."""
        return rows.repartition(chunks, key).groupBy(key)

    chunked = dealt(docs.withColumn("chunk", F.pmod("place", F.lit(chunks)).cast("int")).drop("place"), "chunk")
    asked = chunked.applyInArrow(_ask_words(parts), BLOBS)
    vocabulary = written(dealt(asked.select(F.col("dest").alias("part"), "a", "b"), "part").applyInArrow(_add_words, "part int, words binary, counts binary, kinds long, tokens long"), "vocabulary")
    row = vocabulary.agg(F.sum("kinds").alias("v"), F.sum("tokens").alias("n")).first()
    distinct, tokens = int(row.v or 0), int(row.n or 0)
    hot = _hot(vocabulary, tokens / (4 * parts))
    sweep(spark)

    pairs = chunked.applyInArrow(_ask_pairs(parts, hot), BLOBS)
    seated = written(dealt(pairs.withColumnRenamed("dest", "part"), "part").applyInArrow(_seat_pairs(parts, distinct, hot), BLOBS), "seated")
    sweep(spark)

    tables = dealt(seated.filter("kind > 0").withColumnRenamed("dest", "part"), "part")
    lists = "part int, words binary, counts binary, customers binary, tables binary, own binary, all_customers array<double>, all_tables array<double>"
    parent = written(dealt(vocabulary, "part").cogroup(tables).applyInArrow(_seat_words(distinct), lists), "parent")
    sums = [F.sum(F.get(n, F.lit(s))).alias(f"{n}{s}") for n in ("all_customers", "all_tables") for s in range(SAMPLES)]
    row = parent.agg(*sums).first()
    totals = Totals(tokens, distinct, tuple(row[f"all_customers{s}"] or 0.0 for s in range(SAMPLES)), tuple(row[f"all_tables{s}"] or 0.0 for s in range(SAMPLES)))
    sweep(spark)

    answers = dealt(asked.withColumnRenamed("dest", "part"), "part").cogroup(dealt(parent, "part")).applyInArrow(_answer_words, BLOBS)
    replies = dealt(seated.filter("kind = 0").unionByName(answers).withColumnRenamed("dest", "chunk"), "chunk")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = chunked.cogroup(replies).applyInArrow(_score(parts, hot, totals), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
