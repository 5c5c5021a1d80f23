"""Toxicity: a counterfactual-regularised classifier over words and word beginnings.

A text's features are the words in it (runs of letters, lower-cased) and their first 4 to 7 bytes, as 64-bit hashes,
each present or not. Features that separate the labels are chosen by document counts, which partitions add up before
they meet. Weights are a logistic regression with a squared penalty and a counterfactual one: in every labelled sentence
that mentions a group, its terms are swapped for each other one of their lists (all of a sentence by the same number of
places), and every change of the score that this makes is penalised, as often as it occurs.
So a neutral mention of a group weighs no more than that of another, and terms can't become signs of toxicity.

Training reads at most TRAIN_ROWS labelled rows (in the order of a hash of the id); every document is scored, whole.

Cases: null text is empty and gets the score of no features; without labels of both kinds the score is the share of
label 1, or 0; rows repeat as given; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, discard, fold, slices, text_bytes, texts, written
from .training import labelled, sigmoid
from .words import bounds, mix, running, span

TRAIN_ROWS = 20_000
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
#: So many features, the best over all; their counts are added up in so many groups of hashes.
FEATURES, GROUPS = 6144, 32
LEAST_TOXIC = 4
PENALTY, COUNTERFACTUAL = 5e-5, 1.0
WORK_BYTES = 1 << 20
#: Terms that name groups of people; a term is swapped for the others of its line.
IDENTITY = [
    "women men girls boys woman man girl boy",
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "black white asian latino african european american arab",
    "gay straight lesbian bisexual transgender queer",
    "immigrants refugees foreigners natives disabled elderly",
    "frauen männer mädchen jungen", "muslime christen juden buddhisten", "schwarze weiße ausländer flüchtlinge",
    "femmes hommes filles garçons", "musulmans chrétiens juifs bouddhistes", "noirs blancs étrangers réfugiés",
    "mujeres hombres niñas niños", "musulmanes cristianos judíos budistas", "negros blancos extranjeros refugiados",
]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every feature of every word, with the number of its text."""
    if len(body) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends = bounds(body, offsets, ~_LETTER)
    run = running(body, lower=True)
    owner = np.searchsorted(offsets, starts, "right") - 1
    found, where = [mix(span(run, starts, ends) ^ np.uint64(0x77))], [owner]
    for k in PREFIXES:
        long = ends - starts >= k
        found.append(mix(span(run, starts[long], starts[long] + k) + np.uint64(k)))
        where.append(owner[long])
    return np.concatenate(found), np.concatenate(where)


def _unique(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def _of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[0])


def _counts(train: DataFrame) -> DataFrame:
    """(feature, gain) of the features that separate the labels best, a fixed number of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, offsets = text_bytes(batch.column(0))
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(np.diff(offsets), WORK_BYTES):
                label = labels[a:b]
                h, o = _unique(*features(every[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                kinds, inverse = np.unique(h, return_inverse=True)
                total, toxic = np.bincount(inverse, minlength=len(kinds)), np.bincount(inverse, label[o], len(kinds)).astype(np.int64)
                group = (kinds % np.uint64(GROUPS)).astype(np.int32)
                for g in range(GROUPS):
                    m = group == g
                    if m.any():
                        blob = np.stack([kinds[m].view(np.int64), total[m], toxic[m]])
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([blob.tobytes()], pa.binary()), pa.array([0 if g else len(label)], pa.int64())], ["grp", "counts", "docs"])

    def choose(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, total, toxic = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            got = np.concatenate([np.stack([kinds, total, toxic]), *(np.frombuffer(x.as_buffer(), np.int64).reshape(3, -1) for x in batch.column(1))], axis=1)
            kinds, inverse = np.unique(got[0], return_inverse=True)
            total, toxic = (np.bincount(inverse, got[i], len(kinds)).astype(np.int64) for i in (1, 2))
        keep = toxic >= LEAST_TOXIC
        kinds, total, toxic = kinds[keep], total[keep], toxic[keep]
        # how sure a feature is of label 1, times how much it covers
        gain = toxic * np.log((toxic + 0.5) / (total + 1) / 0.5)
        top = np.lexsort((kinds, -gain))[:FEATURES]
        top = top[gain[top] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(kinds[top]), pa.array(gain[top].astype(np.float64))], ["feature", "gain"])

    slim = train.select("text", "label")
    return slim.mapInArrow(partial, "grp int, counts binary, docs long").groupBy("grp").applyInArrow(choose, "feature long, gain double").orderBy(F.desc("gain"), "feature").limit(FEATURES)


def _shifts() -> tuple[re.Pattern, list[dict[str, str]]]:
    """What finds identity terms, and for each number of places the term that takes each one's place; lines that are shorter have none."""
    lines = [line.split() for line in IDENTITY]
    swaps = [{t: line[(i + k) % len(line)] for line in lines if k < len(line) for i, t in enumerate(line)} for k in range(1, max(map(len, lines)))]
    return re.compile(r"\b(" + "|".join(map(re.escape, swaps[0])) + r")\b"), swaps


def _examples(train: DataFrame, known: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Chosen features (as numbers) of each labelled row, the labels, and what swaps of identity terms change in sentences, with how often.

    Different changes are as many as terms and the word beginnings that they share with a sentence's other words."""
    pattern, swaps = _shifts()

    def numbers(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        return at[known[at] == h] if len(known) else np.zeros(0, np.int64)

    def change(sentence: str, swap: dict[str, str]) -> np.ndarray:
        before, after = numbers(_of(sentence)), numbers(_of(pattern.sub(lambda m: swap.get(m[0], m[0]), sentence)))
        return np.concatenate([~np.setdiff1d(before, after), np.setdiff1d(after, before)]).astype("<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, changes = [], []
            for text in batch.column(0).to_pylist():
                rows.append(numbers(_of(text)).astype("<i4").tobytes())
                own = []
                for sentence in _SENTENCE.findall(text.lower()) if pattern.search(text.lower()) else ():
                    if pattern.search(sentence):
                        own += [c.tobytes() for c in (change(sentence, swap) for swap in swaps) if len(c)]
                changes.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.binary()), batch.column(1), pa.array(changes, pa.list_(pa.binary()))], ["doc_id", "found", "label", "changes"])

    kind = train.schema["doc_id"].dataType.simpleString()
    found = written(train.select("text", "label", "doc_id").mapInArrow(run, f"doc_id {kind}, found binary, label int, changes array<binary>"), "examples")
    got = sorted(found.select("doc_id", "found", "label").collect(), key=lambda r: r.doc_id)
    moved = {bytes(r.change): r.n for r in found.select(F.explode("changes").alias("change")).groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    discard(found)
    # the same for a neutral mention of every term, so the penalty never rests on what the corpus happens to mention
    for swap in swaps:
        for t in swap:
            if len(c := change(f"they are {t}", swap)):
                moved[c.tobytes()] = moved.get(c.tobytes(), 0) + 1
    changes = sorted(moved)
    return [np.frombuffer(r.found, "<i4") for r in got], np.array([r.label for r in got], np.float64), [np.frombuffer(c, "<i4") for c in changes], np.array([moved[c] for c in changes], np.float64)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # ascending
    weights: np.ndarray
    intercept: float


def solve(rows: list[np.ndarray], y: np.ndarray, changes: list[np.ndarray], p: int, times: np.ndarray | None = None, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared and a counterfactual penalty, by gradient steps with momentum. Changes count as often as `times` says."""
    times = np.ones(len(changes)) if times is None else times
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    swap = np.concatenate(changes) if changes else np.zeros(0, np.int64)
    change = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    sign, swap = np.where(swap < 0, -1.0, 1.0), np.where(swap < 0, ~swap, swap)
    n, m = len(y), max(times.sum(), 1)
    degree = np.bincount(row, minlength=n)
    step = 1 / (0.25 * (1 + degree.mean() * 4) + PENALTY + COUNTERFACTUAL * 4)
    w, b, z, c, t = np.zeros(p), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(p), 0.0, 1.0
    c = b
    for _ in range(rounds):
        off = sigmoid(np.bincount(row, z[at], n) + c) - y
        grad = np.bincount(at, off[row], p) / n + PENALTY * z
        if len(changes):
            moved = np.bincount(change, sign * z[swap], len(changes))
            grad += COUNTERFACTUAL * np.bincount(swap, sign * (times * moved)[change], p) / m
        new, new_b = z - step * grad, c - step * off.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    arrow_limits(docs.sparkSession)
    some = written(labelled(docs, labels, target, MODULUS, HELD_OUT, rows), "labelled")
    known = np.array(sorted(r.feature for r in _counts(some).collect()), np.int64).view(np.uint64)
    known.sort()
    examples, y, changes, times = _examples(some, known)
    if len(y) == 0 or y.min() == y.max():
        return Model(known[:0], np.zeros(0), 0.0 if len(y) and y[0] else -40.0)
    w, b = solve(examples, y, changes, len(known), times)
    return Model(known, w, b)


def scorer(model: Model) -> Callable[[Column], Column]:
    """A column function from texts to scores in (0, 1). Only texts go to Python, and one number each comes back."""
    known, weights, intercept = model.features, model.weights, model.intercept

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        body, offsets = text_bytes(column)
        total = np.full(len(column), intercept)
        for a, b in slices(np.diff(offsets), WORK_BYTES) if len(known) else []:
            h, o = features(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            pairs = np.unique(o[hit] * np.int64(len(known)) + at[hit])
            total[a:b] += np.bincount(pairs // len(known), weights[pairs % len(known)], b - a)
        return pa.array(sigmoid(total))

    return lambda text: score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    arrow_limits(docs.sparkSession)
    docs = texts(docs).withColumn("score", scorer(model)(F.col("text")))
    return docs.select("doc_id", (fold(MODULUS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    arrow_limits(docs.sparkSession)
    names = docs.columns
    mark = "_score" + "_" * max((len(c) for c in names), default=0)
    return docs.withColumn(mark, scorer(model)(F.col("text"))).filter(F.col(mark) < THRESHOLD).select(*names)
