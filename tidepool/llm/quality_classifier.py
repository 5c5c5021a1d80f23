"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow regression trees are boosted on statistics of labelled texts; every path from a root is a conjunction of
thresholds. These rules are the features of a logistic regression with an absolute penalty, which leaves few of them,
and the ones left are compiled into one Spark column expression. Statistics are computed in Arrow batches; scoring is
an expression over them, so neither shuffles anything.

Training reads at most TRAIN_ROWS labelled rows (in the order of a hash of the id); every document is scored.

Cases: null text is empty, with statistics of zero, and scored like any other; with labels of one
kind alone every score is 0.88 (label 1) or 0.12, and without labels 0.5; rows repeat as given; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, fold, slices, text_bytes, texts
from .training import labelled, lasso_logistic, sigmoid
from .words import chain, words

TRAIN_ROWS = 20_000
MODULUS, HELD_OUT = 3, 1
TREES, DEPTH, RATE, BINS, LEAST = 16, 3, 0.3, 48, 12
STRENGTH = 2e-4
WORK_BYTES = 1 << 20
STATISTICS = ["log_words", "word_length", "symbols", "upper", "digits", "punctuation", "wide", "lines", "distinct", "windows", "repeats", "long_words", "doubled"]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _DIGIT, _POINT, _LINE = _table("#*$%&|<>~^=_+@\\"), _table("0123456789"), _table(".,;:!?"), _table("\n")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_WIDE = np.arange(256) >= 0xC0


def _distinct(owner: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    o, v = owner[order], values[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=docs)


def statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each of STATISTICS: rates and logarithms, so length alone decides little."""
    docs = len(offsets) - 1
    starts, ends, hashes, at = words(body, offsets, lower=False)
    n = np.diff(at)
    owner = np.repeat(np.arange(docs), n)
    size = np.bincount(owner, ends - starts, docs)

    def count(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return run[offsets[1:]] - run[offsets[:-1]]

    some, chars = np.maximum(n, 1), np.maximum(size, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    doubled = np.zeros(len(body), bool)
    doubled[1:] = (body[1:] == body[:-1]) & (_SYMBOL | _POINT)[body[1:]]
    three = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    window = chain(chain(hashes[three], hashes[three + 1]), hashes[three + 2]) if len(three) else np.zeros(0, np.uint64)
    return np.column_stack([
        np.log1p(n), size / some, count(_SYMBOL[body]) / chars, count(_UPPER[body]) / chars, count(_DIGIT[body]) / chars, count(_POINT[body]) / chars,
        count(_WIDE[body]) / chars, np.log1p(count(_LINE[body])) - np.log1p(n), _distinct(owner, hashes, docs) / some,
        _distinct(owner[three], window, docs) / np.maximum(n - 2, 1), np.bincount(owner[same], minlength=docs) / some,
        np.bincount(owner[ends - starts > 14], minlength=docs) / some, count(doubled) / chars,
    ]).astype(np.float64)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with its text replaced by STATISTICS; other columns go through."""
    arrow_limits(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select("text", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column(0))
            for a, b in slices(np.diff(offsets), WORK_BYTES):
                s = statistics(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), *(pa.array(np.ascontiguousarray(x)) for x in s.T)], [*others, *STATISTICS])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kinds, *(f"{s} double" for s in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most, threshold); `at most` false means above."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, low, t in self.terms:
            out &= (x[:, k] <= t) == low
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, low, t in self.terms:
            out = out & (F.col(STATISTICS[k]) <= t if low else F.col(STATISTICS[k]) > t)
        return out


def _simpler(terms: tuple[tuple[int, bool, float], ...]) -> tuple[tuple[int, bool, float], ...]:
    """The tightest threshold for each statistic and side."""
    best: dict[tuple[int, bool], float] = {}
    for k, low, t in terms:
        best[k, low] = (min if low else max)(best.get((k, low), t), t)
    return tuple(sorted((k, low, t) for (k, low), t in best.items()))


def grow(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list[Rule]]:
    """A regression tree on a random half of the rows: its predictions for all, and the rule of every path."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    half = rng.random(len(x)) < 0.5
    out, rules = np.zeros(len(x)), []

    def split(rows: np.ndarray, terms: tuple, depth: int) -> None:
        mine = rows[half[rows]]
        if terms:
            rules.append(Rule(_simpler(terms)))
        out[rows] = target[mine].mean() if len(mine) else 0.0
        if depth == 0 or len(mine) < 2 * LEAST:
            return
        best, pick = 1e-9, None
        total, n = target[mine].sum(), len(mine)
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            side = np.searchsorted(c, x[mine, k], "left")
            left_n = np.cumsum(np.bincount(side, minlength=len(c) + 1))[:-1]
            left = np.cumsum(np.bincount(side, target[mine], len(c) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left**2 / left_n + (total - left) ** 2 / (n - left_n) - total**2 / n
            gain[(left_n < LEAST) | (n - left_n < LEAST)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, pick = gain[i], (k, float(c[i]))
        if pick:
            low = x[rows, pick[0]] <= pick[1]
            split(rows[low], (*terms, (pick[0], True, pick[1])), depth - 1)
            split(rows[~low], (*terms, (pick[0], False, pick[1])), depth - 1)

    split(np.arange(len(x)), (), DEPTH)
    return out, rules


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over STATISTICS."""
        total = F.lit(self.intercept)
        for rule, w in self.rules:
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model((), 0.0 if len(y) == 0 else 2.0 if y[0] else -2.0)
    rng, at = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        step, own = grow(x, y - sigmoid(at), rng)
        at += RATE * step / max(1e-3, float((sigmoid(at) * (1 - sigmoid(at))).mean()))
        rules |= dict.fromkeys(own)
    holds, kept = [], []
    seen = set()
    for r in rules:
        h = r.holds(x)
        if 0 < h.sum() < len(y) and (key := h.tobytes()) not in seen:
            seen.add(key)
            holds.append(h)
            kept.append(r)
    if not kept:
        return Model((), float(at[0]))
    w, b = lasso_logistic(np.column_stack(holds).astype(np.float64), y, STRENGTH)
    return Model(tuple((r, float(v)) for r, v in zip(kept, w, strict=True) if abs(v) > 1e-6), b)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    got = with_statistics(labelled(docs, labels, target, MODULUS, HELD_OUT, rows)).toPandas().sort_values("doc_id")
    return fit(got[STATISTICS].to_numpy(), got["label"].to_numpy(np.float64))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = with_statistics(texts(docs)).select("doc_id", (fold(MODULUS) == HELD_OUT).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
