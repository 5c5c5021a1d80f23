"""The nearest vectors of each query, in cells of a part of the corpus and a block of the queries.

A cell's cosines are a matrix product, which says what could be among the k best; of that the cosines are computed anew,
coordinate after coordinate, so scores and ties are those of scoring.cosine(). Cells are groups of a cogroup: Spark deals
and shuffles them, none holds more than about PART vectors and BLOCK queries, and it gives about k rows a query.

Cases: vectors of another length than the query's, without a norm, with nulls, or null, have a cosine of 0; copies of a
vector tie exactly, and of those alike the k smallest ids are enough; norms that are extreme or not finite are always computed anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors and queries of a cell, about; products held at once; cosines computed anew at once.
PART, BLOCK, HELD, ANEW = 16_384, 8192, 1 << 22, 1 << 16
#: Products and cosines differ by less than this, and so do scores before and after they are rounded to nine digits.
SLACK = 1e-8


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as they are, and which have this length and no nulls; the others are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size, flat = lengths(column), column.flatten()
    values, start = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), np.cumsum(size) - size
    ok = size == dim
    if flat.null_count:
        gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        ok &= gaps[start + size] == gaps[start]
    out = np.zeros((len(size), dim))
    out[ok] = values[start[ok][:, None] + np.arange(dim)]
    return out, ok


def places(ids: pa.Array) -> np.ndarray:
    """Where each id is in their order, nulls first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64) if len(ids) else np.zeros(0, np.int64)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of columns, added one coordinate after the other."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


class _Side:
    """Vectors of one length, a column each; their norms; the same at length 1; which ones a product can't be trusted for."""

    def __init__(self, column: pa.Array, dim: int) -> None:
        x, ok = matrix(column, dim)
        self.x = np.ascontiguousarray(x.T)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_dots(self.x, self.x))
            self.odd = ~((self.norm == 0) | ((self.norm > 1e-100) & (self.norm < 1e100)))
            self.odd |= (self.norm == 0) & (self.x != 0).any(axis=0)
            self.unit = np.where((self.norm > 0)[:, None] & ~self.odd[:, None], x / self.norm[:, None], 0.0)
        self.odd &= ok


def _cosines(rows: _Side, asked: _Side, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r))
    with np.errstate(all="ignore"):
        for a in range(0, len(r), ANEW):
            i, j = r[a : a + ANEW], q[a : a + ANEW]
            norm = rows.norm[i] * asked.norm[j]
            out[a : a + ANEW] = np.where((norm > 0) | np.isnan(norm), _dots(rows.x[:, i], asked.x[:, j]) / norm, 0.0)
    return out


def _place(group: np.ndarray) -> np.ndarray:
    """Numbers from 0 within runs of equal values."""
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return np.arange(len(group)) - np.repeat(at, np.diff(np.r_[at, len(group)]))


def _best(rows: _Side, asked: _Side, own: np.ndarray, k: int, weight: np.ndarray, bias: np.ndarray, alike: np.ndarray, place: np.ndarray, least: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (of `own`), queries and cosines of all pairs that could be among a query's k best by weight * cosine + bias."""
    m = asked.x.shape[1]
    floor, held = least - slack, 0
    odd_q = bool(asked.odd.any())
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settled() -> None:
        nonlocal kept, held
        r, q, s = (np.concatenate(x) for x in zip(*fresh, strict=True)) if fresh else kept[:3]
        fresh.clear()
        always = rows.odd[r] | asked.odd[q]
        on = always | (s >= floor[q])
        r, q, s = r[on], q[on], s[on]
        r, q, s, e = (np.concatenate(x) for x in zip(kept, (r, q, s, _cosines(rows, asked, r, q)), strict=True))
        order = np.lexsort((-s, q))
        at = order[_place(q[order]) == k - 1]
        floor[q[at]] = np.maximum(floor[q[at]], s[at] - slack)
        on = (rows.odd[r] | asked.odd[q]) | (s >= floor[q])
        r, q, s, e = r[on], q[on], s[on], e[on]
        order = np.lexsort((place[r], alike[r], bias[r], weight[r], e, q))
        r, q, s, e = r[order], q[order], s[order], e[order]
        keys = (q, e, weight[r], bias[r], alike[r])
        new = np.zeros(len(r), np.int64)
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
        on = _place(np.cumsum(new)) < k
        kept, held = (r[on], q[on], s[on], e[on]), 0

    step = max(64, HELD // max(1, m))
    for a in range(0, len(own), step):
        i = own[a : a + step]
        s = rows.unit[i] @ asked.unit.T
        s *= weight[i][:, None]
        s += bias[i][:, None]
        s[rows.odd[i]] = -np.inf
        if a == 0 and len(i) >= k:
            floor = np.maximum(floor, np.partition(s, len(i) - k, axis=0)[len(i) - k] - slack)
        hit = s >= floor
        hit[rows.odd[i]] = True
        if odd_q:
            hit[:, asked.odd] = True
        r, q = np.nonzero(hit)
        fresh.append((i[r], q, s[r, q]))
        held += len(r)
        if held > HELD // 4 + k * m:
            settled()
    settled()
    return kept[0], kept[1], kept[3]


def cogrouped(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int, slack: float = SLACK) -> DataFrame:
    """Rows of a corpus (id, vector, ...) with the queries (query_id, qvec, ...) of the same keys and their cosine as `cos`: for each query and key at least the k best.

    What is best: the corpus may have columns _weight and _bias (by _weight * cos + _bias), _alike (rows whose score is the same function of
    the cosine and of nothing else; the k smallest ids of these are enough), and _within (the k best of each of its values). Queries may have a column `least`: lower scores aren't asked for."""
    mine = [c for c in corpus.columns if c not in ("vector", "_weight", "_bias", "_alike", "_within", *keys)]
    theirs = [c for c in queries.columns if c not in ("qvec", "least", *keys)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for df, cs in ((queries, theirs), (corpus, mine)) for c in cs] + ["cos double"])
    names = [*theirs, *mine, "cos"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows

        def numbers(table: pa.Table, name: str, other: float) -> np.ndarray:
            return pc.fill_null(table[name], other).to_numpy() if name in table.column_names else np.full(table.num_rows, other)

        weight, bias, alike, least = numbers(left, "_weight", 1.0), numbers(left, "_bias", 0.0), numbers(left, "_alike", 0), numbers(right, "least", -np.inf)
        place = places(left["id"].combine_chunks())
        groups = [np.arange(n)]
        if "_within" in left.column_names:
            code = left["_within"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            order = np.argsort(code, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = lengths(right["qvec"].combine_chunks()) if right.num_rows and n else np.zeros(0, np.int64)
        for dim in np.unique(size):
            those = np.flatnonzero(size == dim)
            rows, asked = _Side(left["vector"], max(1, int(dim))), _Side(right["qvec"].take(pa.array(those)), max(1, int(dim)))
            if dim == 0:
                rows.unit[:], rows.norm[:], rows.odd[:] = 0, 0, False
            for own in groups:
                r, q, e = _best(rows, asked, own, k, weight, bias, alike, place, least[those], slack)
                found.append((r, those[q], e))
        r, q, e = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        columns = [right[c].take(pa.array(q)) for c in theirs] + [left[c].take(pa.array(r)) for c in mine] + [pa.array(e, pa.float64())]
        return pa.Table.from_arrays(columns, names)

    return corpus.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, schema)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, by: list[str] | None = None, slack: float = SLACK, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Rows of a corpus with each query and their cosine, as `cogrouped` gives them: at least the k best of each query.

    `by`: columns of the corpus that must equal the query's columns q_<name>; a null equals nothing."""
    by = by or []
    parts, blocks = max(1, -(-corpus.count() // part)), max(1, -(-queries.count() // block))
    rows, asked = corpus, queries
    for name in by:
        rows, asked = rows.withColumn(f"_by_{name}", F.col(name)).filter(F.col(name).isNotNull()), asked.withColumn(f"_by_{name}", F.col(f"q_{name}")).filter(F.col(f"q_{name}").isNotNull())
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumns({"_part": F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int")}).withColumn("_block", each(blocks))
    asked = asked.withColumns({"_block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")}).withColumn("_part", each(parts))
    return cogrouped(asked, rows, [*(f"_by_{name}" for name in by), "_part", "_block"], k, slack)


def same(*columns: str | Column) -> Column:
    """What _alike takes: one number for equal values."""
    return F.xxhash64(*columns)
