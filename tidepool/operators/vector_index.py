"""An inverted-file index of vectors: lists around centroids, searched by an equi-join of probes and lists.

Centroids are fitted by spherical k-means on at most SAMPLE vectors, those with the smallest hashes of their ids; every
vector is then put into the list of its nearest centroid. A list is cut into pieces of about PIECE vectors, and a probe
goes to each piece, so a list that holds a third of all vectors is as many tasks' work. Vectors of another length or
without a norm have a list of their own, which every query probes (their cosine is 0).

search() probes the nearest lists; probes_for() measures how many are needed for a recall. search_exact() goes on to every list that could still hold something as good as the
k-th best so far: by the triangle inequality for angles, none of a list's vectors is nearer to a query than the
centroid's angle less the list's radius. Its result is that of a scan of all vectors.

Cases: an index of no vectors has no lists and gives no hits; ties go to the smaller id; a query without a norm has a
score of 0 everywhere; a null vector is one of length 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .nearest import cogrouped, matrix
from .scoring import top

#: Vectors that centroids are fitted on, at most; lists at most; vectors of a piece, about.
SAMPLE, LISTS, PIECE = 16_384, 1024, 4096
OTHERS = -1
#: Queries that measure how many lists are needed.
TRIALS = 128
#: Angles are of 64-bit numbers; bounds give way by this much.
SLIP = 1e-6


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which rows have the right length and a norm; the others are 0."""
    out, ok = matrix(column, dim)
    norm = np.sqrt((out * out).sum(axis=1))
    ok &= norm > 0
    out[ok] /= norm[ok, None]
    return out, ok


def fit(vectors: DataFrame, lists: int, dim: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length, from a bounded sample; fewer than asked for where there are fewer distinct vectors."""
    rows = vectors.filter(F.size("vector") == dim).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x, ok = _matrix(pa.array([r.vector for r in rows], pa.list_(pa.float64())), dim)
    x = np.unique(x[ok], axis=0)
    if not len(x):
        return np.zeros((0, dim))
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], c)
    return c


class VectorIndex:
    """Lists of (id, vector), stored in the shared folder."""

    def __init__(self, vectors: DataFrame, dim: int, lists: int | None = None, sample: int = SAMPLE, piece: int = PIECE) -> None:
        n = vectors.count()
        self.dim = dim
        self.centroids = fit(vectors, min(LISTS, lists or max(1, int(np.sqrt(n)))), dim, sample)
        c, d = self.centroids, dim
        kind = vectors.schema["id"].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ok = _matrix(batch.column(1), d)
                near, angle = np.full(len(x), OTHERS), np.zeros(len(x))
                if len(c) and ok.any():
                    cos = x[ok] @ c.T
                    near[ok] = cos.argmax(axis=1)
                    angle[ok] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(angle)], ["id", "vector", "list", "angle"])

        element = vectors.schema["vector"].dataType.simpleString()
        dealt = stored(vectors.select("id", "vector").mapInArrow(assign, f"id {kind}, vector {element}, list int, angle double"), "vector-lists")
        #: Size and radius of each list: LISTS + 1 rows at most.
        self.facts = [(r["list"], r["n"], r["radius"]) for r in dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()]
        pieces = {k: -(-size // piece) for k, size, _ in self.facts}
        self.pieces = pieces
        many = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pieces.items() if v > 1]
        of = F.coalesce(F.map_from_entries(F.array(*many))[F.col("list")], F.lit(1)) if many else F.lit(1)
        self.rows = dealt.select("id", "vector", "list", F.pmod(F.xxhash64("id"), of).cast("int").alias("piece"))

    def _probes(self, queries: DataFrame, probes: int, least: DataFrame | None = None) -> DataFrame:
        """(query_id, qvec, list, piece): the nearest lists of each query; or, given a least score a query, the others that could reach it."""
        c, d, facts, pieces = self.centroids, self.dim, self.facts, self.pieces
        known = np.array([k for k, _, _ in facts if k >= 0], int)
        radius = np.array([r for k, _, r in facts if k >= 0])
        kind, element = queries.schema["query_id"].dataType.simpleString(), queries.schema["qvec"].dataType.simpleString()
        asked = queries.select("query_id", "qvec", F.lit(None).cast("double").alias("least")) if least is None else queries.join(least, "query_id", "left").select("query_id", "qvec", "least")
        first = least is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ok = _matrix(batch.column(1), d)
                cos = np.clip(x @ c[known].T, -1, 1) if len(known) else np.zeros((len(x), 0))
                order = np.argsort(-cos, axis=1, kind="stable")
                rows: list[tuple[int, int, int]] = []
                for i in range(len(x)):
                    near = order[i][:probes] if ok[i] else order[i][:0]
                    if first:
                        chosen = [OTHERS, *known[near].tolist()]
                    elif not ok[i]:
                        chosen = known.tolist()
                    else:
                        rest = order[i][probes:]
                        at = batch.column(2)[i].as_py()
                        best = np.cos(np.maximum(np.arccos(cos[i][rest]) - radius[rest], 0)) + SLIP
                        chosen = known[rest if at is None else rest[best >= at]].tolist()
                    rows += [(i, k, p) for k in chosen for p in range(pieces.get(k, 0))]
                at_ = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at_), batch.column(1).take(at_), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["query_id", "qvec", "list", "piece"])

        return asked.mapInArrow(run, f"query_id {kind}, qvec {element}, list int, piece int")

    def _scored(self, probed: DataFrame, k: int) -> DataFrame:
        """The k best of each piece and query that probes it."""
        return cogrouped(probed, self.rows, ["list", "piece"], k).select("query_id", "id", F.col("cos").alias("score"))

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """The k nearest (query_id, id, score, rank) among the lists that lie nearest to each query (query_id, qvec)."""
        return top(self._scored(self._probes(queries, probes), k), ["query_id"], k)

    def probes_for(self, k: int, recall: float = 0.95, queries: int = TRIALS) -> int:
        """How many lists to probe for this share of the k nearest, measured with some of the indexed vectors as queries: TRIALS * k rows come here."""
        trial = self.rows.filter(F.col("list") != OTHERS).orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(queries).select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
        trial = stored(trial, "trial-queries")
        asked = {r.query_id: r.qvec for r in trial.collect()}
        near = self.search_exact(trial, k).join(self.rows.select("id", "list"), "id").filter(F.col("list") != OTHERS).select("query_id", "list").collect()
        x, _ = _matrix(pa.array(list(asked.values()), pa.list_(pa.float64())), self.dim)
        place = {q: np.argsort(np.argsort(-row, kind="stable")) for q, row in zip(asked, x @ self.centroids.T, strict=True)}
        at = sorted(int(place[r.query_id][r.list]) for r in near)
        return 1 + at[min(len(at) - 1, int(np.ceil(recall * len(at))))] if at else 1

    def search_exact(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """The k nearest among all vectors."""
        first = stored(self.search(queries, k, probes).drop("rank"), "first-hits")
        reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query_id", "least")
        rest = self._probes(queries, probes, reached).join(reached, "query_id", "left")
        return top(first.unionByName(self._scored(rest, k)), ["query_id"], k)
