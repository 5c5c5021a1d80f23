"""Searches over stored indexes of words and of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as O
from ..operators.text_index import TextIndex, candidates
from ..operators.vector_index import VectorIndex
from ..sources import tables as S
from ..sources.store import new_path
from .registry import query
from .scoring import BM, TOPV, _queries

DIM = 64


@query("posting_topk", f"WITH {BM}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bs) SELECT query_id, id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def posting_topk(spark: SparkSession, d: str) -> DataFrame:
    """An index made of two segments, one appended to the other; then the best documents for every benchmark item."""
    docs = S.parquet(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    index = TextIndex(spark, new_path(spark, "text-index"))
    index.add(docs.filter("id % 2 = 0"))
    index.add(docs.filter("id % 2 <> 0"))
    q = S.parquet(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    return O.top(index.bm25(q, 10).withColumn("score", F.round("score", 6)), ["query_id"], 10).select("query_id", "id", "score", "rank")


TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))"


@query("event_candidates", f"""WITH t AS (SELECT conv_id, turn, role, {TOK} AS w FROM conversations), q AS (SELECT DISTINCT conv_id AS query_id, unnest(w[:3]) AS token FROM t WHERE turn = 0),
 n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), b AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'summary' WHEN role = 'user' THEN 'utterance' ELSE 'evidence' END AS branch, w FROM t),
 p AS (SELECT DISTINCT conv_id, turn, branch, unnest(w) AS token FROM b), m AS (SELECT query_id, conv_id, turn, branch FROM p JOIN q USING (token) JOIN n USING (query_id) GROUP BY query_id, conv_id, turn, branch, n HAVING count(*) = n),
 e AS (SELECT query_id, conv_id AS event_id, CAST(max(CASE branch WHEN 'summary' THEN 1.0 WHEN 'utterance' THEN 0.8 ELSE 0.6 END) AS DOUBLE) AS score, max(CASE WHEN turn % 3 > 0 THEN CASE branch WHEN 'summary' THEN 10000 WHEN 'utterance' THEN 8000 ELSE 6000 END + turn END) % 1000 AS source_id, array_to_string(list_sort(list(DISTINCT branch)), ',') AS branches FROM m GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM e) SELECT query_id, event_id, score, CAST(source_id AS INTEGER) AS source_id, branches, rank FROM r WHERE rank <= 10""")
def event_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For every conversation the best whose opening, user's turns or answers have the first words of its opening; the source is a turn's number where that isn't a multiple of three."""
    t = S.parquet(spark, d, "conversations").withColumn("id", F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("conv_id", "turn"))))
    branch = F.when(F.col("turn") == 0, "summary").when(F.col("role") == "user", "utterance").otherwise("evidence")
    indexes, owners = {}, {}
    for name in ("summary", "utterance", "evidence"):
        own = t.filter(branch == name)
        indexes[name] = TextIndex(spark, new_path(spark, name), 16)
        indexes[name].add(own.select("id", "text"))
        owners[name] = own.select("id", F.col("conv_id").alias("event_id"), F.when(F.col("turn") % 3 > 0, F.col("turn")).cast("int").alias("source_id"))
    opening = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z0-9_]+)"), 1), 1, 3)
    q = t.filter("turn = 0 AND conv_id IS NOT NULL").select(F.col("conv_id").alias("query_id"), F.concat_ws(" ", opening).alias("text"))
    return candidates(indexes, owners, q, 10)


@query("ann_exact_topk", f"WITH {TOPV} SELECT query_id, id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def ann_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors by lists and bounds: the same as a scan of all."""
    index = VectorIndex(S.vectors(spark, d), DIM)
    return index.search_exact(_queries(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("ann_topk")
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of the nearest lists; recall against a scan is measured in the tests."""
    index = VectorIndex(S.vectors(spark, d), DIM)
    return index.search(_queries(spark, d), 10, probes=index.probes_for(10, 0.97)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")
