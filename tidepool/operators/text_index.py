"""Words of texts as postings, and a stored index of them, so that a search reads the asked words only.

Postings are (id, dl, token, tf) rows, made where the texts are read: each text's words are counted in its own task and
nothing is shuffled. The index stores them dealt by word into shards (folders), each sorted by word. It grows by
segments: one is whole or isn't there, as a segment counts once Spark's success file of its second table stands.
Shards and words that aren't asked for are ruled out before a file is opened, or by the statistics in it.

Postings meet queries in cells of a part of the texts and a block of the queries: groups of a cogroup, which Spark deals and shuffles.
A posting is shuffled once for each block, and what it adds to a query's texts is added within the cell. Events are found
in cells as well, of whole events, and a cell gives the best of each question only.

Cases: null and empty texts count as texts of length 0; a null id has postings and is a hit without an id; an id that is
added twice is two texts; a query without words has no hits.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import small, stored
from .nearest import places

#: Words as scoring.bm25_tokens() has them: ASCII words in lower case, and pairs of characters of Chinese runs.
RUN = re.compile(r"[A-Za-z0-9_]+|[一-鿿]+")
#: Asked words are broadcast up to so many, and named in the scan's filter up to so many.
MOST_WORDS, NAMED_WORDS = 200_000, 400
HELD = 1 << 17
#: Texts, postings and queries of a cell, about; scores or bits held at once; cells of a partition, from so many cells on.
PART, POSTINGS, BLOCK, SCORES, MOST_DEALT = 8192, 1 << 20, 4096, 1 << 22, 2000
#: Questions of a cell of events, about; texts looked up at once; a word is frequent if more than this part of a cell's texts have it.
QUESTIONS, CHECKED, FREQUENT = 1 << 18, 1 << 20, 64
#: Scores further apart than this are still apart when they are rounded to six digits.
SLACK = 2e-6
FIELDS = ["id", "dl", "token", "tf"]


def words_of(text: str) -> list[str]:
    out: list[str] = []
    for run in RUN.findall(text):
        if run[0] < "\x7f":
            out.append(run.lower())
        elif len(run) == 1:
            out.append(run)
        else:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def postings(docs: DataFrame, words: bool = True) -> DataFrame:
    """(id, dl, token, tf) for each word of each text (id, text), and a row with a null token for each text; without `words` only the latter."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: tuple[list, list, list] = ([], [], [])

            def out(ids: pa.Array, at: list[int] = at, rows: tuple[list, list, list] = rows) -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32())], FIELDS)
                for x in (at, *rows):
                    x.clear()
                return made

            for i, text in enumerate(batch.column(1).to_pylist()):
                found = words_of(text or "")
                counts = Counter(found) if words else {}
                at += [i] * (len(counts) + 1)
                rows[0].extend([len(found)] * (len(counts) + 1))
                rows[1].extend(counts)
                rows[1].append(None)
                rows[2].extend(counts.values())
                rows[2].append(0)
                if len(at) > HELD:
                    yield out(batch.column(0))
            if at:
                yield out(batch.column(0))

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, dl int, token string, tf int")


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, token, times) of a table of requests (query_id, text)."""
    return postings(queries.select(F.col("query_id").alias("id"), "text")).filter("token IS NOT NULL").groupBy(F.col("id").alias("query_id"), "token").agg(F.sum("tf").alias("times"))


@dataclass
class TextIndex:
    """An index in a folder: <path>/<segment>/words/shard=<n> and <path>/<segment>/texts."""

    spark: SparkSession
    path: str
    shards: int = 64

    def add(self, docs: DataFrame) -> None:
        """Append texts (id, text) as a segment. Texts are read once, for both of its tables, and large shards are written by several tasks."""
        at = f"{self.path}/{uuid.uuid4().hex}"
        rows = postings(docs).withColumn("shard", F.when(F.col("token").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("token"), F.lit(self.shards)).cast("int")))
        rows.hint("rebalance", "shard").sortWithinPartitions("shard", "token").write.partitionBy("shard").parquet(f"{at}/words")
        of = self.spark.read.schema(rows.schema).parquet(f"{at}/words").filter("shard = -1")
        of.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.lit(rows.schema["id"].dataType.simpleString()).alias("kind")).coalesce(1).write.parquet(f"{at}/texts")

    def segments(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(f"{self.path}/{x}" for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/texts/_SUCCESS")))

    def _texts(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{s}/texts" for s in self.segments()])

    def statistics(self) -> DataFrame:
        """One row: n texts and their mean length. It reads a row a segment."""
        return self._texts().agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))

    def of(self, words: DataFrame) -> DataFrame:
        """Postings of some words (token, each once): only their shards are opened."""
        segments = self.segments()
        kind = self._texts().first().kind
        rows = None
        for s in segments:
            one = self.spark.read.schema(f"id {kind}, dl int, token string, tf int, shard int").parquet(f"{s}/words")
            rows = one if rows is None else rows.unionByName(one)
        few, words = small(words.select("token"), MOST_WORDS)
        if few:
            shards = [r.shard for r in words.select(F.pmod(F.xxhash64("token"), F.lit(self.shards)).cast("int").alias("shard")).distinct().collect()]
            rows = rows.filter(F.col("shard").isin(shards))
            if words.count() <= NAMED_WORDS:
                rows = rows.filter(F.col("token").isin([r.token for r in words.collect()]))
        return rows.filter("shard >= 0").join(words, "token").select(*FIELDS)

    def bm25(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, id, score) of texts that have a word of a query (query_id, text); with k as weighed() cuts them."""
        asked = asked_words(queries)
        return weighed(self.of(asked.select("token").distinct()), asked, self.statistics(), k=k)

    def having_all(self, queries: DataFrame) -> DataFrame:
        """(query_id, id) of texts that have every word of a query."""
        asked = asked_words(queries)
        return having_all(self.of(asked.select("token").distinct()), asked)


def _cells(tf: DataFrame, postings: int, texts: int, terms: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Postings and the words of queries (query_id, token, ...) in cells: the texts of one id are in one part, the words of a query in one block."""
    parts = max(1, -(-texts // PART), -(-postings // POSTINGS))
    blocks = max(1, -(-terms.select("query_id").distinct().count() // BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = tf.select("id", "dl", "token", "tf", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_part"), each(blocks).alias("_block"))
    asked = terms.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_part", each(parts))
    # cells are work, not bytes, so they aren't left to be put together by their size
    n = min(MOST_DEALT, parts * blocks)
    rows, asked = (x.repartition(n, "_part", "_block").groupBy("_part", "_block") for x in (rows, asked))
    return rows.cogroup(asked).applyInArrow(run, schema)


def _coded(left: pa.Table, right: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, int]:
    """The ids of a cell and each posting's number among them; each posting's word; the queries and each term's number among them; each term's word; how many words there are.

    Words are numbered among those of the queries; a posting of another word has -1."""
    ids, asked = (x.combine_chunks().dictionary_encode(null_encoding="encode") for x in (left["id"], right["query_id"]))
    words = right["token"].combine_chunks().dictionary_encode()
    of = pc.fill_null(pc.index_in(left["token"].combine_chunks(), value_set=words.dictionary), -1)
    return ids.dictionary, ids.indices.to_numpy(), of.to_numpy(), asked.dictionary, asked.indices.to_numpy(), words.indices.to_numpy(), len(words.dictionary)


def _found(schema: str, ids: pa.Array, asked: pa.Array, r: np.ndarray, q: np.ndarray, *more: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([asked.take(pa.array(q, pa.int64())), ids.take(pa.array(r, pa.int64())), *map(pa.array, more)], [x.split()[0] for x in schema.split(", ")])


def _schema(tf: DataFrame, asked: DataFrame) -> str:
    return f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {tf.schema['id'].dataType.simpleString()}"


def having_all(tf: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id) of ids whose postings (of asked words) have every word of a query (query_id, token): a word's texts are bits, which are and-ed."""
    schema = _schema(tf, asked)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at, word, queries, query, term, words = _coded(left, right)
        # the last row is that of a word that no text has
        bits = np.zeros((words + 1, -(-len(ids) // 8)), np.uint8)
        on = word >= 0
        np.bitwise_or.at(bits, (word[on], at[on] >> 3), (128 >> (at[on] & 7)).astype(np.uint8))
        order = np.argsort(query, kind="stable")
        first = np.searchsorted(query[order], np.arange(len(queries) + 1))
        r, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, SCORES // max(1, len(ids)))
        for a in range(0, len(queries), step) if len(ids) else ():
            b = min(len(queries), a + step)
            all_of = np.bitwise_and.reduceat(bits[term[order[first[a] : first[b]]]], first[a:b] - first[a], axis=0)
            i, j = np.nonzero(np.unpackbits(all_of, axis=1, count=len(ids)))
            r.append(j)
            q.append(i + a)
        return _found(schema, ids, queries, np.concatenate(r), np.concatenate(q))

    size = tf.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("id").alias("texts")).first()
    return _cells(tf, size.n, size.texts, asked.select("query_id", "token").distinct(), run, schema)


def weighed(tf: DataFrame, asked: DataFrame, statistics: DataFrame, k1: float = 1.5, b: float = 0.75, k: int | None = None) -> DataFrame:
    """BM25 sums of postings of asked words: (query_id, id, score). How many texts have a word is counted among the postings.

    With k only what could be among a query's k best comes out of a cell, whether scores are rounded to six digits or not (and of equal scores the k smallest ids)."""
    df = stored(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "word-counts")
    of, size = statistics.first(), df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()
    n, mean = of.n or 0, of.avgdl
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(df, "token").select("query_id", "token", (F.col("times") * idf).alias("weight"))
    schema = _schema(tf, asked) + ", score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at, word, queries, query, term, words = _coded(left, right)
        tf, dl, weight = left["tf"].to_numpy(), left["dl"].to_numpy(), right["weight"].to_numpy()
        by_word, by_term = np.argsort(word, kind="stable"), np.lexsort((query, term))
        from_word, from_term = (np.searchsorted(x, np.arange(words + 1)) for x in (word[by_word], term[by_term]))
        rank = places(ids)
        found = []
        step = max(1, SCORES // max(1, len(ids)))
        for a in range(0, len(queries), step) if len(ids) else ():
            scores = np.zeros((len(ids), min(step, len(queries) - a)))
            for w in range(words):
                p, t = by_word[from_word[w] : from_word[w + 1]], by_term[from_term[w] : from_term[w + 1]]
                t = t[(query[t] >= a) & (query[t] < a + step)]
                if not len(p) or not len(t):
                    continue
                part = weight[t] * tf[p][:, None] * (k1 + 1) / (tf[p] + k1 * (1 - b + b * dl[p] / mean))[:, None]
                cell = np.ix_(at[p], query[t] - a)
                if len(np.unique(at[p])) == len(p):
                    scores[cell] += part
                else:  # texts that share an id
                    np.add.at(scores, cell, part)
            hit = scores > 0
            if k is not None and len(ids) > k:
                hit &= scores >= np.partition(scores, len(ids) - k, axis=0)[len(ids) - k] - SLACK
            r, q = np.nonzero(hit)
            s = scores[r, q]
            if k is not None and len(r):
                order = np.lexsort((rank[r], -s, q))
                r, q, s = r[order], q[order], s[order]
                first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])])
                on = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k
                r, q, s = r[on], q[on], s[on]
            found.append((r, q + a, s))
        r, q, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return _found(schema, ids, queries, r, q, s)

    return _cells(tf, size.n, n, terms, run, schema)


#: What a hit in a text of each branch counts.
BRANCHES = {"summary": 1.0, "utterance": 0.8, "evidence": 0.6}


def candidates(indexes: dict[str, TextIndex], owners: dict[str, DataFrame], queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, event_id, score, source_id, branches, rank): for each query the k best events with a text that has all its words.

    indexes: a branch's texts; owners (id, event_id, source_id): whose text it is. The best branch of an event counts; its source is that of
    the best branch that has one. Queries of the same words are one question. Texts of all branches meet questions in cells of a part of the
    events, so an event is in one cell, which gives a question's k best; hits are neither shuffled nor stored."""
    words = F.array_join(F.sort_array(F.collect_set("token")), " ")
    own = stored(asked_words(queries).groupBy("query_id").agg(words.alias("words")), "query-words")
    asked = stored(own.select("words").distinct().withColumn("question", F.monotonically_increasing_id()), "questions")
    terms = asked.select(F.explode(F.split("words", " ")).alias("token")).distinct()
    rows, size, total = None, 0, 0.0
    for n, (branch, index) in enumerate(indexes.items()):
        of = index.statistics().first()
        size, total = size + (of.n or 0), total + (of.n or 0) * (of.avgdl or 0)
        texts = index.of(terms).groupBy("id").agg(F.collect_set("token").alias("words"))
        texts = texts.join(owners[branch].select("id", "event_id", "source_id").distinct(), "id").select("event_id", "source_id", F.lit(n).alias("branch"), "words")
        rows = texts if rows is None else rows.unionByName(texts)
    parts, blocks = max(1, -(-size // PART), -(-int(total) // POSTINGS)), max(1, -(-asked.count() // QUESTIONS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int")).withColumn("_block", each(blocks))
    asked_ = asked.withColumn("_block", F.pmod(F.xxhash64("question"), F.lit(blocks)).cast("int")).withColumn("_part", each(parts))
    # cells are work, not bytes, so they aren't left to be put together by their size
    left, right = (x.repartition(min(MOST_DEALT, parts * blocks), "_part", "_block").groupBy("_part", "_block") for x in (rows, asked_))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("event_id", "source_id")]
    schema = f"question long, event_id {kinds[0]}, source_id {kinds[1]}, score double, branches string"
    best = left.cogroup(right).applyInArrow(_best_events([*indexes], k), schema)
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("event_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return own.join(asked, "words").select("query_id", "question").join(best, "question").select("query_id", "event_id", "score", "source_id", "branches", "rank")


def _best_events(branches: list[str], k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a cell of texts (event_id, source_id, branch, words: a list) and questions (question, words: joined) its k best events of each question."""
    scores = np.array([BRANCHES[b] for b in branches])
    level = np.unique(scores, return_inverse=True)[1]

    def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """Values in their order, nulls last, and each row's place among them."""
        of = column.combine_chunks().dictionary_encode(null_encoding="encode")
        place = pc.rank(of.dictionary, null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64) - 1
        return of.dictionary.take(pa.array(np.argsort(place))), place[of.indices.to_numpy()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, asked = left["words"].combine_chunks(), pc.split_pattern(right["words"].combine_chunks(), " ")
        n, size = len(texts), asked.value_lengths().to_numpy()
        events, event = coded(left["event_id"])
        sources, source = coded(left["source_id"])
        branch = left["branch"].to_numpy()
        # of a source the best branch counts, then the source itself
        source = np.where(left["source_id"].is_null().to_numpy(), -1, level[branch] * (len(sources) + 1) + source)
        words = asked.flatten().dictionary_encode()
        of = pc.fill_null(pc.index_in(texts.flatten(), value_set=words.dictionary), -1).to_numpy().astype(np.int64)
        keys = np.sort((of * n + np.repeat(np.arange(n), texts.value_lengths().to_numpy()))[of >= 0])
        word, text = np.divmod(keys, max(1, n))
        first = np.searchsorted(word, np.arange(len(words.dictionary) + 1))
        df = np.diff(first)
        # a question's words, the rarest first
        term = words.indices.to_numpy().astype(np.int64)
        term = term[np.lexsort((df[term], np.repeat(np.arange(len(size)), size)))]
        start = np.cumsum(size) - size
        rarest = df[term[start]]
        frequent = df > n // FREQUENT
        found: list[tuple] = []

        def add(q: np.ndarray, t: np.ndarray) -> None:
            """The k best events of questions q, all of whose hits are here."""
            if not len(q):
                return
            group = q * len(events) + event[t]
            order = np.argsort(group, kind="stable")
            group, t = group[order], t[order]
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            q, e = np.divmod(group[at], len(events))
            top, from_, met = np.maximum.reduceat(scores[branch[t]], at), np.maximum.reduceat(source[t], at), np.bitwise_or.reduceat(1 << branch[t], at)
            order = np.lexsort((e, -top, q))
            q = q[order]
            on = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            on = np.arange(len(q)) - np.repeat(on, np.diff(np.r_[on, len(q)])) < k
            found.append((q[on], *(x[order][on] for x in (e, from_, top, met))))

        # questions of frequent words only: a word's texts are bits, which are and-ed
        often = np.flatnonzero(frequent[term[start]])
        row = np.cumsum(frequent) - 1
        on = frequent[word]
        bits = np.zeros((int(frequent.sum()), -(-n // 8)), np.uint8)
        np.bitwise_or.at(bits, (row[word[on]], text[on] >> 3), (128 >> (text[on] & 7)).astype(np.uint8))
        step = max(1, CHECKED // max(1, n))
        for a in range(0, len(often), step):
            those = often[a : a + step]
            at = np.cumsum(size[those]) - size[those]
            own = row[term[np.repeat(start[those] - at, size[those]) + np.arange(size[those].sum())]]
            i, j = np.nonzero(np.unpackbits(np.bitwise_and.reduceat(bits[own], at, axis=0), axis=1, count=n))
            add(those[i], j)
        # others: the texts of the rarest word, which are looked up for the other words
        seldom = np.flatnonzero(~frequent[term[start]] & (rarest > 0))
        ends = np.cumsum(rarest[seldom])
        for those in np.split(seldom, np.flatnonzero(np.diff(ends // CHECKED)) + 1):
            many = rarest[those]
            q = np.repeat(those, many)
            t = text[np.repeat(first[term[start[those]]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            for slot in range(1, int(size[those].max(initial=0))):
                more = size[q] > slot
                want = term[start[q[more]] + slot] * n + t[more]
                ok = ~more
                ok[more] = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
                q, t = q[ok], t[ok]
            add(q, t)
        q, e, s, top, met = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        names = {m: ",".join(sorted(b for i, b in enumerate(branches) if m >> i & 1)) for m in np.unique(met).tolist()}
        of_source = pa.array(np.where(s < 0, 0, s % (len(sources) + 1)), pa.int64(), mask=s < 0)
        return pa.Table.from_arrays([right["question"].take(pa.array(q)), events.take(pa.array(e)), sources.take(of_source), pa.array(top), pa.array([names[m] for m in met.tolist()], pa.string())], ["question", "event_id", "source_id", "score", "branches"])

    return run
