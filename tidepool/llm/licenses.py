"""License scan by diagonal voting.

1. Every rolling k-gram of words of every text is hashed, and the hashes are joined to those of the templates. The
   template table is fixed by NOTICES and PHRASES (its size is checked), so it is broadcast and texts aren't shuffled.
2. A hit at word i of a text and word j of a template votes for diagonal i - j. Votes are added up per text, template and
   diagonal.
3. Phrases: a diagonal that all k-grams of a phrase vote for is a place where its words stand consecutively.
4. Notices: diagonals no further apart than SLACK, whose hits lie no further apart than the notice is long, are merged,
   so that words put in, left out or changed don't hide a notice. A merged diagonal with enough votes is a candidate.
5. Candidates are verified on the words themselves: a phrase must be equal, and of a notice the longest common
   subsequence with the span must have at least SIMILAR of its words. Where spans overlap, a notice gives way to a better
   one of another label.

A label of a phrase is a base label; notices add labels. The score is the largest verified share, 1 for a phrase.

Cases: a null text is empty; texts without words, or with fewer than k, have no label and a score of 0; a null id counts
as an id of its own; repeated rows each give a row; of repeated ids with other texts each is scanned alone; an empty table
gives none; other columns are not read. Texts of one id are told apart by a 64-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, slices, text_bytes, texts, written
from .words import bounds, chain, mix, running, span

K = 3
SLACK = 4
#: Share of a notice's k-grams that must vote, and of its words that must be found in order.
VOTES, SIMILAR = 0.4, 0.8
WORK_BYTES = 1 << 20
#: The template table is broadcast: no more k-grams than this.
MOST_GRAMS = 1 << 16

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Public license notices and their labels.
NOTICES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "Released under the MIT License"],
    "apache-2": ["Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "gpl-3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "This work is licensed under the GNU General Public License, version 3"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
}

_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[:0x30] = True
_OUTSIDE[0x3A:0x41] = True
_OUTSIDE[0x5B:0x61] = True
_OUTSIDE[0x7B:0x80] = True
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def grams(body: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: which text each k-gram is in, the word it begins at and its hash; and the words of each text."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = bounds(body, offsets, _OUTSIDE)
    hashes, at = span(running(body, lower=True), starts, ends), np.searchsorted(starts, offsets)
    count = np.diff(at)
    some = np.maximum(count - k + 1, 0)
    owner = np.repeat(np.arange(len(count)), some)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some)
    first = place + np.repeat(at[:-1], some)
    out = np.full(len(first), k, np.uint64)
    for j in range(k):
        out = chain(out, hashes[first + j])
    return owner, place.astype(np.int32), mix(out).view(np.int64), count


def templates(phrases: dict[str, str], notices: dict[str, list[str]], k: int) -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, phrase, words) of each template."""
    rows = [(label, True, words_of(t)) for t, label in phrases.items()] + [(label, False, words_of(t)) for label, all_ in notices.items() for t in all_]
    if short := [w for *_, w in rows if len(w) < k]:
        raise ValueError(f"templates with fewer than {k} words: {short}")
    return [(n, *r) for n, r in enumerate(rows)]


def _template_grams(spark: SparkSession, rows: list[tuple], k: int) -> DataFrame:
    """(gram, template, at); template -1 at the gram that marks the end of each text."""
    found = [(0, -1, 0)]
    for n, _, _, words in rows:
        body = " ".join(words).encode()
        _, at, hashes, _ = grams(np.frombuffer(body, np.uint8), np.array([0, len(body)]), k)
        found += [(h, n, a) for h, a in zip(hashes.tolist(), at.tolist(), strict=True)]
    if len(found) > MOST_GRAMS:
        raise ValueError(f"{len(found)} k-grams of templates are more than may be broadcast")
    return spark.createDataFrame(found, "gram long, template int, at int")


def hits(docs: DataFrame, rows: list[tuple], k: int = K) -> DataFrame:
    """(doc_id, hash, pos, template, at) for each k-gram shared with a template, stored; also a row of each text, with template -1 and pos its number of words."""
    arrow_limits(docs.sparkSession)
    own = texts(docs).withColumn("hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column(2))
            for a, b in slices(np.diff(offsets), WORK_BYTES):
                owner, place, gram, count = grams(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                gram = np.where(gram == 0, 1, gram)
                which = pa.array(np.concatenate([owner, np.arange(b - a)]) + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(np.concatenate([place, count.astype(np.int32)])), pa.array(np.concatenate([gram, np.zeros(b - a, np.int64)]))], ["doc_id", "hash", "pos", "gram"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rolled = own.select("doc_id", "hash", "text").mapInArrow(run, f"doc_id {kind}, hash long, pos int, gram long")
    return written(rolled.join(F.broadcast(_template_grams(docs.sparkSession, rows, k)), "gram").select("doc_id", "hash", "pos", "template", "at"), "license-hits")


def _candidates(found: DataFrame, rows: list[tuple], k: int, slack: int, votes: float) -> DataFrame:
    """(doc_id, hash, template, first, last): spans of words to be verified."""
    spark = found.sparkSession
    facts = spark.createDataFrame([(n, phrase, len(words) - k + 1, len(words)) for n, _, phrase, words in rows], "template int, phrase boolean, grams int, size int")
    key = ["doc_id", "hash", "template"]
    # repeated rows hit twice
    voted = found.filter("template >= 0").distinct().groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    voted = voted.join(F.broadcast(facts), "template")
    phrases = voted.filter("phrase AND votes = grams").select(*key, F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"))
    by = Window.partitionBy(*key).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > slack) | (F.col("low") - F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1)) > F.col("size"))
    runs = voted.filter("NOT phrase").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    merged = runs.groupBy(*key, "run", "grams", "size").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("lowest"), F.max("diagonal").alias("highest"))
    merged = merged.filter(F.col("votes") >= F.col("grams") * votes)
    first, last = F.greatest(F.lit(0), F.least("lowest", "low")), F.greatest(F.col("highest") + F.col("size") - 1, F.col("high") + k - 1)
    return phrases.union(merged.select(*key, first.alias("first"), last.alias("last")))


def common_words(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Length of the longest common subsequence of a and b, and the first and last place in b that one of them uses."""
    best: list[tuple[int, int, int]] = [(0, -1, -1)] * (len(b) + 1)
    for x in a:
        above, best = best, [(0, -1, -1)]
        for j, y in enumerate(b):
            n, lo, _ = above[j]
            best.append((n + 1, j if lo < 0 else lo, j) if x == y else max(above[j + 1], best[j], key=lambda v: (v[0], v[1], -v[2])))
    return best[-1]


def best_spans(spans: list[tuple[str, bool, int, int, float]], n_words: int) -> list[int]:
    """Which spans (label, phrase, first, last, share) of a text stay: phrases, and notices that no span of another label beats on a word that both have."""
    share, who = np.zeros(n_words), np.full(n_words, -1)
    labels = {s[0]: k for k, s in enumerate(spans)}
    for label, _, first, last, x in spans:
        part = slice(first, last + 1)
        better = x > share[part]
        share[part][better], who[part][better] = x, labels[label]
    return [k for k, (label, phrase, first, last, x) in enumerate(spans) if phrase or ((share[first : last + 1] <= x) | (who[first : last + 1] == labels[label])).all()]


def verified(docs: DataFrame, candidates: DataFrame, rows: list[tuple], similar: float = SIMILAR) -> DataFrame:
    """(doc_id, hash, label, phrase, first, last, share) for candidates whose words say so.

    Texts are read again, only of ids with candidates: these are stored first, so Spark broadcasts them where their file is small."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = written(candidates.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans")), "license-candidates")
    known = [r[1:] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words, here = words_of(text), []
                for s in batch.column(3)[i].as_py():
                    label, phrase, want = known[s["template"]]
                    part = words[s["first"] : s["last"] + 1]
                    n, lo, hi = (len(want), 0, len(want) - 1) if part == want else (0, 0, 0) if phrase else common_words(want, part)
                    if n >= similar * len(want):
                        here.append((label, phrase, s["first"] + lo, s["first"] + hi, n / len(want)))
                stay = best_spans(here, len(words))
                at += [i] * len(stay)
                out += [here[k] for k in stay]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64())], ["doc_id", "hash", "label", "phrase", "first", "last", "share"])

    own = texts(docs).withColumn("hash", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.hash") == F.col("w.hash"))
    met = own.join(wanted.alias("w"), same).select("d.doc_id", "d.hash", "d.text", "w.spans")
    return met.mapInArrow(run, f"doc_id {kind}, hash long, label string, phrase boolean, first long, last long, share double").distinct()


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None, k: int = K, slack: int = SLACK, votes: float = VOTES, similar: float = SIMILAR) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first, last, share)."""
    rows = templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, k)
    found = hits(docs, rows, k)
    sure = verified(docs, _candidates(found, rows, k, slack, votes), rows, similar)
    base = F.when(F.col("phrase"), F.col("first"))
    each = sure.groupBy("doc_id", "hash").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base"),
        F.sort_array(F.collect_set("label")).alias("all"), F.max("share").alias("score"), F.sort_array(F.collect_set(F.struct("first", "last", "label", "share"))).alias("spans"),
    )
    each = each.alias("e")
    every = found.filter("template = -1").select("doc_id", "hash", F.col("pos").cast("long").alias("n_words")).alias("d")
    out = every.join(each, F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d.hash") == F.col("e.hash")), "left")
    return out.select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint,label:string,share:double>>")).alias("spans"),
    )
