"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a batch lie in one array of symbols. An index maps the rank of each adjacent pair to all its
positions; active ranks are taken in ascending order from a heap, all occurrences of a rank are merged left to right,
and only the lists of pairs beside a merge are updated. Where a merge makes a pair of a lower rank within a word, the
rest of that word waits until the lower rank is done, so ids equal those of merging word by word.

The vocabulary file says how texts are prepared. Two forms are read, both as the tokenizers library does:
"words" (NFC, runs of white space to a space, lower case, a suffix at word ends) and "bytes" (byte-level pieces).

Cases: null text is empty and has no ids; strings of added tokens inside texts give those tokens; rows repeat as given;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_limits, slices, text_bytes, texts

#: Distinct words kept between batches of a worker.
CACHE_WORDS = 250_000
WORK_BYTES = 3 << 20
#: White space as the library's pattern engine has it (no control separators 0x1C to 0x1F).
SPACE = r"\p{White_Space}"
#: Marks that are a pre-token of their own at the end of a word.
MARKS = frozenset(",.;:!?")
#: Python's own split() takes these for white space too.
SEPARATORS = regex.compile("[\x1c-\x1f]")


@lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, merges: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.normalised = bool(spec["normalizer"])
        steps = pre.get("pretokenizers", [pre])
        own = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        own = own or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        own = own.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", SPACE)
        self.pattern = regex.compile(own)
        self.blank = regex.compile(SPACE + "+")
        self.decoder = spec["decoder"]
        self.symbols = [""] * (1 + max(max(self.vocab.values()), *self.added.values()))
        for s, i in [*self.vocab.items(), *self.added.items()]:
            self.symbols[i] = s
        self.cache: dict[str, bytes] = {}  # of units, ids as in the result
        self.words: dict[str, bytes] = {}  # of their pre-tokens
        if not merges:
            return
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        v = self.vocab
        self.by_rank = [(v[a], v[b], v[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(self.by_rank)}
        chars = byte_characters()
        self.first = [v.get(c, -1) for c in chars]
        self.final = [v.get(c + self.suffix, -1) for c in chars]

    # Preparing texts
    def parts(self, text: str) -> Iterator[list[str] | int]:
        """Runs of units (texts that are encoded on their own), and ids of added tokens between them, in order."""
        at = 0
        if "<|" in text:
            for m in self.splitter.finditer(text):
                if m.start() > at:
                    yield self.units(text[at : m.start()])
                yield self.added[m[0]]
                at = m.end()
        if at < len(text):
            yield self.units(text[at:] if at else text)

    def units(self, text: str) -> list[str]:
        """Pre-tokens; or, where none can hold white space, words between white space, as fewer distinct ones need splitting."""
        if not self.normalised:
            return self.pieces(text)
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            # lower() alone would look at a final sigma's neighbours
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return [u for u in self.blank.split(text) if u] if SEPARATORS.search(text) else text.split()

    def pieces(self, text: str) -> list[str]:
        if self.normalised:  # most units are a word, or one with a mark after it
            if text.isalpha():
                return [text]
            if text[-1] in MARKS and text[:-1].isalpha():
                return [text[:-1], text[-1]]
        if not text.isascii() and (odd := [c for c in set(text) if unicodedata.category(c) == "Cn"]):
            # unassigned characters are neither letters nor numbers, whatever the pattern engine takes them for
            plain = text.translate(dict.fromkeys(map(ord, odd), "\ue000"))
            return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
        return self.pattern.findall(text)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit; a distinct pre-token is encoded once."""
        if not self.normalised:
            return self.encode_words(units)
        split = [self.pieces(u) for u in units]
        words = set(chain.from_iterable(split))
        if len(self.words) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in words & self.words.keys()}
        ids = self.words
        distinct = list(words - ids.keys())
        ids.update(zip(distinct, self.encode_words(distinct), strict=True))
        return [ids[s[0]] if len(s) == 1 else b"".join([ids[w] for w in s]) for s in split]

    # Encoding distinct words
    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by the pair occurrence index over all of them. A mark of -1 lies between words and joins nothing."""
        first, final = self.first.__getitem__, self.final
        sym, begin = [-1], []
        for word in words:
            raw = word.encode()
            begin.append(len(sym))
            sym += map(first, raw)
            sym[-1] = final[raw[-1]]
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, by_rank = self.ranks.get, self.by_rank
        index: dict[int, list[int]] = {}
        for p, k in enumerate(map(rank_of, [x << 32 | y for x, y in zip(sym, sym[1:], strict=False)])):
            if k is not None:
                if k in index:
                    index[k].append(p)
                else:
                    index[k] = [p]
        heap = list(index)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            a, b, new = by_rank[rank]
            places.sort()
            waiting: set[int] = set()  # words where a lower rank has come up
            later = []
            for p in places:
                if sym[p] != a:
                    continue
                q = after[p]
                if sym[q] != b:
                    continue
                if waiting and bisect_right(begin, p) in waiting:
                    later.append(p)
                    continue
                sym[p], sym[q] = new, -2
                after[p] = r = after[q]
                before[r] = p
                o = before[p]
                for at, pair in ((p, new << 32 | sym[r]), (o, sym[o] << 32 | new)):
                    k = rank_of(pair)
                    if k is not None:
                        if k in index:
                            index[k].append(at)
                        else:
                            index[k] = [at]
                            push(heap, k)
                        if k < rank:
                            waiting.add(bisect_right(begin, p))
            if later:
                index[rank] = later
                push(heap, rank)
        begin.append(n)
        return [array("I", [s for s in sym[i:j] if s >= 0]).tobytes() for i, j in zip(begin, begin[1:], strict=False)]

    def encode(self, batch: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text. Each distinct word of the batch is encoded once."""
        prepared = [list(self.parts(t)) for t in batch]
        new = set().union(*(run for p in prepared for run in p if not isinstance(run, int)))
        if len(self.cache) > CACHE_WORDS:  # what this batch has again is worth keeping
            self.cache = {w: self.cache[w] for w in new & self.cache.keys()}
        cache = self.cache
        todo = [w for w in new if w not in cache]
        cache.update(zip(todo, self.encode_units(todo), strict=True))
        get = cache.__getitem__
        out = []
        for p in prepared:
            raw = b"".join([b"".join(map(get, run)) if not isinstance(run, int) else np.array(run, "<u4").tobytes() for run in p])
            out.append(np.frombuffer(raw, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, added tokens included: symbols joined by spaces without a decoder, else bytes."""
        pieces = [self.symbols[i] for i in ids.tolist()]
        if self.decoder is None:
            return " ".join(pieces)
        back = {c: b for b, c in enumerate(byte_characters())}
        raw = bytearray()
        for s in pieces:
            got = [back.get(c) for c in s]
            raw += s.encode() if None in got else bytes(got)
        return raw.decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    """One instance for each worker and file."""
    return Bpe(path)


def text_lists(column: pa.Array, most: int = WORK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a string column with their texts, few bytes at a time."""
    _, offsets = text_bytes(column)
    for a, b in slices(np.diff(offsets), most):
        yield a, b, column.slice(a, b - a).to_pylist()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit, n_tokens)."""
    arrow_limits(docs.sparkSession)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for a, b, some in text_lists(batch.column(1)):
                ids = bpe.encode(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encode()'s rows with the text of the ids (special tokens kept)."""
    arrow_limits(encoded.sparkSession)
    encoded = encoded.select("doc_id", "ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens and SHA-256 of its ids and of their decoded text, in one pass over the batch."""
    arrow_limits(docs.sparkSession)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for a, b, some in text_lists(batch.column(1)):
                ids = bpe.encode(some)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
