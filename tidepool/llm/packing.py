"""Packing documents into sequences of a fixed length, by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's ids (its text's, then an end id) are cut into full
sequences and a rest. The rest goes into the open window it fills best; where none has room, the fullest window is
emitted and a new one opened. At the end of a partition its open windows are left over; left-over windows are merged
whole in rounds, each with a fraction of the tasks of the one before, by the same rule, until one small task remains. A
document is in memory alone, and only lengths, places and checksums of pieces are kept.

Cases: null text is empty and gives the end id alone; rows repeat as given (each is packed); ties go to the window opened
first; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, byte_characters, text_lists
from .common import arrow_limits, texts, written

LENGTH = 4096
END = 2
#: Open windows of a partition.
WINDOWS = 256
#: Tasks of a merging round that one of the next takes over.
FAN_IN = 16
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "held", "full"]


class Library(Bpe):
    """Texts prepared as for our own encoder; pre-tokens encoded by the tokenizers library's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path, merges=False)
        self.model = Tokenizer.from_file(path).model
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})

    def encode_words(self, words: list[str]) -> list[bytes]:
        model, letters = self.model.tokenize, self.letters
        # printable ASCII stands for itself
        plain = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters) for w in words]
        return [array("I", [t.id for t in model(w)]).tobytes() for w in plain]


@lru_cache(1)
def load(path: str) -> Library:
    return Library(path)


class Windows:
    """The open windows of one partition; items are (size, pieces). A window is [free, number, items]."""

    def __init__(self, length: int, most: int, number: int):
        self.length, self.most, self.next = length, most, number
        self.by_free: list[list] = [[] for _ in range(length + 1)]
        self.free = np.zeros(length + 1, bool)
        self.open = 0

    def _take(self, free: int) -> list:
        w = self.by_free[free].pop(0)
        self.free[free] = bool(self.by_free[free])
        self.open -= 1
        return w

    def _put(self, free: int, w: list) -> None:
        self.by_free[free].append(w)
        self.free[free] = True
        self.open += 1

    def add(self, size: int, item: object) -> Iterator[tuple[int, list]]:
        """Place an item; yields a window that has become full or had to go, as (number, items)."""
        fit = size + int(np.argmax(self.free[size:]))
        if self.free[fit]:
            w = self._take(fit)
        else:
            if self.open >= self.most:
                out = self._take(int(np.argmax(self.free)))
                yield out[0], out[1]
            w, fit = [self.next, []], self.length
            self.next += 1
        w[1].append(item)
        if fit == size:
            yield w[0], w[1]
        else:
            self._put(fit - size, w)

    def rest(self) -> Iterator[tuple[int, list]]:
        for bucket in self.by_free:
            for w in bucket:
                yield w[0], w[1]


def _rows(sequence: int, items: list, full: bool) -> Iterator[tuple]:
    """Pieces of a window with their offsets. An item is a list of pieces."""
    held = sum(p[2] for item in items for p in item)
    at = 0
    for item in items:
        for p in item:
            yield (*p, sequence, at, held, full)
            at += p[2]


class _Out:
    def __init__(self, id_type: pa.DataType):
        self.rows: list[tuple] = []
        self.schema = pa.schema([("doc_id", id_type), *((n, pa.int64()) for n in COLUMNS[1:8]), ("full", pa.bool_())])

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in COLUMNS]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _schema(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {PIECE}, sequence_id long, offset long, held long, full boolean"


def _first(docs: DataFrame, path: str, length: int, most: int, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base, out = load(path), _partition() << 32, None
        windows, last = Windows(length, most, base), np.array([end], "<u4").tobytes()
        for batch in batches:
            out = out or _Out(batch.schema.field(0).type)
            for a, b, some in text_lists(batch.column(1)):
                for doc, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), bpe.encode(some), strict=True):
                    data = ids.tobytes() + last
                    total, start = len(ids) + 1, 0
                    while total - start >= length:
                        out.rows.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total, windows.next, 0, length, True))
                        windows.next += 1
                        start += length
                    if start < total:
                        for number, items in windows.add(total - start, [(doc, start, total - start, zlib.crc32(data[4 * start :]), total)]):
                            out.rows += _rows(number, items, True)
                yield out.batch()
        if out:
            for number, items in windows.rest():
                out.rows += _rows(number, items, False)
            yield out.batch()

    return docs.mapInArrow(run, _schema(docs))


def _merge(left: DataFrame, length: int, most: int, level: int, last: bool) -> DataFrame:
    """Place whole left-over windows into windows again. Rows come sorted by sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, windows = None, Windows(length, most, level << 56 | _partition() << 32)
        item: list[tuple] = []
        now = None
        for batch in batches:
            out = out or _Out(batch.schema.field(0).type)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5] != now and item:
                    for number, items in windows.add(sum(p[2] for p in item), item):
                        out.rows += _rows(number, items, True)
                    item = []
                now = row[5]
                item.append(row[:5])
            yield out.batch()
        if out:
            if item:
                for number, items in windows.add(sum(p[2] for p in item), item):
                    out.rows += _rows(number, items, True)
            for number, items in windows.rest():
                out.rows += _rows(number, items, last)
            yield out.batch()

    return left.mapInArrow(run, _schema(left))


def pack(docs: DataFrame, path: str, length: int = LENGTH, windows: int = WINDOWS, end: int = END) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of its sequence)."""
    arrow_limits(docs.sparkSession)
    docs = texts(docs)
    tasks = max(1, docs.rdd.getNumPartitions())
    done = written(_first(docs, path, length, windows, end), "packed")
    parts, level = [done.filter("full")], 1
    left = done.filter("NOT full")
    while True:
        tasks = -(-tasks // FAN_IN)
        near = F.shiftrightunsigned("sequence_id", 32).bitwiseAND(F.lit((1 << 24) - 1)) % tasks
        dealt = left.withColumn("near", near).repartition(tasks, "near").sortWithinPartitions("sequence_id", "offset").drop("near")
        merged = written(_merge(dealt, length, windows, level, tasks == 1), f"merged{level}")
        parts.append(merged.filter("full"))
        if tasks == 1:
            break
        left, level = merged.filter("NOT full"), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("padding", F.when(F.bit_count("held") == 1, 0).otherwise(length - F.col("held"))).drop("held", "full")
