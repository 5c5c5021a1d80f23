"""Token counts without ids.

In each batch the pre-tokens of a document are counted (its frequencies), each distinct pre-token's pieces are counted
once by the tokenizer's own model, and the two are joined and summed. Only numbers leave: no id is ever stored. All
work is within a partition, so nothing is shuffled at any size.

Cases: null text is empty and has no tokens; an added token's string inside a text counts as one; rows repeat as given;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Bpe, byte_characters, text_lists
from .common import arrow_limits, text_bytes, texts

CACHE_WORDS = 200_000
#: Documents with more tokens than this are over the limit.
LIMIT = 1024


class Counts:
    """Pieces of distinct pre-tokens for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.split = Bpe(path, merges=False)
        self.model = Tokenizer.from_file(path).model
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.known: dict[str, int] = {}

    def pieces(self, unit: str) -> int:
        words = self.split.pieces(unit) if self.split.normalised else [unit]
        return sum(len(self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))) for w in words)

    def count(self, batch: list[str]) -> list[int]:
        frequencies, special = [], []
        for t in batch:
            own, n = Counter(), 0
            for run in self.split.parts(t):
                if isinstance(run, int):
                    n += 1
                else:
                    own.update(run)
            frequencies.append(own)
            special.append(n)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in set().union(*frequencies) - known.keys():
            known[w] = self.pieces(w)
        return [n + sum([known[w] * k for w, k in own.items()]) for n, own in zip(special, frequencies, strict=True)]


@lru_cache(2)
def load(path: str) -> Counts:
    return Counts(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: n_bytes (UTF-8), n_tokens, over_limit."""
    arrow_limits(docs.sparkSession)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load(path)
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column(1))[1])
            for a, b, some in text_lists(batch.column(1)):
                n = np.array(counts.count(some), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
