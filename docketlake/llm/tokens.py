"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

The merges of one piece of text run over a segment tree: leaf i holds the rank of the
pair that starts at symbol i, the root yields the leftmost pair of the lowest rank, and a
merge updates three leaves in logarithmic time, so even a piece of a whole long text
costs n log n. Stretches between single spaces recur, so their ids are kept in a bounded
cache per worker. A text is encoded in one pass, without a shuffle.

Defined results: null and empty text give an empty list; no special tokens, their
strings are ordinary text. The vocabulary's place is a parameter; its file (under 1 MB)
is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.session import spread, table

VOCABULARY = os.environ.get("DOCKETLAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 200_000
_NEVER = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: lowest rank first, leftmost among equals."""
    n = len(piece)
    sym = [piece[i : i + 1] for i in range(n)]
    if n > 1:
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        shift = width.bit_length()
        get = ranks.get
        tree = [_NEVER] * (2 * width)
        for i in range(n - 1):
            if (r := get(sym[i] + sym[i + 1])) is not None:
                tree[width + i] = r << shift | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        mask = (1 << shift) - 1
        while (best := tree[1]) != _NEVER:
            i = best & mask
            j = nxt[i]
            sym[i] += sym[j]
            sym[j] = b""
            after = nxt[i] = nxt[j]
            if j < n - 1:
                put(j, _NEVER)
            if after < n:
                prv[after] = i
                r = get(sym[i] + sym[after])
                put(i, _NEVER if r is None else r << shift | i)
            else:
                put(i, _NEVER)
            if (p := prv[i]) >= 0:
                r = get(sym[p] + sym[i])
                put(p, _NEVER if r is None else r << shift | p)
    return [ranks[s] for s in sym if s]


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder(dict):
    """Stretch of text -> ids; a dict, so that a known stretch costs one look-up."""

    def __init__(self, ranks: dict[bytes, int], count: bool = False):
        super().__init__()
        self.ranks, self.count = ranks, count
        self.pieces = regex.compile(PATTERN).findall
        self.by_piece: dict[str, list[int]] = {}

    def __missing__(self, stretch: str):
        ids: list[int] = []
        for piece in self.pieces(stretch):
            known = self.by_piece.get(piece)
            if known is None:
                known = merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) < 100:
                    if len(self.by_piece) >= CACHE_ENTRIES:
                        self.by_piece.clear()
                    self.by_piece[piece] = known
            ids += known
        value = len(ids) if self.count else ids
        if len(stretch) < 100:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[stretch] = value
        return value

    # a single space before a visible character always starts a piece, so texts may be cut there
    _cut = re.compile(r" (?=[^\s]|[\x1c-\x1f])").split
    _runs = re.compile(r"\s ")

    def stretches(self, text: str) -> list[str]:
        parts = self._cut(text) if self._runs.search(text) or text.endswith(" ") or re.search(r" \s", text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]


_encoders: dict[tuple[int, bool], Encoder] = {}


def encoder(data: bytes, count: bool = False) -> Encoder:
    """One per worker process and vocabulary, kept between tasks."""
    key = (hash(data), count)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(load_ranks(data), count)
    return _encoders[key]


def _vocabulary(spark, path: str):
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64_000_000:
        raise ValueError(f"{path}: not a vocabulary file")
    return spark.sparkContext.broadcast(data)


def encode_texts(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row."""
    data = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                if t:
                    for ids in map(enc.__getitem__, enc.stretches(t)):
                        flat += ids
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every row; 0 for null and empty text."""
    data = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value, count=True)
        for batch in batches:
            counts = [sum(map(enc.__getitem__, enc.stretches(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, tokens bigint")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
