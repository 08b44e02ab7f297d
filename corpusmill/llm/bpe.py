"""Encoding with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is merged over a contiguous array of part
boundaries with the rank of every adjacent pair: the least rank is found by a scan, its boundary
deleted and the two neighbouring ranks refreshed, until no pair has a rank. Pieces beyond
``SHORT`` bytes use the same merges from a heap, where a scan would be quadratic. Ids of pieces
seen before come from a bounded table in the worker.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 64
_NEVER = 1 << 60


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Rank of each token of a vocabulary file with lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, content.splitlines()))}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by scans over the rank array."""
    cuts = list(range(len(piece) + 1))
    near = [ranks.get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]
    while near:
        least = min(near)
        if least == _NEVER:
            break
        i = near.index(least)
        del cuts[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], _NEVER)
        if i:
            near[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], _NEVER)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids, with a heap of pairs and linked parts."""
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n

    def rank(i: int) -> int:
        j = after[i]
        return ranks.get(piece[i : after[j]], _NEVER) if j < n else _NEVER

    heap = [(r, i, after[i]) for i in range(n - 1) if (r := rank(i)) != _NEVER]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        if not alive[i] or after[i] != j or rank(i) != r:
            continue
        alive[j] = 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (s := rank(k)) != _NEVER:
                heapq.heappush(heap, (s, k, after[k]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Ids by piece."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000) -> None:
        super().__init__()
        self.ranks, self.limit = ranks, limit
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple((merge_short if len(data) <= SHORT else merge_long)(data, self.ranks))
        if len(piece) <= SHORT:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.split(text))), np.int32) if text else np.zeros(0, np.int32)


_encoders: dict[int, Encoder] = {}


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ids (array of int) of each row's text, without special tokens.

    Null and empty texts give an empty list; repeated rows are encoded each. The strings of special
    tokens are ordinary text. The vocabulary file (a fixed size, below a megabyte) is read on the
    driver and broadcast.
    """
    with open(vocabulary, "rb") as file:
        content = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = hash(content.value)
        if at not in _encoders:
            _encoders.clear()
            _encoders[at] = Encoder(parse_ranks(content.value))
        encoder = _encoders[at]
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
