"""Source texts as sets of hashed token windows, and their routing in packs.

A token is a longest run of ASCII letters, digits and underscores, or one other character that is
not white space; a window is a run of five consecutive tokens.

Windows travel in two directions. A pack holds the sets of up to ``PACK`` documents of one task; its
windows are cut by hash into buckets, and a shuffled row has those of one pack in one bucket. A
bucket counts in how many documents each window occurs and answers to the packs, so that every
document learns the frequency of its windows. Rows are packed arrays, some three bytes a window. A
window that occurs in several documents of a pack goes out once with its number, so the list of a
window has at most ``OFTEN`` postings a pack, however many documents hold it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext

WIDTH = 5
#: Documents and windows of a pack.
PACK = 4096
PACK_WINDOWS = 4_000_000
#: A window in more documents of its pack than this goes out once for all of them.
OFTEN = 4
#: Bits of a window's key within its bucket.
KEY = 30
MANY = 0x1FFF  # stands for the documents of a pack that share a window
SIDE = 13  # bit of a posting where the sides begin
_TOKEN = re.compile(r"[A-Za-z0-9_]+|\S")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Hash of a token; those met are remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


_hashes = Hashes()


def token_hashes(source: bytes | None) -> np.ndarray:
    """Hash of each token of a source, read as UTF-8 with bad bytes replaced. Null: no tokens."""
    tokens = _TOKEN.findall((source or b"").decode("utf-8", "replace"))
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` tokens at each position; empty below ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = tokens[:n].copy()
    for i in range(1, width):
        h ^= h >> np.uint64(29)
        h *= _MIX
        h += tokens[i : n + i]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts in place."""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def windows(tokens: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of five tokens; empty below five tokens."""
    return distinct(rolling(tokens, WIDTH))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, none negative, as one compressed string: each in as few bytes as its
    largest value needs, byte planes apart."""
    head, body = [np.uint32(len(arrays)).tobytes()], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        head.append(np.array([len(a), width], np.uint32).tobytes())
        body.append(np.ascontiguousarray(a.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``squeeze``, in their narrow types."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.uint32, 1)[0])
    shapes = np.frombuffer(raw, np.uint32, 2 * count, 4).reshape(-1, 2)
    at, out = 4 + 8 * count, []
    for n, width in shapes.tolist():
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n))
        at += n * width
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of ascending values, the first from zero."""
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


#: kind 0: postings of a pack in a bucket. kind 1: what stays with the pack, on its way through.
SENT = pa.schema([("target", pa.int32()), ("pack", pa.int64()), ("kind", pa.int8()), ("blob", pa.binary()), ("hashes", pa.list_(pa.list_(pa.string())))])
SENT_DDL = "target int, pack bigint, kind tinyint, blob binary, hashes array<array<string>>"


class _Pack:
    """Distinct window sets of documents; copies are one set with several hashes."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sides: list[int] = []
        self.hashes: list[list[str]] = []
        self.n = 0

    def add(self, key: str, side: int, found: np.ndarray) -> None:
        name = xxhash.xxh3_64_intdigest(found.tobytes())
        at = self.place.setdefault(name, len(self.ids))
        if at == len(self.ids):
            self.ids.append(name)
            self.sets.append(found)
            self.sides.append(side)
            self.hashes.append([key])
            self.n += len(found)
        else:
            self.sides[at] |= side
            if key not in self.hashes[at]:
                self.hashes[at].append(key)

    def rows(self, pack: int, buckets: int) -> pa.RecordBatch:
        size = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        side = np.array(self.sides, np.uint16)
        every = np.concatenate(self.sets)
        full = (every & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(KEY) | every >> np.uint64(64 - KEY)
        full = distinct(full << np.uint64(16) | np.repeat(np.arange(len(size), dtype=np.uint64), size))
        doc, full = (full & np.uint64(0xFFFF)).astype(np.uint16), full >> np.uint64(16)
        begins = np.flatnonzero(np.append(True, full[1:] != full[:-1]))
        length = np.diff(np.append(begins, len(full)))
        often = length > OFTEN
        shared = np.repeat(often, length)
        posting = doc | side[doc] << SIDE
        posting[begins[often]] = MANY | np.bitwise_or.reduceat(side[doc], begins)[often] << SIDE
        sent = ~shared
        sent[begins[often]] = True
        weights = length[often]
        kept = squeeze(
            np.array(self.ids, np.uint64), size, side, full[begins[often]] >> np.uint64(KEY), full[begins[often]] & np.uint64((1 << KEY) - 1), weights, doc[shared]
        )
        bucket, key, posting = (full[sent] >> np.uint64(KEY)).astype(np.int64), (full[sent] & np.uint64((1 << KEY) - 1)).astype(np.uint32), posting[sent]
        heavy = np.cumsum((posting & MANY) == MANY)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        columns: list[list] = [[pack % buckets], [pack], [1], [kept], [self.hashes]]
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            lo, hi = cuts[b], cuts[b + 1]
            own = weights[heavy[lo - 1] if lo else 0 : heavy[hi - 1]]
            for column, value in zip(columns, (b, pack, 0, squeeze(steps(key[lo:hi]), posting[lo:hi], own), None)):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT)], schema=SENT)


def send(buckets: int):
    """For mapInArrow: rows (hash, source, side) to the postings of their packs, with what stays behind.
    Sources below five tokens leave none. Packs are told apart by task and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, open_ = TaskContext.get().partitionId(), 0, _Pack()
        for batch in batches:
            for key, source, side in zip(batch.column("hash").to_pylist(), batch.column("source"), batch.column("side").to_pylist()):
                found = windows(token_hashes(source.as_py()))
                if len(found) and key is not None:
                    open_.add(key, side, found)
                if len(open_.ids) >= PACK or open_.n >= PACK_WINDOWS:
                    yield open_.rows(task << 32 | serial, buckets)
                    serial, open_ = serial + 1, _Pack()
        if open_.ids:
            yield open_.rows(task << 32 | serial, buckets)

    return run


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over whole buckets: the postings whose window occurs in several documents, and on
    both sides, go back to their packs with the number of documents. Other rows pass through."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        if (kind == 1).any():
            yield batch.filter(pa.array(kind == 1))
        for b, pack, k, blob in zip(*(batch.column(c).to_pylist() for c in ("target", "pack", "kind", "blob"))):
            if k == 0:
                held.setdefault(b, []).append((pack, blob))
    for b in list(held):
        chunks = held.pop(b)
        packs = np.array([pack for pack, _ in chunks], np.int64)
        sizes, keys, postings, weights = [], [], [], []
        for _, blob in chunks:
            key, posting, weight = unsqueeze(blob)
            w = np.ones(len(posting), np.int64)
            w[(posting & MANY) == MANY] = weight
            sizes.append(len(key))
            keys.append(np.cumsum(key, dtype=np.uint64).astype(np.uint32))
            postings.append(posting.astype(np.uint16))
            weights.append(w.astype(np.uint16) if w.max(initial=0) < 1 << 16 else w)
        del chunks
        posting, weight = np.concatenate(postings), np.concatenate(weights)
        order = np.argsort(np.concatenate(keys), kind="stable")
        key = np.concatenate(keys)[order]
        del postings, weights, keys
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(begins, len(key)))
        documents = np.add.reduceat(weight[order].astype(np.int64), begins)
        sides = np.bitwise_or.reduceat(posting[order] >> SIDE, begins)
        useful = (documents > 1) & (sides == 3)
        keep = np.repeat(useful, length)
        at = order[keep]
        chunk = np.searchsorted(np.cumsum(sizes), at, side="right")
        by_chunk = np.argsort(chunk, kind="stable")  # ascending keys within
        key, posting = key[keep][by_chunk], posting[at[by_chunk]]
        documents = np.repeat(documents[useful], length[useful])[by_chunk]
        cuts = np.searchsorted(chunk[by_chunk], np.arange(len(packs) + 1))
        rows = [(b, int(packs[c]), 0, squeeze(steps(key[cuts[c] : cuts[c + 1]]), posting[cuts[c] : cuts[c + 1]] & MANY, documents[cuts[c] : cuts[c + 1]]), None) for c in range(len(packs)) if cuts[c] < cuts[c + 1]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT)
