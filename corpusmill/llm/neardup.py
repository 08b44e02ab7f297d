"""Near-duplicate sources by T-occurrence search.

A pair of window sets of sizes k and l reaches the threshold t when T = ceil(c (k + l)) windows are
common, c = t / (1 + t). All windows have one global order: rare ones first, by the number of
documents that hold them, then by hash. As DivideSkip does, the longest inverted lists of a pair,
its last T - s windows in that order, are not merged; a similar pair then still occurs s times in the
lists that are. Here s = 1 + T / 16, so the pairs that occur by chance fall out while the lists are
merged, and only the rest is probed: the windows of one set by binary search in those of the other,
which counts the overlap exactly.

Plan (each step one shuffle, rows packed):

1. packs of documents send their windows to buckets by hash, which count documents a window and
   answer with those that occur in several (``windows``); a document thereby knows its order;
2. documents with a window of several documents in their prefix, the k - T + s windows that can
   count for any partner, send this prefix to the buckets; all others are done;
3. a bucket merges its lists to pairs with counts, and sums over the buckets; for a posting only the
   sizes are visited that its place in the order allows, so a window that many documents share costs
   nothing unless most of their other windows are shared, too. A list with more pairs than ``SPLIT``
   is cut into ranges of both sides, which are tasks of their own;
4. pairs meet their two sets and are counted.

Buckets are as many as the bytes of the sources ask for, so tasks keep their size as the corpus
grows; nothing is broadcast. Windows are told apart by bucket and 30 bits: a pair's overlap is
misjudged by one with a chance below 1e-4 in any corpus, and sets are equal by 64 bits. Documents
with equal sets are one node (their copies are not expanded until the end).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import windows as w
from corpusmill.runtime import cut

#: Bytes of sources for each bucket, some four million windows.
BUCKET_BYTES = 16_000_000
#: Pairs that a task makes of one list; longer ones are cut into ranges of RANGE documents.
SPLIT = 4_000_000
RANGE = 2048
#: Pairs held at once while lists are merged.
BLOCK = 2_000_000
SPARE = 16

DOCS = "id bigint, size int, side tinyint, listed int, skip int, blob binary, hashes array<string>"
_DOCS_ARROW = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("side", pa.int8()), ("listed", pa.int32()), ("skip", pa.int32()), ("blob", pa.binary()), ("hashes", pa.list_(pa.string()))])


def required(k: np.ndarray, l: np.ndarray, threshold: float) -> np.ndarray:
    """Common windows that make sets of these sizes similar."""
    return np.maximum(np.ceil((k + l) * (threshold / (1 + threshold)) - 1e-9), 1).astype(np.int64)


def occurrences(need: np.ndarray) -> np.ndarray:
    """Times that a pair with ``need`` common windows must occur in its merged lists."""
    return 1 + need // SPARE


def _prefix(size: np.ndarray, threshold: float) -> np.ndarray:
    """Windows of a set, rarest first, that count for any partner: those for the smallest one."""
    need = np.maximum(np.ceil(size * threshold - 1e-9), 1).astype(np.int64)
    return np.minimum(size - need + occurrences(need), size)


def _arranged(threshold: float):
    """For applyInArrow over packs: the documents whose prefix holds a listed window, with their listed
    windows in the global order, and those with several hashes."""

    def run(table: pa.Table) -> pa.Table:
        ids = hashes = None
        parts = []
        for b, kind, blob, names in zip(*(table.column(c).to_pylist() for c in ("target", "kind", "blob", "hashes"))):
            if kind == 1:
                ids, size, side, m_bucket, m_key, m_count, m_docs = w.unsqueeze(blob)
                hashes = names
            else:
                key, doc, documents = w.unsqueeze(blob)
                parts.append((np.uint64(b) << np.uint64(w.KEY) | np.cumsum(key, dtype=np.uint64), doc.astype(np.uint16), documents.astype(np.int64)))
        if ids is None:
            return _DOCS_ARROW.empty_table()
        size = size.astype(np.int64)
        window, doc, documents = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
        many = doc == w.MANY
        if many.any():  # windows of several documents of this pack
            known = m_bucket.astype(np.uint64) << np.uint64(w.KEY) | m_key.astype(np.uint64)
            at = np.searchsorted(known, window[many])
            first = np.cumsum(m_count, dtype=np.int64) - m_count
            n = m_count[at].astype(np.int64)
            member = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            window, documents = (np.concatenate([x[~many], np.repeat(x[many], n)]) for x in (window, documents))
            doc = np.concatenate([doc[~many], m_docs[member].astype(np.uint16)])
        order = np.lexsort((window, documents, doc))
        window, doc = window[order], doc[order].astype(np.int64)
        listed = np.bincount(doc, minlength=len(ids))
        single = size - listed
        live = (_prefix(size, threshold) > single) & (listed > 0)
        cuts = np.append(0, np.cumsum(listed))
        rows = []
        for i in range(len(ids)):
            if live[i] or len(hashes[i]) > 1:
                own = window[cuts[i] : cuts[i + 1]] if live[i] else window[:0]
                blob = w.squeeze(own & np.uint64((1 << w.KEY) - 1), own >> np.uint64(w.KEY)) if live[i] else None
                rows.append((int(ids[i].astype(np.int64)), int(size[i]), int(side[i]), int(listed[i]) if live[i] else 0, int(single[i]), blob, hashes[i]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DOCS_ARROW)], schema=_DOCS_ARROW) if rows else _DOCS_ARROW.empty_table()

    return run


def _decoded(blob: bytes) -> np.ndarray:
    key, bucket = w.unsqueeze(blob)
    return bucket.astype(np.uint64) << np.uint64(w.KEY) | key.astype(np.uint64)


def _postings(threshold: float):
    """For mapInArrow: the prefixes of documents as packed rows (target, blob) for the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size, side, single = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "size", "side", "skip"))
            n = _prefix(size, threshold) - single
            windows = [_decoded(blob)[:m] for blob, m in zip(batch.column("blob").to_pylist(), n.tolist())]
            n = np.fromiter(map(len, windows), np.int64, len(windows))
            window = np.concatenate(windows)
            doc = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + single[doc]
            bucket = (window >> np.uint64(w.KEY)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, doc, place, key = bucket[order], doc[order], place[order], window[order] & np.uint64((1 << w.KEY) - 1)
            targets, starts = np.unique(bucket, return_index=True)
            ends = np.append(starts[1:], len(bucket))
            blobs = []
            for lo, hi in zip(starts, ends):
                own, count = np.unique(doc[lo:hi], return_counts=True)
                blobs.append(w.squeeze(ids[own].astype(np.uint64), size[own], side[own], count, key[lo:hi], place[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array(blobs, pa.binary())], ["target", "blob"])

    return run


class _Lists:
    """Postings of whole buckets, by list and then by size."""

    def __init__(self, blobs: list[tuple[int, bytes]]) -> None:
        columns = []
        for b, blob in blobs:
            ids, size, side, count, key, place = w.unsqueeze(blob)
            columns.append((np.repeat(ids, count).astype(np.uint64), np.repeat(size, count).astype(np.int64), np.repeat(side, count).astype(np.uint8), np.uint64(b) << np.uint64(w.KEY) | key.astype(np.uint64), place.astype(np.int64)))
        ids, size, side, window, place = (np.concatenate(x) for x in zip(*columns))
        order = np.lexsort((ids, size, window))
        ids, size, side, window, place = (x[order] for x in (ids, size, side, window, place))
        new = np.append(True, (window[1:] != window[:-1]) | (ids[1:] != ids[:-1]))  # copies in several packs are one
        side = np.bitwise_or.reduceat(side, np.flatnonzero(new))
        ids, size, window, place = (x[new] for x in (ids, size, window, place))
        self.ids, self.size, self.side, self.place = ids, size, side, place
        self.list = np.cumsum(np.append(True, window[1:] != window[:-1])) - 1


def _partners(lists: _Lists, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each posting, the range of postings before it in its list, of sets at most as large, whose
    size its place allows: with a larger one the pair would need more windows than follow."""
    top = 1 << 40
    ranked = lists.list * top + lists.size
    room = lists.size - lists.place  # windows from this one on
    # the largest need with need - occurrences(need) < room
    most = (room * SPARE) // (SPARE - 1) + 3
    for _ in range(6):
        most = np.where(most - occurrences(most) >= room, most - 1, most)
    bound = np.floor((most + 1e-6) * (1 + threshold) / threshold).astype(np.int64) - lists.size
    lo = np.searchsorted(ranked, lists.list * top + np.ceil(lists.size * threshold - 1e-9).astype(np.int64))
    hi = np.searchsorted(ranked, lists.list * top + np.maximum(np.minimum(bound, lists.size), 0), side="right")
    return lo, np.maximum(np.minimum(hi, np.arange(len(ranked))), lo)


def _met(lists: _Lists, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of posting pairs of one list each: those that count, as ids a < b, with the occurrences needed."""
    sx, sy = lists.side[x], lists.side[y]
    need = required(lists.size[x], lists.size[y], threshold)
    times = occurrences(need)
    ok = (lists.place[x] < lists.size[x] - need + times) & (lists.place[y] < lists.size[y] - need + times)
    ok &= (((sx & 1) > 0) & ((sy & 2) > 0)) | (((sx & 2) > 0) & ((sy & 1) > 0))
    a, b = lists.ids[x[ok]].astype(np.int64), lists.ids[y[ok]].astype(np.int64)
    return np.minimum(a, b), np.maximum(a, b), times[ok]


PAIRS = "a bigint, b bigint, times int, n int, ranges binary"
_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int32()), ("n", pa.int32()), ("ranges", pa.binary())])


def _summed(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Pairs with their number of occurrences, each once."""
    order = np.lexsort((b, a))
    a, b, times = a[order], b[order], times[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(times[first], pa.int32()), pa.array(n, pa.int32()), pa.nulls(len(first), pa.binary())], schema=_PAIRS_ARROW)


def _visit(lists: _Lists, lo: np.ndarray, hi: np.ndarray, threshold: float, block: int) -> Iterator[pa.RecordBatch]:
    """Pairs of every posting with those in its range, summed over about ``block`` pairs at a time; a
    range is divided where it alone is longer."""
    n = hi - lo
    x = np.flatnonzero(n)
    if not len(x):
        return
    start, length = lo[x], n[x]
    if (length > block).any():
        pieces = -(-length // block)
        x = np.repeat(x, pieces)
        piece = np.arange(len(x)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, length = np.repeat(start, pieces) + piece * block, np.minimum(np.repeat(length, pieces) - piece * block, block)
    held: list[tuple] = []
    size = 0
    groups = np.cumsum(length) // block
    edges = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(x))
    for u, v in zip(edges[:-1], edges[1:]):
        m = length[u:v]
        left = np.repeat(x[u:v], m)
        right = np.repeat(start[u:v] - np.cumsum(m) + m, m) + np.arange(m.sum())
        held.append(_met(lists, left, right, threshold))
        size += len(held[-1][0])
        if size >= block:
            yield _summed(*(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0
    if held:
        yield _summed(*(np.concatenate(c) for c in zip(*held)))


def _merged(threshold: float, split: int, block: int):
    """For mapInArrow over whole buckets: pairs (a, b, times, n) of the lists, and the ranges of lists
    that are too long for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [row for batch in batches for row in zip(batch.column("target").to_pylist(), batch.column("blob").to_pylist())]
        if not blobs:
            return
        lists = _Lists(blobs)
        del blobs
        lo, hi = _partners(lists, threshold)
        begins = np.flatnonzero(np.append(True, lists.list[1:] != lists.list[:-1]))
        pairs = np.add.reduceat(hi - lo, begins)
        ends = np.append(begins[1:], len(lists.list))
        for i in np.flatnonzero(pairs > split):
            for u in range(begins[i], ends[i], RANGE):
                v = min(u + RANGE, ends[i])
                first, last = int(lo[u:v].min()), int(hi[u:v].max())
                for p in range(first, last, RANGE):
                    q = min(p + RANGE, last)
                    own = [np.concatenate([c[u:v], c[p:q]]) for c in (lists.ids, lists.size, lists.side, lists.place, lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in zip((int(lists.ids[u].astype(np.int64)), int(lists.ids[p].astype(np.int64)), 0, 0, w.squeeze(np.array([v - u, p]), *own)), _PAIRS_ARROW.types)],
                        schema=_PAIRS_ARROW,
                    )
            hi[begins[i] : ends[i]] = lo[begins[i] : ends[i]]
        yield from _visit(lists, lo, hi, threshold, block)

    return run


def _ranges(threshold: float, block: int):
    """For mapInArrow: the pairs of ranges cut from long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("ranges").to_pylist():
                (split, base), ids, size, side, place, lo, hi = w.unsqueeze(blob)
                lists = _Lists.__new__(_Lists)
                lists.ids, lists.size, lists.side, lists.place = ids, size.astype(np.int64), side.astype(np.uint8), place.astype(np.int64)
                m = len(ids)
                shift = int(split) - int(base)
                lo, hi = (np.clip(x.astype(np.int64) + shift, int(split), m) for x in (lo, hi))
                hi[int(split) :] = lo[int(split) :]
                yield from _visit(lists, lo, np.maximum(hi, lo), threshold, block)

    return run


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (a, b, overlap) by binary search of each window of one set in the other."""
    last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        counts = []
        for b, x, y in zip(batch.column("b").to_pylist(), batch.column("blob_a").to_pylist(), batch.column("blob_b").to_pylist()):
            if b != last[0]:
                last = b, np.sort(_decoded(y))
            mine, other = _decoded(x), last[1]
            at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
            counts.append(int((other[at] == mine).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("size_a"), batch.column("size_b"), pa.array(counts, pa.int64())], ["a", "b", "size_a", "size_b", "n"])


def n_buckets(sources: DataFrame) -> int:
    """Buckets for the bytes of all sources; at least one a core."""
    total = sources.agg(F.sum(F.octet_length("source"))).first()[0] or 0
    return min(max(-(-total // BUCKET_BYTES), sources.sparkSession.sparkContext.defaultParallelism), 1 << 17)


def arranged_documents(sources: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """Rows DOCS of the documents that may have a partner, and of those with copies in their pack.

    ``sources``: hash, source and, where not all are compared with all, side: 1 and 2 are compared with
    each other, 3 with both. Other columns are ignored.
    """
    side = F.col("side") if "side" in sources.columns else F.lit(3)
    sent = sources.select("hash", "source", side.cast("tinyint").alias("side")).mapInArrow(w.send(buckets), w.SENT_DDL)
    counted = sent.repartitionById(buckets, F.col("target")).mapInArrow(w.count, w.SENT_DDL)
    return counted.repartition(buckets, "pack").groupBy("pack").applyInArrow(_arranged(threshold), DOCS)


def candidates(docs: DataFrame, threshold: float, buckets: int, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """a < b: the pairs that occur often enough in their merged lists."""
    sent = docs.where("blob IS NOT NULL").select("id", "size", "side", "skip", "blob").mapInArrow(_postings(threshold), "target int, blob binary")
    found = cut(sent.repartitionById(buckets, F.col("target")).mapInArrow(_merged(threshold, split, block), PAIRS))
    far = found.where("ranges IS NOT NULL").select("ranges").repartition(buckets).mapInArrow(_ranges(threshold, block), PAIRS)
    every = found.where("ranges IS NULL").unionByName(far).select("a", "b", "times", "n")
    return every.groupBy("a", "b").agg(F.max("times").alias("times"), F.sum("n").alias("n")).where("n >= times").select("a", "b")


def similar_sets(sources: DataFrame, threshold: float, sided: bool = False, split: int = SPLIT, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) between different window sets, and (a, hash): the sources of those sets and of
    all sets that several sources share, beside some that have no partner.

    ``sided`` sources have a column side (see ``arranged_documents``).
    """
    buckets = buckets or n_buckets(sources)
    docs = cut(arranged_documents(sources if sided else sources.select("hash", "source"), threshold, buckets))
    found = candidates(docs, threshold, buckets, split)
    sets = docs.where("blob IS NOT NULL").select("id", "size", "blob").dropDuplicates(["id"])
    met = found.join(sets.toDF("a", "size_a", "blob_a"), "a").join(sets.toDF("b", "size_b", "blob_b"), "b")
    counted = met.select("a", "b", "size_a", "size_b", "blob_a", "blob_b").mapInArrow(_probed, "a bigint, b bigint, size_a int, size_b int, n bigint")
    similarity = F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))
    pairs = counted.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    members = docs.select(F.col("id").alias("a"), F.explode("hashes").alias("hash")).distinct()
    return pairs, members


#: Copies of one set that meet in one task; larger groups are dealt out.
COPIES = 1000


def expand(pairs: DataFrame, members: DataFrame, copies: int = COPIES) -> DataFrame:
    """hash_a < hash_b, similarity: all pairs of sources, with those of one window set (similarity 1).

    The copies of a set are dealt to as many salts as it has thousands of them and meet salt by salt.
    """
    other = members.select(F.col("a").alias("b"), F.col("hash").alias("other"))
    across = pairs.join(members, "a").join(other, "b").select("hash", "other", "similarity")
    several = members.groupBy("a").agg((F.floor(F.count(F.lit(1)) / copies) + 1).cast("int").alias("_salts"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("a", "_salts")
    dealt = members.join(several, "a")
    left = dealt.withColumn("_salt", F.pmod(F.xxhash64("hash"), F.col("_salts")).cast("int")).select("a", "hash", "_salt")
    right = dealt.select("a", F.col("hash").alias("other"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    within = left.join(right, ["a", "_salt"]).where("hash < other").select("hash", "other", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("hash", "other").alias("hash_a"), F.greatest("hash", "other").alias("hash_b"), "similarity")


def similar_sources(sources: DataFrame, threshold: float = 0.5, split: int = SPLIT, buckets: int | None = None) -> DataFrame:
    """hash_a, hash_b, similarity of all pairs of sources whose Jaccard index is at least ``threshold``.

    ``sources``: hash, source. Repeated rows count once; null hashes, and null, empty or blank sources
    and those of fewer than five tokens, have no pairs. An empty table gives an empty result.
    """
    return expand(*similar_sets(sources, threshold, split=split, buckets=buckets))


def groups(sources: DataFrame, threshold: float = 0.5) -> DataFrame:
    """hash, group, n_links: every source with a near-duplicate, the least hash it is linked to over
    any chain, and the number of its window set's links to other sets. Copies are not expanded."""
    from corpusmill.llm.splits import entity_components

    pairs, members = similar_sets(sources, threshold)
    pairs = cut(pairs)
    linked = entity_components(pairs, "a", "b").select(F.col("node").cast("bigint").alias("a"), "component")
    degree = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    label = F.coalesce("component", F.col("a").cast("string"))
    return (
        members.join(linked, "a", "left").join(degree, "a", "left")
        .select("hash", label.alias("_set"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        .transform(lambda t: t.join(t.groupBy("_set").agg(F.min("hash").alias("group"), F.count(F.lit(1)).alias("_n")), "_set"))
        .where("_n > 1").select("hash", "group", "n_links")
    )
