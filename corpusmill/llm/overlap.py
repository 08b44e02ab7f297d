"""Same or near-same records across splits.

Equal records are a join of the recorded sets. For near-equal ones the required similarity is one of
window sets, which forgives moved blocks, so no edit distance bounds it from above and no segment
has to stay at its position. Candidates therefore come from rare windows (``neardup``, with an
evaluation and a training side), which loses no pair. Each candidate is then decided by the segment
join: the evaluation sequence is cut into k + 1 contiguous segments, which are looked for in the
training sequence at the positions that k edits allow; where one matches, a banded dynamic program
gives the edits up to k. An edit changes at most five windows of either set, so k = m / 15 edits of a
set of m windows leave a similarity of at least one half, and pairs within the band are decided by
their edits. Pairs beyond it, with moved blocks or larger insertions, are decided by counting windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import neardup
from corpusmill.llm import windows as w
from corpusmill.runtime import cut
from corpusmill.sources.tables import owner_key

TRAINING, EVALUATION = 1, 2
SMALL = 300_000


def allowed_edits(windows: int, threshold: float) -> int:
    """Edits of a set of so many windows after which the similarity is still at least the threshold."""
    return int(windows * (1 - threshold) / (w.WIDTH * (1 + threshold)) + 1e-9)


def segment_match(held: np.ndarray, trained: np.ndarray, k: int) -> bool:
    """Whether one of the k + 1 segments of ``held`` stands in ``trained`` at a position that k edits
    allow. If none does, the sequences are more than k edits apart. Segments are compared by hash."""
    if abs(len(held) - len(trained)) > k:
        return False
    length = len(held) // (k + 1)
    if not length:
        return True
    here, there = w.rolling(held, length), w.rolling(trained, length)
    starts = np.arange(k + 1) * length
    position = starts[:, None] + np.arange(-k, k + 1)
    inside = (position >= 0) & (position < len(there))
    return bool(len(there)) and bool(((there[np.clip(position, 0, len(there) - 1)] == here[starts][:, None]) & inside).any())


def decide(held: np.ndarray, trained: np.ndarray, threshold: float) -> tuple[float, int | None]:
    """(similarity, edits) of two token sequences; edits where they decided that the pair is similar,
    null where the windows were counted. Decided by edits, the similarity is the least they leave."""
    x, y = w.windows(held), w.windows(trained)
    k = allowed_edits(max(len(x), len(y)), threshold)
    edits = banded_distance(held, trained, k) if segment_match(held, trained, k) else None
    if edits is not None and edits <= k:
        least = (max(len(x), len(y)) - w.WIDTH * edits) / (max(len(x), len(y)) + w.WIDTH * edits)
        return max(least, threshold), edits
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(len(x) + len(y) - common, 1), None


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edit distance of two sequences if it is at most ``band``, by dynamic programming over the
    diagonals that such a distance can reach; else None.

    A row of the band is kept as two integers of 2 * band + 1 bits, which say where the distance rises
    and falls by one from each cell to the next (Hyyro's bit vectors), and is worked out in a dozen
    operations on them.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > band:
        return None
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    band = min(band, len(b))
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int32)
    a, b = codes[: len(a)], np.pad(codes[len(a) :], band, constant_values=-1)
    width = 2 * band + 1
    cells = (1 << width) - 1
    distance = len(b) - 2 * band - len(a)  # where the diagonal of the last cell begins
    diagonal = 1 << (distance + band)
    rises, falls = cells >> band << band, 0
    block = max(1, (1 << 20) // width)
    for lo in range(0, len(a), block):
        rows = a[lo : lo + block]
        equal = np.packbits(np.lib.stride_tricks.sliding_window_view(b[lo : lo + len(rows) + width - 1], width) == rows[:, None], axis=1, bitorder="little")
        for row in equal:
            x = int.from_bytes(row.tobytes(), "little")
            free = ((((x & rises) + rises) ^ rises) | x | falls) & cells  # cells that cost no more than the one before on their diagonal
            up = falls | (cells ^ (free | rises))
            down = free & rises
            if not free & diagonal:
                distance += 1
                if distance > band:
                    return None
            free >>= 1
            rises, falls = down | (cells ^ (free | up)), free & up
    return distance


def edit_distance(a: np.ndarray, b: np.ndarray, band: int = 64) -> int:
    """Edit distance of two sequences: the band is doubled until the distance fits, which it does at
    the length of the longer one at the latest."""
    most = max(len(a), len(b))
    band = max(1, band)
    while (distance := banded_distance(a, b, min(band, most))) is None:
        band *= 2
    return distance


def _beside(big: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Join on ``key``; ``few`` is broadcast only where a count proves it small."""
    return big.join(F.broadcast(few) if few.limit(SMALL + 1).count() <= SMALL else few, key)


def decided_pairs(source_file: DataFrame, sets: DataFrame, threshold: float = 0.5, split: int = neardup.SPLIT, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity, edits) of similar window sets across the sides, and (a, hash): their sources."""
    side = F.when(F.col("set_name") == "training", TRAINING).otherwise(EVALUATION)
    sides = sets.groupBy("hash").agg(F.bit_or(side).cast("tinyint").alias("side"))
    sources = source_file.select("hash", "source")
    buckets = buckets or neardup.n_buckets(sources)
    docs = cut(neardup.arranged_documents(_beside(sources, sides, "hash"), threshold, buckets))
    heads = docs.select("id", "side", F.array_min("hashes").alias("hash")).groupBy("id").agg(F.bit_or("side").alias("side"), F.min("hash").alias("hash"))
    found = neardup.candidates(docs, threshold, buckets, split)
    ends = cut(found.join(heads.toDF("a", "side_a", "hash_a"), "a").join(heads.toDF("b", "side_b", "hash_b"), "b"))
    wanted = ends.select(F.explode(F.array("hash_a", "hash_b")).alias("hash")).distinct()
    texts = _beside(sources, wanted, "hash").dropDuplicates(["hash"])
    met = ends.join(texts.toDF("hash_a", "source_a"), "hash_a").join(texts.toDF("hash_b", "source_b"), "hash_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for side_a, x, y in zip(frame["side_a"], frame["source_a"], frame["source_b"]):
                x, y = w.token_hashes(x), w.token_hashes(y)
                rows.append(decide(x, y, threshold) if side_a & EVALUATION else decide(y, x, threshold))
            out = pd.DataFrame(rows, columns=["similarity", "edits"])
            out["a"], out["b"], out["edits"] = frame["a"].to_numpy(), frame["b"].to_numpy(), out["edits"].astype("Int64")
            yield out[["a", "b", "similarity", "edits"]]

    pairs = met.select("a", "b", "side_a", "source_a", "source_b").mapInPandas(run, "a bigint, b bigint, similarity double, edits bigint")
    members = docs.select(F.col("id").alias("a"), F.explode("hashes").alias("hash")).distinct()
    return pairs.where(F.col("similarity") >= threshold), members


def near_overlaps(source_file: DataFrame, sets: DataFrame, threshold: float = 0.5, split: int = neardup.SPLIT, buckets: int | None = None) -> DataFrame:
    """set_name, hash_a, hash_b, similarity: near-equal sources of which one has results in training and
    the other in ``set_name`` (not training)."""
    pairs, members = decided_pairs(source_file, sets, threshold, split, buckets)
    expanded = neardup.expand(cut(pairs.drop("edits")), members)
    train = sets.where("set_name = 'training'").select("hash")
    held = sets.where("set_name <> 'training'")
    found = None
    for x, y in (("hash_a", "hash_b"), ("hash_b", "hash_a")):
        one = expanded.join(train.withColumnRenamed("hash", x), x, "left_semi").join(held.withColumnRenamed("hash", y), y).select("set_name", "hash_a", "hash_b", "similarity")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def overlaps(source_file: DataFrame, sets: DataFrame, threshold: float = 0.5, split: int = neardup.SPLIT, buckets: int | None = None) -> DataFrame:
    """set_name, hash_a <= hash_b, similarity: all overlaps of training with each other set.

    ``sets``: distinct (hash, set_name) without nulls. A source with results in training and in
    another set overlaps itself (hash_a = hash_b). Repeated source rows count once; sources of fewer
    than five tokens overlap only exactly. Empty tables give an empty result.
    """
    train = sets.where("set_name = 'training'").select("hash")
    both = sets.where("set_name <> 'training'").join(train, "hash", "left_semi").join(source_file.select("hash").distinct(), "hash", "left_semi")
    exact = both.select("set_name", F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(1.0).alias("similarity"))
    return exact.unionByName(near_overlaps(source_file, sets, threshold, split, buckets))


def edits(found: DataFrame, source_file: DataFrame, band: int = 64) -> DataFrame:
    """``found`` with the token edits between the two sources, of every pair; ``band`` is the first to
    be tried. ``found`` is kept in the shared folder, as it is read three times."""
    found = cut(found)
    wanted = found.select(F.col("hash_a").alias("hash")).unionByName(found.select(F.col("hash_b").alias("hash"))).distinct()
    texts = _beside(source_file.select("hash", "source"), wanted, "hash").dropDuplicates(["hash"])
    pairs = found.join(texts.select(F.col("hash").alias("hash_a"), F.col("source").alias("_a")), "hash_a").join(texts.select(F.col("hash").alias("hash_b"), F.col("source").alias("_b")), "hash_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["edits"] = pd.array(
                [edit_distance(w.token_hashes(a), w.token_hashes(b), band) for a, b in zip(frame["_a"], frame["_b"])], dtype="Int64"
            )
            yield frame[["set_name", "hash_a", "hash_b", "similarity", "edits"]]

    return pairs.select("set_name", "hash_a", "hash_b", "similarity", "_a", "_b").mapInPandas(run, "set_name string, hash_a string, hash_b string, similarity double, edits bigint")


def overlap_report(found: DataFrame, repository_source: DataFrame) -> DataFrame:
    """set_name, owner, name, n_exact, n_near: overlapping evaluation or training sources of each
    repository, counted as distinct hashes. Hashes without a mapping have null owner and name."""
    each = found.select("set_name", F.explode(F.array_distinct(F.array("hash_a", "hash_b"))).alias("hash"), (F.col("hash_a") == F.col("hash_b")).alias("exact"))
    each = each.groupBy("set_name", "hash").agg(F.max("exact").alias("exact"))
    homes = repository_source.select(owner_key("owner").alias("owner"), "name", "hash").distinct()
    return each.join(homes, "hash", "left").groupBy("set_name", "owner", "name").agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"))
