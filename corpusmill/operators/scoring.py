"""Scores of token positions under a pair of predicted distributions, and an n-gram model to predict with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.binding import let

#: The least positive single-precision number stands in for a probability of 0.
LEAST = 1.401298464324817e-45


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(values: Column) -> Column:
    def spread(v: Column) -> Column:
        raised = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
        return let(raised, lambda r: let(_sum(r), lambda total: F.transform(r, lambda x: x / total)))

    return let(values, spread)


def cross_entropy(distribution: Column, index: Column) -> Column:
    """In nats, of a prediction for the token that stands there."""
    return -F.log(F.greatest(F.get(distribution, index), F.lit(LEAST)))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, z: acc + z)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def total_variation(a: Column, b: Column) -> Column:
    half = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, z: acc + z) / 2
    return F.least(F.greatest(half, F.lit(0.0)), F.lit(1.0))


def is_normalised(a: Column, p: int = 1, tolerance: float = 0.01) -> Column:
    """Whether the p-norm is 1 within a relative tolerance."""
    norm = F.pow(F.aggregate(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(p))), F.lit(0.0), lambda acc, z: acc + z), F.lit(1.0 / p))
    return F.abs(norm - 1) <= F.lit(tolerance) * F.greatest(norm, F.lit(1.0))


def best_indices(distribution: Column, k: int = 3) -> Column:
    """The k most probable indices, the most probable first and lower ones among equals."""
    keyed = F.array_sort(F.transform(distribution, lambda x, i: F.struct((-x).alias("p"), i.alias("i"))))
    return F.transform(F.slice(keyed, 1, k), lambda s: s["i"])


def argmax(distribution: Column) -> Column:
    return F.array_position(distribution, F.array_max(distribution)) - 1


def suggestions(forwards: Column, backwards: Column, k: int = 3) -> Column:
    """What either direction would rather see, each once."""
    return F.array_union(best_indices(forwards, k), best_indices(backwards, k))


def with_metrics(positions: DataFrame) -> DataFrame:
    """Positions (forwards, backwards, truth) with every measure of agreement."""
    f, b, v = F.col("forwards"), F.col("backwards"), F.col("truth")
    return positions.withColumns(
        {
            "xentropy": cross_entropy(f, v) + cross_entropy(b, v), "indexed_prob": F.get(f, v) * F.get(b, v), "cosine": cosine(f, b),
            "agreement": 1 - total_variation(f, b), "normal": is_normalised(f) & is_normalised(b),
        }
    )


def worst_positions(scored: DataFrame, file: str, position: str, k: int = 3) -> DataFrame:
    """The k positions of each file that the model finds least likely, earlier ones first among equals."""
    order = Window.partitionBy(file).orderBy(F.col("xentropy").desc(), F.col(position))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bigram_model(vectors: DataFrame, size: int, alpha: float = 1.0) -> DataFrame:
    """previous, next, n, probability: counts over all neighbours, smoothed with alpha.

    Neighbours are counted per document before the shuffle, which then holds at most size^2 keys a task.
    """
    pairs = vectors.select(F.explode(F.zip_with(F.slice("vector", F.lit(1), F.greatest(F.size("vector") - 1, F.lit(0))), F.slice("vector", F.lit(2), F.greatest(F.size("vector") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("previous"), b.alias("next")))).alias("p"))
    counts = pairs.groupBy("p.previous", "p.next").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("previous").agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(totals), "previous").select("previous", "next", "n", ((F.col("n") + alpha) / (F.col("_all") + alpha * size)).alias("probability"))


def fix_candidates(files: DataFrame, k: int = 3) -> DataFrame:
    """file, rank, code, index, token, original: every edit to try at the worst positions, in order.

    ``files`` has a row per position with file, position, vector, xentropy, forwards and backwards. At
    each of the k worst positions: insert each suggestion, remove the token, substitute each.
    """
    worst = worst_positions(files, "file", "position", k)
    offered = suggestions(F.col("forwards"), F.col("backwards"))
    edit = lambda code, token, original: F.struct(F.lit(code).alias("code"), F.col("position").cast("int").alias("index"), token.cast("int").alias("token"), original.cast("int").alias("original"))
    nothing, there = F.lit(None), F.col("truth")
    edits = F.concat(F.transform(offered, lambda t: edit("i", t, nothing)), F.array(edit("x", nothing, there)), F.transform(offered, lambda t: edit("s", t, there)))
    return worst.select("file", "rank", F.posexplode(edits).alias("step", "edit")).select("file", "rank", "step", "edit.*")


def rendered(forwards: Column, backwards: Column, texts: Column, k: int = 3) -> Column:
    """The k best of either direction with their percentages, as text: 'forwards: a 50.00%, ... | ...'."""

    def side(name: str, distribution: Column) -> Column:
        each = F.transform(best_indices(distribution, k), lambda i: F.format_string("%s %.2f%%", F.get(texts, i), F.get(distribution, i) * 100))
        return F.concat(F.lit(f"{name}: "), F.array_join(each, ", "))

    return F.concat_ws(" | ", side("forwards", forwards), side("backwards", backwards))
