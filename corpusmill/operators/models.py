"""Scoring token vectors with a pair of models: an interface, an n-gram model and a recurrent one.

A scorer is made in each worker from what it is given (a count table, a weight file's bytes), both of
a size fixed by the vocabulary and the layers, and maps a vector to two distributions a token.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = 1, 2
Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def scored(vectors: DataFrame, make: Callable[[], Scorer], key: str = "doc_id") -> DataFrame:
    """key, position, truth, forwards, backwards of every token of every vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for frame in frames:
            for name, vector in zip(frame[key], frame["vector"]):
                vector = np.asarray(vector, np.int64)
                if not len(vector):
                    continue
                forwards, backwards = score(vector)
                yield pd.DataFrame({key: name, "position": range(len(vector)), "truth": vector.astype("int32"), "forwards": list(forwards.astype(float)), "backwards": list(backwards.astype(float))})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "vector").mapInPandas(run, f"{key} {kind}, position int, truth int, forwards array<double>, backwards array<double>")


def bigram_scorer(counts: np.ndarray, alpha: float = 1.0) -> Callable[[], Scorer]:
    """From a matrix of counts (previous, next) over the vocabulary."""

    def make() -> Scorer:
        smooth = counts + alpha
        following, preceding = smooth / smooth.sum(1, keepdims=True), (smooth / smooth.sum(0, keepdims=True)).T

        def score(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return following[np.append(START, vector[:-1])[: len(vector)]], preceding[np.append(vector[1:], END)[: len(vector)]]

        return score

    return make


def context_length(*weights: bytes, default: int = 9) -> int:
    """Length of the contexts that all weight files were trained on (array context, ``default`` where a
    file has none); ValueError where they differ."""
    found = {int(model["context"]) if "context" in model else default for model in (np.load(io.BytesIO(data)) for data in weights)}
    if len(found) != 1:
        raise ValueError(f"contexts of different lengths: {sorted(found)}")
    return found.pop()


def one_hot_contexts(vector: np.ndarray, size: int, context: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, targets) of all positions, one-hot: shapes (n, context, size) and (n, size)."""
    vector = np.asarray(vector, np.int64)
    unit = np.eye(size, dtype=np.float32)
    if not len(vector):
        return np.zeros((0, context, size), np.float32), np.zeros((0, size), np.float32)
    padded = np.concatenate([vector[1:], np.full(context, END)]) if backwards else np.concatenate([np.full(context, START), vector[:-1]])
    return unit[np.lib.stride_tricks.sliding_window_view(padded, context)], unit[vector]


def training_batches(vectors: DataFrame, size: int, context: int, batch: int, backwards: bool = False, epochs: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of contexts and targets over all vectors, epoch after epoch, endlessly without ``epochs``.
    The last batch of an epoch holds what is left. Vectors stream through the driver a partition at a
    time, for a trainer beside Spark."""
    epoch = 0
    while epochs is None or epoch < epochs:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        seen = False
        for row in vectors.select("vector").toLocalIterator():
            x, y = one_hot_contexts(np.array(row["vector"]), size, context, backwards)
            seen |= bool(len(y))
            held.append((x, y))
            n += len(y)
            while n >= batch:
                xs, ys = (np.concatenate(c) for c in zip(*held))
                yield xs[:batch], ys[:batch]
                held, n = [(xs[batch:], ys[batch:])], n - batch
        if n:
            yield tuple(np.concatenate(c) for c in zip(*held))
        if not seen:
            return
        epoch += 1


def samples_per_epoch(vectors: DataFrame) -> int:
    """Contexts in all vectors: one a token."""
    return vectors.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()[0]


def lstm_scorer(forwards: bytes, backwards: bytes, context: int | None = None) -> Callable[[], Scorer]:
    """From two weight files (npz) with arrays kernel_i, recurrent_i and bias_i of each layer (gates in
    the order input, forget, cell, output), and dense and dense_bias. Both need equal vocabularies and
    contexts; the context's length is read from the files unless given."""
    context = context_length(forwards, backwards) if context is None else context

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def make() -> Scorer:
        models = [dict(np.load(io.BytesIO(data))) for data in (forwards, backwards)]
        if models[0]["dense"].shape[1] != models[1]["dense"].shape[1]:
            raise ValueError("the two directions have different vocabularies")

        def predict(model: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
            layers = sum(name.startswith("kernel_") for name in model)
            inputs: np.ndarray = np.eye(model["dense"].shape[1])[windows]
            for i in range(layers):
                kernel, recurrent, bias = (model[f"{part}_{i}"] for part in ("kernel", "recurrent", "bias"))
                size = recurrent.shape[0]
                h = c = np.zeros((len(windows), size))
                outputs = []
                for t in range(inputs.shape[1]):
                    z = inputs[:, t] @ kernel + h @ recurrent + bias
                    gate = [sigmoid(z[:, k * size : (k + 1) * size]) if k != 2 else np.tanh(z[:, 2 * size : 3 * size]) for k in range(4)]
                    c = gate[1] * c + gate[0] * gate[2]
                    h = gate[3] * np.tanh(c)
                    outputs.append(h)
                inputs = np.stack(outputs, 1)
            logits = inputs[:, -1] @ model["dense"] + model["dense_bias"]
            raised = np.exp(logits - logits.max(1, keepdims=True))
            return raised / raised.sum(1, keepdims=True)

        def score(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(vector):
                empty = np.zeros((0, models[0]["dense"].shape[1]))
                return empty, empty
            before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(context, START), vector[:-1]]), context)
            after = np.lib.stride_tricks.sliding_window_view(np.concatenate([vector[1:], np.full(context, END)]), context)
            return predict(models[0], before), predict(models[1], after)

        return score

    return make


def seeded_order(rows: DataFrame, seed: int, *keys: str) -> Column:
    """A column to sort by for an order that the seed fixes: first files, then what is in them."""
    return F.xxhash64(F.lit(seed), *keys)


def validated(candidates: DataFrame, text: str, check: Callable[[bytes], bool], keep: list[str]) -> DataFrame:
    """Candidates whose repaired text passes a syntax check; a null text, of a token that has no
    source, does not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[t is not None and check(t.encode()) for t in frame[text]]]

    columns = [*keep, text]
    return candidates.select(*columns).mapInPandas(run, candidates.select(*columns).schema)
