"""Evaluation texts leaking into training text.

Every run of ``WIDTH`` words of a held-out item is a pattern; a document leaks an item if it holds one
of its patterns, whatever stands between the words. The search is Wu-Manber's over words: a table of
the last blocks of two words says how far the window can move, so most windows are left after one
look; where it says nothing, the patterns with that suffix are compared, first by their first block,
then in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 13
_WORDS = re.compile(r"[^\W_]+").findall


class Numbers(dict):
    """Number of a word as written; 0 for words of no pattern. Case is ignored."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        number = self.known.get(word.casefold(), 0)
        if len(self) > 300_000:
            self.clear()
        self[word] = number
        return number


class WuManber:
    """Patterns of equal length over numbered words, and the items they belong to."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH) -> None:
        self.width = width
        known: dict[str, int] = {}
        self.shift: dict[tuple[int, int], int] = {}
        self.buckets: dict[tuple[int, int], dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            numbers = [known.setdefault(word.casefold(), len(known) + 1) for word in _WORDS(text or "")]
            for i in range(len(numbers) - width + 1):
                pattern = tuple(numbers[i : i + width])
                for j in range(1, width):
                    block = pattern[j - 1], pattern[j]
                    self.shift[block] = min(self.shift.get(block, width - 1), width - 1 - j)
                self.buckets.setdefault(pattern[-2:], {}).setdefault(pattern, set()).add(item)
        self.firsts = {suffix: {p[:2] for p in patterns} for suffix, patterns in self.buckets.items()}
        self.numbers = Numbers(known)

    def search(self, text: str | None) -> set[int]:
        """Items of which the text holds a pattern. Null and short texts hold none."""
        words = list(map(self.numbers.__getitem__, _WORDS(text))) if text else []
        found: set[int] = set()
        width, shift, n = self.width, self.shift, len(words)
        at = width - 1
        while at < n:
            if not words[at]:
                at += width
                continue
            block = words[at - 1], words[at]
            step = shift.get(block, width - 1)
            if step:
                at += step
                continue
            start = at - width + 1
            if (words[start], words[start + 1]) in self.firsts.get(block, ()):
                found |= self.buckets[block].get(tuple(words[start : at + 1]), set())
            at += 1
        return found


_automata: dict[str, WuManber] = {}


def _built(key: str, shared, width: int) -> WuManber:
    """The automaton of a block, kept by the worker until it meets another one."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = WuManber(shared.value, width)
    return _automata[key]


def leaked(documents: DataFrame, items: DataFrame, width: int = WIDTH, block: int = 20_000) -> DataFrame:
    """doc_id, item_id: each document with each item of which it holds ``width`` consecutive words.

    ``documents``: doc_id, text; ``items``: item_id, text. Pairs are distinct, null keys and texts
    give none, an empty table on either side gives an empty result. The items are the stated query
    set, small beside the documents; they stream through the driver in blocks of at most ``block``, which
    are searched for in one pass over all documents each, so what is held and broadcast at once stays
    bounded. A worker builds the tables of a block once, whatever number of tasks it runs.
    """
    wanted = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().sort("item_id", "text").toLocalIterator()
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = None
    while (rows := [tuple(r) for r in islice(wanted, block)]) or out is None:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid4().hex) -> Iterator[pa.RecordBatch]:
            automaton = _built(key, shared, width)
            for batch in batches:
                docs, hits = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key is not None:
                        for item in automaton.search(text):
                            docs.append(key)
                            hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(hits, pa.int64())], ["doc_id", "item_id"])

        part = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leak_report(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, set_name, n_documents: for every item, how many documents hold a part of it."""
    counts = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("item_id", "suite", "set_name").distinct().join(counts, "item_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))
