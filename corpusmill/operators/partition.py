"""Balanced partitions of repositories, their split into sets, and what keeps sets apart."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETS = ["training", "validation", "test"]


def greedy(weights: list[float], n: int) -> list[int]:
    """Each weight in turn to the partition that is lightest then; equal ones by number."""
    heap = [(0.0, i) for i in range(n)]
    out = []
    for weight in weights:
        load, i = heap[0]
        heapq.heapreplace(heap, (load + weight, i))
        out.append(i)
    return out


def balanced_partitions(totals: DataFrame, keys: list[str], weight: str, n: int = 5, seed: str = "0", classes: int = 65_536) -> DataFrame:
    """keys, weight, partition: repositories dealt in a seeded order to the partition lightest so far.

    Dealing is sequential, so it works on a bounded number of items: repositories fall by hash into
    ``classes`` classes which are dealt as wholes; with far fewer repositories than classes nearly
    each is dealt by itself. Null weights count as 0.
    """
    digest = F.sha2(F.concat_ws("/", *keys, F.lit(seed)), 256)
    item = F.pmod(F.xxhash64(digest), F.lit(classes))
    tagged = totals.withColumn("_item", item)
    items = tagged.groupBy("_item").agg(F.min(digest).alias("_order"), F.sum(F.coalesce(F.col(weight), F.lit(0)).cast("double")).alias("_w"))

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_order", ignore_index=True)
        return pd.DataFrame({"_item": frame["_item"], "partition": greedy(frame["_w"].tolist(), n)})

    dealt = items.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda frame: deal(frame), "_item bigint, partition int")
    return tagged.join(F.broadcast(dealt), "_item").select(*keys, weight, "partition")


def hash_rank(rows: DataFrame, group: list[str], digest: Column, digits: int = 3) -> DataFrame:
    """``rows`` with _rank (from 1) and _n in each group, in the order of a hexadecimal digest.

    Ranks are taken within the digests' first digits and lifted by the counts before them, so a group
    is spread over 16^digits tasks.
    """
    keyed = rows.withColumn("_digest", digest).withColumn("_head", F.substring("_digest", 1, digits))
    heads = keyed.groupBy(*group, "_head").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    lifts = heads.select(*group, "_head", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_lift"), F.sum("_c").over(whole).alias("_n"))
    within = Window.partitionBy(*group, "_head").orderBy("_digest")
    return keyed.join(lifts, [*group, "_head"]).withColumn("_rank", F.row_number().over(within) + F.col("_lift")).drop("_head", "_lift")


def split_sets(repositories: DataFrame, keys: list[str], fractions: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """keys, partition, set_name: in each partition the first part in hash order trains, the next
    validates, the rest tests."""
    ranked = hash_rank(repositories, ["partition"], F.sha2(F.concat_ws("/", *keys), 256))
    first, second = F.floor(F.col("_n") * fractions[0]), F.floor(F.col("_n") * fractions[1])
    name = F.when(F.col("_rank") <= first, SETS[0]).when(F.col("_rank") <= first + second, SETS[1]).otherwise(SETS[2])
    return ranked.select(*keys, "partition", name.alias("set_name"))


def first_seen(assigned: DataFrame) -> DataFrame:
    """hash, partition, set_name: each hash only in the first set that has it, by partition and then set."""
    order = F.array_position(F.array(*(F.lit(s) for s in SETS)), F.col("set_name"))
    return assigned.groupBy("hash").agg(F.min(F.struct("partition", order.alias("o"), "set_name")).alias("m")).select("hash", "m.partition", "m.set_name")


def leaking(split: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that lie in more than one set; none if a split is sound."""
    return split.groupBy(*keys).agg(F.count_distinct("partition", "set_name").alias("n_sets")).where("n_sets > 1")


def first_n(split: DataFrame, n: int) -> DataFrame:
    """The first n hashes of each set, in the order of their digits."""
    order = Window.partitionBy("partition", "set_name").orderBy("hash")
    return split.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")
