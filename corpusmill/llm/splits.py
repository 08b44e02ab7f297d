"""Splits that keep related records together.

Records that share an entity (here: an owner, in any spelling) form a component, which goes to one
split as a whole. Components are balanced over many equal bins by the largest-differencing method:
the two partial solutions whose loads differ most are merged, heaviest bin of one on lightest bin of
the other, until one solution is left. Whole bins then go to the splits by target proportion.

Scale: the method needs all weights in one place, so it runs on a bounded number of items.
Components that weigh at least a quarter of a bin are items of their own (at most 4 x bins of them);
all others fall by hash into a fixed number of classes, each one item. The item of a record is thus
a broadcast lookup in a bounded table or a hash of its component: assigning splits shuffles nothing,
and no component, however hot, is gathered anywhere.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import beside, cut
from corpusmill.sources.tables import owner_key

TARGETS = {"training": 0.8, "validation": 0.1, "test": 0.1}


def entity_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component of the graph whose edges are the rows (left, right); component = least node.

    For records tied by an entity. Every round each node takes the least label among its neighbours' and
    then its label's label, so labels travel twice as far each round; they only ever fall, so the rounds
    end. The labels are written to the shared checkpoint folder, so lineage stays short. A hot node is
    reduced with map-side minima, not gathered. Null ends carry no link.
    """
    edges = links.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "seen").alias("next"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("component").alias("far")), "next", "left")
        fresh = cut(jump.select("node", F.col("component").alias("old"), F.least("next", F.coalesce("far", "next")).alias("component")))
        done = fresh.where("old <> component").isEmpty()
        labels = fresh.select("node", "component")
        if done:
            return labels


def owner_components(mappings: DataFrame, owner: str = "owner") -> DataFrame:
    """``mappings`` with component: the entity behind a spelling of the owner.

    Spellings are tied to the key they share; the component is that key. Null owners are one entity ''.
    Spellings are few beside the mappings, which are joined to a table broadcast by its count.
    """
    spelled = mappings.select(F.coalesce(F.col(owner), F.lit("")).alias("_spelled")).distinct().withColumn("_key", owner_key("_spelled"))
    # nodes of the two kinds are told apart by their first character; keys come first, so they name components
    links = spelled.select(F.concat(F.lit("="), "_spelled").alias("_a"), F.concat(F.lit("+"), "_key").alias("_b"))
    found = entity_components(links, "_a", "_b").where("node LIKE '=%'").select(F.substring("node", 2, 1 << 30).alias("_spelled"), F.substring("component", 2, 1 << 30).alias("component"))
    return beside(mappings.drop("component").withColumn("_spelled", F.coalesce(F.col(owner), F.lit(""))), cut(found), "_spelled").drop("_spelled")


def largest_differencing(weights: list[float], bins: int) -> list[int]:
    """Bin of each weight by the largest-differencing method over ``bins`` bins. No weights: no bins.

    A partial solution is a list of (load, members) from light to heavy, its loads less the lightest.
    Ties go by order of creation, so equal inputs give equal answers.
    """
    if not weights:
        return []
    serial = count()
    heap = []
    for i, w in enumerate(weights):
        heap.append((-w if bins > 1 else 0, next(serial), [(0.0, ())] * (bins - 1) + [(float(w), (i,))]))
    heapq.heapify(heap)
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # a member list is a pair of lists, so that merging costs nothing
        merged = sorted(((a + b, (x, y) if x and y else x or y) for (a, x), (b, y) in zip(first, reversed(second))), key=lambda s: s[0])
        least = merged[0][0]
        merged = [(load - least, members) for load, members in merged]
        heapq.heappush(heap, (-merged[-1][0], next(serial), merged))
    placed = [0] * len(weights)
    for bin_, (_, members) in enumerate(heap[0][2]):
        open_ = [members]
        while open_:
            for x in open_.pop():
                if isinstance(x, tuple):
                    open_.append(x)
                else:
                    placed[x] = bin_
    return placed


def allocate_bins(loads: list[float], targets: dict[str, float]) -> list[str]:
    """Split of each bin: heaviest first, each to the split furthest below its share."""
    total = sum(loads)
    lack = {name: share * total for name, share in targets.items()}
    chosen = [""] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        chosen[i] = max(lack, key=lambda name: lack[name])
        lack[chosen[i]] -= loads[i]
    return chosen


def assign_splits(
    records: DataFrame,
    component: Column,
    targets: dict[str, float] | None = None,
    bins: int = 100,
    classes: int = 1024,
) -> DataFrame:
    """``records`` with columns ``component`` and ``split``; equal components get equal splits.

    Null and blank components count as one component ''. Repeated rows each weigh one; pass distinct
    records if they should not. Columns of these two names are replaced. An empty input stays empty.
    """
    targets = targets or TARGETS
    tagged = records.withColumn("component", F.coalesce(component, F.lit("")))
    weights = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("_weight"))
    total = weights.agg(F.coalesce(F.sum("_weight"), F.lit(0))).scalar()
    heavy = weights.where(F.col("_weight") * (4 * bins) >= total).select("component", F.concat(F.lit("h"), "component").alias("_own"))
    item = F.coalesce("_own", F.concat(F.lit("c"), F.pmod(F.xxhash64("component"), F.lit(classes)).cast("string")))
    items = weights.join(F.broadcast(heavy), "component", "left").groupBy(item.alias("_item")).agg(F.sum("_weight").alias("_weight"))

    def balance(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_weight", "_item"], ascending=[False, True], ignore_index=True)
        placed = largest_differencing(frame["_weight"].tolist(), bins)
        loads = [0.0] * bins
        for w, b in zip(frame["_weight"], placed):
            loads[b] += w
        splits = allocate_bins(loads, targets)
        return pd.DataFrame({"_item": frame["_item"], "split": [splits[b] for b in placed]})

    # at most 4 x bins + classes rows, whatever the input
    chosen = items.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda frame: balance(frame), "_item string, split string")
    return (
        tagged.drop("split")
        .join(F.broadcast(heavy), "component", "left")
        .withColumn("_item", item)
        .join(F.broadcast(chosen), "_item", "left")
        .drop("_item", "_own")
    )


def broken_components(assigned: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """component, split, n_sets, n_moved: components of ``assigned`` that the ``recorded`` sets of their keys
    tear apart, with their new split and how many of their keys are recorded elsewhere.

    Only keys that belong to one component count. ``recorded`` holds (key, set_name); null sets and
    null keys say nothing. A torn component has keys in several sets, so some lie outside its split.
    """
    of_key = assigned.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("component").alias("component"), F.max("component").alias("_last"), F.min("split").alias("split"))
    own = of_key.where("component = _last")
    sets = recorded.where(f"{key} IS NOT NULL AND set_name IS NOT NULL").select(key, "set_name").distinct()
    joined = own.join(sets, key)
    torn = joined.groupBy("component", "split").agg(F.count_distinct("set_name").alias("n_sets"), F.count_if(F.col("set_name") != F.col("split")).alias("n_moved"))
    return torn.where("n_sets > 1")


def balance_report(assigned: DataFrame) -> DataFrame:
    """split, n_records, n_components, share."""
    per = assigned.groupBy("split", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_components"))
    return per.withColumn("share", F.round(F.col("n_records") / per.agg(F.sum("n_records")).scalar(), 4))
