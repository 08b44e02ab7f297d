import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import neardup, overlap, provenance, splits, windows
from corpusmill.sources.tables import owner_key

MAPPING = "owner string, name string, hash string, path string"
WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingles(source):
    tokens = windows._TOKEN.findall((source or b"").decode("utf-8", "replace"))
    return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}


def brute_pairs(rows, threshold):
    sets = {h: shingles(s) for h, s in rows if h is not None}
    keys = sorted(h for h in sets if sets[h])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(40):
        words = text(rng, rng.choice([5, 6, 9, 30, 120, 400])).split()
        rows.append((f"{i:02d}a", " ".join(words).encode()))
        for j in range(rng.randrange(3)):
            edited = list(words)
            for _ in range(max(1, int(len(edited) * rng.choice([0.01, 0.03, 0.08, 0.15])))):
                k = rng.randrange(len(edited))
                edited[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [edited[k], rng.choice(WORDS)]])
            if rng.random() < 0.3 and len(edited) > 20:
                cut = rng.randrange(10, len(edited) - 5)
                edited = edited[cut:] + edited[:cut]  # moved blocks
            rows.append((f"{i:02d}{'bcd'[j]}", " ".join(edited).encode()))
    same = rows[3][1]
    rows += [("zz1", same.replace(b" ", b"\n  ")), ("zz2", same.replace(b" ", b"\t")), ("zz3", b""), ("zz4", b"a b"), ("zz5", None), ("zz6", b"\xff\xfe a b c d e"), (None, same), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_pairs_equal_brute_force(spark, corpus, threshold):
    df = spark.createDataFrame(corpus, "hash string, source binary").repartition(3)
    found = neardup.similar_sources(df, threshold).collect()
    pairs = [(r.hash_a, r.hash_b) for r in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute_pairs(corpus, threshold)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_pairs_of_divided_lists_and_packs(spark, corpus, threshold, monkeypatch):
    monkeypatch.setattr(neardup, "RANGE", 4)
    monkeypatch.setattr(windows, "PACK", 7)
    df = spark.createDataFrame(corpus, "hash string, source binary").repartition(5)
    docs = neardup.arranged_documents(df, threshold, 3)
    assert docs.count() > 0
    pairs = [(r.hash_a, r.hash_b) for r in neardup.similar_sources(df, threshold, split=2, buckets=3).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(corpus, threshold)


def in_memory(rows, threshold, split=10**9, block=1000):
    """The search without a session: pairs of ids that a bucket finds, ranges included."""
    packed = windows._Pack()
    for key, source in rows:
        packed.add(key, 3, windows.windows(windows.token_hashes(source)))
    batches = list(windows.count(iter([packed.rows(0, 1)])))
    docs = neardup._arranged(threshold)(pa.Table.from_batches(batches))
    live = docs.filter(pa.compute.is_valid(docs.column("blob"))).to_batches()
    out = list(neardup._merged(threshold, split, block)(neardup._postings(threshold)(iter(live))))
    far = [b.filter(pa.compute.is_valid(b.column("ranges"))) for b in out]
    near = [b.filter(pa.compute.is_null(b.column("ranges"))) for b in out]
    sums = {}
    for b in near + list(neardup._ranges(threshold, block)(iter(far))):
        for r in b.to_pylist():
            sums[r["a"], r["b"]] = (sums.get((r["a"], r["b"]), (0, 0))[0] + r["n"], r["times"])
    return {k for k, (n, times) in sums.items() if n >= times}, sum(b.num_rows for b in far)


def test_lists_divided_into_ranges_give_the_same_pairs(monkeypatch):
    monkeypatch.setattr(neardup, "RANGE", 5)
    rng = random.Random(15)
    base = text(rng, 60).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((str(i), " ".join(words[: rng.randrange(25, 61)]).encode()))
    whole, none = in_memory(rows, 0.5)
    divided, some = in_memory(rows, 0.5, split=3, block=7)
    assert whole == divided and not none and some > 10


def test_one_header_in_many_small_files_stays_small():
    """Windows that most documents share cost neither memory nor pairs unless the rest is shared, too."""
    tracemalloc = pytest.importorskip("tracemalloc")
    rng = random.Random(16)
    header = text(rng, 24)
    vocabulary = [f"v{i}" for i in range(60_000)]
    packed, batches = [windows._Pack() for _ in range(13)], []
    for i in range(50_000):
        source = f"{header} {' '.join(rng.choices(vocabulary, k=24))}".encode()
        packed[i // 4000].add(str(i), 3, windows.windows(windows.token_hashes(source)))
    batches = [p.rows(i, 1) for i, p in enumerate(packed)]
    tracemalloc.start()
    counted = pa.Table.from_batches(list(windows.count(iter(batches))))
    found = 0
    blobs = []
    for pack in range(13):
        own = counted.filter(pa.compute.equal(counted.column("pack"), pack))
        docs = neardup._arranged(0.5)(own)
        blobs += neardup._postings(0.5)(iter(docs.filter(pa.compute.is_valid(docs.column("blob"))).to_batches()))
    for b in neardup._merged(0.5, neardup.SPLIT, neardup.BLOCK)(iter(blobs)):
        found += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and found < 50_000


def test_squeezed_arrays_come_back():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, top, n, dtype=np.uint64) for top, n in ((200, 5), (60_000, 0), (1 << 31, 77), (1 << 63, 3))]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, windows.unsqueeze(windows.squeeze(*arrays))))


def test_pairs_of_nothing(spark):
    assert neardup.similar_sources(spark.createDataFrame([], "hash string, source binary")).collect() == []


def test_hot_group_of_copies_and_clashing_columns(spark):
    rng = random.Random(5)
    base = text(rng, 200)
    rows = [(f"c{i:03d}", base.replace(" ", " " * (1 + i % 7) + "\n" * (i // 7)).encode()) for i in range(60)]
    rows += [(f"x{i}", text(rng, 100).encode()) for i in range(60)]
    df = spark.createDataFrame(rows, "hash string, source binary").withColumn("a", F.lit(1)).withColumn("part", F.lit(2)).withColumn("n", F.lit(3))
    assert neardup.similar_sources(df, 0.5).count() == 60 * 59 // 2
    groups = neardup.groups(df, 0.5).collect()
    assert len(groups) == 60 and {r.group for r in groups} == {"c000"} and {r.n_links for r in groups} == {0}


def test_groups_are_chains(spark, corpus):
    df = spark.createDataFrame(corpus, "hash string, source binary")
    got = {r.hash: r.group for r in neardup.groups(df, 0.5).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(corpus, 0.5):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {h: root(h) for h in parent}


def test_very_long_source(spark):
    rng = random.Random(6)
    words = text(rng, 60_000).split()
    other = list(words)
    other[100] = "changed"
    df = spark.createDataFrame([("a", " ".join(words).encode()), ("b", " ".join(other).encode())], "hash string, source binary")
    assert [(r.hash_a, r.hash_b) for r in neardup.similar_sources(df).collect()] == [("a", "b")]


# overlaps


def brute_overlaps(rows, sets, threshold=0.5):
    of = {}
    for h, s in sets:
        of.setdefault(h, set()).add(s)
    have = {h for h, _ in rows if h is not None}
    out = {(s, h, h) for h, x in of.items() if h in have and "training" in x for s in x - {"training"}}
    for a, b in brute_pairs(rows, threshold):
        for x, y in ((a, b), (b, a)):
            if "training" in of.get(x, ()):
                out |= {(s, a, b) for s in of.get(y, set()) - {"training"}}
    return out


def test_overlaps_equal_brute_force(spark, corpus):
    rng = random.Random(7)
    hashes = sorted({h for h, _ in corpus if h}) + ["unknown"]
    sets = sorted({(h, rng.choice(["training", "training", "validation", "test"])) for h in hashes for _ in range(rng.choice([0, 1, 1, 2]))})
    source = spark.createDataFrame(corpus, "hash string, source binary").withColumn("side", F.lit("clash"))
    df = spark.createDataFrame(sets, "hash string, set_name string")
    blocks = overlap.overlaps(source.drop("side").repartition(9), df, split=2, buckets=3)
    found = overlap.overlaps(source.drop("side"), df)
    assert {(r.set_name, r.hash_a, r.hash_b) for r in blocks.collect()} == brute_overlaps(corpus, sets)
    got = [(r.set_name, r.hash_a, r.hash_b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_overlaps(corpus, sets)
    report = overlap.overlap_report(found, spark.createDataFrame([(" O", "n", h, "p") for h in hashes[:30]], MAPPING))
    assert {r.owner for r in report.collect()} <= {"o", None}


def test_overlaps_of_nothing(spark):
    source, sets = spark.createDataFrame([], "hash string, source binary"), spark.createDataFrame([], "hash string, set_name string")
    assert overlap.overlaps(source, sets).collect() == []


def test_segments_and_edits_decide(spark):
    rng = random.Random(17)
    words = text(rng, 300).split()
    edited = list(words)
    for i in (20, 90, 200):
        edited[i] = "changed"
    moved = words[150:] + words[:150]
    hashes = lambda x: windows.token_hashes(" ".join(x).encode())
    similarity, edits = overlap.decide(hashes(words), hashes(edited), 0.5)
    assert edits == 3 and 0.5 <= similarity <= len(shingles(" ".join(words).encode()) & shingles(" ".join(edited).encode())) / len(shingles(" ".join(words).encode()) | shingles(" ".join(edited).encode()))
    similarity, edits = overlap.decide(hashes(words), hashes(moved), 0.5)
    assert edits is None and similarity > 0.9


@pytest.mark.parametrize("seed", range(4))
def test_segments_lose_no_pair_within_their_edits(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
        d = plain_distance(a, b)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        for k in range(d, 7):
            assert overlap.segment_match(x, y, k)


def test_edits_within_the_bound_leave_the_similarity():
    rng = random.Random(18)
    for _ in range(200):
        words = text(rng, rng.randrange(20, 120)).split()
        edited = list(words)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(edited))
            edited[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [edited[i], rng.choice(WORDS)]])
        x, y = shingles(" ".join(words).encode()), shingles(" ".join(edited).encode())
        hashes = [windows.token_hashes(" ".join(t).encode()) for t in (words, edited)]
        similarity, edits = overlap.decide(*hashes, 0.5)
        exact = len(x & y) / len(x | y)
        assert (similarity >= 0.5) == (exact >= 0.5) and (edits is None) <= (similarity == exact)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_distance():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(3)
        band = rng.randrange(1, 8)
        d = plain_distance(a, b)
        assert overlap.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), band) == (d if d <= band else None)


def test_edits(spark):
    source = spark.createDataFrame([("a", b"a b c d e f g h"), ("b", b"a b c X e f g h")], "hash string, source binary")
    found = spark.createDataFrame([("test", "a", "b", 0.5)], "set_name string, hash_a string, hash_b string, similarity double")
    assert overlap.edits(found, source).first().edits == 1


def test_edits_beyond_the_first_band(spark):
    rng = random.Random(12)
    words = text(rng, 300).split()
    moved = words[150:] + words[:150]
    longer = words + text(rng, 500).split()
    other = text(rng, 280).split()
    sources = {"a": words, "b": moved, "c": longer, "d": other, "e": []}
    source = spark.createDataFrame([(h, " ".join(x).encode()) for h, x in sources.items()], "hash string, source binary")
    pairs = [(x, y) for x in "abcde" for y in "abcde" if x <= y]
    found = spark.createDataFrame([("test", x, y, 0.5) for x, y in pairs], "set_name string, hash_a string, hash_b string, similarity double")
    got = {(r.hash_a, r.hash_b): r.edits for r in overlap.edits(found, source).collect()}
    assert got == {(x, y): plain_distance(sources[x], sources[y]) for x, y in pairs}
    assert got["a", "b"] > 64 and got["a", "c"] == 500


def test_edit_distance_from_every_band():
    rng = random.Random(13)
    for _ in range(300):
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(60))] for k in (3, 5))
        for band in (0, 1, 3, 64):
            assert overlap.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), band) == plain_distance(a, b)


# splits


def test_largest_differencing_is_balanced_and_whole():
    rng = random.Random(9)
    weights = [rng.randrange(1, 100) for _ in range(400)]
    placed = splits.largest_differencing(weights, 10)
    loads = [0] * 10
    for w, b in zip(weights, placed):
        loads[b] += w
    assert len(placed) == 400 and max(loads) - min(loads) <= 3
    assert splits.largest_differencing([], 5) == [] and splits.largest_differencing([7], 3) == [2] and splits.largest_differencing([1, 2, 3], 1) == [0, 0, 0]
    assert splits.largest_differencing([8, 7, 6, 5, 4], 2) == splits.largest_differencing([8, 7, 6, 5, 4], 2)


def test_no_owner_in_two_splits(spark):
    rng = random.Random(10)
    owners = ["Hot "] * 300 + ["hot"] * 40 + [f"o{rng.randrange(300)}" for _ in range(700)] + [None, "", "  "]
    rows = [(o, "n", f"h{i}", "p") for i, o in enumerate(owners)]
    df = spark.createDataFrame(rows, MAPPING).withColumn("split", F.lit("clash")).withColumn("component", F.lit("clash"))
    out = splits.assign_splits(df, owner_key("owner"))
    assert out.count() == len(rows)
    per = out.groupBy("component").agg(F.count_distinct("split").alias("n"))
    assert per.agg(F.max("n")).first()[0] == 1
    shares = {r.split: r.share for r in splits.balance_report(out).collect()}
    assert abs(shares["training"] - 0.8) < 0.03 and abs(shares["validation"] - 0.1) < 0.03
    again = {(r.hash, r.split) for r in splits.assign_splits(df.repartition(5), owner_key("owner")).collect()}
    assert again == {(r.hash, r.split) for r in out.collect()}


def test_broken_components(spark):
    mappings = [("A ", "n", "h1", "p"), ("a", "n", "h2", "p"), ("b", "n", "h3", "p"), ("b", "n", "h4", "p"), ("c", "n", "h4", "p"), ("c", "n", None, "p"), (None, "n", "h9", "p")]
    sets = [("h1", "training"), ("h2", "test"), ("h3", "training"), ("h4", "test"), ("h9", None), (None, "test")]
    assigned = splits.assign_splits(spark.createDataFrame(mappings, MAPPING), owner_key("owner"))
    found = splits.broken_components(assigned, spark.createDataFrame(sets, "hash string, set_name string"), "hash").collect()
    assert [(r.component, r.n_sets) for r in found] == [("a", 2)] and found[0].n_moved == 1 and found[0].split in splits.TARGETS


def test_splits_of_nothing(spark):
    assert splits.assign_splits(spark.createDataFrame([], MAPPING), owner_key("owner")).collect() == []


def test_components_over_several_entities(spark):
    links = [("a", "b"), ("b", "c"), ("x", "y"), ("q", None), ("d", "d")] + [(f"n{i}", f"n{i + 1}") for i in range(40)]
    got = {r.node: r.component for r in splits.entity_components(spark.createDataFrame(links, "l string, r string"), "l", "r").collect()}
    assert got["a"] == got["c"] == "a" and got["y"] == "x" and got["d"] == "d" and "q" not in got
    assert {got[f"n{i}"] for i in range(41)} == {"n0"}


# provenance

HAND = "import a\n\nclass Thing(Base):\n    def run(self, x):\n        return self.other(x, 1)\n"


@pytest.mark.parametrize(
    "source,expected",
    [
        (HAND, {}),
        ("# Code generated by tool v2; do not edit.\n" + HAND, {"notice": True}),
        ("#!/bin/sh\n# -*- coding: utf-8 -*-\n# @generated from x.idl\n" + HAND, {"notice": True}),
        ("out = '# Code generated by tool. DO NOT EDIT'\n" + HAND, {"notice": False}),
        ("# Tools for code that others generated\n" + HAND, {"notice": False}),
        ("/*! somelib v1.2.3 | MIT */\n" + HAND, {"banner": "somelib"}),
        ("# Copyright 2012 Some One\n" + HAND, {"banner": None}),
        ("# Python 3.6\n" + HAND, {"banner": None}),
        ("const x = [" + ",".join("1234" for _ in range(60)) + "];\n", {"data": True}),
        ("x = {'a': 1}\n" + HAND, {"data": False}),
        ("class A {\n static final int[] B = {\n" + ",".join("12" for _ in range(40)) + "\n };\n}\n", {"data": True}),
        ("import base64\nx = base64.b64decode('" + "QUJD" * 90 + "')\n", {"data": True}),
        ('const x = "data:image/png;base64,' + "QUJD" * 90 + '";\nexport default y;\n', {"data": True}),
        ("function a(b){return b.c?d(1):e[2]||!0}" * 20, {"squeezed": True}),
        ("<!DOCTYPE html><html>" + "<p>words and words of prose</p>" * 30, {"squeezed": False}),
        ("", {"data": False, "squeezed": False, "notice": False}),
    ],
)
def test_marks(source, expected):
    import pandas as pd

    row = next(provenance._features(iter([pd.DataFrame({"hash": ["h"], "source": [source.encode()]})]))).iloc[0]
    for key, value in expected.items():
        assert (row[key] == value) or (value is None and row[key] is None), (key, row[key])


def test_reasons(spark):
    squeezed = ("function a(b){return b.c?d(1):e[2]||!0}" * 20).encode()
    lib = b"def helper(a, b):\n    return [x + a for x in b if x > 2 and x < 90 and a not in b]\n"
    own = b"def own():\n    return 1\n"
    source = [("s", squeezed), ("l", lib), ("lb", b"# somelib v1.0.0 (c) X\n" + lib), ("o", own), ("n", None), ("e", b""), ("o", own)]
    files = [
        ("u", "app", "s", "js/x.js"), ("u", "app", "s", "js/x.py"), ("u", "app", "l", "third_party/somelib/h.py"), ("u", "app2", "lb", "src/a/h.py"), ("v", "home", "l", "lib/h.py"),
        ("w", "home", "l", "lib/h.py"), ("u", "app", "o", "shop/vendor/o.py"), ("u", "app", "o", "lib/parts/o.py"), ("u", "app", "o", "src/vendor_list.py"), ("u", "app", "lb", "vendor/somelib/LICENSE"),
        ("u", "app", "missing", "a.py"), (None, None, "o", None), ("u", "app", "n", "n.py"), ("u", "app", "e", "e.py"), ("u", "app", "s", "js/x.js"), ("somelib", "somelib", "lb", "h.py"),
    ]
    clash = spark.createDataFrame(files, MAPPING).withColumn("tokens", F.lit(1)).withColumn("reason", F.lit("x"))
    out = provenance.judged_files(clash, spark.createDataFrame(source, "hash string, source binary").withColumn("path", F.lit("y")))
    got = {(r.owner, r.name, r.path): r.reason for r in out.collect()}
    assert len(got) == 14 and out.count() == 14
    assert {k for k, v in got.items() if v} == {("u", "app", "js/x.js"), ("u", "app", "third_party/somelib/h.py"), ("u", "app2", "src/a/h.py")}
    empty = provenance.judged_files(spark.createDataFrame([], MAPPING), spark.createDataFrame([], "hash string, source binary"))
    assert empty.collect() == []


def test_grammar_reuse():
    from corpusmill.llm import grammar

    repeated = np.array([1, 2, 3, 4] * 50)
    distinct = np.arange(200)
    out = grammar.infer([repeated, distinct, np.zeros(0, np.int64), np.array([7])])
    assert out["size"].tolist() == [200, 200, 0, 1]
    assert out["rules"][1] == 0 and out["start"][1] == 200 and out["start"][2] == 0 and out["start"][3] == 1
    assert out["rules"][0] > 0 and out["start"][0] + 2 * out["rules"][0] < 40 and out["reuse"][0] > 5
    alone = grammar.infer([repeated])
    assert alone["start"][0] == out["start"][0] and alone["rules"][0] == out["rules"][0]


def test_rules_expand_to_the_same_hash_in_every_document():
    from corpusmill.llm import grammar

    rng = np.random.default_rng(5)
    phrase = rng.integers(1, 1 << 60, 40).astype(np.uint64)
    noise = [rng.integers(1, 1 << 60, 200).astype(np.uint64) for _ in range(3)]
    documents = [np.concatenate([phrase, noise[0], phrase]), np.concatenate([noise[1], phrase, noise[2][:7], phrase]), noise[2]]
    found = grammar.infer(documents)
    rules = [set(found["rule"][found["rule_of"] == i].tolist()) for i in range(3)]
    assert rules[0] & rules[1] and not rules[0] & rules[2]
    whole = np.uint64(0)
    for x in phrase:
        whole = whole * grammar._BASE + x
    assert int(whole) in rules[0] & rules[1]
    samples = grammar.sampled(found, 5)
    assert [len(x) for x in samples] == [5, 5, 5] and all((np.diff(x.astype(object)) > 0).all() for x in samples)


def _program(seed, n=60):
    rng = random.Random(seed)
    return "".join(f"def {rng.choice(WORDS)}{i}(a):\n    return {rng.choice(WORDS)}({rng.choice(WORDS)}, a) + {rng.randrange(900)}\n" for i in range(n))


def test_rules_shared_across_repositories_tell_libraries(spark):
    library, changed, own = _program(1), _program(1).replace("(a):", "(a): # x", 1).replace("return", "return not", 1), _program(2)
    source = [("l", library.encode()), ("c", changed.encode()), ("o", own.encode()), ("f", _program(3).encode())]
    files = [
        ("u", "one", "l", "packages/thing/h.py"), ("v", "two", "c", "libs/thing/h.py"), ("u", "one", "o", "packages/own/h.py"),
        ("w", "fork", "f", "packages/f/h.py"), ("x", "fork", "f", "packages/f/h.py"), ("u", "one", "l", "lib/loose/h.py"),
    ]
    got = {(r.owner, r.path): r.reason for r in provenance.judged_files(spark.createDataFrame(files, MAPPING), spark.createDataFrame(source, "hash string, source binary")).collect()}
    assert {k for k, v in got.items() if v == "vendored"} == {("u", "packages/thing/h.py"), ("v", "libs/thing/h.py")}


@pytest.mark.parametrize("common,seed,shared", [(22, 7, False), (42, 2, True)])
def test_all_long_rules_are_compared(spark, common, seed, shared):
    """Of the eight rules with the least hashes half are shared in the first pair, a quarter in the second."""
    from corpusmill.llm import grammar, windows

    begin = _program(1000 + seed, common)
    texts = [begin + _program(k + seed, 60 - common) for k in (2000, 3000)]
    found = grammar.infer([np.array([windows._hashes[t] for t in provenance.code_tokens(x)], np.uint64) for x in texts])
    rules = [set(found["rule"][found["rule_of"] == i].tolist()) for i in range(2)]
    assert (len(rules[0] & rules[1]) / len(rules[0]) >= 0.5) == shared
    source = [("a", texts[0].encode()), ("b", texts[1].encode()), ("a", texts[0].encode()), ("e", None)]
    files = [("u", "one", "a", "packages/x/h.py"), ("v", "two", "b", "src/h.py"), ("v", None, "b", "h.py"), ("w", None, "a", "h.py"), ("u", "one", "e", "packages/x/e.py")]
    got = provenance.judged_files(spark.createDataFrame(files, MAPPING), spark.createDataFrame(source, "hash string, source binary"))
    assert {(r.owner, r.path) for r in got.where("reason = 'vendored'").collect()} == ({("u", "packages/x/h.py")} if shared else set())


def test_a_notice_counts_where_the_grammar_shows_a_generator(spark):
    notice = "# Code generated by tool v2; do not edit.\n"
    table = "".join(f"    self.field_{i} = reader.read_value(stream, {i % 3})\n" for i in range(80))
    source = [("g", (notice + "def read(self, reader, stream):\n" + table).encode()), ("h", (notice + _program(4)).encode()), ("s", (notice + "x = f(1)\n").encode()), ("n", ("def read(self, reader, stream):\n" + table).encode())]
    files = [("u", "r", h, f"{h}.py") for h in "ghsn"]
    got = {r.hash: r.reason for r in provenance.judged_files(spark.createDataFrame(files, MAPPING), spark.createDataFrame(source, "hash string, source binary")).collect()}
    assert got["g"] == "generated" and got["s"] == "generated" and got["n"] is None


def test_banners_below_a_license_text():
    assert provenance.banner_of(["Copyright 2011 X", "Licensed under terms", "of no one", "", "somelib v1.2.3", "more"]) == ("somelib", "1.2.3")
    assert provenance.banner_of(["a", "b", "c", "as in", "somelib v1.2.3"]) == (None, None) and provenance.banner_of([]) == (None, None)


def test_spellings_of_an_owner_are_one_component(spark):
    rows = [("Ann", "r", "1", "p"), (" ann ", "s", "2", "p"), ("BOB", "r", "3", "p"), (None, "r", "4", "p"), ("=ann", "r", "5", "p")]
    got = {r.hash: r.component for r in splits.owner_components(spark.createDataFrame(rows, MAPPING).withColumn("component", F.lit("clash"))).collect()}
    assert got == {"1": "ann", "2": "ann", "3": "bob", "4": "", "5": "=ann"}
    assert splits.owner_components(spark.createDataFrame([], MAPPING)).collect() == []


def test_components_of_a_long_chain_and_a_hot_node(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)] + [("hub", f"x{i}") for i in range(300)]
    got = {r.node: r.component for r in splits.entity_components(spark.createDataFrame(chain, "a string, b string"), "a", "b").collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {v for k, v in got.items() if k[0] in "hx"} == {"hub"}


def test_classes_cost_little_balance():
    rng = random.Random(19)
    weights = [1 + int(rng.paretovariate(1.1)) for _ in range(20_000)]
    total, bins, classes = sum(weights), 100, 1024
    heavy = [w for w in weights if w * 4 * bins >= total]
    light = [0] * classes
    for w in weights:
        if w * 4 * bins < total:
            light[rng.randrange(classes)] += w
    for items in (heavy + light, sorted(weights)[-3000:]):
        loads = [0] * bins
        for w, b in zip(items, splits.largest_differencing(items, bins)):
            loads[b] += w
        chosen = splits.allocate_bins(loads, splits.TARGETS)
        shares = {s: sum(l for l, c in zip(loads, chosen) if c == s) / sum(items) for s in splits.TARGETS}
        assert all(abs(shares[s] - t) <= max(0.02, max(items) / sum(items)) for s, t in splits.TARGETS.items())
