import random

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import partition as p
from corpusmill.operators import scoring as m
from corpusmill.operators import sequence as s

INTS = "array<int>"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [INTS] * len(values))))
    return df.select(column).first()[0]


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.integers(s.FIRST, s.SIZE - 1), min_size=0, max_size=12), st.integers(0, 10**6)), min_size=1, max_size=20))
def test_edits_undo_themselves(spark, rows):
    df = spark.createDataFrame(rows, "v array<int>, seed bigint").withColumn("e", s.drawn_edit(F.col("v"), F.col("seed"))).withColumn("w", s.applied(F.col("v"), F.col("e")))
    df = s.with_single_fix(df, "v", "w")
    out = df.select("v", "e", "w", "fix", s.applied(F.col("w"), s.inverse(F.col("e"))).alias("back"), s.deserialised(s.serialised(F.col("e"))).alias("again"), s.distance(F.col("v"), F.col("w")).alias("d")).collect()
    for r in out:
        assert r.back == r.v and r.again == r.e and r.d == 1 and r.w != r.v
        assert len(r.w) - len(r.v) == {"i": 1, "x": -1, "s": 0}[r.e.code]
        assert r.e.token is None or s.FIRST <= r.e.token < s.SIZE
        # the fix may sit elsewhere in a run of equal tokens, but does the same
        v = list(r.v)
        if r.fix.code == "i":
            v.insert(r.fix["index"], r.fix.token)
        elif r.fix.code == "x":
            assert v.pop(r.fix["index"]) == r.fix.original
        else:
            v[r.fix["index"]] = r.fix.token
        assert v == r.w


def test_no_single_fix(spark):
    df = spark.createDataFrame([([3, 4, 5], [4, 3, 5]), ([3], [3]), ([3], [3, 4, 5])], "a array<int>, b array<int>")
    assert [r.fix for r in s.with_single_fix(df, "a", "b").collect()] == [None, None, None]


@pytest.mark.parametrize("edit", [("i", 4, 3, None), ("x", 3, None, 3), ("z", 0, 3, 3)])
def test_edits_out_of_bounds(spark, edit):
    df = spark.createDataFrame([([3, 4, 5], edit)], "v array<int>, e struct<code:string,index:int,token:int,original:int>")
    with pytest.raises(Exception, match="does not fit"):
        df.select(s.applied(F.col("v"), F.col("e"))).collect()


@pytest.mark.parametrize("k", [2, 9, 20])
def test_contexts(spark, k):
    v = list(range(3, 13))
    df = spark.createDataFrame([(1, v)], "doc_id int, vector array<int>")
    forward = {r.pos: r for r in s.contexts(df, k).collect()}
    backward = {r.pos: r for r in s.contexts(df, k, True).collect()}
    assert len(forward) == len(backward) == len(v)
    for i, x in enumerate(v):
        assert forward[i].target == backward[i].target == x
        assert forward[i].context == ([s.START] * k + v[:i])[-k:]
        assert backward[i].context == (v[i + 1 :] + [s.END] * k)[:k]


def test_vocabulary_bijection(spark):
    df = spark.createDataFrame([(e,) for e in s.ENTRIES], "e string")
    rows = df.select("e", s.to_index(F.col("e")).alias("i"), s.to_text(s.to_index(F.col("e"))).alias("t")).collect()
    assert sorted(r.i for r in rows) == list(range(s.FIRST, s.SIZE)) and all(r.e == r.t for r in rows)
    with pytest.raises(Exception, match="out of vocabulary"):
        spark.createDataFrame([("?!",)], "e string").select(s.to_index(F.col("e"), strict=True)).collect()


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "if x")], "doc_id int, text string")
    assert {r.doc_id: len(r.vector) for r in s.vectors(df).collect()} == {2: 0, 3: 0, 4: 2}


def test_location_and_lines(spark):
    df = spark.createDataFrame([("ab\ncd", 3, 4), ("abc", 1, 2)], "t string, l int, c int")
    assert [tuple(r[0]) for r in df.select(s.location_end(F.col("t"), F.col("l"), F.col("c"))).collect()] == [(4, 1), (1, 4)]
    line = spark.createDataFrame([(["class", "A", "{"], [0, 6, 10])], "t array<string>, c array<int>").select(s.line_text(F.col("t"), F.col("c"))).first()[0]
    assert line == "class A   {"


def test_suggestion(spark):
    df = spark.createDataFrame([("A.java", 5, 12, ("x", 23, None, 7), "}", None, "  return 1; }")], "f string, l int, c int, e struct<code:string,index:int,token:int,original:int>, o string, n string, t string")
    text = df.select(s.suggestion(*(F.col(x) for x in ("f", "l", "c", "e", "o", "n", "t")))).first()[0]
    lines = text.split("\n")
    assert len(lines) == 4 and lines[0].startswith("A.java:5:13:") and "removing '}'" in lines[1] and lines[3].index("^") - 4 == 12


def test_scores(spark):
    f, b = [0.7, 0.2, 0.1], [0.0, 0.5, 0.5]
    df = spark.createDataFrame([(f, b, 0)], "forwards array<double>, backwards array<double>, truth int")
    r = m.with_metrics(df).first()
    import math

    assert r.xentropy == pytest.approx(-math.log(0.7) + 103.2789, abs=1e-3)
    assert r.indexed_prob == 0 and r.normal
    assert r.agreement == pytest.approx(1 - 0.7)
    top = df.select(m.suggestions(F.col("forwards"), F.col("backwards"), 2), m.argmax(F.col("backwards")), m.one_hot(F.lit(1), 3)).first()
    assert top[0] == [0, 1, 2] and top[1] == 1 and top[2] == [0.0, 1.0, 0.0]


def test_stray_token_is_the_first_candidate(spark):
    rows = []
    for pos in range(4):
        sure = [1.0 if i == pos else 0.0 for i in range(5)]
        doubt = [0.0 if i == pos else 0.25 for i in range(5)]
        rows.append(("f", pos, pos, *([doubt] * 2 if pos == 2 else [sure] * 2)))
    df = m.with_metrics(spark.createDataFrame(rows, "file string, position int, truth int, forwards array<double>, backwards array<double>"))
    tried = m.fix_candidates(df, k=1).orderBy("rank", "step").collect()
    assert {(r["index"], r.rank) for r in tried} == {(2, 1)} and [r.code for r in tried] == ["i"] * 3 + ["x"] + ["s"] * 3


def test_greedy_balances():
    random.seed(5)
    weights = [random.randrange(1, 50) for _ in range(200)]
    loads = [0] * 5
    for w, i in zip(weights, p.greedy(weights, 5)):
        assert loads[i] == min(loads)
        loads[i] += w


def test_split_fractions_and_no_leak(spark):
    repos = spark.createDataFrame([(f"o{i}", "n", i % 5) for i in range(500)], "owner string, name string, partition int")
    split = p.split_sets(repos, ["owner", "name"])
    counts = {(r.partition, r.set_name): r["count"] for r in split.groupBy("partition", "set_name").count().collect()}
    assert all(counts[i, "training"] == 80 and counts[i, "validation"] == 10 and counts[i, "test"] == 10 for i in range(5))
    assert p.leaking(split, ["owner", "name"]).count() == 0
    again = {tuple(r) for r in p.split_sets(repos.repartition(7), ["owner", "name"]).collect()}
    assert again == {tuple(r) for r in split.collect()}


def test_balanced_partitions(spark):
    totals = spark.createDataFrame([(f"o{i}", "n", i % 17) for i in range(300)], "owner string, name string, w int")
    loads = p.balanced_partitions(totals, ["owner", "name"], "w").groupBy("partition").agg(F.sum("w").alias("w")).collect()
    assert len(loads) == 5 and max(r.w for r in loads) - min(r.w for r in loads) <= 32


def test_distances_of_every_width(spark):
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("abc", "abc"), ("aba", "ababa"), ("aaaa", "aa"), ("xabcx", "xbcx")]
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        b = list(a)
        for _ in range(rng.randrange(50)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice("abcd") * rng.randrange(2)
        pairs.append((a, "".join(b)))
    pairs.append(("a" * 90, "b" * 80))
    df = spark.createDataFrame(pairs, "a string, b string")
    from corpusmill.operators import sequence

    got = df.select("a", "b", sequence.string_distance(F.col("a"), F.col("b"), (2, 9)).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in got] == [(a, b, plain(a, b)) for a, b in pairs]
