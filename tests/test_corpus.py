import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus as c
from corpusmill.operators import skew


@pytest.fixture
def tables(spark):
    mappings = spark.createDataFrame(
        [("foo", "bar", "e", "a/__init__.py"), ("foo", "bar", "e", "b/__init__.py"), ("foo", "bar", "f1", "bar/hello.py"), ("herp", "derp", "f1", "derp/hello.py"), ("herp", "derp", "f2", "bar/hello.py")],
        "owner string, name string, hash string, path string",
    )
    summary = spark.createDataFrame([("e", 0, 0), ("f1", 1, 4), ("f2", 1, 4)], "hash string, sloc int, n_tokens int")
    failure = spark.createDataFrame([("f2", None)], "hash string, reason string")
    return mappings, summary, failure


def test_eligible_is_one_of_three(tables):
    mappings, summary, failure = tables
    assert [r.hash for r in c.eligible(summary, failure).collect()] == ["f1"]
    unique = {r.hash: r.is_unique for r in c.is_unique(mappings).collect()}
    assert unique == {"e": False, "f1": False, "f2": True}


def test_totals_count_duplicates_across_places(tables):
    mappings, summary, failure = tables
    totals = {(r.owner, r.name): r.n_tokens for r in c.repository_tokens(mappings, c.eligible(summary, failure)).collect()}
    assert totals == {("foo", "bar"): 4, ("herp", "derp"): 4}


def test_require_one(spark, tables):
    with pytest.raises(KeyError):
        c.require_one(tables[1], "hash", "nothing")
    assert c.require_one(tables[1], "hash", "f1").count() == 1


def test_failure_without_reason_gets_the_default(tables):
    assert c.failure_reasons(tables[2]).first().reason == "Syntax error"


def test_insert_missing_and_upsert(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string")
    assert [tuple(r) for r in c.insert_missing(old, new, ["id"]).collect()] == [(2, "c")]
    assert sorted(tuple(r) for r in c.upsert(old, new, ["id"], "v").collect()) == [(1, "b"), (2, "c")]


def test_grouped_median(spark):
    random.seed(1)
    for _ in range(5):
        values = [random.randrange(20) for _ in range(random.randrange(1, 40))]
        df = spark.createDataFrame([(f"{i}", v) for i, v in enumerate(values)], "hash string, n_tokens int")
        row = c.token_statistics(df).first()
        assert row.median_grouped == pytest.approx(statistics.median_grouped(values))
        assert row.median_grouped == pytest.approx(c.grouped_median_of(values))
        assert row["mode"] == min(statistics.multimode(values))


def test_two_class_break_is_the_best_split(spark):
    import math

    random.seed(2)
    values = [random.uniform(1, 5) for _ in range(30)] + [random.uniform(60, 90) for _ in range(10)]
    logs = sorted(set(values))

    def sse(xs):
        m = sum(xs) / len(xs)
        return sum((x - m) ** 2 for x in xs)

    best = min(range(1, len(logs)), key=lambda i: sse([math.log(v) for v in logs[:i]]) + sse([math.log(v) for v in logs[i:]]))
    df = spark.createDataFrame([(v,) for v in values], "ratio double")
    assert c.two_class_break(df, "ratio").scalar() is not None
    assert c.two_class_break(df, "ratio").first()[0] == pytest.approx(logs[best - 1])


@pytest.mark.parametrize("path,expected", [("a/x.min.js", True), ("A/X-MIN.JS", True), ("min.js", False), ("x.min.js\n", False), ("x.min.jsx", False)])
def test_minified_path(spark, path, expected):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(c.minified_path("path")).first()[0] is expected


@pytest.mark.parametrize("text,owner", [("a/b", "a"), ("a-b.c/d_e", "a-b.c"), ("a", None), ("a/b/c", None), ("a b/c", None)])
def test_repository_id(spark, text, owner):
    parsed = spark.createDataFrame([(text,)], "t string").select(c.repository_id(F.col("t")).alias("r")).first().r
    assert (parsed.owner if parsed else None) == owner


def test_safe_path(spark):
    rows = spark.createDataFrame([("a/b",), ("/a",), ("../a",), ("a/../b",), ("a..b",)], "p string").select(c.safe_path(F.col("p"))).collect()
    assert [r[0] for r in rows] == [True, False, False, False, True]


def test_clamp(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(c.clamp(F.col("x"), 0, 1)).collect()] == [0.0, 0.5, 1.0, None]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([(float("nan"),)], "x double").select(c.clamp(F.col("x"), 0, 1)).collect()


def test_integrity(spark, tables):
    mappings, summary, _ = tables
    assert c.missing_references(mappings, summary.where("hash <> 'f2'"), ["hash"]).collect()[0].hash == "f2"
    assert c.cascade_delete(mappings, summary.where("hash = 'e'"), ["hash"]).count() == 3


def test_metadata(spark):
    meta = spark.createDataFrame([("language", "Python"), ("note", None)], "key string, value string")
    assert c.metadata(meta, "language") == "Python" and c.metadata(meta, "none") is None


class TestEagerAggregation:
    def test_equals_the_plain_join(self, spark):
        random.seed(3)
        facts = [("hot" if random.random() < 0.5 else f"o{random.randrange(9)}", "n", random.choice([None, *"abcdef"]), str(i)) for i in range(300)]
        f = spark.createDataFrame(facts, "owner string, name string, hash string, path string")
        m = spark.createDataFrame([("a", 5), ("b", 7), ("b", 1), ("c", None), (None, 9)], "hash string, n int")
        got = {r.owner: (r.n_rows, r.total) for r in skew.eager_join_aggregate(f, m, "hash", ["owner", "name"], "n").collect()}
        counts = f.groupBy("owner").count().collect()
        sums = f.join(m, "hash").groupBy("owner").agg(F.sum("n").alias("s")).collect()
        plain = {r.owner: r.s for r in sums}
        assert got == {r.owner: (r["count"], plain.get(r.owner)) for r in counts}

    def test_totals(self, spark):
        rows = [(" A", "x", "h", "p"), (" A", "x", "h", "p"), ("a", "x", "h2", "q"), ("b", "y", "h", "p"), (None, "y", None, None)]
        mappings = spark.createDataFrame(rows, "owner string, name string, hash string, path string").withColumn("n_tokens", F.lit("clash"))
        summary = spark.createDataFrame([("h", 1, 10), ("h", 1, 10), ("h", 2, 0), ("h2", None, None)], "hash string, sloc int, n_tokens int")
        totals = {(r.owner, r.name): (r.n_mappings, r.n_tokens) for r in skew.repository_totals(mappings, summary).collect()}
        assert totals == {("a", "x"): (2, 10), ("b", "y"): (1, 10), (None, "y"): (1, 0)}
        heavy = skew.heavy_repositories(skew.repository_totals(mappings, summary), 0.5).collect()
        assert [(r.owner, r.name) for r in heavy] == [("a", "x")]

    def test_empty(self, spark):
        mappings = spark.createDataFrame([], "owner string, name string, hash string, path string")
        summary = spark.createDataFrame([], "hash string, sloc int, n_tokens int")
        assert skew.heavy_repositories(skew.repository_totals(mappings, summary)).collect() == []
