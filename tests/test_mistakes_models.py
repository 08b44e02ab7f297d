import io

import numpy as np
import pytest

from corpusmill.operators import languages, mistakes, models
from corpusmill.operators import scoring as m

SCHEMA = "source_file_id bigint, before_id bigint, before binary, after binary"


def pair(spark, before, after, abstract):
    df = spark.createDataFrame([(1, 2, before.encode(), after.encode())], SCHEMA)
    lexed = mistakes.lexed(df, "java", abstract)
    return mistakes.distances(lexed).first().levenshtein, mistakes.edits(lexed).collect()


@pytest.mark.parametrize(
    "before,after,abstract,distance,fix",
    [
        ("class Hello {", "class Hello {}", True, 1, ("insertion", 3)), ("class Hello {}", "class Hello }", True, 1, ("deletion", 2)), ("enum Hello {}", "class Hello {}", True, 1, ("substitution", 0)),
        ("class Hello {}", "class Hello {}", True, 0, None), ("enum Hello {}", "class Hello {", True, 2, None), ("const int hello;", "final int hello;", True, 1, ("substitution", 0)), ("goto label;", "int label;", False, 1, ("substitution", 0)),
        ("int new Value = 42;", "int newValue = 42;", True, 1, ("deletion", 1)), ("int new Value = 42;", "int newValue = 42;", False, 2, None), ("class Hello {{}", "class Hello {}", True, 1, ("deletion", 3)),
        ("class Hello #{}", "class Hello {}", False, 1, ("deletion", 2)), ("int #label;", "int label;", True, 1, ("deletion", 1)), ("int _;", "int label;", True, 1, ("substitution", 1)), ("", "x", True, 1, ("insertion", 0)),
    ],
)
def test_distances_and_fixes(spark, before, after, abstract, distance, fix):
    d, edits = pair(spark, before, after, abstract)
    assert d == distance
    assert [(e.fix, e.fix_index) for e in edits] == ([fix] if fix else [])


def test_line_of_a_missing_brace(spark):
    before = "class A {\n void f(String[] args) {\n  if (args.length < 3)\n  System.exit(1); } }"
    _, (edit,) = pair(spark, before, before.replace("< 3)", "< 3) {"), True)
    assert (edit.fix, edit.mistake, edit.line_no, edit.new_token, edit.old_token) == ("insertion", "deletion", 3, "LBRACE", None)


def test_eligible(spark):
    df = spark.createDataFrame([(1, 1, b"int a", b"int a;"), (1, 2, b"int", b"int a;"), (2, 1, None, None)], SCHEMA)
    assert [r.before_id for r in mistakes.eligible(df, mistakes.distances(mistakes.lexed(df))).collect()] == [1]


def test_bigram_scores(spark):
    counts = np.zeros((6, 6))
    counts[3, 4] = 8
    df = spark.createDataFrame([(1, [3, 4, 3]), (2, [])], "doc_id bigint, vector array<int>")
    rows = models.scored(df, models.bigram_scorer(counts)).orderBy("position").collect()
    assert [r.truth for r in rows] == [3, 4, 3] and rows[1].forwards[4] == pytest.approx(9 / 14) and all(abs(sum(r.forwards) - 1) < 1e-9 for r in rows)
    assert m.with_metrics(models.scored(df, models.bigram_scorer(counts))).where("normal").count() == 3


def weights(rng, vocabulary, hidden):
    buffer = io.BytesIO()
    np.savez(
        buffer, kernel_0=rng.normal(size=(vocabulary, 4 * hidden)), recurrent_0=rng.normal(size=(hidden, 4 * hidden)), bias_0=np.zeros(4 * hidden),
        kernel_1=rng.normal(size=(hidden, 4 * hidden)), recurrent_1=rng.normal(size=(hidden, 4 * hidden)), bias_1=np.zeros(4 * hidden), dense=rng.normal(size=(hidden, vocabulary)), dense_bias=np.zeros(vocabulary),
    )
    return buffer.getvalue()


def test_lstm_scores(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", [3, 4, 5, 3]), ("b", [])], "doc_id string, vector array<int>")
    rows = models.scored(df, models.lstm_scorer(weights(rng, 6, 5), weights(rng, 6, 5), 3)).orderBy("position").collect()
    assert len(rows) == 4 and all(len(r.forwards) == 6 and sum(r.backwards) == pytest.approx(1) for r in rows)
    with pytest.raises(Exception):
        models.scored(df, models.lstm_scorer(weights(rng, 6, 5), weights(rng, 7, 5), 3)).collect()


def test_validated_candidates(spark):
    df = spark.createDataFrame([(1, "class A { }"), (2, "class A {"), (3, None)], "rank int, text string")
    assert [r.rank for r in models.validated(df, "text", languages.LANGUAGES["java"].parses, ["rank"]).collect()] == [1]


def test_seeded_order(spark):
    df = spark.range(50)
    order = lambda seed: [r.id for r in df.orderBy(models.seeded_order(df, seed, "id")).collect()]
    assert order(1) == order(1) != order(2) and sorted(order(1)) == list(range(50))


def test_command_line(capsys):
    from corpusmill.__main__ import main

    assert main([]) == 2 and "p4_found" in capsys.readouterr().out
