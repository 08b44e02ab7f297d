import pytest
from pyspark.sql import functions as F

from corpusmill.operators import code as c
from corpusmill.operators import languages
from corpusmill.parsers import java8, javascript, python3
from corpusmill.plans import queries

GOOD = b"""package a.b;
/* A stack. */
class Pile {
    private int[] held = new int[0x10];
    int top(String name) { if (name != null) { return held[1]; } return 2 + 3; } // end
    double half(double x) { return x / 2.5e1 + 1f - 'c' + "d\\"e".length(); }
}
"""


def vector_of(spark, source):
    return c.lexed_vectors(spark.createDataFrame([("h", source)], "hash string, source binary"), "java").first()


def test_both_ways_of_lexing_java_agree(spark):
    df = spark.createDataFrame([("g", GOOD), ("e", b""), ("n", None), ("x", b"\xff"), ("b", b"\xef\xbb\xbfint \xc3\xa9 = 1; # `")], "hash string, source binary")
    plain = {r.hash: r.vector for r in c.java_vectors(df).collect()}
    lexed = {r.hash: r.vector for r in c.lexed_vectors(df, "java").collect()}
    assert plain["g"] == lexed["g"] and len(plain["g"]) > 70 and plain["e"] == [] == lexed["n"] and "x" not in plain and "n" not in plain
    assert plain["b"][-2:] == [0, 0] and 0 not in plain["b"][:-2]
    text = c.java_vectors(df.where("hash = 'g'")).select(c.java_printed(F.col("vector"))).first()[0]
    assert java8.check(text.encode()) == [] and text.startswith("package ident . ident ; class ident {")


@pytest.mark.parametrize("name,source,n", [("python", b"if a:\n    b = 'c' + 1\n", 12), ("javascript", b"var r = /[/]/; `a${b}c`", 8), ("java", b"int a = 1L;", 5)])
def test_vectors_of_every_language(spark, name, source, n):
    row = c.lexed_vectors(spark.createDataFrame([("h", source)], "hash string, source binary"), name).first()
    assert len(row.vector) == n == len(row.lines) and 0 not in row.vector and len(set(c.vocabulary(name))) == len(c.vocabulary(name))
    with pytest.raises(KeyError):
        c.vocabulary("cobol")


def test_lengths_of_python_sources_that_no_lexer_reads_to_the_end(spark, tmp_path):
    sources = {
        "good": b"a = 1\nb = 2\n", "null": b"if a:\n    b = 1\n    c\0 = 2\n", "undefined": b"# coding: undefined\na = 1\n", "idna": b"# coding: idna\na = 1\n",
        "utf7": b"# coding: utf-7\na = 1\nb = '+2Nw-'\n", "utf8": b"a = '\xff'\n", "unknown": b"# coding: x\na = 1\n", "empty": b"",
    }
    spark.createDataFrame([(k, bytearray(v)) for k, v in sources.items()], "hash string, source binary").write.parquet(str(tmp_path / "source_file.parquet"))
    spark.createDataFrame([(k, k + ".py") for k in sources], "hash string, path string").write.parquet(str(tmp_path / "repository_source.parquet"))
    rows = {r.hash: (r.n_tokens, r.n_lines, r.n_unknown) for r in queries.queries()["python_vector_lengths"](spark, str(tmp_path)).collect()}
    assert rows == {"good": (8, 2, 0), "null": (9, 2, 0), "undefined": (0, 0, 0), "idna": (0, 0, 0), "utf7": (4, 1, 0), "utf8": (0, 0, 0), "unknown": (0, 0, 0), "empty": (0, 0, 0)}


def test_long_tokens_do_not_nest(spark):
    source = b'class A { String s = "' + b"x" * 200_000 + b'"; /* ' + b"y " * 100_000 + b" */ }"
    assert len(c.java_vectors(spark.createDataFrame([("h", source)], "hash string, source binary")).first().vector) == 9


def test_edits_are_tried_in_order():
    tries = list(c.single_fixes([5, 6, 7], [0.1, 0.9, 0.9], [[5], [8, 6], [9]], 2))
    assert tries == [
        (1, 0, "i", 1, 8, None), (1, 1, "i", 1, 6, None), (1, 2, "x", 1, None, 6), (1, 3, "s", 1, 8, 6), (2, 0, "i", 2, 9, None), (2, 1, "x", 2, None, 7), (2, 2, "s", 2, 9, 7),
    ]
    assert c.edited([5, 6, 7], "i", 3, 1) == [5, 6, 7, 1] and c.edited([5, 6, 7], "x", 0, None) == [6, 7] and c.edited([5, 6, 7], "s", 1, 9) == [5, 9, 7] and list(c.single_fixes([], [], [])) == []


def broken_and_fixed(spark, source, first_only=False):
    df = spark.createDataFrame([("g", GOOD), ("b", source)], "hash string, source binary")
    lexed = c.lexed_vectors(df, "java")
    return c.fixes(lexed.where("hash = 'b'"), c.neighbour_counts(lexed.where("hash = 'g'")), first_only=first_only).collect()


def test_a_stray_token_is_removed(spark):
    bad = GOOD.replace(b"return held[1];", b"return held[1] ...;")
    at = [t.name for t in languages.java_tokens(bad)].index("ELLIPSIS")
    found = broken_and_fixed(spark, bad)
    assert found and (found[0].rank, found[0].code, found[0]["index"], found[0].line) == (1, "x", at, 5)
    assert [(r.rank, r.step) for r in found] == sorted((r.rank, r.step) for r in found)
    assert len(broken_and_fixed(spark, bad, True)) == 1


def test_a_character_that_is_no_token_is_removed(spark):
    assert ("x", 0) in {(r.code, r.original) for r in broken_and_fixed(spark, GOOD.replace(b"null) {", b"null) # {"))}


def test_every_fix_parses(spark):
    bad = GOOD.replace(b"(String name) {", b"(String name {")
    vector = list(vector_of(spark, bad).vector)
    texts = ["<UNK>", "<s>", "</s>", *(c.JAVA_TEXT[x] for x in c.JAVA_ENTRIES)]
    for r in broken_and_fixed(spark, bad):
        assert java8.check(" ".join(texts[t] for t in c.edited(vector, r.code, r["index"], r.token)).encode()) == []


def test_deep_nesting():
    assert javascript.check(b"x = " + b"[" * 1500 + b"]" * 1500) == [] and java8.check(b"class A { int x = " + b"(" * 1500 + b"1" + b")" * 1500 + b"; }") == []
    assert python3.check(b"x = " + b"(" * 200 + b"1" + b")" * 200) == [] and python3.check(b"x = " + b"(" * 201 + b"1" + b")" * 201)
    for n in (99, 100):
        source = "".join(" " * i + "if x:\n" for i in range(n)) + " " * n + "pass\n"
        assert (python3.check(source.encode()) == []) == (n == 99)
