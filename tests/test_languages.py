import json
import tracemalloc
import zipfile
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as e
from corpusmill.operators import languages as lang
from corpusmill.operators import queue as q
from corpusmill.plans import queries
from corpusmill.sources import files
from corpusmill.sources.tables import SCHEMAS, read_or_empty


def test_python():
    assert lang.language("python").summarise(b'from os import path\n\nprint(path.join("a", "b"))\n') == (2, 17)
    tokens = [t.name for t in lang.python_tokens('f"{x} y" + 1')]
    assert tokens.count("STRING") == 1 and not any("FSTRING" in t for t in tokens)
    assert "ERRORTOKEN" in [t.name for t in lang.python_tokens("import $")]
    assert lang.python_check("x = 1") and not lang.python_check("x = (") and not lang.python_check(b"\0")
    assert [lang.python_entry(t) for t in lang.python_tokens("if a: return 1") if t.name != "ENCODING" and t.name != "ENDMARKER"] == ["if", "<IDENTIFIER>", ":", "return", "<NUMBER>"]


def test_python_with_a_null_byte_ends_at_its_line():
    for source in (b"if a:\n    b = 1\n    c\0 = 2\nd\n", b"if a:\n    b = 1\n\0c\n", b"if a:\n    b = 1\n\0"):
        tokens = lang.python_tokens(source)
        assert [t.name for t in tokens] == ["ENCODING", "NAME", "NAME", "OP", "NEWLINE", "INDENT", "NAME", "OP", "NUMBER", "NEWLINE", "ERRORTOKEN"] and tokens[-1].line == 3
        assert lang.language("python").summarise(source) == (2, 9)


def test_java():
    good = "package a;\nclass A {\n int \\u0061 = 0x1F; }\n"
    assert lang.language("java").summarise(good.encode()) == (3, 12)
    assert [t.value for t in lang.java_tokens("x\\u003d \\uu0079\\uuuu003B")] == ["x", "=", "y", ";"]
    assert [t.name for t in lang.java_tokens("#")] == ["ERROR"]
    java = lang.language("java")
    assert java.parses(b"class A {}") and not java.parses(b"class A {") and not java.parses(b"class class { int int = = ; }") and not java.parses("#")
    assert java.parses("class A { int x = " + "(" * 1500 + "1" + ")" * 1500 + "; }")
    assert [t.name for t in lang.java_tokens("1L 1f 0x1.8p1 1e5 'c' \"s\" >>>= -> _")] == [
        "LONGLITERAL", "FLOATLITERAL", "DOUBLELITERAL", "DOUBLELITERAL", "CHARLITERAL", "STRINGLITERAL", "GTGTGTEQ", "ARROW", "UNDERSCORE"
    ]


def entries(text):
    return [lang.javascript_entry(t) for t in lang.javascript_tokens(text)]


def test_javascript():
    script = lang.language("javascript")
    source = '#!/usr/bin/js -u\n// first\nexport {größe as b} from "./c";'.encode()
    assert script.summarise(source) == (1, 9) and script.parses(source)
    assert entries("if (x === null) `a` + 'b' - 2") == ["if", "(", "<IDENTIFIER>", "===", "null", ")", "<STANDALONE-TEMPLATE>", "+", "<STRING>", "-", "<NUMBER>"]
    assert entries("a.\\u0069f = tr\\u0075e") == ["<IDENTIFIER>", ".", "if", "=", "true"]
    with pytest.raises(TypeError):
        lang.javascript_entry(lang.Token("Other", "x", 1, 0, 1, 1))
    assert not script.parses(b"var = = 1 ; if else") and not script.parses(b"a b") and script.parses(b"import a from 'b'")


@pytest.mark.parametrize(
    "text,expected",
    [
        ('var r = /["]/;', ["var", "<IDENTIFIER>", "=", "<REGEXP>", ";"]), ("a / b / c", ["<IDENTIFIER>", "/", "<IDENTIFIER>", "/", "<IDENTIFIER>"]), ("f(/[/]\\//g)", ["<IDENTIFIER>", "(", "<REGEXP>", ")"]),
        ("if (a) /b/.test(c)", ["if", "(", "<IDENTIFIER>", ")", "<REGEXP>", ".", "<IDENTIFIER>", "(", "<IDENTIFIER>", ")"]), ("(a) / b", ["(", "<IDENTIFIER>", ")", "/", "<IDENTIFIER>"]),
        ("return /a/", ["return", "<REGEXP>"]), ("this / 2", ["this", "/", "<NUMBER>"]), ("x = {} / 2", ["<IDENTIFIER>", "=", "{", "}", "/", "<NUMBER>"]), ("{} /a/", ["{", "}", "<REGEXP>"]), ("i++ / 2", ["<IDENTIFIER>", "++", "/", "<NUMBER>"]),
        ("`a${b}c${ {d: `e${1}`} }f`", ["<TEMPLATE-HEAD>", "<IDENTIFIER>", "<TEMPLATE-MIDDLE>", "{", "<IDENTIFIER>", ":", "<TEMPLATE-HEAD>", "<NUMBER>", "<TEMPLATE-TAIL>", "}", "<TEMPLATE-TAIL>"]),
        ("`$ \\${ `", ["<STANDALONE-TEMPLATE>"]), ("`${/}`/}`", ["<TEMPLATE-HEAD>", "<REGEXP>", "<TEMPLATE-TAIL>"]), ("", []),
    ],
)
def test_regular_expressions_and_templates(text, expected):
    assert entries(text) == expected


def test_scripts_with_quotes_in_regular_expressions_parse():
    assert lang.language("javascript").parses(b'var r = /["(]/; f("x");') and not [t for t in lang.javascript_tokens('var r = /["(]/; f("x");') if t.name == "ERROR"]


def test_every_entry_is_in_the_vocabulary():
    known = set(lang.javascript_vocabulary())
    assert len(known) == 98 and {"<REGEXP>", "<STANDALONE-TEMPLATE>", "<TEMPLATE-HEAD>", "<TEMPLATE-MIDDLE>", "<TEMPLATE-TAIL>"} < known
    for entry in sorted(known):
        if entry[0] != "<" or len(entry) < 4:
            assert entries(entry) == [entry] or entry in ("/", "/=", "}"), entry


def test_unknown_language():
    with pytest.raises(KeyError, match="python"):
        lang.language("cobol")


def test_parsed_in_one_pass(spark):
    df = spark.createDataFrame([("a", b"x = 1\n", "python"), ("b", b"x = (", "python"), ("c", None, "java")], "hash string, source binary, language string")
    rows = {r.hash: r for r in lang.parsed(df).collect()}
    assert rows["a"].sloc == 1 and rows["a"].reason is None and rows["b"].reason == "Syntax error" and rows["c"].n_tokens == 0
    tokens = lang.tokenised(df.where("hash = 'a'"), "python").where("name = 'NAME'").collect()
    assert [(t.value, t.entry, t.line, t.column) for t in tokens] == [("x", "<IDENTIFIER>", 1, 0)]


def test_a_worker_holds_the_tokens_of_few_sources(monkeypatch):
    frame = pd.DataFrame({"hash": [str(i) for i in range(400)], "source": [b"class A { int a = 1; } #" * 20] * 400})
    monkeypatch.setattr(lang, "AT_ONCE", 1000)
    frames = list(lang._token_frames(iter([frame]), "java"))
    assert sum(map(len, frames)) == 400 * 200 and max(map(len, frames)) <= 1000 + 200
    assert list(pd.concat(frames).groupby("hash", sort=False)["pos"].agg(list)) == [list(range(200))] * 400
    tracemalloc.start()
    counted = list(lang._entry_frames(iter([frame]), "java"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000 and [dict(zip(f["entry"], f["n"])) for f in counted] == [pd.concat(frames)["entry"].value_counts().to_dict()]


@pytest.mark.parametrize("name", ["java", "javascript"])
def test_vocabularies_count_every_token(spark, tmp_path, name):
    sources = {"a": b"class A { int a = 1; } #", "b": b"a = 'b' + 2;", "e": b"", "n": None, "o": b"other"}
    ending = {"java": ".java", "javascript": ".js"}[name]
    spark.createDataFrame([(k, v and bytearray(v)) for k, v in sources.items()], "hash string, source binary").write.parquet(str(tmp_path / "source_file.parquet"))
    spark.createDataFrame([(k, k + (".py" if k == "o" else ending)) for k in sources] + [("a", "copy" + ending)], "hash string, path string").write.parquet(str(tmp_path / "repository_source.parquet"))
    query = queries.queries()[f"{name}_vocabulary"](spark, str(tmp_path))
    language = lang.language(name)
    tokens = [t for k in "ab" for t in language.tokenise(sources[k])]
    assert {r.entry: r.n for r in query.collect()} == Counter(language.entry(t) if t.name != "ERROR" else "<UNK>" for t in tokens)
    assert query.dtypes == [("entry", "string"), ("n", "bigint")]


def test_bytes_and_escapes(spark):
    df = spark.createDataFrame([([3, 255], "a\\u0041\\u{1F600}")], "v array<int>, t string")
    row = df.select(lang.from_bytes(lang.to_bytes("v")), lang.unescape_unicode("t")).first()
    assert row[0] == [3, 255] and row[1] == "aA\U0001f600"
    with pytest.raises(Exception):
        spark.createDataFrame([([256],)], "v array<int>").select(lang.to_bytes("v")).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps(["a", "b"]))
    assert [tuple(r) for r in files.vocabulary_json(spark, str(tmp_path / "v.json")).collect()] == [(3, "a"), (4, "b")]
    (tmp_path / "v.tsv").write_text('3\tSTRINGLITERAL\t"string"\n4\tCHARLITERAL\t\'c\'\n')
    assert [r.repr for r in files.vocabulary_tsv(spark, str(tmp_path / "v.tsv")).collect()] == ['"string"', "'c'"]
    (tmp_path / "h.txt").write_text(" a \n\nb\n")
    assert [r.hash for r in files.hash_list(spark, str(tmp_path / "h.txt")).collect()] == ["a", "b"]
    (tmp_path / "m.json").write_text(json.dumps({"id": "x", "hidden_layers": [300, 300]}))
    assert files.manifests(spark, str(tmp_path / "m.json")).first().hidden_layers == "300,300"


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/x/a.py", "print(1)")
        z.writestr("top/x/a.txt", "no")
        z.writestr("top/../../evil.py", "no")
    (tmp_path / "b.zip").write_bytes(b"broken")
    rows = files.archive_sources(spark, str(tmp_path / "*.zip"), (".py",)).collect()
    assert [(r.path, bytes(r.source)) for r in rows] == [("x/a.py", b"print(1)")]


def test_export_and_pairs(spark, tmp_path):
    df = spark.createDataFrame([("o", "n", "a/b.py", b"x"), ("o", "n", "../../c.py", b"y")], "owner string, name string, path string, source binary")
    assert [tuple(r) for r in files.export_tree(df, str(tmp_path / "out")).collect()] == [("o/n/a/b.py", 1)]
    assert (tmp_path / "out/o/n/a/b.py").read_bytes() == b"x"
    pairs = files.file_pairs(df.select("path", "source"), df.select("path", "source").where("source = cast('x' as binary)"))
    assert pairs.count() == 1


def test_responses(spark):
    body = json.dumps({"data": {"repository": {"name": "n", "owner": {"login": "o"}, "licenseInfo": None, "defaultBranchRef": {"target": {"sha1": "s", "committedDate": "2018-01-02T03:04:05Z"}}}}})
    row = files.repository_responses(spark.createDataFrame([(body,)], "body string")).first()
    assert (row.owner, row.name, row.license, row.commit_date.year) == ("o", "n", "", 2018)
    stars = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5)], "name string, stars int")
    assert [r.name for r in files.most_starred(stars, 2).collect()] == ["b", "a"]


def test_hash_lists_and_empty_tables(spark, tmp_path):
    split = spark.createDataFrame([("h1", 0, "training"), ("h2", 1, "test")], "hash string, partition int, set_name string")
    files.write_hash_lists(split, str(tmp_path / "lists"))
    assert files.hash_list(spark, str(tmp_path / "lists/partition=1/set_name=test")).first().hash == "h2"
    for name in SCHEMAS:
        assert read_or_empty(spark, str(tmp_path), name).count() == 0


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "ok"), (2, "error"), (2, "error"), (3, None)], "id int, state string")
    done, dead = q.split_jobs(jobs, F.col("state") == "error")
    assert [r.id for r in done.collect()] == [1] and sorted(r.id for r in q.retries(dead, ["id"]).collect()) == [2, 3]
    assert sorted(r.id for r in q.pending(jobs.select("id"), done, ["id"]).collect()) == [2, 3]
    times = spark.sql("SELECT timestamp'2020-01-01 00:01:00' AS r, timestamp'2020-01-01 00:00:00' AS n")
    assert times.select(q.seconds_until(F.col("r"), F.col("n")), q.seconds_until(F.col("n"), F.col("r"))).first()[:] == (62, 2)


def test_evaluation_helpers(spark):
    assert e.plain_identifier("true_fix_rank") and not e.plain_identifier("a b") and not e.plain_identifier("1a")
    assert e.parse_layers("300,300") == [300, 300] and e.parse_split("80/10/10") == (0.8, 0.1, 0.1)
    for bad in ("80/10", "80/10/20"):
        with pytest.raises(ValueError):
            e.parse_split(bad)
    assert e.t_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-5) and e.t_tail(-2.0, 10) == pytest.approx(1 - 0.036694, abs=1e-5)
    merged = e.merge_results({"m": spark.createDataFrame([(1, 2)], "id int, rank int"), "n": spark.createDataFrame([(1, 3)], "id int, rank int")})
    assert sorted((r.model_id, r.id) for r in merged.collect()) == [("m", 1), ("n", 1)]


def test_linear_model(spark):
    df = spark.createDataFrame([(float(i % 2) + 0.01 * i, "ab"[i % 2], "xyz"[i % 3]) for i in range(30)], "y double, f string, g string")
    summary = e.linear_model(df, "y", ["f", "g"])
    assert len(summary.pValues) >= 3
