import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus, models
from corpusmill.operators import evaluation as e
from corpusmill.operators import languages as lang
from corpusmill.sources import files, stores
from corpusmill.streaming.workqueue import WorkQueue, errors_name, queue_name


def test_corpus_is_created_once(spark, tmp_path):
    layout = stores.Layout(str(tmp_path), "java")
    stores.create(spark, layout)
    stores.create(spark, layout)
    assert [tuple(r) for r in stores.table(spark, layout, "meta").collect()] == [("language", "java")]
    stores.set_metadata(spark, layout, started=2018, note=None)
    assert {r.key: r.value for r in stores.table(spark, layout, "meta").collect()} == {"language": "java", "started": "2018", "note": None}
    with pytest.raises(ValueError, match="started"):
        stores.set_metadata(spark, layout, started=2019)
    other = stores.Layout(str(tmp_path), "java")
    spark.createDataFrame([("language", "python")], "key string, value string").write.mode("overwrite").parquet(other.table("meta"))
    with pytest.raises(ValueError, match="python"):
        stores.create(spark, other)
    with pytest.raises(KeyError):
        layout.table("nothing")


def test_vectors_distances_and_edits_are_stored_once(spark, tmp_path):
    layout = stores.Layout(str(tmp_path), "java")
    vectors = spark.createDataFrame([("a", [3, 255, 7]), ("b", []), ("a", [9])], "hash string, vector array<int>")
    stores.put_vectors(spark, layout, vectors.where("hash = 'b' OR size(vector) = 3"))
    stores.put_vectors(spark, layout, vectors)
    assert {r.hash: r.vector for r in stores.vectors(spark, layout).collect()} == {"a": [3, 255, 7], "b": []}
    stores.append(spark, layout, "mistake", spark.createDataFrame([(1, 1, b"class Box {", b"class Box {}"), (1, 2, b"int a = ;", b"long b = 1 + 2;")], stores.MORE["mistake"]), ["source_file_id", "before_id"])
    for _ in range(2):
        stores.put_distances_and_edits(spark, layout)
    assert {r.before_id: r.levenshtein for r in stores.table(spark, layout, "distance").collect()} == {1: 1, 2: 5}
    assert [(r.before_id, r.fix, r.fix_index) for r in stores.table(spark, layout, "edit").collect()] == [(1, "insertion", 3)]
    written = {r.path: r.size for r in stores.export_mistakes(stores.table(spark, layout, "mistake"), str(tmp_path / "out")).collect()}
    assert written["1/1/before.java"] == 11 and len(written) == 4 and (tmp_path / "out/1/2/after.java").read_bytes() == b"long b = 1 + 2;"
    assert (tmp_path / "out").joinpath("1", "1").is_dir() and not list((tmp_path / "out").rglob("*.part"))


def test_views(spark, tmp_path):
    layout = stores.Layout(str(tmp_path), "python")
    stores.create(spark, layout)
    stores.append(spark, layout, "source_summary", spark.createDataFrame([("a", 1, 4), ("b", 1, 4), ("c", 0, 0)], stores.ALL["source_summary"]), ["hash"])
    stores.append(spark, layout, "failure", spark.createDataFrame([("b", "x")], stores.ALL["failure"]), ["hash"])
    stores.register_views(spark, layout)
    assert [r.hash for r in spark.sql("SELECT hash FROM eligible_source").collect()] == ["a"]
    stores.drop_views(spark)
    assert not spark.catalog.tableExists("eligible_source")


def test_epoch_log(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    stores.log_epoch(spark, path, 1, loss=2.5, val_loss=3.5)
    stores.log_epoch(spark, path, 2, val_loss=3.0, loss=2.0)
    assert [tuple(r) for r in stores.epochs(spark, path).collect()] == [(1, 2.5, 3.5), (2, 2.0, 3.0)]


def test_queue_delivers_in_order_and_keeps_what_is_held(spark, tmp_path):
    queue = WorkQueue(spark, str(tmp_path), queue_name("mine", "jobs"))
    queue << b"one" << b"two" << b"three"
    assert len(queue) == 3 and queue.get("w1") == b"one" and queue.held("w1") == [b"one"] and len(queue) == 2
    assert queue.get("w2") == b"two" and queue.acknowledge("w2", b"two") and not queue.acknowledge("w2", b"two")
    assert queue.give_back("w1") == 1 and queue.pop() == b"one"
    other = WorkQueue(spark, str(tmp_path), "other")
    assert queue.transfer(other) == b"three" and other.pop() == b"three" and other.transfer(queue) is None
    assert queue.get("w1", timeout=0.2) is None and queue.pop() is None
    queue.put(b"a").put(b"b").put(b"a")
    assert queue.remove(b"a") == 2 and len(queue) == 1
    queue.clear()
    assert len(queue) == 0


def test_failed_jobs_go_to_the_errors(spark, tmp_path):
    queue = WorkQueue(spark, str(tmp_path), "jobs")
    queue << b"1" << b"x" << b"2"
    assert queue.work("w", lambda job: int(job)) == (2, 1) and queue.held("w") == []
    assert WorkQueue(spark, str(tmp_path), errors_name("jobs")).pop() == b"x"
    for bad in ("", "a b", "..", "a/b"):
        with pytest.raises(ValueError):
            queue_name("mine", bad)


def test_pages_lose_no_ties(spark):
    stars = spark.createDataFrame([(n, s) for n, s in zip("abcdefg", [5, 9, 5, 5, None, 1, 9])], "name string, stars int")
    pages = [[r.name for r in p.collect()] for p in files.star_pages(stars, 2)]
    assert pages == [["b", "g"], ["a", "c"], ["d", "f"]]


def test_broken_archives_are_failures(spark, tmp_path):
    (tmp_path / "b.zip").write_bytes(b"broken")
    assert files.archive_sources(spark, str(tmp_path / "*.zip"), (".py",)).count() == 0
    row = files.archive_sources(spark, str(tmp_path / "*.zip"), (".py",), with_failures=True).first()
    assert row.source is None and row.error and row.archive.endswith("b.zip")


def test_recorded_downloads(spark):
    recorded = spark.createDataFrame([("u", 200, b"x"), ("v", 404, b"no")], "url string, status int, body binary")
    got = {r.url: (r.body, r.error) for r in files.recorded_downloads(spark.createDataFrame([("u",), ("v",), ("w",), ("u",)], "url string"), recorded).collect()}
    assert got == {"u": (b"x", None), "v": (None, "status 404"), "w": (None, "not recorded")}


def test_upsert_takes_the_new_row(spark):
    old = spark.createDataFrame([("a", 9, "old"), ("b", 1, "old")], "k string, o int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("a", 3, "newer"), ("c", None, "new")], "k string, o int, v string")
    assert {r.k: r.v for r in corpus.upsert(old, new, ["k"], "o").collect()} == {"a": "newer", "b": "old", "c": "new"}


def test_language_by_choice_or_environment(monkeypatch):
    lang.forget()
    monkeypatch.delenv(lang.VARIABLE, raising=False)
    with pytest.raises(LookupError):
        lang.chosen()
    monkeypatch.setenv(lang.VARIABLE, "python")
    assert lang.chosen().name == "python" and lang.choose("java").name == "java" and lang.chosen().name == "java"
    lang.forget()
    assert lang.chosen().name == "python"


def test_batches_of_contexts(spark):
    vectors = spark.createDataFrame([([3, 4, 5],), ([],), ([4, 4],)], "vector array<int>").coalesce(1)
    batches = list(models.training_batches(vectors, 6, 2, 2, epochs=2))
    assert [len(y) for _, y in batches] == [2, 2, 1, 2, 2, 1] and models.samples_per_epoch(vectors) == 5
    assert batches[0][0].shape == (2, 2, 6) and batches[0][0].argmax(2).tolist() == [[1, 1], [1, 3]] and batches[0][1].argmax(1).tolist() == [3, 4]
    assert models.one_hot_contexts(np.array([3, 4, 5]), 6, 2, True)[0].argmax(2).tolist() == [[4, 5], [5, 2], [2, 2]]
    assert list(models.training_batches(vectors.where("false"), 6, 2, 2)) == []
    endless = models.training_batches(vectors, 6, 2, 5)
    assert [len(next(endless)[1]) for _ in range(4)] == [5] * 4


def test_context_length_is_read_from_the_weights():
    import io

    def weights(**arrays):
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    assert models.context_length(weights(context=5), weights(context=5)) == 5 and models.context_length(weights(a=1)) == 9
    with pytest.raises(ValueError):
        models.context_length(weights(context=5), weights(context=6))


def test_training_settings():
    t = e.Training(hidden_layers=(300, 200), backwards=True)
    assert "hidden_layers-300+200" in t.slug() and "backwards-true" in t.slug() and t.slug().startswith("backwards") and t.steps(65) == 3
    assert not t.stops([3.0, 2.0, 2.1]) and t.stops([3.0, 2.0, 2.1, 2.2, 2.0]) and not t.stops([3.0, 2.0, 2.1, 2.2, 1.9])


def test_rendered_percentages(spark):
    from corpusmill.operators import scoring

    row = spark.createDataFrame([([0.5, 0.25, 0.25], [0.0, 0.1, 0.9])], "f array<double>, b array<double>")
    assert row.select(scoring.rendered(F.col("f"), F.col("b"), F.array(F.lit("x"), F.lit("y"), F.lit("z")), 2)).first()[0] == "forwards: x 50.00%, y 25.00% | backwards: z 90.00%, y 10.00%"
    norms = row.select(scoring.is_normalised(F.col("f")), scoring.is_normalised(F.col("f") if False else F.array(F.lit(0.5), F.lit(0.2)))).first()
    assert norms[0] and not norms[1]
