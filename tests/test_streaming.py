from pyspark.sql import functions as F

from corpusmill.streaming import jobs


def test_at_least_once_with_dead_letters(spark, tmp_path):
    queue, done, dead, check = (str(tmp_path / x) for x in ("queue", "done", "dead", "check"))
    jobs.enqueue(spark.createDataFrame([(i,) for i in range(10)], "id bigint"), queue)
    work = lambda df: df.withColumn("error", F.when(F.col("id") % 3 == 0, "bad"))

    def run():
        jobs.consume(jobs.jobs_of(spark, queue, "id bigint"), work, done, dead, check).awaitTermination()

    run()
    assert sorted(r.id for r in spark.read.parquet(done).collect()) == [1, 2, 4, 5, 7, 8]
    assert sorted(r.id for r in spark.read.parquet(dead).collect()) == [0, 3, 6, 9]
    run()  # nothing is worked off twice
    assert spark.read.parquet(done).count() == 6
    assert jobs.retry(spark, dead, queue, ["id"]) == 4
    run()
    assert spark.read.parquet(dead).count() == 8


def test_parses_as_sources_come_in(spark, tmp_path):
    queue, done, dead, check = (str(tmp_path / x) for x in ("queue", "done", "dead", "check"))
    rows = [("a", b"x = 1", "python"), ("b", b"x = (", "python"), ("a", b"x = 1", "python")]
    jobs.enqueue(spark.createDataFrame(rows, "hash string, source binary, language string"), queue)
    jobs.parse_incrementally(spark, queue, done, dead, check).awaitTermination()
    assert [(r.hash, r.sloc, r.n_tokens) for r in spark.read.parquet(done).collect()] == [("a", 1, 3)]
    assert [r.hash for r in spark.read.parquet(dead).collect()] == ["b"]


def test_windows_over_events(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = jobs.event_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()
