"""Summaries, ingest and generations: stop, start again, run a batch again."""

import datetime

from pyspark.sql import functions as F

from cadenza.streaming import summaries as S


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/sum"
    kept = S.Summary(spark, path, ["user", "axis"], ["n", "w"], buckets=4)
    batch = lambda data: spark.createDataFrame(data, "user string, axis string, n long, w double")
    assert kept.table() is None
    one, two = batch([("a", "x", 1, 0.5), ("a", "x", 1, 0.5), ("b", "y", 2, 1.0)]), batch([("a", "x", 1, 1.0), ("c", None, 1, 1.0)])
    kept.add(one, 0)
    first = rows(kept.table())
    assert first == [("a", "x", 2, 1.0), ("b", "y", 2, 1.0)]
    kept.add(one, 0)
    assert rows(kept.table()) == first
    kept.add(two, 1)
    want = sorted([("a", "x", 3, 2.0), ("b", "y", 2, 1.0), ("c", None, 1, 1.0)], key=str)
    assert sorted(map(tuple, kept.table().collect()), key=str) == want
    kept.add(two, 1)
    assert sorted(map(tuple, kept.table().collect()), key=str) == want
    for k in range(2, 6):
        kept.add(batch([("a", "x", 1, 0.0)]), k)
    assert {r["user"]: r["n"] for r in kept.table().collect()} == {"a": 7, "b": 2, "c": 1}
    held = [n for v in S.Folder(spark, path).names() for n in S.Folder(spark, path).names(v) if n.startswith("bucket=")]
    assert len(held) < 8  # older versions of a bucket are gone


def test_a_stream_stopped_and_started_again_keeps_the_same_summary(spark, tmp_path):
    inbox, path, cp = f"{tmp_path}/in", f"file://{tmp_path}/sum", f"{tmp_path}/cp"
    write = lambda data: spark.createDataFrame(data, "user long, n long").coalesce(1).write.mode("append").parquet(inbox)
    for k in range(3):
        write([(i % 5, 1) for i in range(20 + k)])
    stream = lambda: spark.readStream.schema("user long, n long").option("maxFilesPerTrigger", 1).parquet(inbox)
    kept = S.Summary(spark, path, ["user"], ["n"])
    kept.keep(stream(), cp).awaitTermination()
    total = lambda: sum(r["n"] for r in kept.table().collect())
    assert total() == 63
    S.Summary(spark, path, ["user"], ["n"]).keep(stream(), cp).awaitTermination()
    assert total() == 63
    write([(9, 4)])
    S.Summary(spark, path, ["user"], ["n"]).keep(stream(), cp).awaitTermination()
    assert total() == 67


def test_an_ingest_goes_on_where_it_stopped(spark, tmp_path):
    inbox, path, cp = f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/cp"
    write = lambda data: spark.createDataFrame(data, "sn string, v long").coalesce(1).write.mode("append").parquet(inbox)
    stream = lambda: spark.readStream.schema("sn string, v long").option("maxFilesPerTrigger", 1).option("latestFirst", True).parquet(inbox)
    write([("a", 1), ("a", 0), ("b", 1), (None, 1)])
    S.ingest(stream(), path, "sn", cp, F.col("v")).awaitTermination()
    assert rows(S.ingested(spark, path)) == [("a", 0), ("b", 1)]
    write([("b", 9), ("c", 1)])
    S.ingest(stream(), path, "sn", cp, F.col("v")).awaitTermination()
    S.ingest(stream(), path, "sn", cp, F.col("v")).awaitTermination()
    assert rows(S.ingested(spark, path)) == [("a", 0), ("b", 1), ("c", 1)]


def test_stale_generations_are_dropped(spark, tmp_path):
    at = lambda m: datetime.datetime(2031, 4, 5, 10, m)
    inbox = f"{tmp_path}/in"
    write = lambda data: spark.createDataFrame(data, "req string, gen long, at timestamp").coalesce(1).write.mode("append").parquet(inbox)
    write([("k", 1, at(0)), ("k", 2, at(1)), ("m", 5, at(1))])
    stream = spark.readStream.schema("req string, gen long, at timestamp").parquet(inbox)
    q = S.current_generation(stream, "req", "gen", "at", "5 minutes").writeStream.format("memory").queryName("generations").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    write([("k", 1, at(2)), ("m", 5, at(3))])
    q.processAllAvailable()
    write([("z", 1, at(40))])
    q.processAllAvailable()
    write([("z", 2, at(59)), ("m", 1, at(58))])  # the state of m has expired by then
    q.processAllAvailable()
    q.stop()
    got = sorted((r["req"], r["gen"]) for r in spark.sql("SELECT * FROM generations").collect())
    assert got == [("k", 2), ("m", 1), ("m", 5), ("m", 5), ("z", 1), ("z", 2)]
