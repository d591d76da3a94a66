"""Forms, line blocks, sources and the streaming extension on small fixtures."""

import gzip
import json

from pyspark.sql import functions as F

from cadenza.functions.forms import canon_form, parse_confidence
from cadenza.operators import blocks as B
from cadenza.sources import readers as S
from cadenza.streaming import sync


def test_forms(spark):
    cases = {"Piano Concerto No. 2": "piano concerto", "Concerto grosso": "concerto", "교향곡 5번": "symphony", "Symphonic Poem": "symphonic poem", "String Quartet": "string quartet", "Étude": "etude", "plain": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", canon_form(F.col("s")).alias("f"), parse_confidence(F.lit(0.45), F.lit(1), F.lit(1), F.lit(2)).alias("c")).collect()
    assert {r["s"]: r["f"] for r in rows} == cases and rows[0]["c"] in (0.72, 0.73)


def test_best_runs(spark):
    hits = {1: [2, 3, 8, 20, 21, 22], 2: [0, 6], 3: [], 4: [1, 3]}
    stops = {4: [2]}
    rows = [(p, i, i in hits[p], i in stops.get(p, ())) for p in hits for i in range(25)]
    df = spark.createDataFrame(rows, "page int, i int, hit boolean, stop boolean")
    got = {r["page"]: (r["first"], r["last"], r["hits"]) for r in B.best_runs(df, "page", "i", F.col("hit"), F.col("stop")).collect()}
    assert got == {1: (2, 8, 3), 2: (0, 0, 1), 4: (1, 1, 1)}


def test_lines(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("a b a c d a b".split())], "page int, i int, t string")
    assert [r["t"] for r in B.dedup_recent(df, "page", "i", "t", 2).orderBy("i").collect()] == ["a", "b", "c", "d", "a", "b"]
    boxes = spark.createDataFrame([(1, "b", 0.5, 0.011), (1, "a", 0.1, 0.019), (1, "c", 0.0, 0.03)], "page int, t string, x double, y double")
    assert [r["t"] for r in B.reading_order(boxes, "page", "x", "y").orderBy("position").collect()] == ["a", "b", "c"]


def test_longest_alias(spark):
    halls = spark.createDataFrame([("h1", "grand hall"), ("h2", "hall"), ("h3", "small room")], "hall string, alias string")
    rows = spark.createDataFrame([(1, "city grand hall, 2f"), (2, "old hall"), (3, "park")], "i int, t string")
    assert {r["i"]: r["hall"] for r in B.longest_alias(rows, "t", halls, "hall", "alias").collect()} == {1: "h1", 2: "h2", 3: None}


def test_sources(spark, tmp_path):
    (tmp_path / "cal.json").write_text(json.dumps({"result": "ok", "20310405": [{"a": "1"}, {"a": "2"}], "20310406": [{"a": "3"}]}))
    assert sorted(r["event"]["a"] for r in S.calendar(spark, str(tmp_path / "cal.json")).collect()) == ["1", "2", "3"]
    (tmp_path / "weeks.json").write_text("﻿" + json.dumps({"Tag": {"Weeks": [[None, {"Date": "d", "Times": [{"t": "x"}]}]]}}), encoding="utf-8")
    assert [r["event"]["t"] for r in S.nested_calendar(spark, str(tmp_path / "weeks.json")).collect()] == ["x"]
    with gzip.open(tmp_path / "77.html.gz", "wt", encoding="utf-8") as f:
        f.write("<p>one</p>\n<p>two</p>")
    assert [tuple(r) for r in S.pages(spark, str(tmp_path)).collect()] == [("77", "<p>one</p>\n<p>two</p>")]
    (tmp_path / "parsed.jsonl").write_text('{"sn":"1","works":[{"seq":1,"opus":"op.1"}]}\nbroken\n')
    rows = S.entries(spark, str(tmp_path / "parsed.jsonl")).collect()
    assert [r["sn"] for r in rows] == ["1", None] and rows[0]["works"][0]["opus"] == "op.1" and rows[1]["_corrupt_record"] == "broken"
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "a.r2.json").write_text(json.dumps({"meta": {"model": "m", "file": "a"}, "output": json.dumps({"data": {"name": {"value": "T", "confidence": 0.5}}})}))
    (tmp_path / "ev" / "_x.json").write_text("{}")
    r = S.records(spark, str(tmp_path / "ev")).select("run", S.pick(F.col("output"), ["title", "name"]).alias("title")).collect()
    assert [tuple(x) for x in r] == [(2, "T")]
    S.write_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, x array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0]["x"] == "a / b"
    assert "██" in S.markdown(spark.createDataFrame([("x", 5.0)], "k string, pct double"), "pct")


def test_stream_replay(spark, tmp_path):
    log = [(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 4, 1), (2, 5, 0)]
    spark.createDataFrame(log, "entity long, seq long, base long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity long, seq long, base long").parquet(str(tmp_path / "in"))
    q = sync.replayed(stream, "entity", "base", "seq").writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: r["applied"] for r in spark.sql("SELECT * FROM replayed").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}
