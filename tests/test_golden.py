"""Golden test of the scorer on invented readings, and what is loaded for it."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.text import normalize_text, similarity
from cadenza.operators import evaluation as E
from cadenza.sources import readers as S

#: Invented: file, run, field, truth, reading, confidence.
READINGS = [
    ("a", 0, "title", "Evening, Op. 1", "evening op 1", 0.9), ("a", 0, "venue", "North Hall", "North Hal", 0.8), ("a", 0, "seat", None, "-", 0.9), ("a", 0, "grade", None, "north hall", 0.9), ("a", 0, "price", None, "about ten", 0.9),
    ("b", 0, "title", "Morning", "Noon", 0.7), ("b", 0, "venue", "South", "", 0.1), ("b", 0, "seat", None, "row 9", 0.2), ("b", 0, "grade", None, "gold", 0.9), ("b", 0, "price", None, None, None),
    ("a", 1, "title", "Evening, Op. 1", "Evening Op.1", 0.9), ("a", 1, "venue", "North Hall", "North Hall", 0.8),
]


def test_scores(spark):
    df = spark.createDataFrame(READINGS, "file string, run int, field string, truth string, reading string, confidence double")
    t, p = normalize_text(F.col("truth"), compose=False), normalize_text(F.col("reading"), compose=False)
    others = F.array_compact(F.collect_list(F.when(F.col("truth").isNotNull(), t)).over(Window.partitionBy("file", "run")))
    scored = df.withColumns({"nt": F.col("truth").isNull(), "sim": similarity(t, p), "s": E.text_score(t, p, similarity(t, p)), "others": others, "empty": F.coalesce(p == "", F.lit(True))})
    outcome = E.null_truth_outcome(F.col("empty"), F.col("confidence"), 0.3, (F.col("field") == "price") & ~F.col("reading").rlike("[0-9]"), E.is_misattributed(p, F.col("others")))
    rows = {(r["file"], r["run"], r["field"]): r for r in scored.withColumn("outcome", F.when(F.col("nt"), outcome)).collect()}
    assert rows["a", 0, "title"]["s"]["correct"] and rows["a", 0, "title"]["s"]["score"] == 1.0
    assert not rows["a", 0, "venue"]["s"]["correct"] and 0.85 < rows["a", 0, "venue"]["sim"] < 1
    assert rows["b", 0, "venue"]["s"]["score"] == 0.0 and rows["b", 0, "title"]["sim"] <= 0.3
    want = {("a", "seat"): "abstain_empty", ("a", "grade"): "misattributed", ("a", "price"): "nonnumeric_text", ("b", "seat"): "abstain_lowconf", ("b", "grade"): "fabricated", ("b", "price"): "abstain_empty"}
    assert {(f, d): rows[f, 0, d]["outcome"] for f, d in want} == want
    told = scored.withColumn("outcome", F.when(F.col("nt"), outcome))
    assert {r["outcome"]: r["n"] for r in E.outcome_distribution(told.filter("nt"), "outcome").collect()} == {"abstain_empty": 2, "abstain_lowconf": 1, "nonnumeric_text": 1, "misattributed": 1, "fabricated": 1}
    flat = told.select("field", "nt", F.col("s.correct").alias("ok"), F.col("s.score").alias("score"), F.col("sim").alias("similarity"))
    stats = {r["field"]: r for r in E.field_stats(flat, "field", "ok", "score", "nt").collect()}
    assert (stats["title"]["n"], stats["title"]["scored"], stats["title"]["accuracy"]) == (3, 3, 0.6667) and stats["seat"]["accuracy"] is None and stats["seat"]["null_truth"] == 2
    means = {r["field"]: r["similarity"] for r in E.field_means(flat, "field", "nt", ["similarity"]).collect()}
    assert means["seat"] is None and means["title"] == pytest.approx((2 + float(rows["b", 0, "title"]["sim"])) / 3, abs=1e-4)
    flips = {r["field"]: (r["unstable"], r["files"]) for r in E.flip_rate(df.withColumn("reading", normalize_text(F.col("reading"), compose=False)), "file", "field", "reading").collect()}
    assert flips == {"title": (0, 1), "venue": (1, 1)}


def test_truths_and_records(spark, tmp_path):
    items = [{"file": "a", "difficulty": "easy", "truth": {"title": "T"}, "unreadable_fields": ["seat"]}, {"file": "", "truth": {"x": None}}, {"file": "c", "truth": None, "unreadable_fields": "seat"}, {"file": "d", "truth": {}, "unreadable_fields": None}]
    (tmp_path / "truth.json").write_text(json.dumps({"version": 1, "items": items}))
    truths = S.truth_items(spark, str(tmp_path / "truth.json"))
    got = {r["at"]: (r["file"], r["truth"] is not None, r["unreadable"], r["problems"]) for r in truths.collect()}
    assert got == {0: ("a", True, ["seat"], []), 1: ("", True, None, ["no file"]), 2: ("c", False, None, ["no truth", "unreadable fields are no list"]), 3: ("d", True, None, [])}
    (tmp_path / "odd.json").write_text("{}")
    with pytest.raises(Exception, match="no list of items"):
        S.truth_items(spark, str(tmp_path / "odd.json")).collect()
    (tmp_path / "raw").mkdir()
    for name, model, file in (("a", "m1", "a"), ("a.r1", "m1", "a"), ("z", "m1", "z"), ("a2", "m2", "a"), ("_skip", "m3", "a")):
        (tmp_path / "raw" / f"{name}.json").write_text(json.dumps({"meta": {"model": model, "file": file}}))
    found = S.records(spark, str(tmp_path / "raw"))
    assert sorted(map(tuple, S.runs_by_model(found, truths).collect())) == [("m1", 1, 2, 1), ("m2", 1, 1, 0)]
    assert sorted((r["model"], r["run"]) for r in S.labelled(found, truths).select("model", "run").collect()) == [("m1", 0), ("m1", 1), ("m2", 0)]


def test_report(spark):
    df = spark.createDataFrame([("x", 50.0)], "k string, pct double")
    assert S.report("R", [("One", "text"), ("Two", df)], {"Two": "pct"}) == "# R\n\n## One\n\ntext\n\n## Two\n\n| k | pct | bar |\n| --- | --- | --- |\n| x | 50.0 | " + "█" * 25 + " |\n"
