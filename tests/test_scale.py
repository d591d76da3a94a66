"""Paths that small tables do not take, against plain Python, and functions that no query calls."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from cadenza import session
from cadenza.functions.forms import mapped
from cadenza.functions.numbers import lerp
from cadenza.operators import blocks, catalog, concentration, evaluation, geometry, retrieval, sync
from cadenza.operators import frequency as Q
from cadenza.operators import programmes, selection
from cadenza.plans.catalogue import QUERIES
from cadenza.sources import readers
from cadenza.streaming import sync as streams

DATA = "/root/testdata/sf0.001"
#: Queries whose large tables are dealt by their number of rows.
DEALT = ["batch_readings", "my_performers_distinct", "pair_cooccurrence", "pair_counts", "seasonality_lift", "work_index"]


def test_ranks_of_crowded_counts(spark):
    rng = random.Random(1)
    rows = [(f"w{rng.randrange(10**6)}-{i}", 1 if i % 10 else 2 + i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "work string, n long").repartition(5)
    want = {w: k for k, (w, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r["work"]: r["position"] for r in Q.rank_and_rarity(df, "work").collect()} == want
    occurrences = sorted(p for w, n in rows for p in [want[w]] * n)
    assert concentration.median_rank(df).first()[0] == occurrences[len(occurrences) // 2]


def test_an_index_is_made_once(spark, tmp_path):
    """Ranking reads the facts once: what runs later reads the saved index."""
    path = str(tmp_path / "facts")
    spark.range(1000).selectExpr("id % 70 AS work").write.parquet(path)
    ranked = Q.rank_and_rarity(spark.read.parquet(path).groupBy("work").count().withColumnRenamed("count", "n"), "work")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert path not in str(ranked.inputFiles()) and "Aggregate [work" not in plan
    assert ranked.count() == 70


@pytest.mark.parametrize("name", DEALT)
def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch, name):
    """Tasks get a bounded number of rows whatever the session's number of partitions, and the rows stay the same."""
    want = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    for module in (session, programmes):
        monkeypatch.setattr(module, "SHARE_ROWS", 500, raising=False)
    got = QUERIES[name](spark, DATA)
    monkeypatch.undo()
    exchanges = got._jdf.queryExecution().toString()
    assert sorted(map(str, got.collect())) == want
    assert name == "work_index" or "REPARTITION_BY_NUM" in exchanges  # a work_index is saved


def test_redirects_of_any_length_and_cycles(spark):
    links = [(i, i - 1) for i in range(1, 150)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (5, 5)]
    rows = spark.createDataFrame([(i,) for i in [0, 60, 149, 1000, 1003, 7777, None]], "id long")
    got = [r["id"] for r in catalog.resolve_redirects(rows, "id", spark.createDataFrame([x for x in links if x != (5, 5)], "old_id long, new_id long")).collect()]
    assert sorted(got, key=str) == sorted([0, 0, 0, 1000, 1003, 7777, None], key=str)


def test_replay_is_the_fold(spark):
    rng = random.Random(2)
    rows = [(e if e < 6 else None, i, rng.choice([None, *range(12)])) for e in range(7) for i in range(80)]
    rows += [(99, i, b) for i, b in enumerate([0, 1, 1, 5, 2])]
    log = spark.createDataFrame(rows, "entity long, seq long, base long").repartition(4)
    got = [sync.replay(log, "entity", "base", ["seq"], short=short).collect() for short in (1000, 50, 0)]
    want = []
    for e in [0, 1, 2, 3, 4, 5, 99, None]:
        rev = 0
        for _, i, b in sorted((r for r in rows if r[0] == e), key=lambda r: r[1]):
            ok = b == rev
            rev += ok
            want.append((e, i, b, ok, rev))
    for have in got:
        assert sorted(map(str, map(tuple, have))) == sorted(map(str, want))


def test_replay_sorted_by_sequence_not_base(spark):
    rows = [(1, i, b) for i, b in enumerate([0, 0, 2, 1, 1, 2, 3])]
    got = sync.replay(spark.createDataFrame(rows, "entity long, seq long, base long"), "entity", "base", ["seq"], short=0).orderBy("seq").collect()
    assert [(r["applied"], r["rev"]) for r in got] == [(True, 1), (False, 1), (False, 1), (True, 2), (False, 2), (True, 3), (True, 4)]


def test_long_alias_lists(spark):
    aliases = [(f"h{i}", f"hall {i:03d}") for i in range(300)] + [("big", "great hall 007 of the city"), ("tie", "hall 007")]
    df = spark.createDataFrame(aliases, "hall string, alias string")
    rows = spark.createDataFrame([(1, "at hall 007 tonight"), (2, "the great hall 007 of the city"), (3, "nowhere"), (4, None), (5, "ha")], "id int, place string")
    assert {r["id"]: r["hall"] for r in blocks.longest_alias(rows, "place", df, "hall", "alias").collect()} == {1: "h7", 2: "big", 3: None, 4: None, 5: None}
    letters = spark.createDataFrame([("x", "a"), ("y", "ha"), ("z", "a")], "hall string, alias string")
    assert {r["id"]: r["hall"] for r in blocks.longest_alias(rows, "place", letters, "hall", "alias").collect()} == {1: "y", 2: "y", 3: None, 4: None, 5: "y"}


def test_cosine_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "id long, v array<double>")
    queries = vectors.filter("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    one = sorted(map(tuple, retrieval.cosine_top(vectors, "id", "v", queries, "q", "qv", 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.cosine_top(vectors, "id", "v", queries, "q", "qv", 3).collect())) == one and len(one) == 18


def test_votes_without_catalogue_numbers(spark):
    rows = [(1, "c", "sonata", "1", "op.1", "s", "raw"), (2, "c", "sonata", None, None, "", "raw text"), (3, "c", None, None, "op.1", None, "r")]
    got = {r["idx"]: r["workKey"] for r in programmes.work_keys(spark.createDataFrame(rows, "idx long, composer string, form string, num string, opus string, slug string, raw string"), ["sonata"]).collect()}
    assert got == {1: "c|sonata#1", 2: "c|?|raw text", 3: "c|sonata#1"}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scores_and_numbers(spark):
    s = lambda x: F.lit(x).cast("string")
    r = one(spark, evaluation.text_score(s("a"), s("a"), F.lit(0.2)).alias("a"), evaluation.text_score(s("a"), s("b"), F.lit(0.2)).alias("b"), evaluation.text_score(s(""), s(""), F.lit(1.0), partial=False).alias("c"))
    assert (tuple(r["a"]), tuple(r["b"]), tuple(r["c"])) == ((True, 1.0), (False, 0.2), (False, 0.0))
    others = F.array(s("grand hall"), s("x"))
    assert tuple(one(spark, *[evaluation.is_misattributed(s(v), others).alias(f"c{i}") for i, v in enumerate(["hall", "x", "grand hall two", "else", None])])) == (True, False, True, False, False)
    assert tuple(one(spark, lerp(F.lit(2.0), F.lit(4.0), F.lit(0.25)).alias("a"), mapped(s("k"), {"k": "v"}).alias("b"), mapped(s("z"), {"k": "v"}).alias("c"), mapped(s("k"), {}).alias("d"))) == (2.5, "v", None, None)
    assert one(spark, selection.worst(s("confirmed"), s("inferred")).alias("a"))[0] == "inferred"


def test_filters_and_rows(spark):
    day = datetime.date
    events = spark.createDataFrame([(1, day(2024, 1, 1), "A", 10), (2, day(2023, 1, 1), "A", 10), (3, day(2024, 1, 2), "B", 10), (4, day(2024, 1, 1), "A", 99)], "id int, date date, region string, price_min int")
    pick = lambda travel, budget: sorted(r["id"] for r in retrieval.hard_filter(events, F.lit(day(2024, 1, 1)), F.lit("A"), F.lit(travel), F.lit(budget).cast("int")).collect())
    assert (pick(False, 50), pick(True, None), pick(False, None)) == ([1], [1, 3, 4], [1, 4])
    assert [r["id"] for r in catalog.own_rows(events, "region", "B").collect()] == [3] and list(catalog.published({"a": events, "b": events}, ["b"])) == ["b"]
    with pytest.raises(KeyError):
        catalog.published({"a": events}, ["b"])
    assert sorted(map(tuple, readers.missing_or_extra(events.select("id"), spark.createDataFrame([(3,), (9,)], "id int"), "id").collect())) == [(1, "left"), (2, "left"), (4, "left"), (9, "right")]
    seen = spark.createDataFrame([("d1", datetime.datetime(2024, 1, 1)), ("d2", datetime.datetime(2024, 5, 1)), ("d1", datetime.datetime(2024, 1, 9))], "device string, at timestamp")
    assert [r["device"] for r in sync.stale_devices(seen, "device", "at", F.lit(datetime.datetime(2024, 6, 1))).collect()] == ["d1"]


def test_lines_and_points(spark):
    lines = spark.createDataFrame([(1, "a", 2, 0, "x"), (1, "a", 1, 5, "y"), (1, "b", 2, 1, "z"), (2, "a", 2, 0, "w")], "page int, canonical string, scale int, at int, t string")
    assert sorted(r["t"] for r in blocks.merge_scales(lines, "page", "canonical", "scale", "at").collect()) == ["w", "y", "z"]
    text = spark.createDataFrame([(1, i, t) for i, t in enumerate(["plain", "Name", "Kim", "call 010-1234-5678", "end"])], "page int, at int, t string")
    kinds = {r["at"]: r["kind"] for r in blocks.pii_lines(text, "page", "at", {"phone": r"\d{3}-\d{4}-\d{4}"}, "t", ["Name"]).collect()}
    assert kinds == {0: "neighbour", 1: "label", 2: "neighbour", 3: "phone", 4: None}
    points = spark.createDataFrame([(k, float(k), 0.0) for k in range(6)], "k int, x double, y double")
    targets = spark.createDataFrame([(1, 2.4, 0.0), (2, 9.0, 0.0)], "t int, tx double, ty double")
    assert sorted((r["t"], r["k"], r["place"]) for r in geometry.nearest_top(points, "k", "x", "y", targets, "t", "tx", "ty", 2).collect()) == [(1, 2, 1), (1, 3, 2), (2, 4, 2), (2, 5, 1)]


def test_json_sink(spark, tmp_path):
    readers.write_json(spark.createDataFrame([(1, ["a"])], "id int, xs array<string>"), str(tmp_path / "out"))
    assert [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()] == [{"id": 1, "xs": ["a"]}]


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(1, "a", at(0)), (1, "a", at(1)), (2, "a", at(3)), (3, "b", at(4)), (4, "a", at(59))], "key long, who string, at timestamp")
    rows.write.parquet(str(tmp_path / "log"))

    def run(make, name):
        stream = make(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log")))
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["key"] for r in run(lambda s: streams.deduplicated(s, "key", "at"), "once")) == [1, 2, 3, 4]
    got = sorted((r["who"], r["n"]) for r in run(lambda s: streams.counted(s, "at", "who", delay="0 seconds"), "counts"))
    assert ("a", 3) in got and ("b", 1) in got
    got = sorted((r["who"], r["n"]) for r in run(lambda s: streams.sessions(s, "at", "who", gap="10 minutes", delay="0 seconds"), "visits"))
    assert got[:2] == [("a", 3), ("b", 1)]


def test_a_pack_is_scored_in_slices():
    """Scores of a slice are held at a time, not those of all pairs of two packs."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    held = []
    retrieval.best_of_pack(type("Pairs", (), {"mapInArrow": lambda self, run, schema: held.append(run)})(), 3)
    n, rng = retrieval.PACK, np.random.default_rng(5)
    m = rng.normal(size=(n, 8))
    ids = np.arange(n)
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([m.tobytes()]), pa.array([ids.tobytes()]), pa.array([m.tobytes()]), pa.array([8], pa.int32())], names=["keys", "vectors", "q_keys", "q_vectors", "dims"])
    tracemalloc.start()
    got = [tuple(r.values())[:2] for out in held[0]([batch]) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3 * n and {k for q, k in got if q == 7} == set(np.argsort(-(m @ m[7]))[:3].tolist())
    assert peak < 40 << 20


def test_bm25_reads_texts_for_terms_once(spark, tmp_path):
    """The terms are saved: the scores do not read the documents, and a term in all of them moves no row for each query."""
    docs = [(i, " ".join(["the", *(["red"] * (i % 3)), f"w{i % 5}"])) for i in range(60)]
    spark.createDataFrame(docs, "doc long, text string").write.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([(q, f"the w{q % 5} red" if q % 2 else "the") for q in range(8)], "q long, words string")
    run = lambda: retrieval.bm25(spark.read.parquet(str(tmp_path / "docs")), "doc", "text", queries, "q", "words")
    rounded = lambda df: sorted((r["q"], r["doc"], round(r["score"], 9)) for r in df.collect())
    one = run()
    assert not any(str(tmp_path) in f for f in one.inputFiles())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "TERM_ROWS", 20)
        dealt = run()
    assert rounded(dealt) == rounded(one) and len({(q, d) for q, d, _ in rounded(one)}) == 480
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
