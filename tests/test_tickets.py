"""Ticket records, repairs and merges on invented values."""

from pyspark.sql import functions as F

from cadenza.functions import parsers as P
from cadenza.operators import scoring
from cadenza.operators import tickets as T

RULES = T.Rules(venues=(("Orb", "Orb Hall"),), dates=(r"\d{4}\.\d{2}\.\d{2}", r"\d{4}-\d{2}-\d{2}"), times=(r"\d{1,2}:\d{2}",), gate="게이트", booking=r"^[A-Z]\d{5,}$", grade="(?:VIP|R|S)석", price=r"[\d,]+원", free="초대")


def test_records(spark):
    pages = {
        1: [("2024-05-01 and 2024.05.02", 0.9, 0.02), ("Orb", 0.8, 0.09), ("A long name in Latin", 0.9, 0.05), ("한글 제목", 0.5, 0.045), ("게이트 2층 3열", 1.0, 0.01), ("객석 2층", 1.0, 0.01), ("좌석: 2층 5열 7번", 1.0, 0.01), ("좋은 S석입니다 오늘", 1.0, 0.01), ("VIP석", 1.0, 0.01), ("초대권", 1.0, 0.01)],
        2: [("12345", 1.0, 0.9), ("티켓링크 안내", 1.0, 0.9), ("A12345", 1.0, 0.9), ("20,000원", 0.7, 0.9), ("ab", 1.0, 0.9)],
        3: [(None, None, None)],
    }
    rows = [(p, i, t, c, h, i / 10) for p, ls in pages.items() for i, (t, c, h) in enumerate(ls)]
    got = {r["page"]: r for r in T.record_of(spark.createDataFrame(rows, "page int, at int, text string, confidence double, height double, top double"), "page", RULES).collect()}
    value = lambda p: {f: got[p][f] and got[p][f]["value"] for f in ("venue", "date", "time", "seat", "grade", "price", "title")}
    assert value(1) == {"venue": "Orb Hall", "date": "2024.05.02", "time": None, "seat": "2층 5열 7번", "grade": "VIP석", "price": "초대", "title": "한글 제목"}
    assert got[1]["venue"]["confidence"] == 0.8 and got[1]["title"]["confidence"] == 0.5 and got[1]["seat"]["confidence"] == 0.9
    assert value(2) == {"venue": None, "date": None, "time": None, "seat": None, "grade": None, "price": "20,000원", "title": None}
    assert not any(value(3).values())


def test_repairs(spark):
    cases = {"B구역 15일": ("B구역 15열", ["row-after-block"]), "15월 01번": ("15열 01번", ["row-before-number"]), "lO열 7번": ("10열 7번", ["zero", "one"]), "2024년 6월 20일": ("2024년 6월 20일", []), "plain": ("plain", []), None: (None, [])}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.repaired_seat(F.col("s")).alias("r")).collect()
    assert {r["s"]: (r["r"]["text"], r["r"]["rules"]) for r in rows} == cases


def test_typed_records(spark):
    r = spark.createDataFrame([("2024.03.01", "19:30", "l층 B구역 3열 4번", "30,000원"), (None, "", "-", None)], "d string, t string, s string, p string").select(T.typed_record(F.col("d"), F.col("t"), F.col("s"), F.col("p")).alias("r")).collect()
    assert (r[0]["r"]["date"]["value"], r[0]["r"]["time"]["value"], r[0]["r"]["seat"]["floor"], r[0]["r"]["price"]) == ("2024-03-01", "19:30", 1, 30000)
    assert not any(r[1]["r"][f] for f in ("date", "time", "seat", "price"))


def test_typed_records_parse_a_text_once(spark):
    """The rows are those of typed_record, and seats and days are parsed before they meet their tickets."""
    rows = [(i, d, "19:30" if i % 2 else None, s, "30,000원") for i, (d, s) in enumerate([("2024.03.01", "l층 B구역 3열 4번"), ("2024.03.01", "l층 B구역 3열 4번"), (None, "-"), ("", None), ("31 May 2024", "2층")] * 3)]
    df = spark.createDataFrame(rows, "id int, d string, t string, s string, p string")
    got = T.typed_records(df, "d", "t", "s", "p")
    want = df.select("id", F.explode(F.array(T.typed_record(F.col("d"), F.col("t"), F.col("s"), F.col("p")))).alias("r")).select("id", "r.*")
    assert sorted(map(str, got.toDF("id", "date", "time", "seat", "price").collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp") < 20


def test_composers(spark):
    aliases = [("arbel", "Arbel"), ("아르벨", "Arbel"), ("norvik", "Norvik")]
    cases = {("Norvik and ARBEL: duo", "아르벨 - 왈츠"): ["Arbel", "Norvik"], ("J. Ostrel - Sonata", "j. ostrel: other", "12 - x", " ", "plain"): ["Ostrel", "j. ostrel"], (): []}
    rows = spark.createDataFrame([(list(k),) for k in cases], "items array<string>").select(T.composers_of(F.col("items"), aliases).alias("c")).collect()
    assert [r["c"] for r in rows] == list(cases.values())


def test_merges(spark):
    values = [("f", k, "title", v) for k, v in enumerate(["A, b", "ab", "c"])] + [("f", k, "date", v) for k, v in enumerate(["x", "y"])]
    got = {r["field"]: (r["value"], r["confidence"]) for r in T.merged_fields(spark.createDataFrame(values, "file string, run int, field string, value string")).collect()}
    assert got == {"title": ("A, b", 0.6667), "date": ("x", 0.5)}
    items = [("f", 0, 0, "One"), ("f", 0, 1, "two!"), ("f", 1, 0, "TWO"), ("f", 1, 1, "three"), ("g", 0, 0, "only")]
    runs = [("f", 0), ("f", 1), ("g", 0), ("g", 1)]
    merged = T.merged_programmes(spark.createDataFrame(items, "file string, run int, at int, item string"), spark.createDataFrame(runs, "file string, run int")).collect()
    assert [tuple(r) for r in merged] == [("f", 1, "two!", 0.3333)]


def test_genres_forces_and_zones(spark):
    rules = [("관현악", "orchestra", 1.0), ("재즈", "jazz", 0.1)]
    rows = spark.createDataFrame([("서울 관현악단",), ("재즈",), ("else",), ("",), (None,)], "g string").select(T.genre_class(F.col("g"), rules, "none").alias("x")).collect()
    assert [tuple(r["x"]) for r in rows] == [("orchestra", 1.0), ("jazz", 0.1), ("else", 0.5), ("none", 0.5), ("none", 0.5)]
    seats = spark.createDataFrame([("v", 1, "front-left"), ("v", 1, "front-left"), ("v", 2, None)], "venue string, floor int, zone string")
    assert [tuple(r) for r in T.occupied_zones(seats, "zone").collect()] == [("v", 1, "front-left", 2)]
    zones = spark.createDataFrame([("v", 1, "A", "left"), ("v", 1, "A", "right"), ("v", 1, "B", "left"), ("v", 1, "B", "left")], "venue string, floor int, code string, col string")
    assert [r["code"] for r in T.column_conflicts(zones).collect()] == ["A"]


def test_second_pass_and_votes(spark):
    rows = spark.createDataFrame([([0.9, None, 0.9], "d", "t"), ([0.5], "d", "t"), ([1.0], None, "t"), ([], "d", "t"), ([None], "d", "t")], "c array<double>, d string, t string")
    assert [r[0] for r in rows.select(scoring.needs_second_pass(F.col("c"), F.col("d"), F.col("t"))).collect()] == [False, True, True, True, True]
    names = [("a", "x", False)] * 3 + [("a", "y", True)] + [("b", "z", False)] + [("c", "w", False)] * 2
    works = spark.createDataFrame([("a", 3), ("b", 2), ("c", 8)], "k string, works int")
    got = scoring.name_vote(spark.createDataFrame(names, "k string, n string, strong boolean"), works, "k", "n", "strong").collect()
    assert sorted(map(tuple, got)) == [("a", "y"), ("c", "w")]


def test_fields_are_read_once(spark):
    """A pattern stands once in the plan for each place that says it, however often its find is used."""
    rows = spark.range(1).select(F.col("id").cast("string").alias("s"))
    regexps = lambda column: rows.select(column.alias("x")).select("x.*")._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_")
    assert regexps(P.parse_seat(F.col("s"))) < 60
    assert regexps(P.parse_date(F.col("s"))) < 100
    assert regexps(P.parse_time(F.col("s"))) < 20
    assert regexps(T.typed_record(F.col("s"), F.col("s"), F.col("s"), F.col("s"))) < 250
