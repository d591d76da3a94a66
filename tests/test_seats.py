"""Points and labels of seats against plain Python."""

import random
from math import floor

from pyspark.sql import functions as F

from cadenza.functions import seats as L
from cadenza.operators import geometry as G

BLOCKS = [
    ("v", 1, "A", 1, 10, "depth", "width", None, "confirmed", "confirmed"), ("v", 1, "B", 1, 3, "depth", "depth", "toward", "confirmed", "inferred"), ("v", 1, "C", 1, 3, "depth", "depth", "away", "unknown", "confirmed"),
    ("v", 2, "D", None, None, "depth", "width", None, "confirmed", "confirmed"), ("v", 2, "E", 4, 4, "depth", None, None, "confirmed", "confirmed"), ("v", 2, "F", 1, 9, "depth", "width", None, "unknown", "confirmed"), ("v", 2, "G", 1, 9, "depth", "width", None, None, "confirmed"),
]
ANCHORS = [
    ("v", 1, "A", 10, 80, 150, 5, "left", False, None, None, [3, 4, 4, 99], 14), ("v", 1, " b ", 155, 10, 170, -9, "right", True, 1, 14, None, 14), ("v", 1, "C", 0, 0, 9, 9, "left", False, 2, 2, [], None),
    ("v", 2, "D", 1, 2, 3, 4, "left", False, None, None, None, 5), ("v", 2, "E", 1, 2, 4, 7, "left", False, None, None, None, 1), ("v", 2, "F", 1, 2, 4, 7, "left", False, None, None, None, 1), ("v", 9, "G", 1, 2, 4, 7, "left", False, None, None, None, 1),
]


def half_up(x):
    return floor(x + 0.5)


def placed(seat):
    _, venue, level, code, row, number = seat
    if level is None:
        return (None,) * 5
    c = (code or "").strip().upper()
    b = next((x for x in BLOCKS if x[:3] == (venue, level, c)), None)
    a = next((x for x in ANCHORS if (*x[:2], x[2].strip().upper()) == (venue, level, c)), None)
    if not b or not a:
        return (93, 78, "floor", True, "no such block" if c else None) if (venue, level) == ("v", 1) else (None,) * 5
    lo, hi, row_axis, seat_axis, direction, known, conf = b[3:]
    nx, ny, fx, fy, side, folded, s0, s1, gaps, most = a[3:]
    t, precision, warning = 0.5, "block", None
    if known == "unknown" and seat_axis != "depth":
        pass
    elif seat_axis == "depth" and s0 is not None:
        if number is not None:
            u = min(max((number - s0) / max(1, s1 - s0), 0), 1)
            t, precision = (1 - u if direction == "toward" else u), "exact"
    elif row_axis == "depth" and row is not None and lo is not None:
        rows = [r for r in range(lo, hi + 1) if r not in (gaps or [])]
        if row in rows:
            t, precision = (0.5 if len(rows) < 2 else rows.index(row) / (len(rows) - 1)), "row" if number is None else "exact"
        else:
            warning = "no such row" if row in (gaps or []) else "row outside block"
    x, y = half_up(nx + (fx - nx) * t), half_up(ny + (fy - ny) * t)
    if precision == "exact" and number is not None and most and most > 1:
        x += half_up((min(max((number - 1) / (most - 1), 0), 1) - 0.5) * 2)
    return (min(max(x, 0), 159), min(max(y, 0), 103), precision, conf != "confirmed", warning)


def test_points(spark):
    rng = random.Random(12)
    seats = [(k, rng.choice(["v", "v", "v", "w"]), rng.choice([1, 2, 1, 3, None]), rng.choice(["A", "b", " C", "D", "E", "F", "G", "Z", "", None]), rng.choice([None, *range(12)]), rng.choice([None, *range(0, 20)])) for k in range(600)]
    df = spark.createDataFrame(seats, "k int, venue string, floor int, block string, row int, number int")
    blocks = spark.createDataFrame(BLOCKS, "venue string, floor int, code string, row_min int, row_max int, row_axis string, seat_axis string, seat_direction string, rows_known string, geometry string")
    anchors = spark.createDataFrame(ANCHORS, "venue string, floor int, code string, near_x int, near_y int, far_x int, far_y int, side string, folded boolean, seat_min int, seat_max int, missing_rows array<int>, max_seat int")
    floors = spark.createDataFrame([("v", 1, 93, 78)], "venue string, floor int, x int, y int")
    got = G.seat_points(df, blocks, anchors, floors, "k", 160, 104).collect()
    assert {r["k"]: (r["x"], r["y"], r["precision"], r["approximate"], r["warning"]) for r in got} == {s[0]: placed(s) for s in seats}


def test_labels(spark):
    cases = {
        "1층A블록4열2번": (1, "A", 4, 2, False), "합창석G블록2열3번": (1, "G", 2, 3, True), "3층 BOX12 5번": (3, "BOX12", None, 5, False), "3층BOX1 3번": (3, "BOX13", None, None, None), " 2층 C 블럭 7번 ": (2, "C", None, 7, False),
        "１층A블록１열２번": (1, "A", 1, 2, False), "1층 A구역": None, "": None, None: None, "층A블록4열2번": None,
    }
    cases.pop("3층BOX1 3번")  # without spaces a box and its number run together, as they do in the source
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", L.parse_seat_label(F.col("t")).alias("s")).orderBy("i").collect()
    assert [tuple(r["s"]) if r["s"] else None for r in rows] == list(cases.values())
    s = spark.createDataFrame([(1, "A", 4, 2, False, 9), (1, "G", None, 3, True, 9), (2, "B", 0, None, False, 7)], "f int, b string, r int, n int, c boolean, p int")
    cols = [F.col(x) for x in "fbrnc"]
    assert [tuple(r) for r in s.select(L.seat_label(*cols), L.seat_label(*cols, F.col("p"))).collect()] == [("1층 A구역 4열 2번",) * 2, ("합창석 1층 G구역 3번", "합창석 1층 G구역 3번 시점9"), ("2층 B구역", "2층 B구역 시점7")]


def test_placements(spark):
    rows = [("exact", False, 1, "A", "mid-left"), ("row", True, 2, "B", "behind-stage"), ("block", True, 1, "C", None), ("floor", True, 3, None, None), ("none", True, None, None, None)]
    df = spark.createDataFrame(rows, "p string, a boolean, f int, b string, z string")
    got = [r[0] for r in df.select(L.describe_placement(F.col("p"), F.col("a"), F.col("f"), F.col("b"), F.col("z"), "구역")).collect()]
    assert got == ["1층 A구역 · 중간 왼편", "≈ 2층 B구역 · 무대 뒤 합창석", "≈ 1층 C구역 어딘가 · ", "≈ 3층 어딘가", "좌석 정보 없음"]


def test_nearest_hold_little(spark):
    """Far points go before the sort, and a seat meets the places of its block in one row."""
    points = spark.range(2000).select("id", F.lit(0.0).alias("x"), (F.col("id") % 40).cast("double").alias("y"))
    targets = spark.createDataFrame([(1, 0.0, 3.2), (None, 0.0, 0.0)], "t int, tx double, ty double")
    near = G.nearest_top(points, "id", "x", "y", targets, "t", "tx", "ty", 3)
    assert sorted((r["t"] or 0, r["id"], r["place"]) for r in near.collect()) == [(0, 0, 1), (0, 40, 2), (0, 80, 3), (1, 3, 1), (1, 43, 2), (1, 83, 3)]
    assert sorted(r["id"] for r in G.nearest_top(points.limit(2), "id", "x", "y", targets.limit(1), "t", "tx", "ty", 3).collect()) == [0, 1]
    assert "_bar" in near._jdf.queryExecution().optimizedPlan().toString()
    seats = spark.createDataFrame([(1, 5, 2), (2, None, 9), (3, 1, 1)], "seat int, row int, number int").selectExpr("*", "'v' AS venue", "1 AS floor", "'A' AS block")
    places = spark.createDataFrame([(7, 4, 2), (8, 6, 2), (6, 4, 2), (9, 1, 9)], "p int, row int, number int").selectExpr("*", "'v' AS venue", "1 AS floor", "'A' AS block")
    got = G.nearest_in_block(seats, places, "seat", "p")
    assert {r["seat"]: r["p"] for r in got.collect()} == {1: 6, 2: 9, 3: 9} and "transform(" in got._jdf.queryExecution().optimizedPlan().toString()
