"""Scalar functions on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import parsers as P
from cadenza.functions import text as T


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in rows.select("i", function(F.col("s")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "function,cases",
    [
        (P.parse_date, {"2031년 4월 5일(토)": ("2031-04-05", 0.97), "2031.4.5": ("2031-04-05", 0.95), "20310405": ("2031-04-05", 0.8), "5 Apr 2031": ("2031-04-05", 0.92), "April 5th, 2031": ("2031-04-05", 0.92), "04/05/2031": ("2031-04-05", 0.5), "25.04.2031": ("2031-04-25", 0.85), "04/25/2031": ("2031-04-25", 0.85), "2031-02-30": (None, 0.0), "4월 5일": (None, 0.0), "": (None, 0.0), "1800-01-01": (None, 0.0)}),
        (P.parse_time, {"19:30": ("19:30", 0.9), "오후 7시 30분": ("19:30", 0.9), "7시": ("07:00", 0.7), "12:05 am": ("00:05", 0.9), "25:00": (None, 0.0), "none": (None, 0.0)}),
        (P.parse_price, {"470,000원": 470000, "초대권": 0, "Invitation": 0, "초대 30,000": 30000, "R석": None, "12": None}),
        (P.parse_seat, {
            "객석 1층 B구역 15열 01번": (1, "B", 15, 1, None, 1.0), "입장: 8층 2번 게이트 좌석: 객석 2층 c구역 3열 7번": (2, "C", 3, 7, None, 1.0), "3층 E블록 6열": (3, "E", 6, None, None, 0.85),
            "R석 초대": (None, None, None, None, "R석", 0.5), "VIP석 1층": (1, None, None, None, "VIP석", 0.55), "": (None, None, None, None, None, 0.0), "예매 12번호": (None, None, None, None, None, 0.0),
        }),
        (T.parse_opus, {"Symphony Op. 67": "op.67", "KV 331": "K.331", "BWV 1004a": "BWV.1004a", "작품번호 10": "op.10", "none": None, "op.10 - 3": "op.10-3"}),
        (T.parse_key, {"Sonata in c# minor": "C sharp minor", "다장조": "다장조", "E flat major": "E flat major", "D dur": "D major", "plain": None}),
        (T.work_number, {"No. 9": "9", "제 5번": "5", "교향곡 3번": "3", "No. 500": None, "x": None}),
        (T.slug, {"Someone - The Blue Hour Op. 3 / soloist": "blue hour", "a": ""}),
        (T.sort_name, {"Ann B Lee": "Lee, Ann B", "Solo": "Solo"}),
        (T.normalize_work, {"Op. 10 No.3": "op10no3", "작품번호 10": "op10", "Ａ（b）": "ab", "stop. x": "stopx"}),
        (T.is_empty_value, {" N/A ": True, "": True, "미상": True, "x": False}),
        (T.to_number, {"₩470,000": 470000.0, "": None, "-": None, "1.5": 1.5}),
        (T.latin_ratio, {"ab가나": 0.5, "12": 0.0}),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_cases(spark, function, cases):
    got = apply(spark, function, list(cases))
    for (raw, want), x in zip(cases.items(), got):
        x = tuple(x) if hasattr(x, "asDict") else x
        if isinstance(want, tuple):
            assert tuple(pytest.approx(w) if isinstance(w, float) else w for w in want) == x, raw
        else:
            assert x == want, raw


def test_html_lines(spark):
    html = "<html><head><title>T&amp;t</title><style>p{}</style></head><body><!-- x --><script>var a='</p>';</script><p>one <b>two</b></p><p> </p>three<br>four&nbsp;five</body>"
    assert apply(spark, T.html_lines, [html])[0] == ["T&t", "one two", "three", "four five"]
