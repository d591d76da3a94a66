"""Parts of pages against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from cadenza.functions import pages as P


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def matched(page, first, second):
    """Bracket matching one character at a time."""
    at = page.find(first)
    at = page.find(second, at) if at >= 0 else -1
    if at < 0:
        return None
    begin = at + len(second) - 1
    depth, inside, escaped = 0, False, False
    for p in range(begin, len(page)):
        c = page[p]
        if inside:
            inside, escaped = (inside, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                try:
                    json.loads(page[begin : p + 1])
                except ValueError:
                    return None
                return page[begin : p + 1]
    return None


def test_embedded_json(spark):
    rng = random.Random(9)
    texts = [None, "", "A", "A B{", 'A B{"a":1}', 'B{"a":1}', 'A B{"a":"}"} tail }', 'A B{"a":"\\"}"}', 'A B{"a":"\\\\"}', 'A B{"a":"open}', "A B{a}", 'xA "B{" B{"q":{"r":[1,{"s":"é\\n"}]}}', 'A B{"long":"' + "x" * 300_000 + '"}', 'A B{"a":"l1\nl2"}']
    for _ in range(200):
        texts.append("A B{" + "".join(rng.choice(['"', "\\", "{", "}", '"k":', "1", ",", '"v"', '{"m":2}']) for _ in range(rng.randrange(0, 14))) + "}")
    want = [matched(t, "A", "B{") if t is not None else None for t in texts]
    assert column(spark, texts, lambda c: P.embedded_json(c, "A", "B{")) == want
    assert sum(x is not None for x in want) > 8


def cut(page, begin, end, cap):
    out = []
    for m in re.finditer(begin, page):
        e = re.compile(end).search(page, m.end())
        out.append(page[m.end() : e.start()] if e else page[m.end() : m.end() + cap])
    return out


def test_regions(spark):
    rng = random.Random(8)
    texts = ["", "none", "<a>", "<a><a></a>", "<a>one</a>two<a>three", "<a>x<b>y<a>z</a>"] + ["".join(rng.choice(["<a>", "<b>", "</a>", "<hr>", "é", "word ", "\n"]) for _ in range(rng.randrange(0, 25))) for _ in range(200)]
    assert column(spark, texts, lambda c: P.regions(c, "<[ab]>", "</a>|<hr>", 6)) == [cut(t, "<[ab]>", "</a>|<hr>", 6) for t in texts]
    assert column(spark, [None], lambda c: P.regions(c, "a", "b")) == [[]]


def test_many_and_long_regions(spark):
    page = "<a>x</a>" * 3000 + "<a>" + "y" * 100_000
    got = column(spark, [page], lambda c: P.regions(c, "<a>", "</a>"))[0]
    assert len(got) == 3001 and got[0] == "x" and got[-1] == "y" * P.REGION


def test_lines_once_in_order(spark):
    page = "<h2>i</h2><p>two</p><p>one</p><div class=end><h2>n</h2><p>one</p><!-- c --><p>three &amp; four</p>"
    assert column(spark, [page], lambda c: P.region_lines(c, "</h2>", "<div class=")) == [["two", "one", "three & four"]]


def test_sections(spark):
    details = [("공연소개", "<p>a</p><img src='/x.png'><IMG class=q src = \"//h/y.jpg\"><img src='z.SVG'>"), ("아티스트", "<p>no</p><img src='/no.png'>"), ("공지사항", "<p>b</p><p>a</p><img src=' /x.png '><img alt='1' src='http://k/?a&amp;b'>"), ("알립니다", None), (None, "x")]
    df = spark.createDataFrame([(1, details), (2, None), (3, [])], f"i int, d {P.DETAILS}")
    got = df.select("i", P.section_lines(F.col("d")).alias("l"), P.section_images(F.col("d"), "http://s").alias("u")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, ["a", "b"], ["http://s/x.png", "https://h/y.jpg", "http://k/?a&b"]), (2, [], []), (3, [], [])]
