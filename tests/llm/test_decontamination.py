"""op9 against a scan of every item-sized window, and odd rows."""

import math
import re
from collections import Counter

import pytest

from cadenza.llm import op9_decontamination as op9


def ngrams(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub(r"[!-/:-@\[-`{-~]+", "", (text or "").lower())) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute(docs, items, least=0.8):
    grams = [(i, ngrams(t)) for i, t in items]
    grams = [(i, g) for i, g in grams if g]
    df = Counter(x for _, g in grams for x in set(g))
    weight = lambda x: math.log(1 + len(grams) / df[x])
    out = {}
    for d, t in docs:
        g = ngrams(t)
        where = {}
        for p, x in enumerate(g):
            where.setdefault(x, []).append(p)
        for i, h in grams:
            starts = {p - k for x in set(h) for p in where.get(x, ()) for k in range(len(h))}  # all others share nothing
            c = Counter(h)
            for s in starts:
                k = Counter(g[max(0, s) : max(0, s + len(h))])
                both = sum(weight(x) * min(c[x], k[x]) for x in c)
                either = sum(weight(x) * max(c[x], k[x]) for x in c) + math.log(1 + len(grams)) * sum(n for x, n in k.items() if x not in c)
                if both / either >= least - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), both / either)
    return {k: round(v, 6) for k, v in out.items()}


def run(spark, docs, items):
    got = op9.contaminated(spark.createDataFrame(docs, "doc_id long, text string, item long"), spark.createDataFrame(items, "item_id long, text string, id long")).collect()
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in got}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op9.query(spark, "/root/testdata/sf0.01").collect()}
    want = brute(docs, items)
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def text(n, salt=""):
    return " ".join(f"{salt}w{i * i % 9973}" for i in range(n))


def test_odd(spark):
    item = text(60)
    edited = item.split()
    edited[30] = "changed"
    items = [(1, item, 0), (2, item.upper() + "!", 0), (3, None, 0), (4, "", 0), (5, "two words", 0), (6, text(9, "b"), 0), (7, "again " * 40, 0)]
    docs = [(1, "lead " * k + item + " tail" * k, 0) for k in range(1, 12)] + [(100 + k, t, 0) for k, t in enumerate([None, "", "two words", "Two, words", "x " * 50_000, text(25), " ".join(edited), "z " + text(9, "b") + " z", "again " * 60, "a\x1cb"])]
    docs += [(None, item, 0), (100, None, 0)]
    got = run(spark, docs, items)
    want = brute([d[:2] for d in docs], [i[:2] for i in items])
    assert got == pytest.approx(want, abs=2e-6)
    assert (None, 1) in got and (106, 1) in got and (105, 1) not in got


@pytest.mark.parametrize("docs,items", [([], []), ([(1, "a b c d e f", 0)], []), ([], [(1, "a b c d e f", 0)])])
def test_empty(spark, docs, items):
    assert run(spark, docs, items) == {}


def test_reordered_and_edited_passages(spark):
    """Recall against a scan of every start: swapped halves, moved thirds, edits that are spread or together."""
    import random

    rng = random.Random(6)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(rng.randrange(12, 90)))) for k in range(40)]
    docs = []
    for k, t in items:
        w = t.split()
        n, fill = len(w), lambda m: [f"x{rng.randrange(10**9)}" for _ in range(m)]
        for cut in (n // 2, n // 3):
            docs.append(w[cut:] + w[:cut])
        for edits in range(1, 5):
            e = list(w)
            for p in rng.sample(range(n), min(edits, n)):
                e[p] = fill(1)[0]
            docs.append(e)
        docs += [w[: n - n // 9], w[n // 9 :], w[: n // 2] + fill(n // 12) + w[n // 2 :], w + w[::-1] + w]
    docs = [(i, " ".join(fill(rng.randrange(0, 150)) + d + fill(rng.randrange(0, 150)))) for i, d in enumerate(docs)]
    got, want = run(spark, [(*d, 0) for d in docs], [(*i, 0) for i in items]), brute(docs, items)
    assert len(want) > 150 and got.keys() <= want.keys()
    assert len(got) >= 0.97 * len(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_fingerprints_agree_with_plain_arithmetic(spark):
    from pyspark.sql import functions as F

    rows = spark.range(40).select(F.transform(F.sequence(F.lit(0), F.col("id").cast("int")), lambda k: F.xxhash64("id", k)).alias("h"))
    for most in (50, 20_000):
        for r in rows.select("h", op9.simhash(F.col("h"), most).alias("p")).collect():
            bits = sum((2 * sum(x >> b & 1 for x in r["h"]) >= len(r["h"])) << b for b in range(64))
            assert r["p"] % 2**64 == bits


def test_the_index_holds_all_within_the_radius(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    flips = [sum(1 << b for b in rng.sample(range(64), op9.RADIUS)) for _ in range(300)]
    rows = [(x, x ^ f) for f in flips for x in [rng.getrandbits(64)]]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in rows], "a long, b long")
    assert df.filter(F.arrays_overlap(op9.block_keys(F.col("a"), False), op9.block_keys(F.col("b"), True))).count() == len(rows)
