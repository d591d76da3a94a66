"""op11 and op12 against brute force, op13 against a walk through every order."""

import random
from itertools import permutations
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import op11_jaccard, op12_negatives, op13_filters
from cadenza.llm.common import Scratch
from tests.llm.test_minhash import ODD, family, shingle_set


def links(docs, percent=80):
    """(id, n, component, links) of rows that are each a document of their own."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    sets = [shingle_set(docs[k][1]) for k in order]
    near = {a: [] for a in range(len(sets))}
    for a, s in enumerate(sets):
        for b, t in enumerate(sets):
            if a != b and s and t and 100 * len(s & t) >= percent * len(s | t):
                near[a].append(b)
    least = {}
    for a in range(len(sets)):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = a
                todo += near[x]
    return sorted(((docs[order[a]][0], len(s), docs[order[least[a]]][0], len(near[a])) for a, s in enumerate(sets)), key=str)


def joined(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, op11_jaccard.jaccard_join(df, **more).collect()), key=str)


def test_join_odd_rows(spark):
    assert joined(spark, ODD) == links(ODD)
    assert joined(spark, []) == []


@pytest.mark.parametrize("block", [4, 1024])
def test_join_families(spark, block):
    rng = random.Random(block)
    docs = family(rng, 40, 60, 0) + family(rng, 25, 300, 1000) + family(rng, 6, 7, 2000)
    docs += [(3000 + k, " ".join(docs[k][1].split()[: 45 + k])) for k in range(10)]  # sizes at the threshold
    docs += [(4000 + k, docs[k][1]) for k in range(0, 12, 2)]  # copies
    shared = " ".join(f"p{k}" for k in range(60))
    docs += [(5000 + k, shared + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(100))) for k in range(30)]
    rng.shuffle(docs)
    assert joined(spark, docs, block=block) == links(docs)


def test_join_other_columns_and_long_texts(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(200_000))
    df = spark.createDataFrame([(1, long, 1, "a", 2), (2, long + " more", 2, "b", 3), (3, "else", 3, "c", 4)], "doc_id long, text string, n long, hub string, key long")
    assert sorted(map(tuple, op11_jaccard.jaccard_join(df).select("doc_id", "component_id", "n_links").collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_search_is_exact_for_any_number_of_long_lists():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(50)]
    index = op11_jaccard.Inverted(sets)
    for q in [*sets[:10], np.array([100, 200], np.uint64), np.zeros(0, np.uint64)]:
        for least in (1, 5, 15, 24):
            want = [(k, len(np.intersect1d(q, s))) for k, s in enumerate(sets) if len(np.intersect1d(q, s)) >= least]
            for mu in (0.01, 0.5, 100):
                assert list(zip(*map(list, index.search(q, least, mu)))) == want


def mined(rows, anchors, k=5, share=80):
    ok = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(v is not None and isfinite(v) for v in x):
            v = [min(max(floor(256 * float(np.float32(c))), -(1 << 27)), 1 << 27) for c in x]
            ok[i] = min(ok.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in filter(anchors, ok):
        score = sorted(((-dot(ok[a][1], ok[b][1]), b) for b in ok if b != a))
        for s, p in [x for x in score if ok[x[1]][0] == ok[a][0]][:k]:
            fit = [(t, b) for t, b in score if ok[b][0] != ok[a][0] and share * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, b, -s, -t) for r, (t, b) in enumerate(fit)]
    return sorted(out)


def mine(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    return sorted(map(tuple, op12_negatives.hard_negatives(df, F.col("id") % 10 == 0, **more).collect()))


def test_negatives(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = [(k, int(rng.integers(0, 5)), [float(x) for x in np.float32(centres[k % 4] + rng.normal(size=8) * 0.3)]) for k in range(400)]
    rows += [(400 + k, k % 2, rows[10][2]) for k in range(60)]  # a hot vector, ties
    rows += [(500, None, [1.0] * 8), (None, 1, [1.0] * 8), (510, 1, None), (520, 1, [1.0, None]), (530, 1, [float("nan")] * 8), (540, 1, [float("inf")] * 8), (550, 1, []), (560, 1, [0.5]), (570, 2, [-3e30] * 8), (20, 0, rows[20][2]), (20, 0, rows[20][2]), (580, 77, [0.1] * 8)]
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert mine(spark, rows) == want
    assert mine(spark, []) == []


def test_negatives_of_few_rows_and_small_rings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, k % 3, [float(x) for x in np.float32(rng.normal(size=4))]) for k in range(900)]
    for name, value in (("SAMPLE", 20), ("CHUNK", 7), ("PART", 10), ("PACK", 4)):
        monkeypatch.setattr(op12_negatives, name, value)
    assert mine(spark, rows) == mined(rows, lambda i: i % 10 == 0)
    assert mine(spark, rows[:4]) == mined(rows[:4], lambda i: i % 10 == 0)


def walked(docs, labels):
    least, rows = {}, []
    low = lambda i: (i is not None, i or 0)
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", low(i)), low(i))
    for i, t, part in docs:
        t = t or ""
        w = [x for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), low(i) > least[t])) if bad}
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((part or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for *_, x in mine)))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            alive = own
            for k, f in enumerate(order):
                hit = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                shapley[f] += len(hit)
                steps.append((part, "".join(order), k + 1, len(alive), len(hit), sum(f in r[1] for r in own) - len(hit), sum(r[1] == {f} for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_filters(spark, tmp_path):
    rng = random.Random(1)
    some = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    texts = [some(250), some(199), some(200) + " #", "AB " * 300, "A\tB\x0bC " + some(220), "", None, "long " * 100_000, some(210) + " É"]
    docs = [(k, texts[k % 9], f"s{k % 3}") for k in range(60)] + [(None, texts[0], "s1"), (None, None, None), (7, texts[7], "s0"), (70, texts[3], None), (71, texts[3] + "|", "")]
    labels = [(k, k % 2, k % 5 == 0 and 1 or 0) for k in range(40)] + [(3, 1, 1), (3, None, None), (None, 1, 1)]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, source string, digest string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scratch = lambda: Scratch(spark, "filters")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = op13_filters.audit(op13_filters.flagged(d, lab, scratch()), scratch()).select(*columns)
    assert sorted(map(tuple, got.collect())) == walked(docs, labels)
    empty = op13_filters.audit(op13_filters.flagged(d.limit(0), lab.limit(0), scratch()), scratch())
    assert empty.collect() == []


def test_survivors_of_the_corpus(spark):
    flags = spark.createDataFrame([("a", True, False, 1, 0), ("a", False, False, 1, 1), ("b", False, True, 0, 0)], "part string, A boolean, B boolean, good int, toxic int")
    got = {(r["part"], r["subset"]): r["n"] for r in op13_filters.survivors(flags, "AB").collect()}
    assert got == {("a", 0): 2, ("a", 1): 1, ("a", 2): 2, ("a", 3): 1, ("b", 0): 1, ("b", 1): 1, (None, 0): 3, (None, 1): 2, (None, 2): 2, (None, 3): 1}
