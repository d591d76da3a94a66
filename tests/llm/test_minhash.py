"""op7 against brute force: exact sets, all pairs, plain union-find."""

import random
import re

import numpy as np
import pytest

from cadenza.llm import op7_minhash
from cadenza.llm.common import Scratch
from cadenza.llm.components import connected_components


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=85):
    low = lambda i: -(2**63) if i is None else i
    sets = [(low(i), shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            inverted.setdefault(g, []).append(k)
    pairs = {(a, b) for v in inverted.values() if len(v) > 1 for x, a in enumerate(v) for b in v[x + 1 :]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        n = len(s & t)
        if 100 * n >= percent * (len(s) + len(t) - n):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    back = lambda i: None if i == -(2**63) else i
    return sorted(((back(i), len(s), back(root(i)), root(i) == i) for i, s in sets), key=str)


def run(df, **more):
    return sorted(map(tuple, op7_minhash.near_duplicates(df, **more).collect()), key=str)


def family(rng, size, words, first):
    """Copies of one text with up to a third of its words changed, in random order of change."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(size):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


ODD = [(5, None), (6, ""), (7, " \n "), (8, "one two"), (9, "ONE two"), (4, "one  two "), (None, "one two three four five"), (3, "one two three four five"), (3, "one two three four five"), (3, "other words that share an id only"), (11, "a " * 50_000), (10, "A " * 400), (12, "é é é é é"), (13, "É É É É É"), (14, "a\x1cb c"), (15, "a b c")]


@pytest.mark.parametrize("docs", [ODD, []], ids=["odd", "empty"])
def test_odd(spark, docs):
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_families(spark):
    rng = random.Random(4)
    docs = [d for f in range(12) for d in family(rng, 40, 100 + 10 * f, 1000 * f)]
    docs += family(rng, 700, 120, 50_000)  # more than one block
    rng.shuffle(docs)
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), block=100) == brute(docs)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert run(df) == brute([tuple(r) for r in df.collect()])


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t"))
    assert sorted(map(tuple, got.collect())) == sorted((x, root(x)) for x in list(parent))


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in rng.integers(1, 200, 30)]
    got = op7_minhash.intersections(sets[:13], sets[13:], width=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[13:]] for a in sets[:13]]
