"""op3 against plain Python: units, cuts, and what any run of 50 words must lose."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import op3_substrings as op3
from cadenza.llm.wordcodes import Runs, Words
from tests.llm.test_texts import ODD, SCHEMA, docs, lower, order, sha, words  # noqa: F401

WORD = re.compile(r"[^\x20\t\n\x0b\x0c\r]+")
low = lambda i: -(2**63) if i is None else i


def plain_units(text, unit, least, passage, core):
    """(start, stop, soft, key) of one text, by start: plain loops."""
    text = text or ""
    spans = [m.span() for m in WORD.finditer(text)]
    w = [x.lower() for x in words(text)]
    if not w:
        return []
    out = [(0, len(text), False, ("whole", *w))]
    groups = [[0]]
    for i in range(1, len(w)):
        gap = text[spans[i - 1][1] : spans[i][0]].count("\n")
        if gap >= (1 if unit == "line" else 2):
            groups.append([i])
        else:
            groups[-1].append(i)
    for g in groups:
        if len(g) >= least:
            start = text.rfind("\n", 0, spans[g[0]][0]) + 1
            stop = text.find("\n", spans[g[-1]][1])
            out.append((start, len(text) if stop < 0 else stop, False, ("unit", *[w[i] for i in g])))
    if passage:
        k, width = op3.SHINGLE, (passage - core) // 2 + 1
        coded = Words(pa.array([text]))
        values = op3.shingle_values(Runs(coded), len(coded)).tolist()
        at = sorted({p for s in range(len(values) - width + 1) for p in range(s, s + width) if values[p] == min(values[s : s + width])})
        out += [(spans[a][0], spans[b + k - 1][1], True, ("cut", *w[a : b + k])) for a, b in zip(at, at[1:])]
    return sorted(out, key=lambda u: u[:3])


def brute(rows, unit="line", least_words=op3.LEAST_WORDS, passage=0, core=op3.CORE):
    units = [(low(i), plain_units(t, unit, least_words, passage, core)) for i, t in rows]
    owner = {}
    for i, us in units:
        for *_, key in us:
            owner[key] = min(i, owner.get(key, i))
    want = []
    for (i, t), (j, us) in zip(rows, units):
        t = t or ""
        hard, soft, seen = np.zeros(len(t), bool), np.zeros(len(t), bool), set()
        spans = []
        for a, b, is_soft, key in us:
            if owner[key] != j or key in seen:
                (soft if is_soft else hard)[a:b] = True
                spans += [(a, b)] if is_soft else []
            seen.add(key)
        for a, b in op3.united(spans):
            if len(words(t[a:b])) >= core:
                hard[a:b] = True
        want.append((i, int(hard.sum()), sha("".join(c for c, g in zip(t, hard) if not g))))
    return want


def got(df, **more):
    return [(r[0], sum(s["stop"] - s["start"] for s in r[2]), sha(r[3])) for r in op3.dedup_units(df, **more).collect()]


@pytest.mark.parametrize("options", [{}, {"unit": "paragraph"}, {"least_words": 16}, {"passage": 50}, {"passage": 12, "core": 4, "unit": "paragraph"}, {"passage": 50, "least_words": 8}], ids=str)
def test_units(docs, options):  # noqa: F811
    rows, df = docs
    assert order(got(df, **options)) == order(brute(rows, **options))


def test_every_run_of_fifty_words_goes_and_nothing_else(spark):
    """By a scan of all runs: each that an earlier text has loses 16 words or more, and what goes stands elsewhere."""
    rng = random.Random(8)
    fresh = iter(range(10**6))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    runs = [new(50 + k) for k in range(30)]
    rows = []
    for i in range(120):
        w = new(rng.randrange(0, 40))
        for r in rng.sample(runs, 2):
            w += r + new(rng.randrange(1, 30))
        rows.append((i, "".join(x + rng.choice("  \n") for x in w)))
    have = op3.dedup_units(spark.createDataFrame(rows, SCHEMA).repartition(5), passage=50).collect()
    have = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in have}
    seen = {}
    for i, t in rows:
        spans, w = [m.span() for m in WORD.finditer(t)], t.split()
        gone = [any(a <= s and e <= b for a, b in have[i]) for s, e in spans]
        for p in range(len(w) - 49):
            if seen.get(tuple(w[p : p + 50]), i) < i:
                assert sum(gone[p : p + 50]) >= op3.CORE
        for p in np.flatnonzero(gone):
            assert any(seen.get(tuple(w[q : q + 9]), i) < i for q in range(max(0, p - 8), p + 1))
        for n in (9, 50):
            for p in range(len(w) - n + 1):
                seen.setdefault(tuple(w[p : p + n]), i)


def test_short_texts_are_units_as_a_whole(spark):
    df = spark.createDataFrame([(1, "All rights reserved"), (2, " ALL rights \n reserved"), (3, "All rights reserved\nown words"), (4, " \n\n"), (5, " \n\n")], SCHEMA)
    assert {r[0]: r["kept_text"] for r in op3.dedup_units(df).collect()} == {1: "All rights reserved", 2: "", 3: "\nown words", 4: " \n\n", 5: " \n\n"}


def test_a_short_line_of_three_documents_stays_in_one(spark):
    line = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(i, f"own {i}\n{line}\nmore {i}") for i in range(3)], SCHEMA)
    kept = {r["doc_id"]: r["kept_text"] for r in op3.dedup_units(df, passage=50).collect()}
    assert kept == {0: f"own 0\n{line}\nmore 0", 1: "own 1\n\nmore 1", 2: "own 2\n\nmore 2"}


def test_words_and_positions():
    texts = [None, "", " \n", "a\x1cb ÄÖ 😀x Ab", "x" * 300 + " " + "X" * 300, "no end", "end ", ODD[3][1], "é" * 100 + " " + "É" * 100]
    w = Words(pa.array(["skipped", *texts]).slice(1))
    assert w.text.tolist() == [i for i, t in enumerate(texts) for _ in WORD.findall(t or "")]
    assert list(zip(w.characters(w.start, w.text).tolist(), w.characters(w.stop, w.text).tolist())) == [m.span() for t in texts for m in WORD.finditer(t or "")]
    key = {}
    for t, a, b in zip([x.lower() for t in texts for x in words(t or "")], *w.hash):
        assert key.setdefault(t, (a, b)) == (a, b)
    assert len(set(key.values())) == len(key)


def test_hot_digests_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(op3, "HOT_SHARE", 10**9)
    line = " ".join(f"h{i}" for i in range(20))
    rows = [(i, f"{line}\nown {i}") for i in range(1500)]
    have = op3.dedup_units(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in have if r["n_removed"]) == list(range(1, 1500))


def test_extra_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, id long, tag long, start long")
    assert op3.dedup_units(df).count() == 1
