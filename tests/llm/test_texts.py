"""op4, op6 and op8 against plain Python on odd rows and on the small documents."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import op3_substrings, op4_packing, op6_lines, op8_quality

WS = " \t\n\x0b\x0c\r"
LINE = "a line that is long enough to count"
ODD = [
    (1, "one\n" + LINE + "\ntwo"), (2, "  " + LINE.upper() + "\t\n\n"), (3, LINE + "\n" + LINE), (4, None), (5, ""), (6, "\n\n"), (None, LINE), (3, LINE + "\n" + LINE),
    (3, "another text under the same id\n" + LINE), (7, "x" * 200_000), (8, ("w%d " % 1) * 30_000), (9, "é" * 20 + "\n" + "É" * 20), (10, "é" * 20), (11, "é" * 20), (12, "a\x1cb\x85c d \x1f" * 3),
    (13, "Ünïcode 😀 <|endoftext|> it's 'S we'LL 12³ ½"), (14, " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(40))),
    (15, "p q r s t u v w x y\n" * 3), (16, " \x0b " + LINE + " \x0c"), (17, "# * $ % & | < >\n# * $ % & | < >"), (18, "d " * 12), (19, "one two three four five six seven eight " * 2 + "nine"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module", params=["odd", "sf0.001", "empty"])
def docs(request, spark):
    if request.param == "odd":
        return ODD, spark.createDataFrame(ODD, SCHEMA).repartition(3)
    if request.param == "empty":
        return [], spark.createDataFrame([], SCHEMA)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in df.collect()], df


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return text.encode().split()


def test_lines(docs):
    rows, df = docs
    holders = defaultdict(set)
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k := lower(x.strip(WS))) >= 20:
                holders[k].add(low(i))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(lower(x.strip(WS)), ())) >= 3 and max(h) != low(i))]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    for batches in (1, 9) if len(rows) < 50 else (4,):
        got = op6_lines.dedup_lines(df, batches=batches).collect()
        assert order([(r[0], r[1], r[2], sha(r[3])) for r in got]) == order(want)


def test_runs_stay_levelled(spark):
    runs = op6_lines.LineRuns(op6_lines.Scratch(spark, "t"), fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, 0, b * 100 + k) for k in range(b, b + 4)], "h1 long, h2 long, id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    with op6_lines.in_order(spark):
        got = {r["h1"]: r["top"] for r in runs.held_by(3).collect()}
        assert got == {2: 202, 3: 303, 4: 404, 5: 405}
        fresh = runs.unseen(spark.createDataFrame([(0, 0), (7, 0), (99, 0)], "h1 long, h2 long")).collect()
    assert [r["h1"] for r in fresh] == [99]


def test_a_batch_moves_only_itself(spark):
    """Whatever the runs hold, a batch is shuffled once and sorted once, and the runs not at all."""
    runs = op6_lines.LineRuns(op6_lines.Scratch(spark, "t"), fanout=3)
    batch = lambda b: spark.range(b * 50, b * 50 + 100).repartition(3).selectExpr("id AS h1", "id * 7 AS h2", "id")
    for b in range(8):
        runs.add(batch(b))
        with op6_lines.in_order(spark):
            plan = runs.marked(batch(b + 1))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Sort [") == 1, plan
        assert plan.count("Bucketed: true") == plan.count("SortMergeJoin") == len(runs.runs())
    assert [len(level) for level in runs.levels] == [2, 2]
    with op6_lines.in_order(spark):
        assert runs.held_by(2).count() == 350 and runs.held_by(1).count() == 450


def pack(df, window=4096):
    return op4_packing.pack(df, op4_packing.vocabulary(), window=window).collect()


@pytest.mark.parametrize("window", [4096, 64, 1])
def test_packing(docs, window):
    rows, df = docs
    if window == 1 and len(rows) > 50:
        return
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op4_packing.vocabulary())
    if window == 1:
        df = df.filter("length(coalesce(text, '')) < 1000")
        rows = [r for r in rows if len(r[1] or "") < 1000]
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in rows)
    got = pack(df, window)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
    for k, s in sequences.items():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == window or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    have = Counter()
    for i, ps in pieces.items():
        ps.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        ids, total = [], 0
        for r in ps:
            assert r["start"] == len(ids)
            ids += np.frombuffer(r["ids"], "<u4").tolist()
            if len(ids) == r["doc_tokens"]:
                have[i, tuple(ids)] += 1
                ids = []
        assert not ids
    assert have == want


def test_packing_crc(spark):
    df = spark.createDataFrame([(1, "Hello, world's hello")], SCHEMA)
    from pyspark.sql import functions as F

    r = op4_packing.pack(df, op4_packing.vocabulary()).withColumn("crc", F.crc32("ids")).collect()[0]
    assert r["crc"] == zlib.crc32(r["ids"])


def repeats(w, window=8):
    at = defaultdict(list)
    for p in range(len(w) - window + 1):
        at[tuple(w[p : p + window])].append(p)
    hit = np.zeros(len(w), bool)
    for v in at.values():
        for p in v if len(v) > 1 else ():
            hit[p : p + window] = True
    return int(hit.sum())


def test_quality(docs):
    rows, df = docs
    want = []
    for i, t in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        r = repeats(w)
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, len(w) < 20 or 100 * r > 30 * len(w)))
    got = op8_quality.judge_quality(df).collect()
    assert order([(r[0], *r[1:6], r["base_failed"]) for r in got]) == order(want)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_longest_repeat():
    codes = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9])
    assert op8_quality.repetition(codes, 2) == (8, 5)
    rng = np.random.default_rng(5)
    for _ in range(60):
        c = rng.integers(0, 3, rng.integers(1, 40))
        w = int(rng.integers(2, 6))
        longest = max((n for n in range(len(c)) if len({tuple(c[i : i + n]) for i in range(len(c) - n + 1)}) < len(c) - n + 1), default=0)
        covered, most = op8_quality.repetition(c, w)
        assert covered == repeats(c.tolist(), w)
        assert len(c) <= w or most == longest


def test_extra_columns_may_clash(spark):
    df = spark.createDataFrame([(1, LINE, 5, 6, 7, 8)], "doc_id long, text string, id long, pos long, n_words long, task long")
    assert op6_lines.dedup_lines(df, carry=("id", "n_words")).collect()[0]["n_words"] == 7
    assert op3_substrings.dedup_units(df).count() == 1
    assert op8_quality.judge_quality(df, carry=("id",)).collect()[0]["id"] == 5
    assert len(pack(df)) == 1
