"""The pipeline against a chain of the plain Python versions of its stages."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from cadenza.llm import op4_packing, op8_quality
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_minhash import brute as components
from tests.llm.test_texts import WS, lower, repeats, words

DATA = "/root/testdata/sf0.001"


def good(text):
    w = words(text or "")
    numbers = {}
    codes = np.array([numbers.setdefault(x, len(numbers)) for x in w], np.int64)
    r = repeats(w)
    return len(w) >= 20 and 100 * r <= 30 * len(w) and op8_quality.repetition(codes)[1] <= op8_quality.LONGEST


def without_lines(docs):
    holders = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            if len(k := lower(x.strip(WS))) >= 20:
                holders[k].add(i)
    return [(i, "\n".join(x for x in t.split("\n") if not (len(h := holders.get(lower(x.strip(WS)), ())) >= 3 and max(h) != i))) for i, t in docs]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    docs = without_lines([d for d in docs if good(d[1])])
    kept = {i for i, _, _, k in components(docs, 80) if k}
    docs = [d for d in docs if d[0] in kept]
    dirty = {i for i, _ in leaks(docs, items)}
    docs = {i: t for i, t in docs if i not in dirty}
    t = Tokenizer.from_file(op4_packing.vocabulary())
    want = {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in docs.items()}

    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == set(want)
    seen = defaultdict(int)
    for r in got:
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(x) for i, x in want.items())


def test_stages_pass_on_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 5 + "\nall different words follow here so that the rules accept this text as a clean one with some twenty words in it", "en", "s", 9, 1), (None, None, None, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long, id long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.count() == 1


def test_rows_that_share_an_id_go_each_for_itself(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(None, text("a")), (None, text("b")), (None, item), (5, text("c")), (5, text("d")), (6, text("c")), (7, text("a")), (8, text("e")), (8, text("e")), (9, item + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = corpus_pipeline.near_duplicates(spark, docs, DATA)
    want = [(None, text("a")), (None, text("b")), (None, item), (5, text("c")), (5, text("d")), (8, text("e"))]
    order = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert order(near) == sorted(want, key=str)
    clean = corpus_pipeline.decontamination(spark, docs, DATA)
    assert order(clean) == sorted([r for r in rows if item not in r[1]], key=str)
