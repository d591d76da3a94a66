"""Hybrid retrieval: hard filter, BM25, cosine, reciprocal rank fusion, taste blend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import dealt, saved, shares, small_side


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def hard_filter(events: DataFrame, today, region: Column, travel_ok: Column, budget: Column) -> DataFrame:
    """Not before today, in the region unless travel is fine, and within the budget if there is one."""
    return events.filter((F.col("date") >= today) & (travel_ok | (F.col("region") == region)) & (budget.isNull() | (F.col("price_min") <= budget)))


#: Counted terms of documents in a share; each meets all queries that hold it.
TERM_ROWS = 100_000


def bm25(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, words: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score): terms that some query holds are counted once and saved; lengths over all documents.

    What is saved is dealt by document and meets the queries' terms with their weights
    where it lies, so that a document's scores are made in one task and only they move.
    """
    q = queries.select(query, F.explode(F.array_distinct(tokens(F.col(words)))).alias("term"))
    asked = q.select("term").distinct()
    sized = docs.select(doc, tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = saved(sized.select(doc, "dl", F.explode("ts").alias("term")).join(asked, "term", "left_semi").groupBy(doc, "dl", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    told = saved(q.join(df, "term").join(F.broadcast(stats)).select(query, "term", "avgdl", idf.alias("idf")))  # stats are one row
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    met = dealt(tf, shares(tf, TERM_ROWS), doc).join(small_side(told), "term")
    return met.select(query, doc, weight.alias("w")).groupBy(query, doc).agg(F.sum("w").alias("score"))


#: Query vectors of one broadcast.
QUERY_BLOCK = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Vectors of one pack, which is one row, and queries that are scored with a pack at a time.
PACK, SLICE = 2048, 128


def packs(rows: DataFrame, key: str, vector: str, tag: str | None) -> DataFrame:
    """(tag, n, dims, keys, vectors): up to PACK vectors of one tag and length as one row of unit vectors, by key; null vectors are left out."""
    flat = rows.select((F.lit("") if tag is None else F.col(tag).cast("string")).alias("tag"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("vector IS NOT NULL AND tag IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            tags, keys, vectors = (b.column(c) for c in ("tag", "key", "vector"))
            dims, tags = pc.list_value_length(vectors).to_numpy(), tags.to_pylist()
            edges = [i for i in range(b.num_rows) if i == 0 or tags[i] != tags[i - 1] or dims[i] != dims[i - 1]]
            for lo, hi in zip(edges, [*edges[1:], b.num_rows]):
                for a in range(lo, hi, PACK):
                    z = min(a + PACK, hi)
                    ids = keys.slice(a, z - a).to_numpy()
                    m = vectors.slice(a, z - a).flatten().to_numpy(zero_copy_only=False).reshape(z - a, dims[a])
                    order = np.argsort(ids, kind="stable")
                    with np.errstate(invalid="ignore", divide="ignore"):
                        unit = m[order] / np.sqrt((m[order] ** 2).sum(1))[:, None]
                    out.append((tags[a], z - a, int(dims[a]), ids[order].tobytes(), unit.tobytes()))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["tag", "n", "dims", "keys", "vectors"])

    return flat.sortWithinPartitions("tag", F.size("vector")).mapInArrow(run, "tag string, n long, dims int, keys binary, vectors binary")


def best_of_pack(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of packs to (query, key, similarity): the k best keys of each query in the pack, ties to smaller keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):  # what a row holds is read where it lies, and a slice of its queries is scored at a time
                part = {c: np.frombuffer(b.column(c)[r].as_buffer(), kind) for c, kind in (("keys", np.int64), ("q_keys", np.int64), ("vectors", np.float64), ("q_vectors", np.float64))}
                keys, dims = part["keys"], b.column("dims")[r].as_py()
                unit, every = (part[c].reshape(len(x), dims) for c, x in (("vectors", keys), ("q_vectors", part["q_keys"])))
                for lo in range(0, len(every), SLICE):
                    asked = part["q_keys"][lo : lo + SLICE]
                    score = every[lo : lo + SLICE] @ unit.T
                    known = ~np.isnan(score)
                    rank = np.where(known, score, -np.inf)
                    fit = np.ones(score.shape, bool)
                    if len(keys) > k:  # columns are in order of keys, so the first of equal ones stay
                        bar = np.partition(rank, len(keys) - k, axis=1)[:, len(keys) - k][:, None]
                        above, tie = rank > bar, rank == bar
                        fit = above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(1)[:, None]))
                    i, j = np.nonzero(fit)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(keys[j]), pa.array(score[i, j], mask=~known[i, j])], names=["query", "key", "similarity"])

    return pairs.mapInArrow(run, "query long, key long, similarity double")


def cosine_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int = 20, tag: str | None = None) -> DataFrame:
    """(query, key, similarity, place) of the k most similar vectors of each query, in exact search.

    The queries are a stated set, and each is compared with every vector, or with
    those of its own ``tag`` if a column of both is named. Queries are packed, saved and
    broadcast in blocks of about QUERY_BLOCK; vectors never move: each pair of packs
    is one matrix product and gives k rows a query, which meet in a window. Ties go to
    the smaller key; vectors of other lengths are not compared; a zero vector is like
    nothing and comes last with a null similarity.
    """
    asked = saved(packs(queries, query, query_vector, tag).select("tag", "dims", F.col("n").alias("q_n"), F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors")))
    blocks = -(-(asked.agg(F.sum("q_n")).first()[0] or 0) // QUERY_BLOCK) or 1
    held = packs(vectors, key, vector, tag)
    found = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q_keys"), F.lit(blocks)) == i)
        one = best_of_pack(held.join(F.broadcast(block.drop("q_n")), ["tag", "dims"]), k)
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), "key")
    placed = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return placed.select(F.col("query").alias(query), F.col("key").alias(key), "similarity", "place")


def fuse(lists: list[DataFrame], query: str, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists(query, key, place)."""
    rows = None
    for one in lists:
        part = one.select(query, key, (1.0 / (k + F.col("place"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(query, key).agg(F.sum("s").alias("score"))


def blend_weight(events: Column) -> Column:
    """Weight of the query against the taste vector, by the number of events seen."""
    return F.when(events < 3, 1.0).when(events < 10, 0.7).otherwise(0.55)


def blend(query_vector: Column, taste: Column, events: Column) -> Column:
    a = blend_weight(events)
    return F.zip_with(query_vector, taste, lambda q, u: a * q.cast("double") + (1 - a) * u.cast("double"))
