"""Hard-negative mining by one-dimensional distance keys.

Vectors become integers, floor(256 x), and get one more coordinate, sqrt(M - |x|^2)
with M the largest squared length, so all of them have length sqrt(M). An anchor's
extra coordinate is 0, hence |q - x|^2 = |q|^2 + M - 2 qx: the largest inner products
are the nearest rows.

1. Index: every row belongs to its nearest pivot; its key is (pivot, distance to it).
   The table is sorted by the key and cut into chunks of rows that follow each other.
   Pivots and the borders of key intervals ("rings") are fitted on SAMPLE rows, which
   changes what is scanned and not what is found; the rows, with the number and the
   least and largest distance of each ring, are of all data.
2. Search: by the triangle inequality a row within r of a query has a distance to its
   pivot p within r of the query's own, d(q, p), and one beyond r' of the query at
   least r' - d(q, p). A round scans the rings that this annulus meets and that no
   earlier round has scanned. The sample gives a first bound, and a round begins with
   a part of it.
3. A query is done when its k-th best row lies within the radius scanned: no other
   ring can hold a better one. Otherwise the radius grows, to the distance of the
   k-th best where k are known, so that the next round certifies them.

Positives are searched among rows of the anchor's label. Each positive's negatives
are searched among rows of other labels with scores from ``share`` percent of the
positive's score up to it, so radii end at the distance of the lower limit. Scores
are exact integers; ties go to smaller ids, and radii are widened by a rounding
margin, so nothing at a border is missed.

Queries are packed and a pack meets a ring's chunks by a join on (pivot, ring, part);
rings with many rows have several parts. Each pair of pack and chunk is one matrix
product, and gives no more than k rows a query.

Defined results: rows with a null id, label or vector, or any null or non-finite
component take no part; of rows that share an id the one with the least label and
vector does; components beyond 2^27 count as that; shorter vectors are filled up with
zeros, an empty one is all zeros; a positive with a negative score has no negatives;
an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, batch_rows

NAME = "op12_hard_negatives"

SCALE = 256
#: Rows that pivots and ring borders are fitted on; pivots; rings of each.
SAMPLE, PIVOTS, RINGS = 2048, 16, 12
#: Rows of a chunk, rows of a ring's part, queries of a pack, and pairs of both that a worker reads at once.
CHUNK, PART, PACK, PAIRS = 2048, 16_384, 256, 64
#: The part of the sample's bound that a first round scans.
FIRST = 0.85
LARGEST = 1 << 27


def integer_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vec, square) of the rows that take part; vec is array<int>."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(F.forall("x", finite))
    whole = F.transform("x", lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return kept.select("id", "label", whole.alias("vec")).withColumn("square", F.aggregate("vec", F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.float64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in doubles where they stay below 2^53, in longs elsewhere."""
    if not left.size or not right.size or np.abs(left).max() * np.abs(right).max() * left.shape[1] < 2.0**53:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


@dataclass
class Space:
    """What tasks need to know: the pivots, the rings, and the sample; its size is fixed by the parameters."""

    dims: int
    most: float  # the largest squared length
    pivots: np.ndarray  # with the extra coordinate
    borders: np.ndarray  # of the rings, one row a pivot
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]  # id, label, vectors
    rings: np.ndarray | None = None  # pivot, ring, parts, least and largest key of those that hold rows

    @property
    def margin(self) -> float:
        return 1e-6 * (1 + self.most**0.5)

    def keys(self, vec: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        square = (vec * vec).sum(1) + extra * extra
        cross = vec @ self.pivots[:, :-1].T + extra[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum(square[:, None] - 2 * cross + (self.pivots**2).sum(1), 0))

    def distance(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of a query of that squared length to a row of that score."""
        return np.sqrt(np.maximum(square + self.most - 2.0 * score, 0))

    def meets(self, near: np.ndarray, inner: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which rings (columns) hold what lies between inner and reach of queries with those pivot distances."""
        at, low, high = near[:, self.rings[:, 0].astype(int)], self.rings[:, 3], self.rings[:, 4]
        return (low <= at + reach[:, None]) & (high >= at - reach[:, None]) & (high >= inner[:, None] - at) & (reach >= 0)[:, None]


def fitted(base: DataFrame, dims: int, most: int) -> Space:
    """Pivots by a few rounds of k-means and ring borders by quantiles, from SAMPLE rows of least hash."""
    rows = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    vec = np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), dims)
    extra = np.sqrt(np.maximum(most - (vec * vec).sum(1), 0))
    full = np.column_stack([vec, extra])
    pivots = full[np.linspace(0, len(full) - 1, min(PIVOTS, len(full))).astype(int)]
    space = Space(dims, float(most), pivots, np.zeros((len(pivots), 0)), (np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), vec))
    for _ in range(8):
        own = space.keys(vec, extra).argmin(1)
        space.pivots = np.array([full[own == p].mean(0) if (own == p).any() else space.pivots[p] for p in range(len(pivots))])
    keys = space.keys(vec, extra)
    own, key = keys.argmin(1), keys.min(1)
    cuts = np.linspace(0, 1, RINGS + 1)[1:-1]
    space.borders = np.array([np.quantile(key[own == p], cuts) if (own == p).any() else np.zeros(len(cuts)) for p in range(len(pivots))])
    return space


def indexed(base: DataFrame, space: Space, scratch: Scratch) -> DataFrame:
    """(pivot, ring, n, low, high, ids, labels, vecs): chunks of rows in the order of (pivot, distance)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = matrix(b.column("vec"), space.dims)
            keys = space.keys(vec, np.sqrt(np.maximum(space.most - (vec * vec).sum(1), 0)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.argmin(1), pa.int32()), pa.array(keys.min(1) if len(vec) else np.zeros(0)), *[b.column(c) for c in ("id", "label", "vec")]], names=["pivot", "key", "id", "label", "vec"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, at = b.column("pivot").to_numpy(), b.column("key").to_numpy()
            ring = np.array([np.searchsorted(space.borders[p], k, side="right") for p, k in zip(pivot, at)], np.int64)
            new = np.append(True, (pivot[1:] != pivot[:-1]) | (ring[1:] != ring[:-1]))
            first = np.flatnonzero(new) if len(pivot) else np.zeros(0, int)
            edges = sorted({x for a, z in zip(first, [*first[1:], len(pivot)]) for x in range(a, z, CHUNK)} | {len(pivot)})
            vec, ids, labels = matrix(b.column("vec"), space.dims).astype(np.int32), b.column("id").to_numpy(), b.column("label").to_numpy().astype(np.int64)
            out = []
            for a, z in zip(edges[:-1], edges[1:]):
                order = a + np.argsort(ids[a:z], kind="stable")  # by id, for ties
                out.append((int(pivot[a]), int(ring[a]), z - a, float(at[a]), float(at[z - 1]), ids[order].tobytes(), labels[order].tobytes(), vec[order].tobytes()))
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["pivot", "ring", "n", "low", "high", "ids", "labels", "vecs"])

    keyed = scratch.save(base.select("id", "label", "vec").mapInArrow(key, "pivot int, key double, id long, label int, vec array<int>"), "keyed")
    ordered = keyed.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
    index = scratch.save(ordered.mapInArrow(chunks, "pivot int, ring int, n long, low double, high double, ids binary, labels binary, vecs binary"), "index")
    # at most PIVOTS x RINGS rows
    rings = index.groupBy("pivot", "ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    space.rings = np.array([(r["pivot"], r["ring"], ceil(r["n"] / PART), r["low"] - space.margin, r["high"] + space.margin) for r in sorted(rings)], np.float64).reshape(len(rings), 5)
    return index


STATE = "anchor long, slot int, label int, same boolean, top long, least long, vec array<int>, cap double, reach double, want double, home int, ids array<long>, scores array<long>"


def advanced(state: DataFrame, space: Space, k: int, opening: bool) -> DataFrame:
    """The state with the radius of its next round as want; want = reach says that a query is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = matrix(b.column("vec"), space.dims)
            square = (vec * vec).sum(1)
            near = space.keys(vec, np.zeros(len(vec)))
            anchor, label, same = (b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "label", "same"))
            top, least = b.column("top").to_numpy(), b.column("least").to_numpy()
            reach, cap = b.column("reach").to_numpy().copy(), b.column("cap").to_numpy().copy()
            far = np.max(near[:, space.rings[:, 0].astype(int)] + space.rings[:, 4], axis=1, initial=0)  # beyond every row
            end = np.minimum(far, np.where(least == MIN, np.inf, space.distance(square, least)) + space.margin)
            if opening:
                ids, labels, known = space.sample
                score = products(vec, known)
                fit = ((labels == label[:, None]) == same[:, None]) & (ids != anchor[:, None]) & (score <= top[:, None]) & (score >= least[:, None])
                best = -np.sort(-np.where(fit, score, MIN), axis=1)[:, k - 1] if len(ids) >= k else np.full(len(vec), MIN)
                cap = np.where(best == MIN, np.inf, space.distance(square, best) + space.margin)
                want = np.where(best == MIN, near.min(1), FIRST * cap)
                want = np.maximum(want, np.where(top == MAX, 0, space.distance(square, top)))
                reach = np.full(len(vec), -1.0)
            else:
                scores = b.column("scores").to_pylist()
                kth = np.array([s[k - 1] if s is not None and len(s) >= k else MIN for s in scores], np.int64)
                known = np.where(kth == MIN, np.inf, space.distance(square, kth) + space.margin)
                want = np.where(np.isfinite(known), known, np.minimum(cap, 2 * reach + space.margin))
                end = np.minimum(end, known)
            want = np.maximum(np.minimum(np.minimum(want, cap), end), reach)
            done = reach >= end
            columns = {f: b.column(f) for f in b.schema.names} | {"cap": pa.array(cap), "reach": pa.array(reach), "want": pa.array(np.where(done, reach, want)), "home": pa.array(near.argmin(1), pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return state.mapInArrow(run, STATE)


MIN, MAX = -(2**63), 2**63 - 1
PACKED = {"anchor": np.int64, "slot": np.int64, "label": np.int64, "same": np.int64, "top": np.int64, "least": np.int64, "floor": np.int64, "reach": np.float64, "want": np.float64}


def requests(state: DataFrame, space: Space, k: int) -> DataFrame:
    """Packs of queries, one row for each part of a ring that any of them has to scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PACK):
                part = b.slice(lo, PACK)
                vec = matrix(part.column("vec"), space.dims)
                near, square = space.keys(vec, np.zeros(len(vec))), (vec * vec).sum(1)
                fields = {f: part.column(f).to_numpy(zero_copy_only=False) for f in PACKED if f != "floor"}
                fields["floor"] = np.array([s[k - 1] if s is not None and len(s) >= k else MIN for s in part.column("scores").to_pylist()])
                new = fresh(space, near, square, fields).any(0)
                at = [(int(p), int(r), j) for p, r, parts, _, _ in space.rings[new] for j in range(int(parts))]
                blob = {f: fields[f].astype(t).tobytes() for f, t in PACKED.items()} | {"vec": vec.astype(np.int32).tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in at], pa.int32()) for i in range(3)] + [pa.array([v] * len(at), pa.binary()) for v in blob.values()], names=["pivot", "ring", "part", *(f"q_{f}" for f in blob)])

    return state.sortWithinPartitions("home", "slot").mapInArrow(run, "pivot int, ring int, part int, " + ", ".join(f"q_{f} binary" for f in [*PACKED, "vec"]))


def fresh(space: Space, near: np.ndarray, square: np.ndarray, q: dict[str, np.ndarray]) -> np.ndarray:
    """Rings that queries scan in this round: those of the new radius without those of the old one."""
    inner = np.where(q["top"] == MAX, 0.0, space.distance(square, q["top"].astype(np.float64)) - space.margin)
    return space.meets(near, inner, np.asarray(q["want"], np.float64)) & ~space.meets(near, inner, np.asarray(q["reach"], np.float64))


def scanned(pairs: DataFrame, space: Space, k: int) -> DataFrame:
    """Pairs of pack and chunk to (anchor, slot, id, score): at most k rows for each query and chunk."""
    columns = {(int(r[0]), int(r[1])): i for i, r in enumerate(space.rings)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q = {f: np.frombuffer(row[f"q_{f}"], t) for f, t in PACKED.items()}
                vec = np.frombuffer(row["q_vec"], np.int32).reshape(-1, space.dims).astype(np.float64)
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                rows = np.frombuffer(row["vecs"], np.int32).reshape(-1, space.dims).astype(np.float64)
                use = np.flatnonzero(fresh(space, space.keys(vec, np.zeros(len(vec))), (vec * vec).sum(1), q)[:, columns[row["pivot"], row["ring"]]])
                q = {f: v[use] for f, v in q.items()}
                score = products(vec[use], rows)
                fit = ((labels == q["label"][:, None]) == (q["same"] == 1)[:, None]) & (ids != q["anchor"][:, None])
                fit &= (score <= q["top"][:, None]) & (score >= np.maximum(q["least"], q["floor"])[:, None])
                score = np.where(fit, score, MIN)
                if len(ids) > k:  # the k best; columns are in order of ids, so the first of equal scores stay
                    bar = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
                    above, tie = score > bar, fit & (score == bar)
                    fit &= above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(1)[:, None]))
                i, j = np.nonzero(fit)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(q["anchor"][i]), pa.array(q["slot"][i], pa.int32()), pa.array(ids[j]), pa.array(score[i, j])], names=["anchor", "slot", "id", "score"])

    return pairs.mapInArrow(run, "anchor long, slot int, id long, score long")


def nearest(queries: DataFrame, index: DataFrame, space: Space, k: int, scratch: Scratch, name: str) -> DataFrame:
    """queries(anchor, slot, label, same, top, least, vec) with ids and scores of their k best rows."""
    spark = queries.sparkSession
    opened = queries.select("anchor", "slot", "label", "same", "top", "least", "vec", F.lit(0.0).alias("cap"), F.lit(0.0).alias("reach"), F.lit(0.0).alias("want"), F.lit(0).alias("home"), F.expr("CAST(NULL AS array<bigint>)").alias("ids"), F.expr("CAST(NULL AS array<bigint>)").alias("scores"))
    state = scratch.save(advanced(opened, space, k, True), f"{name}-0")
    parts = spark.createDataFrame([(int(p), int(r), int(n)) for p, r, n, _, _ in space.rings], "pivot int, ring int, parts int")
    dealt = index.join(F.broadcast(parts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("ids"), "parts").cast("int")).drop("parts", "n", "low", "high")
    # merged: Spark takes the requests for as small as the queries they are made of, and would broadcast them
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    turn = 0
    while not (open_ := state.filter("want > reach")).isEmpty():
        turn += 1
        found = scanned(requests(open_, space, k).join(dealt.hint("merge"), ["pivot", "ring", "part"]), space, k)
        before = open_.select("anchor", "slot", F.explode(F.arrays_zip("ids", "scores")).alias("s")).select("anchor", "slot", F.col("s.ids").alias("id"), F.col("s.scores").alias("score"))
        kept = found.unionByName(before).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        lists = kept.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("s")).select("anchor", "slot", F.col("s.id").alias("new_ids"), F.col("s.score").alias("new_scores"))
        joined = state.join(lists, ["anchor", "slot"], "left").withColumns({"reach": F.col("want"), "ids": F.coalesce("new_ids", "ids"), "scores": F.coalesce("new_scores", "scores")}).drop("new_ids", "new_scores")
        with batch_rows(spark, PAIRS):
            state = scratch.save(advanced(joined, space, k, False), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return state


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, share: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, a predicate over the column ``id``."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    base = scratch.save(integer_vectors(rows, id_col, label_col, vector_col), "vectors")
    if not base.groupBy("id").count().filter("count > 1").isEmpty():
        base = scratch.save(base.groupBy("id").agg(F.min(F.struct("label", "vec", "square")).alias("r")).select("id", "r.*"), "single")
    whole = base.agg(F.max(F.size("vec")).alias("dims"), F.max("square").alias("most")).first()
    dims = max(whole["dims"] or 0, 1)
    if whole["dims"] is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    base = base.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0), F.lit(dims) - F.size("vec"))))
    space = fitted(base, dims, whole["most"])
    index = indexed(base, space, scratch)

    anchors = base.filter(is_anchor).select(F.col("id").alias("anchor"), "label", "vec")
    asked = anchors.select("anchor", F.lit(0).alias("slot"), "label", F.lit(True).alias("same"), F.lit(MAX).alias("top"), F.lit(MIN).alias("least"), "vec")
    near = nearest(asked, index, space, positives, scratch, "positives")
    pairs = near.select("anchor", "label", "vec", F.posexplode(F.arrays_zip("ids", "scores")).alias("slot", "p")).select("anchor", "slot", "label", "vec", F.col("p.ids").alias("positive"), F.col("p.scores").alias("score"))
    pairs = scratch.save(pairs.filter("score >= 0"), "pairs")
    lower = F.expr(f"({share} * score + 99) div 100")
    asked = pairs.select("anchor", "slot", "label", F.lit(False).alias("same"), F.col("score").alias("top"), lower.alias("least"), "vec")
    far = nearest(asked, index, space, negatives, scratch, "negatives")
    hits = far.select("anchor", "slot", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "n"))
    named = hits.join(pairs.select("anchor", "slot", "positive", "score"), ["anchor", "slot"])
    return named.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("n.ids").alias("negative_id"), F.col("score").alias("positive_score"), F.col("n.scores").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh row's label is moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 100 == 0)


#: The same from all products of anchors and rows.
ORACLE = r"""
WITH b AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM b a JOIN b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY rank <= 5
"""
