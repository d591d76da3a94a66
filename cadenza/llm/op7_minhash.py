"""MinHash near-dedup: universal minima, bands, verification and star components.

1. Every whole text gives its set of 5-word shingles as 64-bit hashes, a digest of
   the set, and a signature of 128 minima of multiply-add hashes.
2. Texts with equal sets are one class; its least id stands for it.
3. Signatures are cut into 32 bands of 4. All classes that share a band are put
   together with the least of them only, their hub - a star, not all pairs.
4. A star's pairs are verified: by signature first, with a margin of over six
   standard deviations, then on the full sets. What holds is joined into components
   by alternating large-star and small-star.
5. A star whose members are still in several components is compared in full, but
   within blocks: members are dealt to cells by set size (sets whose sizes differ by
   more than the threshold cannot link) and by salt, and a cell of bounded size
   counts all intersections at once and returns only links that join
   two components. So no pair that shares a band goes unverified, no group is
   gathered in one task, and pairs are never rows.

Shingles are compared by 64-bit hashes: two different ones of a pair of texts with n
shingles meet with a probability of n^2 / 2^64, which could raise an intersection by one.

A pair at the threshold shares no band with probability (1 - 0.85^4)^32 = 5e-11.

Defined results: a null or wordless text has an empty set and stands alone; one of
fewer than 5 words has its whole sequence as its only shingle; a null id ranks below
all others; rows that share an id and have words are one node,
so they share a component; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Hashes, Scratch, ids, maybe_broadcast, null_id, short_batches
from cadenza.llm.components import connected_components

NAME = "op7_minhash_components"

SHINGLE, HASHES, ROWS = 5, 128, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Words of a chunk whose minima are taken at once.
CHUNK = 1 << 16
#: Members of a block of a star, and shingles of all of them, on average.
BLOCK, BLOCK_SHINGLES = 1024, 400_000


def shingles(text: str | None, hashes: Hashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII space only
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = w[:n].copy()
    for i in range(1, min(k, len(w))):
        h *= _STEP
        h += w[i : i + n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    if len(w) < k:
        h += np.uint64(len(w))
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


@cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20140)
    a = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 minima, one row for each (non-empty) set."""
    a, b = _family()
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= CHUNK):
            size += len(sets[hi])
            hi += 1
        part = [s for s in sets[lo:hi] if len(s)]
        if part:
            flat = np.concatenate(part)
            starts = np.cumsum([0] + [len(s) for s in part[:-1]])
            rows = np.flatnonzero([len(s) > 0 for s in sets[lo:hi]]) + lo
            buffer = np.empty_like(flat)
            for j in range(HASHES):
                np.multiply(flat, a[j], out=buffer)
                buffer += b[j]
                out[rows, j] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
        lo = hi
    return out


def signed(docs: DataFrame) -> DataFrame:
    """docs(id, text) to (id, n, digest, signature); the last two are binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingles(t, hashes) for t in part.column("text").to_pylist()]
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["id", "n", "digest", "signature"],
                )

    return docs.select("id", "text").mapInArrow(run, "id long, n long, digest binary, signature binary")


def shingled(docs: DataFrame) -> DataFrame:
    """docs(id, text) to (id, n, items): items is the sorted set as array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, hashes).view(np.int64) for t in part.column("text").to_pylist()]
                sizes = [len(s) for s in sets]
                flat = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
                items = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), items], names=["id", "n", "items"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, items array<long>")


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of left with right, by products of incidence blocks."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    dense = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])]) if len(column) else column
    for lo in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
        a, b = np.searchsorted(dense, [lo, lo + width])
        block = np.zeros((len(left) + len(right), width), np.float32)
        block[owner[a:b], dense[a:b] - lo] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)


def compare_cell(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one cell that join two components: rows (id, comp, n, items, left, right)."""
    sets = [np.asarray(x).view(np.uint64) for x in cell["items"]]
    left, right = np.flatnonzero(cell["left"].to_numpy()), np.flatnonzero(cell["right"].to_numpy())
    none = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
    if not len(left) or not len(right):
        return none
    node, comp, n = cell["id"].to_numpy(), cell["comp"].to_numpy(), cell["n"].to_numpy()
    both = intersections([sets[i] for i in left], [sets[i] for i in right])
    union = n[left][:, None] + n[right][None, :] - both
    hit = (100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for i, j in zip(*np.nonzero(hit)):
        a, b = root(int(comp[left[i]])), root(int(comp[right[j]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((node[left[i]], node[right[j]]))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64") if out else none


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Every row with n_shingles, component_id and kept (whether it is its component's least id).

    block bounds the members of a star that are compared at once; it changes no result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    short_batches(docs.sparkSession)
    rows = docs.select(ids(id_col).alias("id"), F.col(text_col).alias("text"))
    base = scratch.save(signed(rows), "signed")
    classes = scratch.save(base.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    # the signature of each class, read where its least id is
    shared = base.groupBy("id").count().filter("count > 1").select("id")
    repeated = not shared.isEmpty()
    once = lambda df, *by: df.dropDuplicates(list(by)) if repeated else df
    reps = scratch.save(once(base.filter("n > 0").join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"]), "digest").select("id", "n", "signature"), "reps")

    width = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda j: F.xxhash64(j, F.substring("signature", j * width + 1, F.lit(width))))
    bands = reps.select("id", F.explode(keys).alias("band"))
    hubs = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").select("band", "hub")
    stars = scratch.save(bands.join(hubs, "band").filter("id <> hub").select("hub", "id").distinct(), "stars")

    # sets of the classes in stars alone, made again from their texts
    wanted = maybe_broadcast(scratch.save(stars.select("id").union(stars.select(F.col("hub").alias("id"))).distinct(), "wanted"))
    sets = scratch.save(once(shingled(rows.join(wanted, "id", "left_semi")), "id", "items"), "sets")

    # verification of the stars: signatures, then sets
    one = reps.select("id", F.col("n").alias("n1"), F.col("signature").alias("s1"))
    two = reps.select(F.col("id").alias("hub"), F.col("n").alias("n2"), F.col("signature").alias("s2"))
    piece = lambda s, j: F.substring(s, j * 4 + 1, F.lit(4))
    agree = F.aggregate(F.sequence(F.lit(0), F.lit(HASHES - 1)), F.lit(0), lambda acc, j: acc + F.when(piece("s1", j) == piece("s2", j), 1).otherwise(0))
    margin = max(0, int(HASHES * percent / 100 - 6.2 * (HASHES * percent * (100 - percent)) ** 0.5 / 100))
    likely = stars.join(one, "id").join(two, "hub").filter((100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (agree >= margin)).select("hub", "id")
    mine = sets.select("id", F.col("n").alias("n1"), F.col("items").alias("i1"))
    theirs = sets.select(F.col("id").alias("hub"), F.col("n").alias("n2"), F.col("items").alias("i2"))
    common = F.size(F.array_intersect("i1", "i2"))
    links = likely.join(mine, "id").join(theirs, "hub").filter(100 * common >= percent * (F.col("n1") + F.col("n2") - common)).select(F.col("id").alias("u"), F.col("hub").alias("v"))
    if repeated:
        links = links.unionByName(base.filter("n > 0").join(shared, "id", "left_semi").join(classes, "digest").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    first = scratch.save(connected_components(links, scratch, "first"), "first")

    # stars that are still in several parts
    member = stars.join(first.select(F.col("node").alias("id"), "root"), "id", "left").join(reps.select("id", "n"), "id").select("hub", "id", "n", F.coalesce("root", "id").alias("comp"))
    open_ = member.groupBy("hub").agg(F.count("*").alias("size"), F.sum("n").alias("volume"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("volume") / BLOCK_SHINGLES)).cast("int")
    rest = scratch.save(member.join(open_.select("hub", blocks.alias("blocks")), "hub"), "rest")
    if rest.isEmpty():
        second = first
    else:
        sized = rest.join(sets.select("id", "items"), "id").withColumn("class", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")).withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
        other = F.sequence(F.lit(0), F.col("blocks") - 1)
        cell = lambda c, i, j, lt, rt: F.struct(c.alias("class"), i.alias("i"), j.alias("j"), F.lit(lt).alias("left"), F.lit(rt).alias("right"))
        c, b = F.col("class"), F.col("block")
        same = F.transform(F.filter(other, lambda j: j > b), lambda j: cell(c, b, j, True, False))
        over = F.transform(F.filter(other, lambda i: i < b), lambda i: cell(c, i, b, False, True))
        own = F.array(cell(c, b, b, True, True))
        up = F.transform(other, lambda j: cell(c, b, j + 1_000_000, True, False))  # against the next size class
        down = F.transform(other, lambda i: cell(c - 1, i, b + 1_000_000, False, True))
        dealt = sized.select("hub", "id", "comp", "n", "items", F.explode(F.concat(same, over, own, up, down)).alias("cell")).select("hub", "id", "comp", "n", "items", "cell.*")
        keep = dealt.groupBy("hub", "class", "i", "j").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("left").alias("l"), F.max("right").alias("r")).filter("c0 < c1 AND l AND r").select("hub", "class", "i", "j")
        found = dealt.join(keep, ["hub", "class", "i", "j"]).groupBy("hub", "class", "i", "j").applyInPandas(lambda pdf: compare_cell(pdf, percent), "u long, v long")
        more = scratch.save(found, "more")
        second = first if more.isEmpty() else scratch.save(connected_components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), scratch, "second"), "second")

    named = classes.select("digest", F.col("rep").alias("node"), "copies").join(second, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    out = base.select("id", "n", "digest").join(named, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return out.select(null_id("id").alias(id_col), F.col("n").alias("n_shingles"), null_id("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same components from all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
