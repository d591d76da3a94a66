"""N-gram Jaccard join by T-occurrence search.

Two texts link at a Jaccard similarity of ``percent``, so a set of n shingles shares at
least T = ceil(percent n / 100) with every partner.

1. Candidates by prefixes that are exact for every pair. Shingles are ordered by hash;
   the first n - T + l(n) of each set, with l(n) = 1 + n // 20, hold at least
   l(least partner size) shingles in common with any partner's. A grouped minimum over
   all of them gives each shingle's documents and the least of their ids; shingles of
   one set alone are of no use. Of what a set shares with others it may then drop its
   most frequent l(...) - 1 shingles: by the pigeonhole principle the rarest common
   one stays on both sides. So a passage that very many documents hold makes no
   candidates of documents that are otherwise different.
2. A kept shingle puts its documents with the least of them, their hub. Every linking
   pair has a hub in common, and pairs are never rows.
3. Hubs are dealt to cells by size class (sets that differ by more than the threshold
   in size cannot link) and by blocks of bounded size, each block against itself and
   against the others. In a cell the right side is an inverted index, and each set of
   the left side searches it: DivideSkip sets aside the longest lists of the query,
   the others are merged - as sorted runs of one array, which is what a heap of list
   heads does a posting at a time - and kept where they reach T less the number of long
   lists; these candidates are looked up in the long lists by binary search. What
   reaches the overlap for both sizes links. A pair that meets in several hubs counts
   in the least.
4. A cell returns for each member how many documents it links to and the edges of a
   spanning forest of its links. Components follow by large-star and small-star.

Equal sets are one class; its least document stands for it and its copies are counted.
Shingles are compared by 64-bit hashes: two different ones of a pair of texts with n
shingles meet with a probability of n^2 / 2^64.

Defined results: a null or wordless text has an empty set and stands alone; one of
fewer than 5 words has its whole sequence as its only shingle; a null id ranks below
all others; rows that share an id are documents of their own, and a component's id is
the least id of its rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Hashes, Scratch, batch_rows, maybe_broadcast, numbered
from cadenza.llm.components import connected_components
from cadenza.llm.op7_minhash import shingled, shingles

NAME = "op11_jaccard_join"

#: One more shingle of the prefix must be shared for each so many of the set.
EXTRA = 20
#: Members of a block, and shingles of all of them, on average.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Weight of the logarithm that decides how many lists are long (mu of DivideSkip, for array operations).
LONG_LISTS = 0.5


def required(n, percent: int):
    """Shingles that a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - required(n, percent) + 1 + n // EXTRA)


def to_drop(n: Column, percent: int) -> Column:
    """How many of its shared prefix shingles a set of n may drop: one less than any pair is sure to share."""
    return F.floor(F.floor((n * percent + 99) / 100) / EXTRA).cast("int")


def prefixed(rows: DataFrame, percent: int) -> DataFrame:
    """rows(key, text) to (key, n, digest, tokens): tokens is the prefix of the sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, hashes) for t in part.column("text").to_pylist()]
                heads = [s[: prefix_length(len(s), percent)].view(np.int64) for s in sets]
                tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads)))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), tokens], names=["key", "n", "digest", "tokens"])

    return rows.select("key", "text").mapInArrow(run, "key long, n long, digest binary, tokens array<long>")


def candidates(base: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, id, n, copies, lower, size, volume), saved: every linking pair of classes has a hub in common."""
    tokens = base.select("key", F.xxhash64("digest").alias("set"), F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("df"), F.min("set").alias("s0"), F.max("set").alias("s1"))
    shared = scratch.save(held.filter("s0 <> s1").select("token", "hub", "df"), "shared")
    mine = tokens.select("key", "token").join(shared.hint("merge"), "token")
    listed = mine.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token", "hub"))).alias("held"))  # a part of one document
    listed = listed.join(classes.select(F.col("rep").alias("key"), "n", "copies").hint("merge"), "key")  # copies go
    left = F.slice("held", F.lit(1), F.greatest(F.size("held") - to_drop(F.col("n"), percent), F.lit(0)))
    hubs = scratch.save(listed.select(F.col("key").alias("id"), "n", "copies", F.array_distinct(F.transform(left, lambda x: x["hub"])).alias("hubs")).filter(F.size("hubs") > 0), "hubs")
    member = hubs.select("id", "n", "copies", F.explode("hubs").alias("hub"), "hubs")
    # a hub that one class alone has kept joins nothing; saved, so that a hot hub's members can be split
    some = member.groupBy("hub").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("size"), F.sum("n").alias("volume")).filter("a < z")
    some = scratch.save(some.select("hub", "size", "volume"), "some")
    return scratch.save(member.join(some.hint("merge"), "hub").select("hub", "id", "n", "copies", F.filter("hubs", lambda h: h < F.col("hub")).alias("lower"), "size", "volume"), "members")


class Inverted:
    """Inverted lists of sets, each in order of the set's number."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = len(sets)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        self.tokens, self.start = flat[first], np.append(first, len(flat))
        # postings as one ascending array, for binary search in any list
        self.postings = np.repeat(np.arange(len(first)), np.diff(self.start)) * self.sets + self.owner

    def search(self, query: np.ndarray, least: int, mu: float = LONG_LISTS) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the sets that share at least ``least`` items with the query, and how many."""
        none = np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < least:
            return none, none
        size = self.start[at + 1] - self.start[at]
        at, size = (x[np.argsort(size, kind="stable")] for x in (at, size))
        long = min(least - 1, int(least / (mu * log2(size[-1] + 1) + 1)))
        short = at[: len(at) - long]
        # the short lists, merged: sorted runs of one array, then lengths of equal ones
        count = size[: len(short)]
        place = np.repeat(self.start[short] - np.cumsum(count) + count, count) + np.arange(count.sum())
        seen = np.bincount(self.owner[place], minlength=self.sets)
        found = np.flatnonzero(seen >= least - long)
        overlap = seen[found]
        for lo in range(0, len(found), 256):  # probes of the long lists, a few candidates at a time
            probe = at[len(short) :, None] * self.sets + found[None, lo : lo + 256]
            hit = np.searchsorted(self.postings, probe)
            overlap[lo : lo + 256] += (self.postings[np.minimum(hit, len(self.postings) - 1)] == probe).sum(0)
        enough = overlap >= least
        return found[enough], overlap[enough]


def compare_cell(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one cell: rows (u, v, links); v is null where a row only counts the documents that u links to."""
    sets = [np.asarray(x).view(np.uint64) for x in cell["items"]]
    node, copies, n = (cell[c].to_numpy() for c in ("id", "copies", "n"))
    left, right = np.flatnonzero(cell["left"].to_numpy()), np.flatnonzero(cell["right"].to_numpy())
    none = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="Int64"), "links": pd.Series(dtype="int64")})
    if not len(left) or not len(right):
        return none
    index = Inverted([sets[i] for i in right])
    lower = [frozenset(x) for x in cell["lower"]]
    size, links = n[right], np.zeros(len(cell), np.int64)
    parent = np.arange(len(cell)).tolist()
    edges: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in left:
        found, both = index.search(sets[i], int(required(int(n[i]), percent)))
        found = found[100 * both >= percent * (n[i] + size[found] - both)]
        other = right[found]
        other = other[other != i]
        if lower[i] and len(other):  # a pair with a lower hub in common counts there
            other = other[[lower[i].isdisjoint(lower[j]) for j in other]]
        if not len(other):
            continue
        links[i] += copies[other].sum()
        if not cell["right"].iat[i]:  # the other block never asks for this one
            links[other] += copies[i]
        for j in other.tolist():
            a, b = root(int(i)), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(node[i]), int(node[j])))
    some = np.flatnonzero(links)
    u = [a for a, _ in edges] + node[some].tolist()
    v = [b for _, b in edges] + [None] * len(some)
    return pd.DataFrame({"u": pd.Series(u, dtype="int64"), "v": pd.Series(v, dtype="Int64"), "links": pd.Series([0] * len(edges) + links[some].tolist(), dtype="int64")})


def cells(member: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Members of hubs dealt to (hub, class, i, j), with left and right, the sides they are on there."""
    step = 100.0 / percent
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("volume") / BLOCK_SHINGLES)).cast("int")
    sized = member.withColumns({"class": F.floor(F.log("n") / F.log(F.lit(step)) + 1e-9).cast("int"), "blocks": blocks}).withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda c, i, j, lt, rt: F.struct(c.alias("class"), i.alias("i"), j.alias("j"), F.lit(lt).alias("left"), F.lit(rt).alias("right"))
    c, b = F.col("class"), F.col("block")
    same = F.transform(F.filter(other, lambda j: j > b), lambda j: cell(c, b, j, True, False))
    over = F.transform(F.filter(other, lambda i: i < b), lambda i: cell(c, i, b, False, True))
    own = F.array(cell(c, b, b, True, True))
    up = F.transform(other, lambda j: cell(c, b, j + 1_000_000, True, False))  # against the next size class
    down = F.transform(other, lambda i: cell(c - 1, i, b + 1_000_000, False, True))
    dealt = sized.select("hub", "id", "n", "copies", "lower", F.explode(F.concat(same, over, own, up, down)).alias("cell")).select("hub", "id", "n", "copies", "lower", "cell.*")
    keep = dealt.groupBy("hub", "class", "i", "j").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.max("left").alias("l"), F.max("right").alias("r")).filter("a < z AND l AND r").select("hub", "class", "i", "j")
    return dealt.join(keep, ["hub", "class", "i", "j"]).join(sets.hint("merge"), "id")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Every row with n_shingles, component_id and n_links (documents that it links to, copies included).

    block bounds the members of a hub that are searched at once; it changes no result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    rows, new = numbered(docs, id_col, text_col, scratch)
    with batch_rows(spark, 1000):
        base = scratch.save(prefixed(rows, percent), "prefixes", codec="lz4")
    classes = scratch.save(base.filter("n > 0").groupBy("digest").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    member = candidates(base.filter("n > 0"), classes, percent, scratch)
    wanted = maybe_broadcast(scratch.save(member.select(F.col("id").alias("key")).distinct(), "wanted"))
    texts = rows.select("key", "text").join(wanted, "key", "left_semi").select(F.col("key").alias("id"), "text")
    with batch_rows(spark, 1000):
        sets = scratch.save(shingled(texts).select("id", "items"), "sets", codec="lz4")
    found = cells(member, sets, percent, block).groupBy("hub", "class", "i", "j").applyInPandas(lambda pdf: compare_cell(pdf, percent), "u long, v long, links long")
    found = scratch.save(found, "found")
    roots = connected_components(found.filter("v IS NOT NULL").select("u", "v"), scratch, "parts")
    linked = found.filter("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    told = classes.join(linked, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    told = told.select("digest", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.select("key", "n", "digest").join(told, "digest", "left").select("key", "n", F.coalesce("component", "key").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if new:
        ids = rows.select("key", "id")
        out = out.join(ids, "key").join(ids.select(F.col("key").alias("component"), F.col("id").alias("least")), "component")
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "n_links")
    return out.select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at 0.8."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same from all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n_links FROM u GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, coalesce(k.n_links, 0) AS n_links FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
