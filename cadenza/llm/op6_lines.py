"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line digests, bucketed and sorted by digest, with the number of
documents that hold each line and the largest of their ids. A batch's own digests
are aggregated and merge-joined against the runs, which stay where they are: those
that no run holds are new, the others are marked as seen and carry what the batch
adds to their count. Both become a run of level 0. When a level is full its runs are
summed into one of the next level, so a batch meets a number of runs that grows with
the logarithm of the batches, and a row is rewritten once a level.

After the last batch the runs are summed once more and a line's fate is known:
digests held by too few documents are dropped from view, the rest name the document
that keeps the line.

Defined results: a null or empty text is one empty line; a null id counts as one
document below all others; rows that share an id count as one document, and each
row loses its own lines; repeated rows give repeated results; texts are split whole,
however long; extra columns are left out unless they are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import SPACES, Scratch, ids, in_order, maybe_broadcast, null_id, short_batches, slices, small

NAME = "op6_levelled_line_runs"

DIGEST = ["h1", "h2"]
#: Batches of the query: three runs make one of the next level, so nine fill two levels.
BATCHES = 9
_LONG = 1 << 63


def digest(key: bytes) -> tuple[int, int]:
    """128-bit digest as two signed longs."""
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - _LONG, (h & (2 * _LONG - 1)) - _LONG


def line_digests(docs: DataFrame, least: int) -> DataFrame:
    """docs(id, tag, text) to (id, tag, pos, first, h1, h2), one row for each line with a key of least code points.

    first marks a key's first line in its document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, pos, first, h1, h2 = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                seen: set[bytes] = set()
                for k, line in enumerate((text or "").split("\n")):
                    line = line.strip(SPACES)
                    if len(line) >= least:
                        key = line.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
                        a, b = digest(key)
                        at.append(i)
                        pos.append(k)
                        first.append(key not in seen)
                        seen.add(key)
                        h1.append(a)
                        h2.append(b)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("tag").take(rows), pa.array(pos, pa.int32()), pa.array(first, pa.bool_()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["id", "tag", "pos", "first", "h1", "h2"],
            )

    return docs.mapInArrow(run, "id long, tag long, pos int, first boolean, h1 long, h2 long")


class LineRuns:
    """Levelled runs (h1, h2, n, top, seen): digest, its documents of those batches, their largest id.

    seen marks digests that an older run holds already. A run is bucketed and sorted
    by digest, so the joins with it move and sort the new batch alone, however much
    the runs hold.
    """

    def __init__(self, scratch: Scratch, fanout: int = 3):
        self.scratch, self.fanout = scratch, fanout
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self._count = 0

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        self._count += 1
        name = f"run-{self._count}"
        return name, self.scratch.save_sorted(df.select(*DIGEST, "n", "top", "seen"), name, DIGEST, self.buckets)

    def runs(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def marked(self, keys: DataFrame) -> DataFrame:
        """The digests of (h1, h2, id), distinct, by one merge join with each run: n, top and seen."""
        fresh = keys.groupBy(*DIGEST).agg(F.count("*").alias("n"), F.max("id").alias("top"))
        runs = self.runs()
        for k, run in enumerate(runs):
            fresh = fresh.join(run.filter("NOT seen").select(*DIGEST, F.lit(True).alias(f"in{k}")).hint("merge"), DIGEST, "left")
        return fresh.select(*DIGEST, "n", "top", F.coalesce(*[F.col(f"in{k}") for k in range(len(runs))], F.lit(False)).alias("seen"))

    def add(self, keys: DataFrame) -> None:
        """Takes one batch's (h1, h2, id), distinct."""
        with in_order(self.scratch.spark):
            self._place(self._write(self.marked(keys)), 0)

    def _place(self, run: tuple[str, DataFrame], level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._place(self._write(summed([df for _, df in full])), level + 1)
            for name, _ in full:
                self.scratch.drop(name)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines (with h1 and h2) that no run holds."""
        return reduce(lambda df, run: df.join(run.filter("NOT seen").hint("merge"), DIGEST, "left_anti"), self.runs(), lines)

    def held_by(self, least: int) -> DataFrame:
        """(h1, h2, top) of digests in at least that many documents."""
        return summed(self.runs()).filter(F.col("n") >= least).select(*DIGEST, "top")


def summed(runs: list[DataFrame]) -> DataFrame:
    """Several runs as one; a digest that any of them saw first counts as new."""
    rows = reduce(DataFrame.unionByName, runs)
    return rows.groupBy(*DIGEST).agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.bool_and("seen").alias("seen"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES, carry: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """Every row with n_lines, n_dropped and its kept text as ``kept_text``.

    A line with a key of least_chars code points that least_docs documents hold
    stays only in the largest id that holds it. Documents are dealt to batches by
    id; the number of batches changes no result. carry names columns to pass on.
    """
    fixed = {id_col, "n_lines", "n_dropped", "kept_text"}
    if fixed & set(carry):
        raise ValueError(f"carried columns clash with results: {sorted(fixed & set(carry))}")
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    short_batches(docs.sparkSession)
    rows = docs.select(ids(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    dealt = line_digests(rows.select("id", "tag", "text"), least_chars).withColumn("batch", F.pmod(F.hash("id"), F.lit(batches)))
    lines = scratch.save(dealt, "lines", by="batch")  # a batch reads its own files
    repeated = not rows.select("id").groupBy("id").count().filter("count > 1").isEmpty()
    runs = LineRuns(scratch)
    for b in range(batches):
        keys = lines.filter((F.col("batch") == b) & F.col("first")).select(*DIGEST, "id")
        runs.add(keys.distinct() if repeated else keys)
    with in_order(scratch.spark):
        common = scratch.save(runs.held_by(least_docs), "common")
    common = maybe_broadcast(common)
    lost = lines.join(common, DIGEST).filter("id <> top").groupBy("id", "tag").agg(F.collect_set("pos").alias("lost"))
    lost = scratch.save(lost, "lost")
    if small(lost) and (lost.agg(F.sum(F.size("lost"))).first()[0] or 0) <= 2_000_000:  # both bounds: at most some 20 MB
        lost = F.broadcast(lost)
    joined = rows.join(lost, ["id", "tag"], "left")
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    order = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lost")))
    text = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(order, lambda i: F.element_at(parts, i + 1)), "\n"))
    return joined.select(
        null_id("id").alias(id_col), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"),
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.top IS NOT NULL AND c.top <> k.doc_id AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
