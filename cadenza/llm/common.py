"""What the operators of this subpackage share: scratch tables, words and spans.

Scratch tables cut lineage. They are Parquet below ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor costs no more than a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: ASCII white space, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null identifier inside an operator: below every real one. A real identifier of that value counts as null.
NO_ID = -(2**63)
#: Rows and bytes that a table may have to be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


class Scratch:
    """A folder of this run's intermediate tables in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        self.root = f"{base}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """Writes df once and returns what was written, without its lineage; by names a column that parts the files."""
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path, partitionBy=by)
        schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema])
        return self.spark.read.schema(schema).parquet(path)

    def save_sorted(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """save(), bucketed and sorted by the keys; read back, the table keeps both.

        The catalog entry serves only to make the DataFrame and is removed at once.
        """
        table = f"cadenza_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
        out = self.spark.read.table(table)
        out.schema  # noqa: B018 (resolves the table before its entry goes)
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def drop(self, name: str) -> None:
        """Removes a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Hashes(dict):
    """64-bit hashes of words; starts anew beyond a size."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def short_batches(spark: SparkSession) -> None:
    """Has Python workers read 1,000 rows at a time, unless the session says how many: batches of long texts fill an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":  # Spark's own default
        spark.conf.set(key, "1000")


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """While it is open, Python workers read at most that many rows at a time; for jobs that run inside it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def in_order(spark: SparkSession):
    """While it is open, scans of sorted buckets count as sorted.

    Unions of bucketed tables are told to make no claim of their partitioning: with
    it, Spark 4.1 leaves out a shuffle but may read the tables without their buckets.
    """
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most that many rows, so a worker's lists stay short."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a saved table has at most limit rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count is at most limit, else as it is."""
    return F.broadcast(df) if small(df, limit) else df


def ids(column: str) -> Column:
    """The identifier as long, NO_ID for null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(key, id, text) and whether keys are new: key is a long of each row's own, in the order of the id, nulls first.

    It is the id itself where no row shares one or has none; otherwise the rows are
    sorted by id and hash of the text, numbered and saved.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        return rows.select(F.col("id").alias("key"), "id", "text"), False
    ordered = rows.orderBy(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return scratch.save(ordered.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "numbered"), True


def null_id(column: str) -> Column:
    """Undoes ids()."""
    return F.when(F.col(column) != F.lit(NO_ID), F.col(column))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def words(column: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null: none."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), f"[{SPACE}]+", -1), "")


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, hit>>.

    Positions are code points, end exclusive. The pieces between matches and the
    matches alternate, so running lengths give positions; a text without a match
    costs one pass of the pattern.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        return F.struct(
            end.cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["hit"].alias("hit")))).alias("out"),
        )

    none = F.expr("CAST(array() AS array<struct<start:int,end:int,hit:string>>)")
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    found = F.aggregate(pairs, F.struct(F.lit(0).cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def span_list(spans: Column) -> Column:
    """array<struct<start, rank, kind, end, ...>> in order as `kind:start:end,...`."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
