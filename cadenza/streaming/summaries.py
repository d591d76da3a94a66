"""Tables that a stream keeps up to date: summaries made when rows arrive, and an ingest that can stop anywhere.

Both write with ``foreachBatch`` into folders named by the batch, so a batch that
Spark runs again after a failure writes the same folders again and changes nothing.
Tables and checkpoints lie in storage that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Parts of a summary; a batch rewrites only those that its keys fall into.
BUCKETS = 64


class Folder:
    """A folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self._fs.exists(self._at(name)) else []

    def complete(self, name: str) -> bool:
        return "_SUCCESS" in self.names(name)

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Summary:
    """Sums by key, kept as Parquet: ``version=N/bucket=B`` holds bucket B as of batch N.

    A batch adds up its own rows, joins the buckets they fall into as they were before
    it, and writes those buckets under its number. The version before is kept for a
    batch that runs again; older ones go.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.keys, self.sums, self.buckets = spark, list(keys), list(sums), buckets
        self.folder = Folder(spark, path)

    def _versions(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names() if n.startswith("version=") and self.folder.complete(n))

    def _held(self, before: int) -> dict[int, list[int]]:
        """Versions of each bucket below a batch, ascending."""
        out: dict[int, list[int]] = {}
        for v in self._versions():
            if v < before:
                for n in self.folder.names(f"version={v}"):
                    if n.startswith("bucket="):
                        out.setdefault(int(n.split("=")[1]), []).append(v)
        return out

    def _read(self, parts: Mapping[int, int]) -> DataFrame | None:
        paths = [f"{self.folder.path}/version={v}/bucket={b}" for b, v in sorted(parts.items())]
        return self.spark.read.parquet(*paths).select(*self.keys, *self.sums) if paths else None

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes one batch; running it again with its number leaves the table as it is."""
        fresh = batch.groupBy(*self.keys).agg(*[F.sum(s).alias(s) for s in self.sums]).withColumn("bucket", F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int"))
        fresh.persist()
        try:
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` rows
            held = self._held(number)
            old = self._read({b: held[b][-1] for b in touched if b in held})
            rows = fresh if old is None else fresh.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")))
            merged = rows.groupBy("bucket", *self.keys).agg(*[F.sum(s).alias(s) for s in self.sums])
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/version={number}")
        finally:
            fresh.unpersist()
        for b, versions in held.items():
            for v in versions[:-1] if b in touched else versions[:-2]:
                self.folder.drop(f"version={v}/bucket={b}")

    def table(self) -> DataFrame | None:
        """The summary now; None before the first batch with rows."""
        return self._read({b: vs[-1] for b, vs in self._held(2**62).items()})

    def keep(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts to take what the stream has now, and stops after it."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, path: str, key: str, checkpoint: str, order: Column | None = None) -> StreamingQuery:
    """Appends each key of a file stream once to a table of ``batch=N`` folders, and stops when no file is left.

    A key that any other batch has brought is skipped; of rows of one key in a batch
    the first by ``order`` is taken. Run again with the same checkpoint it goes on
    where it stopped. For newest files first, make the stream with ``latestFirst``.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        folder = Folder(spark, path)
        others = [f"{path}/{n}" for n in folder.names() if n.startswith("batch=") and n != f"batch={number}" and folder.complete(n)]
        new = batch.filter(F.col(key).isNotNull())
        if others:
            new = new.join(spark.read.parquet(*others).select(key), key, "left_anti")
        first = new.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.lit(0) if order is None else order).alias("r")).select("r.*")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The table that ingest has written."""
    folder = Folder(spark, path)
    return spark.read.parquet(*[f"{path}/{n}" for n in folder.names() if n.startswith("batch=") and folder.complete(n)])


def current_generation(results: DataFrame, key: str, generation: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """Results that no newer request of their key had overtaken when they came: (key, generation, at).

    In a batch, and against what came before, only rows of a key's greatest generation
    pass. The generation is kept as state until the watermark has passed the key's
    last row; what comes later than that is too late to be kept at all.
    """
    kinds = {f.name: f.dataType.simpleString() for f in results.schema.fields}

    def keep(name: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        newest = max(int(rows[generation].max()), state.get[0] if state.exists else -(2**63))
        state.update((newest,))
        state.setTimeoutTimestamp(max(int(rows[at].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows.loc[rows[generation] == newest, [key, generation, at]]

    shape = ", ".join(f"{c} {kinds[c]}" for c in (key, generation, at))
    return results.withWatermark(at, delay).groupBy(key).applyInPandasWithState(keep, shape, "newest long", "append", GroupStateTimeout.EventTimeTimeout)


