"""SparkSession factory with the settings that every query of the engine assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def get_session(app: str = "cadenza", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with AQE on; conf entries override, with `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns are pruned by the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a side of a join may have to be broadcast.
SMALL_ROWS = 200_000


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A saved table with a broadcast hint if it has at most limit rows, else as it is.

    Only for tables that lie in files: the count of a plan would run it once more.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows of one share of a large table.
SHARE_ROWS = 500_000


def shares(df: DataFrame, rows: int | None = None) -> int:
    """Into how many partitions a table that lies in files is to be dealt: 1 up to ``rows`` (SHARE_ROWS), then as many as keep a task's rows bounded at every size."""
    n = -(-df.count() // (rows or SHARE_ROWS))
    return max(n, df.sparkSession.sparkContext.defaultParallelism) if n > 1 else 1


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by keys to n shares, whatever the session's number of shuffle partitions; left as it is for one share."""
    return df.repartition(n, *keys) if n > 1 else df


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only a local session without that setting uses a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written once and read again, without its lineage."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return spark.read.schema(StructType([StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
