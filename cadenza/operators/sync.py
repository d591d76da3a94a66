"""Replay of an offline-first log: order, idempotency, revisions, fields, tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import saved, small_side


def idempotent(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first entry of each idempotency key."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def above_watermark(log: DataFrame, marks: DataFrame, device: str = "device", seq: str = "seq", mark: str = "last_mutation_id") -> DataFrame:
    """Entries of a device beyond what it has already sent; an unknown device has sent nothing."""
    return log.join(marks.select(device, mark), device, "left").filter(F.col(mark).isNull() | (F.col(seq) > F.col(mark))).drop(mark)


#: Entries of an entity that are folded in one row; longer logs are followed by pointers.
SHORT_LOG = 2_000


def _folded(log: DataFrame, entity: str, base_rev: str, order: Sequence[str]) -> DataFrame:
    """replay() for short logs: one grouped pass, the fold runs inside an entity's row."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(base_rev).cast("long").alias("_base"), F.struct(*log.columns).alias("_row"))))
    each = log.groupBy(entity).agg(items.alias("_items"))

    def step(acc, x):
        ok = F.coalesce(x["_base"] == acc["rev"], F.lit(False))
        rev = F.when(ok, acc["rev"] + 1).otherwise(acc["rev"])
        return F.struct(rev.alias("rev"), F.concat(acc["out"], F.array(F.struct(ok.alias("applied"), rev.alias("rev")))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("rev"), F.expr("CAST(array() AS array<struct<applied:boolean,rev:bigint>>)").alias("out"))
    folded = each.select("_items", F.aggregate("_items", start, step, lambda acc: acc["out"]).alias("_out"))
    return folded.select(F.explode(F.zip_with("_items", "_out", lambda i, o: F.struct(i["_row"].alias("row"), o["applied"].alias("applied"), o["rev"].alias("rev")))).alias("x")).select("x.row.*", "x.applied", "x.rev")


def _followed(log: DataFrame, entity: str, base_rev: str, order: Sequence[str]) -> DataFrame:
    """replay() for logs of any length: each entry points to its successor, the applied ones are the path from the first entry with base 0.

    The path is found by pointer doubling, so a log of n entries takes log2 n rounds.
    """
    e = F.struct(F.col(entity).alias("e")).alias("_e")  # in a struct a null entity equals itself
    rows = saved(log.withColumn("_base", F.col(base_rev).cast("long")).withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(*order)).cast("long")).select("*", e))
    entries = rows.filter("_base IS NOT NULL").select("_e", F.col("_base").alias("_at"), "_n", F.lit(True).alias("_entry"))
    asking = entries.select("_e", (F.col("_at") + 1).alias("_at"), "_n", F.lit(False).alias("_entry"))
    later = Window.partitionBy("_e", "_at").orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    jumps = entries.unionByName(asking).withColumn("_to", F.min(F.when(F.col("_entry"), F.col("_n"))).over(later))
    jumps = saved(jumps.filter("NOT _entry AND _to IS NOT NULL").select("_e", "_n", "_to"))
    path = saved(entries.filter("_at = 0").groupBy("_e").agg(F.min("_n").alias("_n")))
    before, size = -1, path.count()
    while size > before:
        path = saved(path.unionByName(path.join(jumps, ["_e", "_n"]).select("_e", F.col("_to").alias("_n"))).distinct())
        ahead = jumps.select("_e", F.col("_n").alias("_to"), F.col("_to").alias("_far"))
        jumps = saved(jumps.join(ahead, ["_e", "_to"]).select("_e", "_n", F.col("_far").alias("_to")))
        before, size = size, path.count()
    marked = rows.join(path.withColumn("applied", F.lit(True)), ["_e", "_n"], "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    rev = F.max(F.when(F.col("applied"), F.col("_base") + 1)).over(Window.partitionBy("_e").orderBy("_n"))
    return marked.select(*log.columns, "applied", F.coalesce(rev, F.lit(0)).cast("long").alias("rev"))


def replay(log: DataFrame, entity: str, base_rev: str, order: Sequence[str], short: int = SHORT_LOG) -> DataFrame:
    """Optimistic concurrency: in order, an entry is applied if its base revision is the entity's, which then rises by one.

    Adds applied and rev. Revisions rise by one and never fall, so the entry that is
    applied on base r is the first one with base r after the entry applied on r - 1.
    Entities of up to ``short`` entries are folded, the others followed by pointers,
    so no long log is ever gathered.
    """
    long = log.groupBy(entity).agg(F.count("*").alias("_k")).filter(F.col("_k") > short).select(F.col(entity).alias("_long"))
    if long.isEmpty():
        return _folded(log, entity, base_rev, order)
    long, is_long = small_side(saved(long)), F.col(entity).eqNullSafe(F.col("_long"))
    return _folded(log.join(long, is_long, "left_anti"), entity, base_rev, order).unionByName(_followed(log.join(long, is_long, "left_semi"), entity, base_rev, order))


def latest(log: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The winning entry of each entity by revision, then device: never by clock."""
    best = F.max_by(F.struct(*log.columns), F.struct(*order))
    return log.groupBy(entity).agg(best.alias("x")).select("x.*")


def merge_fields(log: DataFrame, entity: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per field the last value that was sent (null: not sent)."""
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields]
    return log.groupBy(entity).agg(*last)


def live(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return rows.filter(F.col(deleted).isNull())


def stale_devices(seen: DataFrame, device: str, at: str, now: Column | DataFrame, days: int = 90) -> DataFrame:
    """Devices idle for longer than tombstones live: they need a full copy. now is a value, or a table of one row with it."""
    last = seen.groupBy(device).agg(F.max(at).alias("last"))
    if isinstance(now, DataFrame):
        last, now = last.join(F.broadcast(now.toDF("_now"))), F.col("_now")
    return last.filter(F.col("last") < now - F.expr(f"INTERVAL {int(days)} DAYS")).select(device, "last")
