"""Frequency index of works: counts, spans, positions and rarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import saved


def work_index(occ: DataFrame, work: str, concert: str, date: str) -> DataFrame:
    """Per work: occurrences, distinct concerts, first and last date.

    The distinct count is made of two plain aggregates (per concert, then per
    work), so that no row is expanded and both steps combine on the map side.
    """
    per_night = occ.groupBy(work, concert).agg(F.count("*").alias("k"), F.min(date).alias("d0"), F.max(date).alias("d1"))
    return per_night.groupBy(work).agg(
        F.sum("k").alias("n"), F.count("*").alias("concerts"), F.min("d0").alias("first_date"), F.max("d1").alias("last_date")
    )


def count_histogram(index: DataFrame, n: str = "n") -> DataFrame:
    """Distinct counts v with multiplicity m, with c works above and the total.

    Its size is the number of distinct counts, so the windows over it are small
    whatever the number of works is.
    """
    h = index.groupBy(F.col(n).alias("v")).agg(F.count("*").alias("m"))
    down = Window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.select("v", "m", (F.sum("m").over(down) - F.col("m")).alias("above"), F.sum("m").over(Window.partitionBy()).alias("total"))


def with_rarity(index: DataFrame, n: str = "n") -> DataFrame:
    """Adds above (works with a greater count) and rarity, the percent rank, from the histogram of counts.

    The histogram is broadcast: m distinct counts need m (m + 1) / 2 occurrences, so a
    trillion of them make at most 1.4 million rows.
    """
    h = F.broadcast(count_histogram(index, n))
    share = F.when(F.col("total") > 1, F.col("above") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return index.join(h, F.col(n) == F.col("v")).select(*index.columns, "above", share.cast("double").alias("rarity"))


def rank_and_rarity(index: DataFrame, work: str, n: str = "n") -> DataFrame:
    """Adds position (row number by count descending, then key) and rarity (percent rank).

    The index is sorted by ranges of (count, key), whatever number of works has the
    same count, and saved once; a row's position is its place in its range and the
    rows of the ranges before, one count a range.
    """
    order = [F.col(n).desc(), F.col(work)]
    ordered = saved(index.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before")))  # a row for each range
    ranked = with_rarity(ordered, n).join(before, part == F.col("_part"))
    return ranked.select(*index.columns, (F.col("_before") + place + 1).cast("long").alias("position"), "rarity")


def work_records(occ: DataFrame, work: str, concert: str, date: str, raw: str, encore: str, at: str, first: Sequence[str] = (), labels: int = 3) -> DataFrame:
    """Per work: n, concerts, encores, first_date, last_date, label, alt_labels, months, and the first known value of each column of ``first``.

    Labels are the most frequent spellings, the earlier seen (by ``at``) among equals;
    months are array<struct<month, n>> in order. Every part is a grouped count that
    combines on the map side, and what is gathered is three labels and twelve months.
    """
    per_night = occ.groupBy(work, concert).agg(F.count("*").alias("k"), F.count_if(encore).alias("e"), F.min(date).alias("d0"), F.max(date).alias("d1"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in first], *[F.min(F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_at_{c}") for c in first])
    index = per_night.groupBy(work).agg(
        F.sum("k").alias("n"), F.count("*").alias("concerts"), F.sum("e").alias("encores"), F.min("d0").alias("first_date"), F.max("d1").alias("last_date"), *[F.min_by(c, F.col(f"_at_{c}")).alias(c) for c in first]
    )
    spelt = occ.groupBy(work, raw).agg(F.count("*").alias("k"), F.min(at).alias("seen"))
    best = Window.partitionBy(work).orderBy(F.desc("k"), "seen")
    named = spelt.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= labels)
    named = named.groupBy(work).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(raw).alias("l")))), lambda s: s["l"]).alias("all"))
    months = occ.groupBy(work, F.month(date).alias("month")).agg(F.count("*").alias("n")).groupBy(work).agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("months"))
    told = index.join(named, work, "left").join(months, work, "left")
    return told.select(work, "n", "concerts", "encores", "first_date", "last_date", F.get("all", F.lit(0)).alias("label"), F.slice("all", 2, labels).alias("alt_labels"), "months", *first)
