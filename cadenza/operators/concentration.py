"""Coverage and concentration of a count table: all windows are over the histogram of counts.

A count table has one row per key. Its distinct counts are few, so the cumulative
forms are computed over (count, multiplicity) and no task orders the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import ratio, rounded


def histogram(counts: DataFrame, n: str = "n") -> DataFrame:
    """(v, m): distinct counts and their multiplicity."""
    return counts.groupBy(F.col(n).cast("long").alias("v")).agg(F.count("*").alias("m"))


def _descending(h: DataFrame) -> DataFrame:
    """Adds keys and mass above v, and both totals."""
    down = Window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    mass = F.col("v") * F.col("m")
    return h.select("v", "m", (F.sum("m").over(down) - F.col("m")).alias("above"), (F.sum(mass).over(down) - mass).alias("mass_above"), F.sum("m").over(every).alias("keys"), F.sum(mass).over(every).alias("mass"))


def coverage_curve(counts: DataFrame, tops: Sequence[int], n: str = "n") -> DataFrame:
    """Share of all occurrences in the top N keys, in percent with one decimal, for N up to the number of keys."""
    d = _descending(histogram(counts, n))
    wanted = d.sparkSession.createDataFrame([(int(t),) for t in tops], "top_n long")
    # each N falls into one step of the histogram
    at = d.join(F.broadcast(wanted), (F.col("top_n") > F.col("above")) & (F.col("top_n") <= F.col("above") + F.col("m")))
    share = ratio((F.col("mass_above") + F.col("v") * (F.col("top_n") - F.col("above"))) * 100, F.col("mass"))
    return at.select("top_n", rounded(share, 1).alias("coverage"))


def coverage_needed(counts: DataFrame, shares: Sequence[int], n: str = "n") -> DataFrame:
    """Smallest number of top keys that reach each share (percent) of all occurrences."""
    d = _descending(histogram(counts, n))
    wanted = d.sparkSession.createDataFrame([(int(s),) for s in shares], "share long")
    need = F.ceil((F.col("share") * F.col("mass") - 100 * F.col("mass_above")) / (100 * F.col("v")))
    steps = d.join(F.broadcast(wanted), (100 * F.col("mass_above") < F.col("share") * F.col("mass")) & (100 * (F.col("mass_above") + F.col("v") * F.col("m")) >= F.col("share") * F.col("mass")))
    return steps.select("share", (F.col("above") + F.greatest(need, F.lit(1))).cast("long").alias("needed"))


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: the Gini coefficient of the counts, 0 if there are none."""
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = histogram(counts, n).withColumn("c", F.sum("m").over(up) - F.col("m"))
    weighted = F.sum(F.col("v") * (F.col("m") * F.col("c") + F.col("m") * (F.col("m") + 1) / 2))
    keys, mass = F.sum("m"), F.sum(F.col("v") * F.col("m"))
    value = ratio(2 * weighted, keys * mass) - ratio(keys + 1, keys)
    return h.agg(rounded(F.coalesce(value, F.lit(0.0)), 6).alias("gini"))


def top_shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Share of occurrences in the top tenth and in the top half of the keys (at least one key)."""
    d = _descending(histogram(counts, n))

    def mass_of(first: Column) -> Column:
        return F.sum(F.col("v") * F.greatest(F.lit(0), F.least(F.col("m"), first - F.col("above"))))

    tenth, half = F.greatest(F.lit(1), F.floor(F.col("keys") / 10)), F.greatest(F.lit(1), F.floor(F.col("keys") / 2))
    return d.agg(rounded(ratio(mass_of(tenth), F.max("mass"))).alias("top_tenth"), rounded(ratio(mass_of(half), F.max("mass"))).alias("top_half"))


def median_rank(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: the upper median over all occurrences of the rank of what occurs, by count descending.

    A key with v occurrences weighs v, so the rank follows from the step of the
    histogram that holds the middle occurrence.
    """
    d = _descending(histogram(counts, n)).withColumn("half", F.floor(F.col("mass") / 2))
    at = d.filter((F.col("mass_above") <= F.col("half")) & (F.col("half") < F.col("mass_above") + F.col("v") * F.col("m")))
    return at.select((F.col("above") + F.floor((F.col("half") - F.col("mass_above")) / F.col("v")) + 1).cast("long").alias("median_rank"))


def thresholds(counts: DataFrame, n: str = "n") -> DataFrame:
    """Number of keys that occur once, and at least 5, 10 and 20 times."""
    c = F.col(n)
    return counts.agg(F.count_if(c == 1).alias("once"), F.count_if(c >= 5).alias("ge5"), F.count_if(c >= 10).alias("ge10"), F.count_if(c >= 20).alias("ge20"))


def upper_median(counts: DataFrame, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """The element at half the size (rounded down, from 0) of the sorted values, per group.

    Values are first counted, so a group is as large as its distinct values.
    """
    h = counts.filter(F.col(n).isNotNull()).groupBy(*by, F.col(n).alias("v")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = h.select(*by, "v", "m", F.sum("m").over(w).alias("upto"), F.sum("m").over(Window.partitionBy(*by)).alias("all"))
    half = F.floor(F.col("all") / 2)
    return at.filter((F.col("upto") > half) & (F.col("upto") - F.col("m") <= half)).select(*by, F.col("v").alias("median"))
