"""Scoring of extracted records: fields, sets, outcomes, calibration, stability, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import ratio, rounded

#: Outcomes where the truth is null, in order of precedence.
OUTCOMES = ("abstain_empty", "abstain_lowconf", "nonnumeric_text", "misattributed", "fabricated")


def text_score(truth: Column, predicted: Column, similarity: Column, partial: bool = True) -> Column:
    """struct<correct, score> of normalised texts: 1 if equal and not empty, else the similarity."""
    exact = (truth == predicted) & (F.length(truth) > 0)
    return F.struct(F.coalesce(exact, F.lit(False)).alias("correct"), F.when(exact, 1.0).otherwise(similarity if partial else F.lit(0.0)).alias("score"))


def set_score(truth: Column, predicted: Column) -> Column:
    """struct<precision, recall, f1, matched, missing, spurious> of two arrays taken as sets of non-empty strings."""
    clean = lambda a: F.array_distinct(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    t, p = clean(truth), clean(predicted)
    hit = F.size(F.array_intersect(t, p))
    precision = F.when(F.size(p) > 0, hit / F.size(p)).otherwise(F.when(F.size(t) > 0, 0.0).otherwise(1.0))
    recall = F.when(F.size(t) > 0, hit / F.size(t)).otherwise(1.0)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(F.try_divide(2 * precision * recall, precision + recall))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.array_intersect(p, t).alias("matched"), F.array_except(t, p).alias("missing"), F.array_except(p, t).alias("spurious"))


def is_misattributed(value: Column, others: Column) -> Column:
    """Whether a normalised value of two characters or more contains, or is part of, another truth of the record."""
    return F.coalesce((F.length(value) >= 2) & F.exists(others, lambda t: (F.length(t) >= 2) & (F.contains(t, value) | F.contains(value, t))), F.lit(False))


def null_truth_outcome(empty: Column, confidence: Column, threshold: float, price_text: Column, misattributed: Column) -> Column:
    return F.when(empty, OUTCOMES[0]).when(confidence < threshold, OUTCOMES[1]).when(price_text, OUTCOMES[2]).when(misattributed, OUTCOMES[3]).otherwise(OUTCOMES[4])


def outcome_distribution(rows: DataFrame, outcome: str) -> DataFrame:
    """All outcomes with their counts, zeros included."""
    every = rows.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    n = rows.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))
    return every.join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def calibration_bins(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Per bin of clamped confidence (the last one closed): n, mean confidence, accuracy."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    x = rows.filter(F.col(confidence).isNotNull()).select(F.least(F.floor(c * bins), F.lit(bins - 1)).cast("long").alias("bin"), c.alias("c"), F.col(correct).cast("double").alias("ok"))
    return x.groupBy("bin").agg(F.count("*").alias("n"), rounded(F.avg("c")).alias("confidence"), rounded(F.avg("ok")).alias("accuracy"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: n, the expected calibration error, and Pearson's correlation (null without spread)."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    x = rows.filter(F.col(confidence).isNotNull()).select(F.least(F.floor(c * bins), F.lit(bins - 1)).alias("bin"), c.alias("c"), F.col(correct).cast("double").alias("ok"))
    # sums per bin carry all that both figures need
    b = x.groupBy("bin").agg(*[F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("ok").alias("o"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("ok") * F.col("ok")).alias("oo"), F.sum(F.col("c") * F.col("ok")).alias("co")])
    n, sc, so = F.sum("n"), F.sum("c"), F.sum("o")
    vc, vo = n * F.sum("cc") - sc * sc, n * F.sum("oo") - so * so
    pearson = F.when((vc > 1e-9) & (vo > 1e-9), (n * F.sum("co") - sc * so) / F.sqrt(vc) / F.sqrt(vo))
    return b.agg(n.alias("n"), rounded(F.sum(F.abs(F.col("c") - F.col("o"))) / n).alias("ece"), rounded(pearson).alias("pearson"))


def field_stats(scored: DataFrame, field: str, correct: str, score: str, null_truth: str) -> DataFrame:
    """Per field: rows, rows with and without truth, accuracy and mean score over those with truth."""
    has = ~F.col(null_truth)
    return scored.groupBy(field).agg(
        F.count("*").alias("n"), F.count_if(has).alias("scored"), F.count_if(F.col(null_truth)).alias("null_truth"),
        rounded(ratio(F.count_if(has & F.col(correct)), F.count_if(has))).alias("accuracy"), rounded(F.avg(F.when(has, F.col(score)))).alias("mean_score"),
    )


def field_means(scored: DataFrame, field: str, null_truth: str, measures: Sequence[str]) -> DataFrame:
    """Per field the mean of each measure - similarity, precision, recall, f1 - over rows with truth that have it; null if none has."""
    return scored.groupBy(field).agg(*[rounded(F.avg(F.when(~F.col(null_truth), F.col(m)))).alias(m) for m in measures])


def flip_rate(runs: DataFrame, file: str, field: str, value: str) -> DataFrame:
    """Per field over files with at least two runs: unstable files, files, rate. A missing value counts as a value."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("\0"))
    each = runs.groupBy(file, field).agg(F.count("*").alias("runs"), F.min(v).alias("a"), F.max(v).alias("b")).filter("runs >= 2")
    return each.groupBy(field).agg(F.count_if(F.col("a") != F.col("b")).alias("unstable"), F.count("*").alias("files"), rounded(ratio(F.count_if(F.col("a") != F.col("b")), F.count("*"))).alias("rate"))


def latency(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, least, greatest, and the elements at n/2 and 95n/100 of the sorted values (from 0).

    Positions come from counts of distinct values, so no group is collected.
    """
    h = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys)
    x = h.withColumn("upto", F.sum("m").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("m").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    return x.groupBy(*keys, "n").agg(
        rounded(F.sum(F.col("v") * F.col("m")) / F.col("n"), 2).alias("mean"), at(F.floor(F.col("n") / 2)).alias("p50"),
        at(F.least(F.col("n") - 1, F.expr("n * 95 div 100"))).alias("p95"), F.min("v").alias("least"), F.max("v").alias("most"),
    )


def anti_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side alone, with the side."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))
