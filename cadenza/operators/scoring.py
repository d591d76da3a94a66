"""Scoring of whole items over runs: representative runs, inventory, provenance, cost and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import ratio, rounded


def exact(truth: Column, predicted: Column) -> Column:
    """Equality of normalised values; null equals nothing."""
    return F.coalesce(truth == predicted, F.lit(False))


def representative(runs: DataFrame, file: str, order: str) -> DataFrame:
    """The first run of each file, which headline figures use."""
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(file).orderBy(order))).filter("_r = 1").drop("_r")


def headline(scored: DataFrame, inside: Column, correct: str) -> DataFrame:
    """Rows and accuracy in scope and out of it."""
    return scored.groupBy(F.when(inside, "in").otherwise("out").alias("scope")).agg(F.count("*").alias("n"), rounded(ratio(F.count_if(correct), F.count("*"))).alias("accuracy"))


def inventory(records: DataFrame, model: str, file: str, error: str) -> DataFrame:
    """Per model: files, records, good and failed ones; the most good ones first."""
    per_file = records.groupBy(model, file).agg(F.count("*").alias("k"), F.count_if(F.col(error).isNull()).alias("good"))
    out = per_file.groupBy(model).agg(F.count("*").alias("files"), F.sum("k").alias("records"), F.sum("good").alias("ok"))
    return out.withColumn("errors", F.col("records") - F.col("ok")).orderBy(F.desc("ok"), model)


def provenance(records: DataFrame, key: str, hashed: str, current: Column) -> DataFrame:
    """Per key: whether its records have several hashes, and whether none or not all are of the current one."""
    seen = records.groupBy(key).agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"), F.count_if(F.col(hashed) == current).alias("fresh"), F.count("*").alias("n"))
    return seen.select(key, (F.col("a") != F.col("b")).alias("mixed"), (F.col("fresh") < F.col("n")).alias("stale"))


def not_numbers(rows: DataFrame, field: str) -> DataFrame:
    """Rows with a value in a numeric field that is no number."""
    return rows.filter(F.col(field).isNotNull() & F.col(field).try_cast("double").isNull())


def latency_share(own: Column, cached: Column, batch: Column, size: Column) -> Column:
    """Milliseconds of one item: its own unless cached, and its part of the batch."""
    return F.when(cached, F.lit(0.0)).otherwise(own.cast("double")) + F.try_divide(batch.cast("double"), size)


def token_cost(prompt: Column, candidates: Column, thoughts: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of one call; null if a price is. Thoughts are paid as output, absent ones are none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (zero(candidates) + zero(thoughts)) * price_out + zero(prompt) * price_in


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, key: str, recall_at: int = 50, gain_at: int = 8) -> DataFrame:
    """Per query: recall and binary NDCG of ranked(query, key, place, from 1) against relevant(query, key)."""
    hits = ranked.join(relevant.select(query, key), [query, key]).groupBy(query).agg(F.count_if(F.col("place") <= recall_at).alias("found"), F.sum(F.when(F.col("place") <= gain_at, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("all"), F.lit(gain_at)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    every = relevant.groupBy(query).agg(F.count("*").alias("all"))
    return every.join(hits, query, "left").select(query, rounded(F.coalesce("found", F.lit(0)) / F.col("all")).alias("recall"), rounded(F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"))


def batch_check(answers: DataFrame, batch: str, index: str, expected: DataFrame, size: str) -> DataFrame:
    """Per batch: answers, those out of range, repeated and missing ones, and whether it may be read by index or only by position."""
    j = expected.select(batch, size).join(answers.select(batch, index), batch, "left")
    good = F.col(index).between(0, F.col(size) - 1)
    per = j.groupBy(batch, size, index).agg(F.count(index).alias("k"), F.max(good).alias("good"))
    out = per.groupBy(batch, size).agg(F.sum("k").alias("answers"), F.sum(F.when(~F.col("good"), F.col("k")).otherwise(0)).alias("outside"), F.sum(F.when(F.col("good"), F.col("k") - 1).otherwise(0)).alias("repeated"), F.count_if("good").alias("seen"))
    missing = F.col(size) - F.col("seen")
    return out.select(batch, "answers", "outside", "repeated", missing.alias("missing"), F.when((F.col("outside") == 0) & (F.col("repeated") == 0) & (missing == 0), "index").when(F.col("answers") == F.col(size), "position").otherwise("reject").alias("reading"))


def needs_second_pass(confidences: Column, date: Column, title: Column, least: float = 0.8) -> Column:
    """Whether a record should be read again: the mean of its given confidences is low, or date or title is missing."""
    given = F.filter(confidences, lambda c: c.isNotNull())
    mean = F.try_divide(F.aggregate(given, F.lit(0.0), lambda a, c: a + c), F.size(given))
    return F.coalesce(mean < least, F.lit(True)) | date.isNull() | title.isNull()


def name_vote(names: DataFrame, work_count: DataFrame, key: str, name: str, strong: str) -> DataFrame:
    """The second name of each key by vote: any strong votes decide; weak ones only from max(2, a quarter of its works) on.

    Ties go to the name that comes first in order. work_count(key, works).
    """
    n = names.groupBy(key, name).agg(F.count_if(strong).alias("_firm"), F.count("*").alias("_votes"))
    best = Window.partitionBy(key).orderBy(F.desc("_firm"), F.desc("_votes"), name)
    top = n.withColumn("_r", F.row_number().over(best)).filter("_r = 1").join(work_count, key)
    return top.filter((F.col("_firm") > 0) | (F.col("_votes") >= F.greatest(F.lit(2.0), 0.25 * F.col("works")))).select(key, name)


def groundedness(cited: Column, given: Column) -> Column:
    """Share of the distinct items that an answer cites and was given; null if it cites none."""
    known = F.array_distinct(F.filter(cited, lambda x: x.isNotNull()))
    return F.try_divide(F.size(F.array_intersect(known, given)).cast("double"), F.size(known))


def golden_agreement(rows: DataFrame, field: str, truth: str, value: str, number: str, truth_number: str) -> DataFrame:
    """Per field of a golden set: n, and the share of values that agree - numbers by sign, others if they are equal; what the truth leaves open is left out."""
    numeric = F.col(truth_number).isNotNull()
    agrees = F.when(numeric, F.signum(truth_number) == F.signum(F.coalesce(F.col(number), F.lit(0.0)))).otherwise(F.col(truth).eqNullSafe(F.col(value)))
    known = rows.filter(numeric | F.col(truth).isNotNull())
    return known.groupBy(field).agg(F.count("*").alias("n"), rounded(F.avg(agrees.cast("double"))).alias("agreement"))
