"""Profiles of users, performers and works: shares, cross-tabulations, phases, consensus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import ratio, rounded


def taste_distribution(facts: DataFrame, user: str, axis: str) -> DataFrame:
    """Per user the share of each value of an axis; null values are left out."""
    n = facts.filter(F.col(axis).isNotNull()).groupBy(user, axis).agg(F.count("*").alias("n"))
    return n.withColumn("share", rounded(ratio(F.col("n"), F.sum("n").over(Window.partitionBy(user)))))


def adventurousness(facts: DataFrame, who: str, rarity: str) -> DataFrame:
    """Mean rarity of what each performer plays."""
    return facts.groupBy(who).agg(F.count("*").alias("n"), rounded(F.avg(rarity)).alias("adventure"))


def cross_table(facts: DataFrame, group: str, value: str, least: int = 8) -> DataFrame:
    """Mean of a value per group, with a flag that says whether there are enough for firm wording."""
    return facts.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), rounded(F.avg(value), 2).alias("mean")).withColumn("firm", F.col("n") >= least)


def comment_marks(comments: DataFrame, video: str, text: str) -> DataFrame:
    """Frequency of minute:second marks per (video, second)."""
    marks = F.regexp_extract_all(text, F.lit(r"(\d{1,2}:\d{2})"), F.lit(1))
    x = comments.select(video, F.explode(marks).alias("mark"))
    at = F.split("mark", ":")
    return x.select(video, (at[0].cast("int") * 60 + at[1].cast("int")).alias("second")).groupBy(video, "second").agg(F.count("*").alias("n"))


def life_phase(composed: Column, born: Column, died: Column) -> Column:
    """early below a third, middle below 0.70, else late; null outside a life."""
    r = F.try_divide((composed - born).cast("double"), (died - born).cast("double"))
    return F.when(r.between(0, 1), F.when(r < 0.33, "early").when(r < 0.70, "middle").otherwise("late"))


def consensus(runs: DataFrame, keys: Sequence[str], run: str, value: str, canonical: str) -> DataFrame:
    """Per key the modal canonical value over runs, ties to the earliest run, with the share of runs that agree."""
    n = runs.groupBy(*keys, canonical).agg(F.count("*").alias("votes"), F.min(run).alias("first"), F.min_by(value, run).alias("value"))
    total = Window.partitionBy(*keys)
    best = Window.partitionBy(*keys).orderBy(F.desc("votes"), "first")
    x = n.withColumn("runs", F.sum("votes").over(total)).withColumn("r", F.row_number().over(best)).filter("r = 1")
    return x.select(*keys, "value", rounded(ratio(F.col("votes"), F.col("runs"))).alias("confidence"))


def architecture(items: DataFrame, concert: str, seq: str, form: str, intermission: Column) -> DataFrame:
    """Per concert whether a concerto stands before the first break and a symphony after it."""
    cut = F.min(F.when(intermission, F.col(seq)))
    each = items.groupBy(concert).agg(cut.alias("cut"), F.min(F.when(F.col(form).contains("concerto"), F.col(seq))).alias("c"), F.max(F.when(F.col(form).contains("symphony"), F.col(seq))).alias("s"))
    label = F.when((F.col("c") < F.col("cut")) & (F.col("s") > F.col("cut")), "concerto-symphony").when(F.col("s").isNotNull(), "symphony").when(F.col("c").isNotNull(), "concerto").otherwise("other")
    return each.select(concert, label.alias("architecture"))


def first_available(base: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """base with the value of the first source that has one, and the source's name."""
    out = base
    for name, df in sources:
        out = out.join(df.select(key, F.col(value).alias(f"_{name}")), key, "left")
    origin = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in sources])
    return out.select(*base.columns, F.coalesce(*[F.col(f"_{n}") for n, _ in sources]).alias(value), origin.alias("origin"))


def group_breakdown(scored: DataFrame, group: str, file: str, correct: str, fabricated: str, unknown: str = "(미상)") -> DataFrame:
    """Per group: items, accuracy and the rate of fabrications; a null group is shown as unknown."""
    g = scored.withColumn("_g", F.coalesce(group, F.lit(unknown)))
    per = g.groupBy("_g", file).agg(F.count("*").alias("k"), F.count_if(correct).alias("ok"), F.count_if(fabricated).alias("bad"))
    return per.groupBy(F.col("_g").alias("grp")).agg(F.count("*").alias("items"), rounded(ratio(F.sum("ok"), F.sum("k"))).alias("accuracy"), rounded(ratio(F.sum("bad"), F.sum("k"))).alias("fabricated_rate"))


def correlation_by(rows: DataFrame, group: str, x: str, y: str, least: int = 8) -> DataFrame:
    """Per group of at least that many pairs: n and Pearson's correlation from one pass of sums; null without spread."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))
    return s.filter(F.col("n") >= least).select(group, "n", rounded(F.when(~F.isnan("r"), F.col("r"))).alias("correlation"))


def mood_axes(tags: DataFrame, work: str, tag: str, values: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Per work the mean of each axis over its distinct tags: values(tag, axis, value). A tag without values says nothing."""
    known = tags.select(work, F.col(tag).alias("tag")).distinct().join(values, "tag")
    return known.groupBy(work).agg(*[rounded(F.avg(F.when(F.col("axis") == a, F.col("value")))).alias(a) for a in axes])


def collection_summary(rows: DataFrame, flags: Mapping[str, Column], sizes: Mapping[str, Column]) -> DataFrame:
    """(measure, n): all rows, rows for which each flag holds, and the sum of each size, in one pass."""
    measures = [F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in flags.items()], *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in sizes.items()]]
    one = rows.agg(*measures)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in one.columns])).alias("m")).select("m.*")


def success_by(rows: DataFrame, key: str, steps: Mapping[str, Column], unknown: str = "?") -> DataFrame:
    """Per category how many rows there are and how many pass each step; a null category is ``unknown``."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(unknown)).alias(key)).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in steps.items()])
