"""Analytics over programmes: seasons, novelty, pairs, shapes and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import ratio, rounded
from cadenza.session import SHARE_ROWS, dealt, saved, shares


def seasonality_lift(occ: DataFrame, work: str, month: str, least: int = 3, candidates: int = 200, top: int = 6) -> DataFrame:
    """Works over-represented in a month: share in the month over share in all, above 2.

    Only a month's most frequent works are candidates. The limit compares integers;
    the ranking uses the lift rounded to one decimal, then the month's order.
    """
    n_month = occ.groupBy(month, work).agg(F.count("*").alias("n"))
    n_all = n_month.groupBy(work).agg(F.sum("n").alias("overall"))
    months = n_month.groupBy(month).agg(F.sum("n").alias("in_month"))
    order = Window.partitionBy(month).orderBy(F.desc("n"), work)
    first = n_month.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= candidates)
    joined = first.join(n_all, work).join(months, month)
    total = months.agg(F.sum("in_month").alias("total"))
    joined = joined.join(F.broadcast(total))  # the one row of a global aggregate
    over = joined.filter((F.col("n") >= least) & (F.col("n") * F.col("total") > 2 * F.col("overall") * F.col("in_month")))
    lift = rounded(ratio(F.col("n") * F.col("total"), F.col("overall") * F.col("in_month")), 1)
    best = Window.partitionBy(month).orderBy(F.desc("lift"), "place")
    return over.withColumn("lift", lift).withColumn("position", F.row_number().over(best)).filter(F.col("position") <= top).select(month, work, "n", "lift", "position")


def novelty_by_year(occ: DataFrame, work: str, year: str) -> DataFrame:
    """Per year: distinct works, and works first seen in that year."""
    seen = occ.select(work, year).distinct()
    first = seen.groupBy(work).agg(F.min(year).alias("first_year"))
    return seen.join(first, work).groupBy(year).agg(F.count("*").alias("works"), F.count_if(F.col(year) == F.col("first_year")).alias("new_works"))


def pair_cooccurrence(occ: DataFrame, concert: str, work: str, top: int | None = None) -> DataFrame:
    """Unordered pairs of distinct works in a concert, with the number of concerts.

    A programme is a bounded list, so pairs are made inside the row of a concert and
    the concert-work table, which lies in files, is shuffled once. Pairs of a large
    table are dealt by their exact number; most are rare and would not combine before.
    """
    n = shares(occ)
    sets = dealt(occ.select(concert, work), n, concert).groupBy(concert).agg(F.array_sort(F.collect_set(work)).alias("ws")).filter(F.size("ws") > 1)
    pairs = F.flatten(F.transform("ws", lambda a, i: F.transform(F.slice("ws", i + 2, F.size("ws")), lambda b: F.struct(a.alias("work_a"), b.alias("work_b")))))
    if n > 1:
        sets = saved(sets)
        n = -(-(sets.agg(F.sum(F.size("ws").cast("long") * (F.size("ws") - 1))).first()[0] or 0) // (2 * SHARE_ROWS))
    each = dealt(sets.select(F.inline(pairs)), n, "work_a", "work_b")
    counted = each.groupBy("work_a", "work_b").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "work_a", "work_b").limit(top) if top else counted


def shapes(occ: DataFrame, concert: str, form: str, order: list[str], length: int = 4) -> DataFrame:
    """Histogram of the first forms of each programme with at least two works; null is `?`."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(form), F.lit("?")).alias("_form"))))
    each = occ.groupBy(concert).agg(items.alias("items")).filter(F.size("items") >= 2)
    shape = F.array_join(F.transform(F.slice("items", 1, length), lambda x: x["_form"]), " > ")
    return each.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


def first_before(occ: DataFrame, concert: str, position: Column, one: Column, two: Column) -> DataFrame:
    """One row: concerts with both kinds, and those where the first of one is before the first of two."""
    each = occ.groupBy(concert).agg(F.min(F.when(one, position)).alias("p1"), F.min(F.when(two, position)).alias("p2")).filter("p1 IS NOT NULL AND p2 IS NOT NULL")
    return each.agg(F.count("*").alias("both"), F.count_if(F.col("p1") < F.col("p2")).alias("before"))


def compare_corpora(occ: DataFrame, corpus: str, work: str, a: str, b: str) -> DataFrame:
    """One row: works of each corpus, shared works, Jaccard, and the share of each corpus's occurrences in shared works."""
    n = occ.groupBy(work).agg(F.count_if(F.col(corpus) == a).alias("na"), F.count_if(F.col(corpus) == b).alias("nb")).filter("na > 0 OR nb > 0")
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    out = n.agg(
        F.count_if(F.col("na") > 0).alias("works_a"), F.count_if(F.col("nb") > 0).alias("works_b"), F.count_if(both).alias("shared"), F.count("*").alias("either"),
        F.sum(F.when(both, F.col("na"))).alias("sa"), F.sum(F.when(both, F.col("nb"))).alias("sb"), F.sum("na").alias("ta"), F.sum("nb").alias("tb"),
    )
    return out.select(
        "works_a", "works_b", "shared", (F.col("works_a") - F.col("shared")).alias("only_a"), (F.col("works_b") - F.col("shared")).alias("only_b"),
        rounded(ratio(F.col("shared"), F.col("either"))).alias("jaccard"), rounded(ratio(F.col("sa"), F.col("ta"))).alias("mass_shared_a"), rounded(ratio(F.col("sb"), F.col("tb"))).alias("mass_shared_b"),
    )


def cross_coverage(occ: DataFrame, corpus: str, work: str, a: str, b: str, top: int = 100) -> DataFrame:
    """One row: the percentage of each corpus's occurrences in the other one's ``top`` works, by count and then key."""
    n = occ.groupBy(work).agg(F.count_if(F.col(corpus) == a).alias("na"), F.count_if(F.col(corpus) == b).alias("nb"))
    best = lambda m, name: n.filter(F.col(m) > 0).orderBy(F.desc(m), work).limit(top).select(work, F.lit(True).alias(name))
    met = n.join(F.broadcast(best("na", "in_a")), work, "left").join(F.broadcast(best("nb", "in_b")), work, "left")  # ``top`` rows each
    share = lambda m, name: rounded(ratio(100 * F.sum(F.when(F.col(name), F.col(m)).otherwise(0)), F.sum(m)), 1)
    return met.agg(share("nb", "in_a").alias("b_in_top_a"), share("na", "in_b").alias("a_in_top_b"))


def share_delta(occ: DataFrame, corpus: str, key: str, a: str, b: str, least: int = 15) -> DataFrame:
    """Keys with at least `least` occurrences in both corpora: percent shares and their difference."""
    n = occ.groupBy(key).agg(F.count_if(F.col(corpus) == a).alias("na"), F.count_if(F.col(corpus) == b).alias("nb"))
    total = n.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    x = n.filter((F.col("na") >= least) & (F.col("nb") >= least)).join(F.broadcast(total))  # one row
    sa, sb = ratio(100 * F.col("na"), F.col("ta")), ratio(100 * F.col("nb"), F.col("tb"))
    return x.select(key, "na", "nb", rounded(sa, 2).alias("share_a"), rounded(sb, 2).alias("share_b"), rounded(sb - sa, 2).alias("delta"))


def concert_coverage(occ: DataFrame, ranks: DataFrame, concert: str, work: str, tops: list[int]) -> DataFrame:
    """For each N: percent of concerts whose works are all in the top N, and the mean share of works that are."""
    placed = occ.select(concert, work).join(ranks.select(work, "position"), work)
    per = [F.count_if(F.col("position") <= t).alias(f"k{t}") for t in tops]
    each = placed.groupBy(concert).agg(F.count("*").alias("size"), *per)
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("top_n"), (F.col(f"k{t}") == F.col("size")).alias("full"), (F.col(f"k{t}") / F.col("size")).alias("share")) for t in tops])
    flat = each.select(F.explode(rows).alias("r")).select("r.*")
    return flat.groupBy("top_n").agg(rounded(ratio(100 * F.count_if("full"), F.count("*")), 2).alias("full_percent"), rounded(F.avg("share"), 4).alias("mean_share"))


def work_keys(occ: DataFrame, generic: list[str]) -> DataFrame:
    """Assigns workKey to occurrences (idx, composer, form, num, opus, slug, raw) by majority vote.

    a is composer, form and number; b composer and catalogue number. Each b votes for
    an a, specific forms first, then by votes, then by first appearance. A generic
    form takes its b's vote; then a, the vote, b, the form's slug, the slug, the text.
    """
    no = lambda c: F.col(c).isNull() | (F.col(c) == "")
    a = F.when(~no("form") & ~no("num"), F.concat_ws("", "composer", F.lit("|"), "form", F.lit("#"), "num"))
    b = F.when(~no("opus"), F.concat_ws("|", "composer", "opus"))
    is_generic = no("form") | F.col("form").isin(generic)
    o = occ.withColumn("_a", a).withColumn("_b", b).withColumn("_generic", is_generic)
    votes = o.filter("_a IS NOT NULL AND _b IS NOT NULL").groupBy("_b", "_a", "_generic").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    # an a has one form, so it is either specific or generic
    best = Window.partitionBy("_b").orderBy("_generic", F.desc("n"), "first")
    chosen = votes.withColumn("r", F.row_number().over(best)).filter("r = 1").select("_b", F.col("_a").alias("_vote"))
    key = (
        F.when(F.col("_a").isNotNull() & F.col("_generic") & F.col("_vote").isNotNull(), F.col("_vote"))
        .when(F.col("_a").isNotNull(), F.col("_a"))
        .when(F.col("_b").isNotNull(), F.coalesce("_vote", "_b"))
        .when(~no("form") & ~no("slug"), F.concat_ws("|", "composer", "form", "slug"))
        .when(~no("slug"), F.concat_ws("|", "composer", F.lit("t"), "slug"))
        .otherwise(F.concat_ws("|", "composer", F.lit("?"), F.substring("raw", 1, 30)))
    )
    # occurrences without a catalogue number have no vote; joined, they would all meet in one task
    voted = o.filter("_b IS NOT NULL").join(chosen, "_b", "left")
    rest = o.filter("_b IS NULL").withColumn("_vote", F.lit(None).cast("string"))
    return voted.unionByName(rest).withColumn("workKey", key).drop("_a", "_b", "_generic", "_vote")
