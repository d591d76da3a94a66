"""Two-stage work matching: the composer is known first, then that composer's works alone are scored.

Lines and works become features - catalogue number, form, ordinal, key, words - and a
line's score against a work is the weighted mean over what the line says. Everything
is Column code; lines meet works by an equi-join on the composer, so no line is ever
compared with the whole catalogue, and equal lines are scored once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.forms import canon_form
from cadenza.functions.text import STOPWORDS, parse_key, parse_opus, work_number
from cadenza.operators.names import fold
from cadenza.session import saved

#: Weights of what a line may say. A catalogue number nearly decides, words always count.
WEIGHTS = {"opus": 0.5, "form": 0.2, "number": 0.15, "key": 0.05, "words": 0.2}
#: Score from which a work is taken, from which one is asked about, and the lead it needs over the next.
ACCEPT, ASK, LEAD = 0.85, 0.6, 0.02
#: What a line and a work are met by, if the line tells it, from the most telling on; a line is scored in each until it is settled.
TIERS = (("opus",), ("form", "number"), ("form",))
#: Words of a title whose order counts; beyond, words count as a set.
ORDERED = 60


def title_words(s: Column) -> Column:
    """Telling words of a title in lower case, without accents."""
    return F.filter(F.split(fold(s), "[^a-z0-9가-힣]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def features(df: DataFrame, title: str, mark: str) -> DataFrame:
    """df with the features of a title, each with a mark before its name."""
    x = F.coalesce(F.col(title), F.lit(""))
    made = {"opus": parse_opus(x), "form": canon_form(x), "number": work_number(x), "key": parse_key(x), "words": title_words(x)}
    return df.withColumns({f"{mark}{name}": column for name, column in made.items()})


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.when(F.arrays_overlap(a, b), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def common_in_order(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; b has at most ORDERED elements.

    One fold over a: bit i of the state is off if b's element i ends a longer match
    than before, and an addition carries each match to the next free place.
    """
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, F.size(b)) - 1
    places = lambda x: F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(b, i) == x, F.call_function("shiftleft", one, i)).otherwise(0)))

    def step(state: Column, x: Column) -> Column:
        at = places(x)
        return (state + state.bitwiseAND(at)).bitwiseOR(state.bitwiseAND(F.bitwise_not(at))).bitwiseAND(full)

    return F.aggregate(a, full, step, lambda state: F.size(b) - F.bit_count(state))


def in_order_ratio(a: Column, b: Column) -> Column:
    """Twice the words common in order, over all words; of longer titles, common words in any order. 0 without words."""
    total = F.size(a) + F.size(b)
    common = F.when(~F.coalesce(F.arrays_overlap(a, b), F.lit(False)), 0).when(F.size(b) <= ORDERED, common_in_order(a, b)).otherwise(F.size(F.array_intersect(a, b)))
    return F.coalesce(F.try_divide(2 * common, total), F.lit(0.0))


def score(line: str, work: str, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean over what the line says: 1 or 0 where it equals the work's, and for words the mean of set and order."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        a, b = F.col(f"{line}{name}"), F.col(f"{work}{name}")
        if name == "words":
            said, alike = F.lit(True), (jaccard(a, b) + in_order_ratio(a, b)) / 2
        else:
            said, alike = a.isNotNull(), F.coalesce((a == b).cast("double"), F.lit(0.0))
        total = total + F.when(said, w * alike).otherwise(0.0)
        weight = weight + F.when(said, F.lit(float(w))).otherwise(0.0)
    return F.round(total / weight, 9)  # so that a threshold is met alike wherever it is computed


def said_weight(line: str, weights: Mapping[str, float]) -> Column:
    """The weights of what a line says; words always count."""
    return reduce(add, [F.lit(float(w)) if name == "words" else F.when(F.col(f"{line}{name}").isNotNull(), float(w)).otherwise(0.0) for name, w in weights.items()])


def alike_works(works: DataFrame) -> DataFrame:
    """works(_composer, _work, _known) with features, one row for all works of a composer that no line can tell apart: the least work and their number."""
    least = F.when(F.count("_work") == F.count("*"), F.min("_work")).alias("_work")  # null is before all others, as in the order of two_best
    titles = works.groupBy("_composer", "_known").agg(least, F.count("*").alias("_copies"))
    made = features(titles, "_known", "b_")
    return made.groupBy("_composer", *[f"b_{name}" for name in WEIGHTS]).agg(least, F.sum("_copies").alias("_copies"))


def two_best(pairs: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(_composer, _title, _other, _b, _next): the best work of a title, ties by least work, and the score of the next one."""
    order = Window.partitionBy("_composer", "_title").orderBy(F.desc("_score"), "_work")
    scored = pairs.select("_composer", "_title", "_other", "_work", "_copies", score("a_", "b_", weights).alias("_score"))
    two = scored.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    one = two.groupBy("_composer", "_title").agg(F.max("_other").alias("_other"), F.max(F.when(F.col("_r") == 1, F.struct("_score", "_work", "_copies"))).alias("_b"), F.max(F.when(F.col("_r") == 2, F.col("_score"))).alias("_second"))
    return one.select("_composer", "_title", "_other", "_b", F.when(F.col("_b._copies") > 1, F.col("_b._score")).otherwise(F.col("_second")).alias("_next"))


def match_works(lines: DataFrame, works: DataFrame, composer: str, title: str, work: str, work_title: str, weights: Mapping[str, float] = WEIGHTS, accept: float = ACCEPT, ask: float = ASK, lead: float = LEAD) -> DataFrame:
    """lines with work, score and near, the works of lines' composers as works(composer, work, work_title).

    A line meets the works that agree with it in what it tells first (TIERS), and is
    settled by them if its best is further from all that a work without this can
    reach than ``lead``; the lines left meet all works of their composer.

    work is the best one if it reaches ``accept``, ties by least work, else null. near
    says that somebody should be asked: the best reaches ``ask`` but is not taken, or
    the next one is as good to within ``lead``. A line without a composer, or whose
    composer has no works, matches nothing.
    """
    said = lines.filter(F.col(composer).isNotNull() & F.col(title).isNotNull()).select(F.col(composer).alias("_composer"), F.col(title).alias("_title")).distinct()
    asked = saved(features(said, "_title", "a_"))
    held = saved(alike_works(works.select(F.col(composer).alias("_composer"), F.col(work).alias("_work"), F.col(work_title).alias("_known"))))
    best, rest = [], asked
    for names in TIERS:
        tells = reduce(and_, [F.col(f"a_{name}").isNotNull() for name in names])
        met = rest.filter(tells).withColumns({name: F.col(f"a_{name}") for name in names}).join(held.withColumns({name: F.col(f"b_{name}") for name in names}), ["_composer", *names])
        other = 1 - min(weights.get(name, 0.0) for name in names) / said_weight("a_", weights)
        found = saved(two_best(met.withColumn("_other", other), weights))
        sure = found.filter(F.col("_b._score") - lead > F.col("_other") + 1e-6)
        best.append(sure)
        rest = rest.join(sure.select("_composer", "_title"), ["_composer", "_title"], "left_anti")
    best = reduce(DataFrame.unionByName, [*best, two_best(rest.join(held, "_composer").withColumn("_other", F.lit(0.0)), weights)])
    top = F.col("_b._score")
    taken = top >= accept
    near = F.when(taken, F.coalesce(F.col("_next") > F.round(top - lead, 9), F.lit(False))).otherwise(top >= ask)
    told = best.select("_composer", "_title", F.when(taken, F.col("_b._work")).alias(work), top.alias("score"), near.alias("near"))
    out = lines.join(told, (F.col(composer) == F.col("_composer")) & (F.col(title) == F.col("_title")), "left")
    return out.select(*lines.columns, work, "score", F.coalesce("near", F.lit(False)).alias("near"))
