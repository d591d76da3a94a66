"""Filter interaction audit: what filters do alone, together and in every order.

1. Each document gets one flag a filter, its part, and whether labels call it good
   or toxic. Only flags, digest and part are written; texts are read once. Filter E
   needs the whole corpus: the least id of each text comes from a grouped minimum,
   and only texts that several rows hold are joined back.
2. Rows are counted by (part, flags, good, toxic): a few dozen rows a part.
3. CUBE over the part and the flags: a grouping-set row whose selected flags are all
   false counts the documents that survive just that subset of filters. With no flag
   selected it counts the part, without a part selected the corpus.
4. A step of an order is a pair of subsets, before and after; all 120 orders of five
   filters have 600 such pairs, joined to the survivors of both. Shapley sums follow
   from the 80 pairs of a subset and the same with one filter more.

Everything is DataFrame functions. Words are maximal runs of characters other than
ASCII white space, compared as they are.

Defined results: a null text is an empty one, so null and empty texts are identical;
a null id ranks before all others, rows of equal text and id are no copies of each
other; a null source is the part ''; a document counts once, good or toxic if any of
its labels says so, and one without id has no labels; an empty table gives no rows;
extra columns are left out, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import UPPER, Scratch, words

NAME = "op13_filter_audit"

FILTERS = "ABCDE"


def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """Failures that a text shows by itself; words is its array of words, a column of its own."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A to E, good, toxic), one row for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    split = rows.select("id", "part", "text", words(F.col("text")).alias("words"))
    own = split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(f) for f, c in text_flags(F.col("text"), F.col("words")).items()])
    own = scratch.save(own, "flags")
    held = own.groupBy("digest").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first"), F.count("*").alias("n"))
    repeated = scratch.save(held.filter("n > 1").select("digest", F.col("first.id").alias("first"), F.col("first.known").alias("known")), "repeated")
    later = F.when(F.col("known"), F.col("id") > F.col("first")).otherwise(F.col("id").isNotNull() & F.col("known").isNotNull())
    marked = own.join(repeated.hint("merge"), "digest", "left").select("id", "part", *"ABCD", F.coalesce(later, F.lit(False)).alias("E"))
    said = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return marked.join(said, "id", "left").select("part", *FILTERS, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def bits(columns: list[Column]) -> Column:
    """A subset of the filters as a number: bit k for filter k."""
    return sum(((c.cast("int") * (1 << k)) for k, c in enumerate(columns)), F.lit(0)).cast("int")


def survivors(flags: DataFrame, filters: str = FILTERS, part: str = "part", sums: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """(part, of_part, subset, n, and each of sums): the rows that pass every filter of each subset, by part and, where of_part is false, in all.

    A subset that nothing survives has no row.
    """
    counted = flags.groupBy(part, *filters, *sums).agg(F.count("*").alias("n"))
    measures = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(s)).alias(s) for s in sums]]
    selected = [F.grouping(f) == 0 for f in filters]
    cubed = counted.select(part, *filters, "n", *sums).cube(part, *filters).agg(*measures, bits(selected).alias("subset"), (F.grouping(part) == 0).alias("of_part"))
    passing = [F.coalesce(F.col(f), F.lit(False)) for f in filters]  # null where the flag is not selected
    return cubed.filter(~F.greatest(*passing)).select(part, "of_part", "subset", "n", *sums)


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, filter, before, after) of all orders: a fixed table, 600 rows for five filters."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, f in enumerate(order):
            rows.append(("".join(filters[i] for i in order), k + 1, filters[f], before, before | 1 << f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def marginals(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter, before, after, weight): each subset without a filter, and how many orders have just that subset before it."""
    m = len(filters)
    rows = [(f, s, s | 1 << k, factorial(s.bit_count()) * factorial(m - 1 - s.bit_count())) for k, f in enumerate(filters) for s in range(1 << m) if not s >> k & 1]
    return spark.createDataFrame(rows, "filter string, before int, after int, weight int")


def audit(flags: DataFrame, scratch: Scratch, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    spark = flags.sparkSession
    alive = scratch.save(survivors(flags, filters).filter("of_part").drop("of_part"), "survivors")
    full = (1 << len(filters)) - 1
    # every part has all subsets; the empty one has a row in any case
    parts = alive.filter("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("subset"))
    grid = parts.join(alive, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])
    side = lambda name: grid.select("part", F.col("subset").alias(name), F.struct("n", "good", "toxic").alias(f"{name}_of"))
    lost = lambda what: F.col("before_of")[what] - F.col("after_of")[what]

    def paired(pairs: DataFrame) -> DataFrame:
        return side("before").join(F.broadcast(pairs), "before").join(side("after"), ["part", "after"])  # pairs are fixed by the number of filters

    shares = paired(marginals(spark, filters)).groupBy("part", "filter").agg(F.sum(F.col("weight") * lost("n")).alias("shapley"))
    singles = spark.createDataFrame([(f, 0, 1 << k, full & ~(1 << k)) for k, f in enumerate(filters)], "filter string, before int, after int, others int")
    alone = paired(singles).join(side("others"), ["part", "others"]).select("part", "filter", lost("n").alias("fails"), F.col("others_of.n").alias("rest"))
    whole = grid.filter(F.col("subset") == full).select("part", F.col("n").alias("clean"))
    each = shares.join(alone, ["part", "filter"]).join(whole, "part")
    told = paired(steps(spark, filters)).join(each, ["part", "filter"])
    return told.select(
        "part", "filter_order", "step", F.col("after_of.n").alias("kept"), lost("n").alias("removed"), (F.col("fails") - lost("n")).alias("redundant"),
        (F.col("rest") - F.col("clean")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), "shapley",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source, filters A to E."""
    scratch = Scratch(spark, "filters")
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(flagged(read("documents"), read("labels"), scratch), scratch)


#: The same by going through the filters in each order.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, concat(
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
  CASE WHEN 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x) THEN 'C' ELSE '' END,
  CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END) AS fails FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM s a JOIN s b ON b.c <> a.c JOIN s d ON d.c NOT IN (a.c, b.c) JOIN s e ON e.c NOT IN (a.c, b.c, d.c) JOIN s h ON h.c NOT IN (a.c, b.c, d.c, e.c)),
p AS (SELECT filter_order, unnest(generate_series(1, 5)) AS step FROM o),
q AS (SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS before FROM p),
r AS (SELECT part, filter_order, step, c, n, good, toxic, contains(fails, c) AS hit, length(translate(before, fails, '')) < length(before) AS gone, fails = c AS single FROM g CROSS JOIN q),
z AS (SELECT part, filter_order, step, c, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN single THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM z
"""
