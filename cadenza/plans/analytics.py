"""Corpus analytics on the driver tables.

concert = order, occurrence = line, work = part, composer = brand, form = part type,
performer = supplier, hall = region of the customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.numbers import ratio, rounded
from cadenza.operators import concentration as C
from cadenza.operators import programmes as P
from cadenza.operators.frequency import rank_and_rarity, work_index
from cadenza.plans.catalogue import register
from cadenza.plans.core import occurrences
from cadenza.session import table

TOPS, SHARES = (10, 20, 50, 100, 200, 500, 1000, 2000, 3000), (50, 60, 70, 80, 90, 95)
COUNTS_SQL = "WITH idx AS (SELECT l_partkey AS work, count(*) AS n FROM lineitem GROUP BY 1)"
R4 = lambda x: f"floor(({x}) * 10000.0 + 0.5) / 10000.0"
R2 = lambda x: f"floor(({x}) * 100.0 + 0.5) / 100.0"
R1 = lambda x: f"floor(({x}) * 10.0 + 0.5) / 10.0"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("n"))


@register("rarity_linear", COUNTS_SQL + f" SELECT work, n, {R4('1 - n / (max(n) OVER ())::DOUBLE')} AS rarity FROM idx")
def rarity_linear(spark, sf_dir):
    c = counts(spark, sf_dir)
    most = c.agg(F.max("n").alias("most"))
    return c.join(F.broadcast(most)).select("work", "n", rounded(1 - F.col("n") / F.col("most")).alias("rarity"))


@register("rarity_rank_pct", COUNTS_SQL + f" SELECT work, {R4('row_number() OVER (ORDER BY n DESC, work) / (count(*) OVER ())::DOUBLE')} AS rarity FROM idx")
def rarity_rank_pct(spark, sf_dir):
    ranked = rank_and_rarity(counts(spark, sf_dir), "work")
    total = ranked.agg(F.count("*").alias("total"))
    return ranked.join(F.broadcast(total)).select("work", rounded(F.col("position") / F.col("total")).alias("rarity"))


@register("coverage_curve", COUNTS_SQL + f""", r AS (SELECT row_number() OVER (ORDER BY n DESC, work) AS top_n, sum(n) OVER (ORDER BY n DESC, work ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM idx)
SELECT top_n, {R1('cum * 100 / total::DOUBLE')} AS coverage FROM r WHERE top_n IN {TOPS}""")
def coverage_curve(spark, sf_dir):
    return C.coverage_curve(counts(spark, sf_dir), TOPS)


@register("coverage_needed", COUNTS_SQL + """, r AS (SELECT row_number() OVER (ORDER BY n DESC, work) AS pos, sum(n) OVER (ORDER BY n DESC, work ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM idx)
SELECT s.share, min(pos) AS needed FROM r JOIN (SELECT unnest([50,60,70,80,90,95])::BIGINT AS share) s ON 100 * cum >= s.share * total GROUP BY 1""")
def coverage_needed(spark, sf_dir):
    return C.coverage_needed(counts(spark, sf_dir), SHARES)


GINI = "SELECT floor((2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*)) * 1000000.0 + 0.5) / 1000000.0 AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM idx)"


@register("gini_parts", COUNTS_SQL + " " + GINI)
def gini_parts(spark, sf_dir):
    return C.gini(counts(spark, sf_dir))


def brand_counts(spark, sf_dir):
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("composer"))
    return counts(spark, sf_dir).join(brand, "work")


@register("gini_brands", "WITH idx AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) " + GINI)
def gini_brands(spark, sf_dir):
    return C.gini(brand_counts(spark, sf_dir).groupBy("composer").agg(F.sum("n").alias("n")))


@register("share_topdecile", COUNTS_SQL + f""", r AS (SELECT n, row_number() OVER (ORDER BY n DESC, work) AS pos, count(*) OVER () AS k, sum(n) OVER () AS total FROM idx)
SELECT {R4('sum(CASE WHEN pos <= greatest(1, k // 10) THEN n END) / max(total)::DOUBLE')} AS top_tenth, {R4('sum(CASE WHEN pos <= greatest(1, k // 2) THEN n END) / max(total)::DOUBLE')} AS top_half FROM r""")
def share_topdecile(spark, sf_dir):
    return C.top_shares(counts(spark, sf_dir))


@register("threshold_counts", COUNTS_SQL + " SELECT count(*) FILTER (n = 1) AS once, count(*) FILTER (n >= 5) AS ge5, count(*) FILTER (n >= 10) AS ge10, count(*) FILTER (n >= 20) AS ge20 FROM idx")
def threshold_counts(spark, sf_dir):
    return C.thresholds(counts(spark, sf_dir))


@register("upper_median_count", "WITH idx AS (SELECT p_brand AS composer, p_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT composer, list_sort(list(n))[len(list(n)) // 2 + 1] AS median FROM idx GROUP BY 1")
def upper_median_count(spark, sf_dir):
    return C.upper_median(brand_counts(spark, sf_dir), by=["composer"])


@register("brand_share_top30", f"""WITH b AS (SELECT p_brand AS composer, count(*) AS n, count(DISTINCT l_partkey) AS works FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT composer, n, works, {R2('n * 100 / (sum(n) OVER ())::DOUBLE')} AS share FROM b QUALIFY row_number() OVER (ORDER BY n DESC, composer) <= 30""")
def brand_share_top30(spark, sf_dir):
    b = brand_counts(spark, sf_dir).groupBy("composer").agg(F.sum("n").alias("n"), F.count("*").alias("works"))
    total = b.agg(F.sum("n").alias("total"))
    return b.orderBy(F.desc("n"), "composer").limit(30).join(F.broadcast(total)).select("composer", "n", "works", rounded(ratio(F.col("n") * 100, F.col("total")), 2).alias("share"))


OCC = "WITH occ AS (SELECT l_orderkey AS concert, l_partkey AS work, l_linenumber AS seq, l_suppkey AS performer, CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@register("seasonality_lift", OCC + f""", m AS (SELECT month(date)::BIGINT AS month, work, count(*) AS n FROM occ GROUP BY ALL),
a AS (SELECT work, sum(n)::BIGINT AS overall FROM m GROUP BY 1), k AS (SELECT month, sum(n)::BIGINT AS in_month FROM m GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM m),
c AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, work) AS place FROM m QUALIFY place <= 200),
l AS (SELECT month, work, n, place, {R1('(n * total)::DOUBLE / (overall * in_month)::DOUBLE')} AS lift FROM c JOIN a USING (work) JOIN k USING (month), t WHERE n >= 3 AND n * total > 2 * overall * in_month)
SELECT month, work, n, lift, row_number() OVER (PARTITION BY month ORDER BY lift DESC, place) AS position FROM l QUALIFY position <= 6""")
def seasonality_lift(spark, sf_dir):
    occ = occurrences(spark, sf_dir).withColumn("month", F.month("date").cast("long"))
    return P.seasonality_lift(occ, "work", "month").withColumn("position", F.col("position").cast("long"))


@register("novelty_by_year", OCC + """, s AS (SELECT DISTINCT work, year(date)::BIGINT AS year FROM occ), f AS (SELECT work, min(year) AS y0 FROM s GROUP BY 1)
SELECT year, count(*) AS works, count(*) FILTER (year = y0) AS new_works FROM s JOIN f USING (work) GROUP BY 1""")
def novelty_by_year(spark, sf_dir):
    return P.novelty_by_year(occurrences(spark, sf_dir).withColumn("year", F.year("date").cast("long")), "work", "year")


@register("histogram_year_month", OCC + " SELECT year(date)::BIGINT AS year, month(date)::BIGINT AS month, count(*) AS n, count(DISTINCT concert) AS concerts FROM occ GROUP BY ALL")
def histogram_year_month(spark, sf_dir):
    occ = occurrences(spark, sf_dir).select(F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"), "concert")
    nights = occ.groupBy("year", "month", "concert").agg(F.count("*").alias("k"))
    return nights.groupBy("year", "month").agg(F.sum("k").alias("n"), F.count("*").alias("concerts"))


@register("pair_cooccurrence", "WITH s AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS w FROM lineitem) SELECT a.w AS work_a, b.w AS work_b, count(*) AS n FROM s a JOIN s b ON a.c = b.c AND a.w < b.w GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 20")
def pair_cooccurrence(spark, sf_dir):
    """The top-20 report of pairs."""
    return P.pair_cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 20)


@register("pair_counts", "WITH s AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS w FROM lineitem) SELECT a.w AS work_a, b.w AS work_b, count(*) AS n FROM s a JOIN s b ON a.c = b.c AND a.w < b.w GROUP BY ALL")
def pair_counts(spark, sf_dir):
    return P.pair_cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def typed_lines(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))


SEQ = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@register("shape_histogram", """WITH r AS (SELECT l_orderkey, coalesce(p_type, '?') AS form, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT l_orderkey, string_agg(form, ' > ' ORDER BY i) AS shape FROM r WHERE i <= 4 AND size >= 2 GROUP BY 1) SELECT shape, count(*) AS n FROM s GROUP BY 1""")
def shape_histogram(spark, sf_dir):
    return P.shapes(typed_lines(spark, sf_dir), "l_orderkey", "p_type", SEQ)


@register("concerto_before_symphony", """WITH e AS (SELECT l_orderkey, min(CASE WHEN lower(p_type) LIKE '%promo%' THEN l_linenumber END) AS p1, min(CASE WHEN lower(p_type) LIKE '%standard%' THEN l_linenumber END) AS p2 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT count(*) AS both, count(*) FILTER (p1 < p2) AS before FROM e WHERE p1 IS NOT NULL AND p2 IS NOT NULL""")
def concerto_before_symphony(spark, sf_dir):
    """The kinds are two part types: promo before standard."""
    kind = F.lower("p_type")
    return P.first_before(typed_lines(spark, sf_dir), "l_orderkey", F.col("l_linenumber"), kind.contains("promo"), kind.contains("standard"))


def regional(spark, sf_dir):
    """Occurrences with the region of the customer as corpus."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "r_name")
    who = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "r_name")  # nations are 25
    nights = table(spark, sf_dir, "orders").join(who, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("r_name").alias("corpus"))
    return table(spark, sf_dir, "lineitem").join(nights, F.col("o_orderkey") == F.col("l_orderkey")).select("corpus", F.col("l_partkey").alias("work"))


REGIONAL = "WITH o AS (SELECT r_name AS corpus, l_partkey AS work FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


@register("corpus_compare_jaccard", REGIONAL + f""", n AS (SELECT work, count(*) FILTER (corpus = 'ASIA') AS na, count(*) FILTER (corpus = 'EUROPE') AS nb FROM o GROUP BY 1), m AS (SELECT * FROM n WHERE na > 0 OR nb > 0),
s AS (SELECT count(*) FILTER (na > 0) AS works_a, count(*) FILTER (nb > 0) AS works_b, count(*) FILTER (na > 0 AND nb > 0) AS shared, count(*) AS either, sum(na) FILTER (nb > 0) AS sa, sum(nb) FILTER (na > 0) AS sb, sum(na) AS ta, sum(nb) AS tb FROM m)
SELECT works_a, works_b, shared, works_a - shared AS only_a, works_b - shared AS only_b, {R4('shared / either::DOUBLE')} AS jaccard, {R4('sa / ta::DOUBLE')} AS mass_shared_a, {R4('sb / tb::DOUBLE')} AS mass_shared_b FROM s""")
def corpus_compare_jaccard(spark, sf_dir):
    return P.compare_corpora(regional(spark, sf_dir), "corpus", "work", "ASIA", "EUROPE")


@register("composer_delta", REGIONAL + f""", n AS (SELECT p_brand AS composer, count(*) FILTER (corpus = 'ASIA') AS na, count(*) FILTER (corpus = 'EUROPE') AS nb FROM o JOIN part ON p_partkey = work GROUP BY 1), t AS (SELECT sum(na) AS ta, sum(nb) AS tb FROM n)
SELECT composer, na, nb, {R2('100 * na / ta::DOUBLE')} AS share_a, {R2('100 * nb / tb::DOUBLE')} AS share_b, {R2('100 * nb / tb::DOUBLE - 100 * na / ta::DOUBLE')} AS delta FROM n, t WHERE na >= 15 AND nb >= 15""")
def composer_delta(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("composer"))
    return P.share_delta(regional(spark, sf_dir).join(part, "work"), "corpus", "composer", "ASIA", "EUROPE")


@register("concert_coverage", COUNTS_SQL + f""", r AS (SELECT work, row_number() OVER (ORDER BY n DESC, work) AS position FROM idx),
c AS (SELECT l_orderkey, top_n, bool_and(position <= top_n) AS hit, avg((position <= top_n)::INT) AS share FROM lineitem JOIN r ON work = l_partkey, (SELECT unnest([100, 200, 500, 1000, 2000])::BIGINT AS top_n) GROUP BY ALL)
SELECT top_n, {R2('100 * count(*) FILTER (hit) / count(*)::DOUBLE')} AS full_percent, {R4('avg(share)')} AS mean_share FROM c GROUP BY 1""")
def concert_coverage(spark, sf_dir):
    ranks = rank_and_rarity(counts(spark, sf_dir), "work")
    occ = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("concert"), F.col("l_partkey").alias("work"))
    return P.concert_coverage(occ, ranks, "concert", "work", [100, 200, 500, 1000, 2000])


@register("corpus_baseline", COUNTS_SQL + f""", r AS (SELECT work, n, row_number() OVER (ORDER BY n DESC, work) AS position FROM idx), o AS (SELECT n, position FROM lineitem JOIN r ON work = l_partkey)
SELECT list_sort(list(position))[len(list(position)) // 2 + 1] AS median_rank, {R4('avg(position)')} AS mean_rank, {R4('100 * count(*) FILTER (n <= 20) / count(*)::DOUBLE')} AS rare_percent, {R4('avg(n)')} AS mean_count FROM o""")
def corpus_baseline(spark, sf_dir):
    """Over occurrences: a work with n occurrences weighs n."""
    r = rank_and_rarity(counts(spark, sf_dir), "work")
    weighted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work")).join(r, "work")
    median = C.median_rank(counts(spark, sf_dir))
    rest = weighted.agg(rounded(F.avg("position")).alias("mean_rank"), rounded(ratio(100 * F.count_if(F.col("n") <= 20), F.count("*"))).alias("rare_percent"), rounded(F.avg("n")).alias("mean_count"))
    return median.join(F.broadcast(rest))


@register("artist_profile", COUNTS_SQL + f""", r AS (SELECT work, n, row_number() OVER (ORDER BY n DESC, work) AS position FROM idx),
a AS (SELECT s_name AS artist, l_orderkey, l_partkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE regexp_matches(s_name, '(?i)00[1-9]$')),
j AS (SELECT a.*, n, position FROM a JOIN r ON work = l_partkey)
SELECT artist, count(DISTINCT l_orderkey) AS concerts, count(*) AS works, count(DISTINCT l_partkey) AS unique_works, list_sort(list(position))[len(list(position)) // 2 + 1] AS median_rank, {R4('avg(position)')} AS mean_rank, {R4('100 * count(*) FILTER (position <= 100) / count(*)::DOUBLE')} AS top100_percent FROM j GROUP BY 1""")
def artist_profile(spark, sf_dir):
    ranks = rank_and_rarity(counts(spark, sf_dir), "work")
    who = table(spark, sf_dir, "supplier").filter(F.col("s_name").rlike("(?i)00[1-9]$")).select("s_suppkey", F.col("s_name").alias("artist"))
    lines = table(spark, sf_dir, "lineitem").join(who, F.col("s_suppkey") == F.col("l_suppkey"))
    j = lines.join(ranks, F.col("work") == F.col("l_partkey"))
    main = j.groupBy("artist").agg(F.countDistinct("l_orderkey").alias("concerts"), F.count("*").alias("works"), F.countDistinct("l_partkey").alias("unique_works"), rounded(F.avg("position")).alias("mean_rank"), rounded(ratio(100 * F.count_if(F.col("position") <= 100), F.count("*"))).alias("top100_percent"))
    return main.join(C.upper_median(j, "position", ["artist"]).withColumnRenamed("median", "median_rank"), "artist")


GENERIC = ["sonata", "concerto", "quartet", "quintet", "trio", "sextet", "octet", "suite", "fantasy"]


@register("work_key_votes", """WITH o AS (SELECT l_orderkey * 100000 + l_partkey AS idx, p_brand AS composer, CASE WHEN p_size % 3 = 0 THEN 'sonata' ELSE p_type END AS form, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size % 7)::VARCHAR END AS num,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'op.' || (p_size % 11)::VARCHAR END AS opus, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 's' || (p_partkey % 50)::VARCHAR END AS slug, p_name AS raw, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT *, CASE WHEN form IS NOT NULL AND num IS NOT NULL THEN composer || '|' || form || '#' || num END AS a, CASE WHEN opus IS NOT NULL THEN composer || '|' || opus END AS b, form = 'sonata' AS g FROM o),
v AS (SELECT b, a, g, count(*) AS n, min(idx) AS f FROM k WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), c AS (SELECT b, a AS vote FROM v QUALIFY row_number() OVER (PARTITION BY b ORDER BY g, n DESC, f) = 1)
SELECT p_partkey, count(*) AS n, min(CASE WHEN a IS NOT NULL AND g AND vote IS NOT NULL THEN vote WHEN a IS NOT NULL THEN a WHEN k.b IS NOT NULL THEN coalesce(vote, k.b) WHEN slug <> '' THEN composer || '|' || form || '|' || slug ELSE composer || '|?|' || substring(raw, 1, 30) END) AS work_key
FROM k LEFT JOIN c ON k.b = c.b GROUP BY 1""")
def work_key_votes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    occ = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        "p_partkey", (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("idx"), F.col("p_brand").alias("composer"),
        F.when(F.col("p_size") % 3 == 0, "sonata").otherwise(F.col("p_type")).alias("form"), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 7).cast("string")).alias("num"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("op."), (F.col("p_size") % 11).cast("string"))).alias("opus"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string"))).alias("slug"), F.col("p_name").alias("raw"),
    )
    return P.work_keys(occ, GENERIC).groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("workKey").alias("work_key"))
