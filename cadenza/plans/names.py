"""Composer names and two-stage work matching, on names made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.numbers import rounded
from cadenza.functions.text import NOISE
from cadenza.operators import matching as M
from cadenza.operators import names as N
from cadenza.operators.programme_parser import line_shares, parse_programmes
from cadenza.operators.selection import match_route
from cadenza.plans.catalogue import register
from cadenza.session import dealt, table

#: Digits to letters: a number as a surname with accents, and as a Hangul name.
LETTERS, SYLLABLES = "abcéfghïjk", "가나다라마바사아자차"


def surname(k):
    return F.concat(F.lit("Mo"), F.translate(k.cast("string"), "0123456789", LETTERS))


def hangul(k):
    return F.concat(F.lit("하"), F.translate(k.cast("string"), "0123456789", SYLLABLES))


def people(spark, sf_dir):
    """Written names: a colour and a surname, with a particle, brackets or alone."""
    k = F.col("p_partkey")
    given, last = F.initcap(F.substring_index("p_name", " ", 1)), surname(k % 700)
    name = F.when(k % 4 == 0, F.concat_ws(" ", given, F.lit("van"), last)).when(k % 4 == 1, F.concat_ws(" ", given, last)).when(k % 4 == 2, F.concat_ws(" ", given, F.lit("(elder)"), last)).otherwise(last)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def manual(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").filter(s % 3 == 0).select(F.lower(surname(s * 7 % 900)).alias("alias"), s)
    return rows.groupBy("alias").agg(F.concat(F.lit("S"), F.min("s_suppkey").cast("string")).alias("composer"))


def index(spark, sf_dir):
    return N.surname_index(people(spark, sf_dir), "name", "p_partkey", manual(spark, sf_dir))


def korean(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(hangul(F.col("n_nationkey")).alias("alias"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("composer"))


SN = "'Mo' || translate(CAST({0} AS VARCHAR), '0123456789', 'abcéfghïjk')"
HN = "'하' || translate(CAST({0} AS VARCHAR), '0123456789', '가나다라마바사아자차')"
INDEX = f"""
man AS (SELECT lower({SN.format('s_suppkey * 7 % 900')}) AS alias, 'S' || min(s_suppkey) AS composer FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1),
ppl AS (SELECT p_partkey AS pos, {SN.format('p_partkey % 700')} AS own, p_partkey % 4 = 0 AS parted FROM part),
frm AS (SELECT pos, own, 0 AS form, own AS t FROM ppl UNION ALL SELECT pos, own, 1, 'van ' || own FROM ppl WHERE parted),
can AS (SELECT pos, coalesce(arg_max(composer, form) FILTER (composer IS NOT NULL), min(own)) AS composer FROM frm LEFT JOIN man ON alias = lower(t) GROUP BY pos),
kys AS (SELECT pos, form, 0 AS variant, lower(t) AS key FROM frm UNION ALL SELECT pos, form, 1, strip_accents(lower(t)) FROM frm),
fst AS (SELECT key, composer FROM kys JOIN can USING (pos) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos, form, variant) = 1),
idx AS (SELECT key, composer FROM fst WHERE key NOT IN (SELECT alias FROM man) UNION ALL SELECT alias, composer FROM man)"""


@register("surname_index", f"WITH {INDEX} SELECT key, composer FROM idx")
def surname_index(spark, sf_dir):
    return index(spark, sf_dir)


NAMED = f"""
nam AS (SELECT o_orderkey, o_orderkey % 6 AS c, {SN.format('o_custkey % 900')} AS sn, {HN.format('o_custkey % 40')} AS hn, o_custkey % 40 AS h FROM orders),
got AS (SELECT o_orderkey, c, h, sn, hn, coalesce(idx.composer, sn) AS base, idx.composer IS NULL AS strange, h < 25 AS known FROM nam LEFT JOIN idx ON key = lower(sn))"""


@register("composer_names", f"""WITH {INDEX}, {NAMED}
SELECT o_orderkey, CASE WHEN c = 0 AND base = 'S0' THEN 'R. S0' WHEN c IN (0, 1) THEN base WHEN c = 2 THEN coalesce(van.composer, base)
  WHEN c = 3 THEN CASE WHEN known THEN 'N' || h ELSE 'KO:' || hn[2:] END WHEN c = 4 THEN CASE WHEN known THEN 'N' || h ELSE base END END AS composer,
  CASE WHEN c < 3 THEN 0.85 WHEN c = 3 THEN CASE WHEN known THEN 1.0 ELSE 0.3 END WHEN c = 4 THEN CASE WHEN known THEN 0.9 ELSE 0.85 END ELSE 0.0 END::DOUBLE AS confidence
FROM got LEFT JOIN idx van ON van.key = 'van ' || lower(sn)""")
def composer_names(spark, sf_dir):
    """Names of a Latin and a Hangul column: initials, edges, particles, one column alone, both, neither."""
    c, k = F.col("o_orderkey") % 6, F.col("o_custkey")
    last, ko = surname(k % 900), hangul(k % 40)
    latin = F.when(c == 0, F.concat(F.lit("R. "), last)).when(c == 1, F.concat(F.lit(" ;"), F.upper(last), F.lit("., "))).when(c == 2, F.concat(F.lit("Jo van "), last)).when(c == 4, last).when(c == 5, F.lit(" - "))
    korean_name = F.when(c == 3, F.concat(F.substring(ko, 1, 1), F.lit(" · "), F.expr("substring(ko, 2)"))).when(c == 4, F.concat(F.lit("옛 "), F.col("ko"))).when(c == 5, F.lit(""))
    rows = table(spark, sf_dir, "orders").withColumn("ko", ko).select("o_orderkey", latin.alias("en"), korean_name.alias("ko"))
    kin = table(spark, sf_dir, "supplier").filter("s_suppkey < 2").select(F.lit("S0").alias("base"), F.when(F.col("s_suppkey") == 0, "r.").otherwise("j.").alias("initials"), F.col("s_suppkey").alias("at"), F.concat(F.when(F.col("s_suppkey") == 0, "R. ").otherwise("J. "), F.lit("S0")).alias("composer"))
    out = N.norm_composers(rows, "en", "ko", korean(spark, sf_dir), index(spark, sf_dir).withColumnRenamed("key", "alias"), kin)
    return out.select("o_orderkey", "composer", "confidence")


@register("composers_in_lines", f"""WITH {INDEX}, {NAMED}
SELECT o_orderkey, CASE WHEN c IN (1, 3) AND known THEN 'N' || h ELSE base END AS composer, CASE WHEN c IN (1, 3) AND known THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence,
  CAST(CASE c WHEN 0 THEN 14 WHEN 1 THEN 3 WHEN 3 THEN CASE WHEN known THEN 0 ELSE length(hn) + 2 END ELSE 19 END AS INTEGER) AS start,
  CAST(CASE c WHEN 0 THEN 14 + length(sn) WHEN 1 THEN 3 + length(hn) WHEN 3 THEN CASE WHEN known THEN length(hn) ELSE length(hn) + 2 + length(sn) END ELSE 19 + length(sn) END AS INTEGER) AS stop
FROM got WHERE (c = 0 AND NOT strange) OR (c = 1 AND known) OR (c = 3 AND (known OR NOT strange)) OR (c = 4 AND NOT strange)""")
def composers_in_lines(spark, sf_dir):
    """Lines of programmes that name a composer in Latin or Hangul letters, or nobody."""
    c, k = F.col("o_orderkey") % 6, F.col("o_custkey")
    last, ko = surname(k % 900), hangul(k % 40)
    line = F.when(c == 0, F.concat(F.lit("12 Zz, op. 3, "), last)).when(c == 1, F.concat(F.lit("곡: "), ko, F.lit(" 2번"))).when(c == 2, F.concat(F.lit("새"), ko))
    line = line.when(c == 3, F.concat(ko, F.lit(", "), last)).when(c == 4, F.concat(F.lit("for piano by Xerxe-"), last))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return N.find_composers(rows, "o_orderkey", "line", korean(spark, sf_dir), index(spark, sf_dir))


#: Forms of the works, in the two spellings of lines.
WORK_FORMS = ("symphony", "piano concerto", "string quartet", "violin sonata", "prelude", "waltz")
KOREAN_FORMS = ("교향곡", "피아노 협주곡", "현악 사중주", "바이올린 소나타", "전주곡", "왈츠")


def works(spark, sf_dir):
    """Works of some hundred composers: form, ordinal, catalogue number and words."""
    k = F.col("p_partkey")
    title = F.concat(F.element_at(F.array(*map(F.lit, WORK_FORMS)), (k % 6 + 1).cast("int")), F.lit(" No. "), k % 9 + 1, F.lit(", op. "), k % 140, F.lit(" "), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size") % 20).alias("composer"), F.col("p_partkey").alias("work"), title.alias("known"), "p_name")


@register("matched_works", r"""
WITH p AS (SELECT p_partkey AS work, p_brand || '/' || (p_size % 20) AS composer, p_partkey % 6 AS f, (p_partkey % 9 + 1) AS n, (p_partkey % 140) AS o, p_name,
    ['symphony', 'piano concerto', 'string quartet', 'violin sonata', 'prelude', 'waltz'][p_partkey % 6 + 1] || ' No. ' || (p_partkey % 9 + 1) || ', op. ' || (p_partkey % 140) || ' ' || p_name AS known FROM part),
l AS (SELECT o_orderkey, o_orderkey % 5 AS c, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE composer END AS composer, f, n, o, CASE o_orderkey % 5 WHEN 0 THEN known WHEN 1 THEN ['교향곡', '피아노 협주곡', '현악 사중주', '바이올린 소나타', '전주곡', '왈츠'][f + 1] || ' ' || n || '번 ' || p_name
    WHEN 2 THEN ['symphony', 'piano concerto', 'string quartet', 'violin sonata', 'prelude', 'waltz'][f + 1] || ' ' || split_part(p_name, ' ', 1) WHEN 3 THEN 'op. ' || o || ' new ' || p_name ELSE known END AS title FROM orders JOIN p ON work = o_custkey),
w AS (SELECT ['the','a','an','of','in','for','and','or','op','no','nr','with','de','la','le','les','il','un','une','piano','violin','cello','viola','flute','oboe','clarinet','horn','trumpet','solo','duo','major','minor','sharp','flat','dur','moll','from','etc'] AS stop),
a AS (SELECT DISTINCT composer, title, CASE WHEN c IN (0, 3) THEN o END AS o, CASE WHEN c < 3 THEN f END AS f, CASE WHEN c < 2 THEN n END AS n FROM l WHERE composer IS NOT NULL),
fa AS (SELECT a.*, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9가-힣]+'), lambda x: length(x) > 1 AND NOT list_contains(stop, x)) AS t FROM a, w),
fb AS (SELECT p.*, list_filter(regexp_split_to_array(lower(known), '[^a-z0-9가-힣]+'), lambda x: length(x) > 1 AND NOT list_contains(stop, x)) AS u FROM p, w),
j AS (SELECT fa.composer, fa.title, work, t, u, (CASE WHEN fa.o = fb.o THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN fa.f = fb.f THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN fa.n = fb.n THEN 0.15::DOUBLE ELSE 0 END) AS s,
    (CASE WHEN fa.o IS NULL THEN 0 ELSE 0.5::DOUBLE END) + (CASE WHEN fa.f IS NULL THEN 0 ELSE 0.2::DOUBLE END) + (CASE WHEN fa.n IS NULL THEN 0 ELSE 0.15::DOUBLE END) + 0.2::DOUBLE AS total FROM fa JOIN fb ON fa.composer = fb.composer),
v AS (SELECT *, len(list_intersect(t, u)) AS shared, len(list_distinct(t || u)) AS joint, len(u) AS m, (1::BIGINT << len(u)) - 1 AS ones,
    list_transform(t, lambda x: list_sum(list_transform(range(len(u)), lambda i: CASE WHEN u[i + 1] = x THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT) AS pos FROM j),
q AS (SELECT *, m - bit_count(list_reduce(list_prepend(ones, pos), lambda st, x: ((st + (st & x)) | (st & ~x)) & ones)) AS common FROM v),
z AS (SELECT composer, title, work, round((s + 0.2 * (coalesce(shared::DOUBLE / nullif(joint, 0), 0) + coalesce(2.0 * common / nullif(len(t) + m, 0), 0)) / 2) / total, 9) AS score FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY composer, title ORDER BY score DESC, work) AS k FROM z),
b AS (SELECT composer, title, max(CASE WHEN k = 1 THEN score END) AS score, max(CASE WHEN k = 1 THEN work END) AS best, max(CASE WHEN k = 2 THEN score END) AS nxt FROM r GROUP BY ALL)
SELECT o_orderkey, CASE WHEN score >= 0.85 THEN best END AS work, floor(score * 1e6 + 0.5) / 1e6 AS score,
  CASE WHEN l.composer IS NULL THEN 'review' WHEN score >= 0.85 AND NOT coalesce(nxt > round(score - 0.02, 9), false) THEN 'matched' WHEN score >= 0.6 THEN 'ask' ELSE 'composer-only' END AS route
FROM l LEFT JOIN b ON l.composer = b.composer AND l.title = b.title
""")
def matched_works(spark, sf_dir):
    """Programme lines against works: whole titles, Korean ones, a form and a word, a number with strange words, nobody known."""
    w, c = works(spark, sf_dir), F.col("o_orderkey") % 5
    k = F.col("work")
    form = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % 6 + 1).cast("int"))
    title = F.when(c == 1, F.concat(form(KOREAN_FORMS), F.lit(" "), k % 9 + 1, F.lit("번 "), F.col("p_name"))).when(c == 2, F.concat_ws(" ", form(WORK_FORMS), F.substring_index("p_name", " ", 1)))
    title = title.when(c == 3, F.concat(F.lit("op. "), k % 140, F.lit(" new "), F.col("p_name"))).otherwise(F.col("known"))
    lines = table(spark, sf_dir, "orders").join(w, F.col("o_custkey") == k).select("o_orderkey", F.when(c != 4, F.col("composer")).alias("composer"), title.alias("title"))
    out = M.match_works(lines, w, "composer", "title", "work", "known")
    return out.select("o_orderkey", "work", rounded(F.col("score"), 6).alias("score"), match_route(F.col("composer"), F.col("work"), F.col("near")).alias("route"))


@register("programme_pages", f"""
WITH k AS (SELECT o_orderkey, n_name, 'NATION_' || (o_orderkey % 25) AS other, o_orderkey % 9 + 1 AS a, o_orderkey % 90 + 1 AS b, o_custkey % 70 + 1 AS c, o_custkey % 600 + 1 AS d, {HN.format('n_nationkey')} AS hn FROM orders JOIN nation ON n_nationkey = o_custkey % 25)
SELECT o_orderkey, 1 AS seq, n_name AS composer, 0.9::DOUBLE AS confidence, 'op.' || b AS opus, 'Symphony No. ' || a || ', Op. ' || b AS title, hn || ' 교향곡 ' || a || '번 작품 ' || b AS title_ko, 'Kim Soloist' AS soloist, 'I. Allegro' AS movements, false AS after_break FROM k
UNION ALL SELECT o_orderkey, 2, other, 0.7, 'op.' || c, 'Violin Concerto Op. ' || c, NULL, NULL, '', false FROM k
UNION ALL SELECT o_orderkey, 3, n_name, 0.9, 'K.' || d, 'Sonata KV ' || d, NULL, NULL, '', true FROM k""")
def programme_pages(spark, sf_dir):
    """Whole pages: a block under its heading, a work in two scripts with a movement, a composer as a heading, an intermission, and lines after the block."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nation = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("n"), hangul(F.col("n_nationkey")).alias("hn"))
    other = F.concat(F.lit("NATION_"), k % 25)
    a, b = k % 9 + 1, k % 90 + 1
    lines = F.array(
        F.lit("An evening in town"), F.lit("PROGRAM"), F.concat("n_name", F.lit(": Symphony No. "), a, F.lit(", Op. "), b, F.lit(" / Kim Soloist")), F.concat("hn", F.lit(" 교향곡 "), a, F.lit("번 작품 "), b), F.lit("I. Allegro"),
        F.concat(other, F.lit(" (1801-1866)")), F.concat(F.lit("Violin Concerto Op. "), c % 70 + 1), F.lit("INTERMISSION (15 min)"), F.concat("n_name", F.lit(" - Sonata KV "), c % 600 + 1), F.lit("출연"), F.concat(other, F.lit(": Symphony No. 7")),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = line_shares(orders, 11)
    pages = dealt(orders, n, "o_orderkey").join(F.broadcast(nation), c % 25 == F.col("n")).select("o_orderkey", F.posexplode(lines).alias("i", "line"))  # 25 rows
    sure = F.lit(0.9).alias("confidence")
    names = nation.select(F.col("n_name").alias("alias"), F.col("n_name").alias("name"), sure).unionByName(nation.select(F.col("hn").alias("alias"), F.col("n_name").alias("name"), sure))
    works = parse_programmes(pages, "o_orderkey", "i", "line", names, "(?i)Symphon|Concerto|Sonata|교향곡|협주곡", NOISE, blocks=True, n=n)
    return works.select("o_orderkey", "seq", "composer", "confidence", "opus", "title", "title_ko", "soloist", F.array_join("movements", ",").alias("movements"), "after_break")
