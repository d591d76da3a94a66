"""Parsers and line operators on strings made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import parsers as P
from cadenza.functions.numbers import rounded
from cadenza.functions.text import is_empty_value, normalize_text, parse_opus, sort_name, work_number
from cadenza.operators import blocks as B
from cadenza.plans.catalogue import register
from cadenza.plans.pages import lines_of
from cadenza.session import table


@register("date_parse", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, CASE o_orderkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 WHEN 2 THEN 0.92 ELSE 0.97 END::DOUBLE AS confidence FROM orders""")
def date_parse(spark, sf_dir):
    """Order dates written in four forms and read back."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "yyyy.M.d")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "d MMM yyyy")).otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("년 "), F.date_format(d, "M"), F.lit("월 "), F.date_format(d, "d"), F.lit("일")))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.parse_date(raw).alias("p")).select("o_orderkey", "p.value", "p.confidence")


@register("time_parse", "SELECT event_id, strftime(ts, '%H:%M') AS value, CASE WHEN hour(ts) >= 13 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM events")
def time_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", P.parse_time(F.concat(F.lit("at "), F.date_format("ts", "H:mm"))).alias("p"))
    return e.select("event_id", "p.value", "p.confidence")


@register("price_parse", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1000 + p_partkey END::BIGINT AS price FROM part")
def price_parse(spark, sf_dir):
    n = 1000 + F.col("p_partkey")
    raw = F.when(F.col("p_partkey") % 10 == 0, F.lit("초대권")).otherwise(F.concat(F.format_number(n, 0), F.lit("원")))
    return table(spark, sf_dir, "part").select("p_partkey", P.parse_price(raw).alias("price"))


@register("seat_parse", "SELECT c_custkey, (c_custkey % 5 + 1)::INT AS floor, chr((65 + c_custkey % 26)::INT) AS block, (c_custkey % 200 + 1)::INT AS row, (c_custkey % 500 + 1)::INT AS number, 1.0::DOUBLE AS confidence FROM customer")
def seat_parse(spark, sf_dir):
    """Seat lines behind a gate line that must not be read as a seat."""
    k = F.col("c_custkey")
    raw = F.concat(F.lit("입장: 8층 2번 게이트 좌석: 객석 "), k % 5 + 1, F.lit("층 "), F.char(65 + k % 26), F.lit("구역 "), k % 200 + 1, F.lit("열 "), k % 500 + 1, F.lit("번"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.parse_seat(raw).alias("s")).select("c_custkey", "s.floor", "s.block", "s.row", "s.number", "s.confidence")


@register("opus_parse", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'op.' || p_size WHEN 1 THEN 'K.' || p_size ELSE NULL END AS opus, CASE WHEN p_size BETWEEN 1 AND 120 THEN p_size::VARCHAR END AS number FROM part")
def opus_parse(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Piece, Op. "), n)).when(k == 1, F.concat(F.lit("Piece KV "), n)).otherwise(F.lit("Piece"))
    return table(spark, sf_dir, "part").select("p_partkey", parse_opus(raw).alias("opus"), work_number(F.concat(F.lit("Piece No. "), n)).alias("number"))


@register("names_normalised", "SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[#._-]', ' ', 'g'), '\\s+', '', 'g') AS norm, false AS empty, s_name AS sorted FROM supplier")
def names_normalised(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", normalize_text(F.col("s_name"), compose=False).alias("norm"), is_empty_value(F.col("s_name")).alias("empty"), sort_name(F.col("s_name")).alias("sorted"))


@register("clusters_islands", r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT doc_id, i, length(t) BETWEEN 30 AND 90 AS hit, sum((length(t) > 450)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS stops FROM l),
h AS (SELECT *, lag(i) OVER w AS p, lag(stops) OVER w AS s FROM m WHERE hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum((p IS NULL OR i - p > 5 OR stops > s)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
e AS (SELECT doc_id, run, min(i) AS first, max(i) AS last, count(*) AS hits FROM r GROUP BY ALL)
SELECT doc_id, first::INT AS first, last::INT AS last, hits FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, first) = 1""")
def clusters_islands(spark, sf_dir):
    """Per document the run of lines of 30 to 90 characters with most of them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    n = F.length("t")
    return B.best_runs(lines, "doc_id", "i", n.between(30, 90), n > 450)


@register("line_dedup", f"""WITH l AS (SELECT page_id, {lines_of('html')} AS x FROM pages), e AS (SELECT page_id, list_transform(range(len(x)), lambda i: [{{'i': i, 'v': x[i + 1]}}]) AS e FROM l WHERE len(x) > 0),
k AS (SELECT page_id, unnest(list_reduce(e, lambda a, s: CASE WHEN list_contains(list_transform(a[-40:], lambda t: t.v), s[1].v) THEN a ELSE a || s END)) AS s FROM e)
SELECT page_id, CAST(s.i AS INTEGER) AS line_no, s.v AS line FROM k""")
def line_dedup(spark, sf_dir):
    """Lines of each page without those that equal one of the last 40 kept."""
    from cadenza.functions.text import html_lines

    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html_lines(F.col("html"))).alias("line_no", "line"))
    return B.dedup_recent(lines, "page_id", "line_no", "line")


@register("pii_flags", r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]') AS email, regexp_matches(text, '[0-9]{10,}') AS digits FROM documents""")
def pii_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]").alias("email"), F.col("text").rlike("[0-9]{10,}").alias("digits"))


@register("source_languages", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, floor(avg(n_chars) * 100.0 + 0.5) / 100.0 AS mean_chars FROM documents GROUP BY 1")
def source_languages(spark, sf_dir):
    """Categorical distribution of a collection."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), rounded(F.avg("n_chars"), 2).alias("mean_chars"))
