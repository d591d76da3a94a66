"""Regions, embedded data and images of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import pages as P
from cadenza.functions.text import html_lines
from cadenza.plans.catalogue import register
from cadenza.session import table

#: The lines of a piece of a page, as html_lines makes them.
LINES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b.*?</(?:script|style)>', '', 'g'), '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/td|/th|/ul|/ol|/table|/title)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[ \t\r\f\x{00A0}]+', ' ', 'g'), chr(10)), lambda v: trim(v, ' ')), lambda v: v <> '')"""



def lines_of(sql: str) -> str:
    return LINES.replace("{0}", sql)


@register("page_lines", f"WITH l AS (SELECT page_id, {lines_of('html')} AS x FROM pages) SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS line_no, unnest(x) AS line FROM l")
def page_lines(spark, sf_dir):
    """Lines of every page with their number."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html_lines(F.col("html"))).alias("line_no", "line"))


#: Paragraphs and bold texts reach to the next break or end of a paragraph; a paragraph that begins bold is read twice.
BEGIN, END, CAP = "<(?:p|b)>", "<br|</p>", 500


@register("page_regions", rf"""
WITH s AS (SELECT page_id, html, string_split_regex(html, '<(?:p|b)>') AS x FROM pages),
i AS (SELECT page_id, html, x, unnest(range(1, len(x))) AS i FROM s),
t AS (SELECT page_id, i, substr(html, CAST(list_sum(list_transform(x[1:i], lambda v: length(v))) + 3 * i + 1 AS BIGINT)) AS t FROM i),
r AS (SELECT page_id, i, CASE WHEN regexp_matches(t, '<br|</p>') THEN string_split_regex(t, '<br|</p>')[1] ELSE t[:500] END AS r FROM t),
l AS (SELECT page_id, i, {lines_of('r')} AS x FROM r),
o AS (SELECT page_id, i, generate_subscripts(x, 1) AS k, unnest(x) AS line FROM l),
f AS (SELECT page_id, line, min(i * 1000000 + k) AS at FROM o GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY at) - 1 AS INTEGER) AS line_no, line FROM f
""".replace(" AS at FROM o", " AS pos FROM o").replace("ORDER BY at)", "ORDER BY pos)"))
def page_regions(spark, sf_dir):
    """Lines of the regions of every page, each once."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(P.region_lines(F.col("html"), BEGIN, END, CAP)).alias("line_no", "line"))


SITE = "https://www.example.com"
SQL_IMAGES = f"[CASE WHEN page_id % 3 = 0 THEN '{SITE}/i/' || page_id || '.png' ELSE 'https://cdn.example.com/' || page_id || '.jpg' END, 'x/' || (page_id % 10) || '?a=1&b=2']"


@register("embedded_pages", rf"""
SELECT page_id, html AS body, {SQL_IMAGES} AS images FROM pages WHERE page_id % 7 NOT IN (3, 5)
""".replace("html AS body", "sha256(html) AS body_sha256").replace(" AS images", "[1] AS image, 2 AS images"))
def embedded_pages(spark, sf_dir):
    """Pages wrapped as the data of a script, with quotes, escapes and braces in their strings; every seventh is cut short, another is no JSON."""
    k = F.col("page_id")
    image = F.when(k % 3 == 0, F.concat(F.lit("/i/"), k, F.lit(".png"))).otherwise(F.concat(F.lit("//cdn.example.com/"), k, F.lit(".jpg")))
    tags = F.concat(F.lit("<img alt=\"}{\" src='"), image, F.lit("'><IMG src=\" x/"), k % 10, F.lit("?a=1&amp;b=2 \"><img src=\"/logo.SVG\"><img src='"), image, F.lit("'>"))
    section = lambda name, value: F.struct(F.lit(name).alias("Name"), value.alias("Value"))
    data = F.to_json(F.struct(F.struct(F.lit("\\\"}").alias("odd")).alias("Meta"), F.array(section("공연소개", tags), section("아티스트", F.lit("<img src='/no.png'>")), section("공연정보", F.col("html"))).alias("Details")))
    cut = F.when(k % 7 == 3, F.expr("substring(data, 1, length(data) - 2)")).when(k % 7 == 5, F.concat(F.lit("{no json"), F.expr("substring(data, 2)"))).otherwise(F.col("data"))
    page = F.concat(F.lit("<script>data: {\"not\": 1}; new V({ el: \"#body\", data: "), cut, F.lit(" }, go: {} });</script>"))
    whole = table(spark, sf_dir, "pages").select("page_id", "html", data.alias("data")).select("page_id", F.when(k % 7 == 3, F.regexp_replace(page, r"(?s) \}, go: \{\} \}\);</script>$", "")).otherwise(page).alias("page"))
    # generators keep what is read once from being read again for each use
    read = whole.select("page_id", F.explode(F.array(P.embedded_json(F.col("page"), 'el: "#body"', "data: {"))).alias("json")).filter("json IS NOT NULL")
    got = read.select("page_id", F.explode(F.array(F.from_json("json", f"Details {P.DETAILS}"))).alias("d"))
    images = P.section_images(F.col("d.Details"), SITE)
    body = F.get(F.filter("d.Details", lambda d: d["Name"] == "공연정보"), F.lit(0))["Value"]
    return got.select("page_id", F.sha2(body, 256).alias("body_sha256"), F.get(images, F.lit(0)).alias("image"), F.size(images).alias("images"))
