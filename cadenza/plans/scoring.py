"""Item scoring, inventories and parser queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import rounded
from cadenza.operators import scoring as S
from cadenza.operators import tickets as T
from cadenza.operators.programme_parser import line_shares, parse_programmes
from cadenza.operators.selection import in_scope
from cadenza.plans.catalogue import register
from cadenza.session import dealt, shares, table


def r4(x):
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


RUNS = "WITH r AS (SELECT o_custkey AS file, o_orderkey AS run, o_orderpriority AS model, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' END AS error, o_orderstatus AS value FROM orders)"


def runs(spark, sf_dir):
    """Orders as runs over files: the customer is the file, the priority the model."""
    error = F.when(F.col("o_orderkey") % 9 == 0, "failed")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("model"), error.alias("error"), F.col("o_orderstatus").alias("value"), "o_totalprice")


@register("exact_scores", "SELECT a.l_orderkey, count(*) FILTER (a.l_returnflag = b.l_returnflag) AS equal, count(*) AS n FROM lineitem a JOIN (SELECT l_orderkey, CASE WHEN min(l_linenumber) % 2 = 0 THEN NULL ELSE min(l_returnflag) END AS l_returnflag FROM lineitem GROUP BY 1) b ON a.l_orderkey = b.l_orderkey GROUP BY 1")
def exact_scores(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    truth = lines.groupBy("l_orderkey").agg(F.when(F.min("l_linenumber") % 2 != 0, F.min("l_returnflag")).alias("truth"))
    return lines.join(truth, "l_orderkey").groupBy("l_orderkey").agg(F.count_if(S.exact(F.col("truth"), F.col("l_returnflag"))).alias("equal"), F.count("*").alias("n"))


@register("representative_runs", RUNS + " SELECT file, run, value FROM r QUALIFY row_number() OVER (PARTITION BY file ORDER BY run) = 1")
def representative_runs(spark, sf_dir):
    return S.representative(runs(spark, sf_dir), "file", "run").select("file", "run", "value")


@register("scope_split", f"SELECT CASE WHEN starts_with(source, 'src1') THEN 'out' ELSE 'in' END AS scope, count(*) AS n, {r4('count(*) FILTER (quality = 1) / count(*)::DOUBLE')} AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def scope_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("ok", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return S.headline(d, in_scope(F.col("source"), ["src1"]), "ok")


@register("model_inventory", RUNS + " SELECT model, count(DISTINCT file) AS files, count(*) AS records, count(*) FILTER (error IS NULL) AS ok, count(error) AS errors FROM r GROUP BY 1")
def model_inventory(spark, sf_dir):
    return S.inventory(runs(spark, sf_dir), "model", "file", "error")


@register("provenance", RUNS + " SELECT file, count(DISTINCT value) > 1 AS mixed, count(*) FILTER (value = 'O') < count(*) AS stale FROM r GROUP BY 1")
def provenance(spark, sf_dir):
    return S.provenance(runs(spark, sf_dir), "file", "value", F.lit("O"))


@register("not_numbers", "SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN NULL ELSE c_nationkey::VARCHAR END AS v FROM customer) WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL")
def not_numbers(spark, sf_dir):
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.col("c_mktsegment")).when(k != 1, F.col("c_nationkey").cast("string"))
    return S.not_numbers(table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")), "v")


@register("latency_shares", "SELECT event_id, floor((CASE WHEN event_type = 'click' THEN 0 ELSE value END + 1000 / (event_id % 20 + 1)::DOUBLE) * 100 + 0.5) / 100 AS ms FROM events")
def latency_shares(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", rounded(S.latency_share(F.col("value"), F.col("event_type") == "click", F.lit(1000), F.col("event_id") % 20 + 1), 2).alias("ms"))


@register("token_costs", "SELECT o_orderpriority AS model, sum(o_custkey) AS prompt, floor(sum(CASE WHEN o_orderpriority NOT LIKE '1%' THEN (o_orderkey % 50 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 7 END) * 3 + o_custkey * 2 END) + 0.5)::BIGINT AS cost FROM orders GROUP BY 1")
def token_costs(spark, sf_dir):
    """Sums per model; one model has no price."""
    priced = lambda p: F.when(~F.col("o_orderpriority").startswith("1"), F.lit(p))
    cost = S.token_cost(F.col("o_custkey"), F.col("o_orderkey") % 50, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7), priced(2), priced(3))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.sum("o_custkey").alias("prompt"), F.sum(cost).cast("long").alias("cost"))


@register("ranking_metrics", f"""WITH g AS (SELECT l_suppkey AS q, l_partkey AS k, sum(l_quantity) AS s FROM lineitem GROUP BY ALL), p AS (SELECT q, k, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS place FROM g), r AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05),
h AS (SELECT r.q, count(*) AS n, count(*) FILTER (place <= 50) AS found, sum(CASE WHEN place <= 8 THEN 1 / log2(place + 1) ELSE 0 END) AS gain FROM r JOIN p USING (q, k) GROUP BY 1)
SELECT q, {r4('found / n::DOUBLE')} AS recall, {r4('gain / (SELECT sum(1 / log2(i + 1)) FROM generate_series(1, least(n, 8)) t(i))')} AS ndcg FROM h""")
def ranking_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"q": F.col("l_suppkey"), "k": F.col("l_partkey")})
    g = li.groupBy("q", "k").agg(F.sum("l_quantity").alias("s"))
    ranked = g.select("q", "k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "k")).alias("place"))
    return S.ranking_metrics(ranked, li.filter("l_returnflag = 'R' AND l_discount > 0.05").select("q", "k").distinct(), "q", "k")


@register("batch_readings", """WITH e AS (SELECT o_orderkey AS b, count(*) AS size FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), a AS (SELECT l_orderkey AS b, l_linenumber - CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS i FROM lineitem),
k AS (SELECT e.b, size, i, count(i) AS k, i BETWEEN 0 AND size - 1 AS good FROM e LEFT JOIN a USING (b) GROUP BY e.b, size, i),
s AS (SELECT b, size, sum(k) AS answers, sum(CASE WHEN NOT good THEN k ELSE 0 END) AS outside, sum(CASE WHEN good THEN k - 1 ELSE 0 END) AS repeated, size - count(*) FILTER (good) AS missing FROM k GROUP BY b, size)
SELECT b, answers::BIGINT AS answers, outside::BIGINT AS outside, repeated::BIGINT AS repeated, missing::BIGINT AS missing, CASE WHEN outside = 0 AND repeated = 0 AND missing = 0 THEN 'index' WHEN answers = size THEN 'position' ELSE 'reject' END AS reading FROM s""")
def batch_readings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    li = dealt(li.select("l_orderkey", "l_linenumber"), shares(li), "l_orderkey")
    expected = li.groupBy(F.col("l_orderkey").alias("b")).agg(F.count("*").alias("size"))
    i = F.col("l_linenumber") - F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(1)
    return S.batch_check(li.select(F.col("l_orderkey").alias("b"), i.alias("i")), "b", "i", expected, "size")


@register("second_passes", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (coalesce(quality, 0) + coalesce(1 - toxic, 0) + ((doc_id * 37) % 101) / 100.0) / (1 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) < 0.8 OR lang = 'es' OR n_chars = 0")
def second_passes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sure = F.array(F.col("quality").cast("double"), (1 - F.col("toxic")).cast("double"), ((F.col("doc_id") * 37) % 101) / 100.0)
    return d.filter(S.needs_second_pass(sure, F.nullif("lang", F.lit("es")), F.nullif("n_chars", F.lit(0)))).select("doc_id")


@register("name_votes", """WITH v AS (SELECT p_brand AS composer, p_type AS name, count(*) FILTER (p_size = 1) AS firm, count(*) AS n FROM part GROUP BY ALL), w AS (SELECT p_brand AS composer, count(DISTINCT p_size) AS works FROM part GROUP BY 1),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY composer ORDER BY firm DESC, n DESC, name) = 1) SELECT composer, name FROM t JOIN w USING (composer) WHERE firm > 0 OR n >= greatest(2, 0.25 * works)""")
def name_votes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("composer"), F.col("p_type").alias("name"), (F.col("p_size") == 1).alias("strong"), "p_size")
    works = p.select("composer", "p_size").distinct().groupBy("composer").agg(F.count("*").alias("works"))
    return S.name_vote(p, works, "composer", "name", "strong")


@register("programme_works", """WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 = 0 AS brk, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
w AS (SELECT *, max(brk::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM l)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS seq, n_name AS composer, 'op.' || (o_orderkey % 1000) AS opus, after = 1 AS after_break FROM w WHERE NOT brk""")
def programme_works(spark, sf_dir):
    """Customers as pages of works by composers who are named like nations, with intermissions, read back."""
    nations = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")  # 25 rows
    line = F.when(F.col("o_orderkey") % 5 == 0, "INTERMISSION").otherwise(F.concat("n_name", F.lit(": Sonata, Op. "), (F.col("o_orderkey") % 1000).cast("string")))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    n = line_shares(orders)
    pages = dealt(orders, n, "o_custkey").join(dealt(c, n, "c_custkey"), F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", "o_orderkey", line.alias("line"))
    names = nations.select(F.col("n_name").alias("alias"), F.col("n_name").alias("name"), F.lit(0.9).alias("confidence"))
    works = parse_programmes(pages, "o_custkey", "o_orderkey", "line", names, "(?i)Sonata", "문의", n=n)
    return works.select("o_custkey", "seq", "composer", "opus", "after_break")


TICKET = T.Rules(
    venues=((r"(?i)grand\s*hall", "Grand Hall"), (r"(?i)hall", "Other Hall")), dates=(r"\d{4}\.\d{2}\.\d{2}", r"\d{4}-\d{2}-\d{2}"), times=(r"\d{1,2}:\d{2}",),
    gate="게이트", booking=r"^[A-Z]{2}\d{6,}$", grade="[A-Z]+석", price=r"\d[\d,]*원", free="초대",
)


@register("ticket_records", """SELECT o_orderkey, 'Grand Hall' AS venue, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y.%m.%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '19:30' END AS time,
 (o_orderkey % 3 + 1) || '층 ' || (o_orderkey % 20 + 1) || '열 ' || (o_orderkey % 30 + 1) || '번' AS seat, 'R석' AS grade, (o_orderkey % 90 + 10) || ',000원' AS price, '공연 ' || o_orderkey AS title, 0.6::DOUBLE AS sure FROM orders""")
def ticket_records(spark, sf_dir):
    """Orders as the printed lines of tickets, read back by rule."""
    k = F.col("o_orderkey")
    n = lambda m, plus: (k % m + plus).cast("string")
    lines = F.array(
        F.concat(F.lit("공연 "), k.cast("string")), F.lit("The GRAND HALL, main hall"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(k % 3 != 0, "19:30").otherwise("evening, doors open"), F.concat(F.lit("좌석: "), n(3, 1), F.lit("층 "), n(20, 1), F.lit("열 "), n(30, 1), F.lit("번")), F.lit("3번 게이트"), F.concat(F.lit("R석 "), n(90, 10), F.lit(",000원")), F.lit("AB1234567"),
    )
    page = table(spark, sf_dir, "orders").select(k, F.posexplode(lines).alias("at", "text"))
    page = page.withColumns({"confidence": F.lit(1.0), "height": F.when(F.col("at") == 0, 0.1).otherwise(0.05), "top": F.col("at") / 10})
    r = T.record_of(page, "o_orderkey", TICKET)
    return r.select("o_orderkey", *[F.col(f"{c}.value").alias(c) for c in ("venue", "date", "time", "seat", "grade", "price", "title")], F.col("title.confidence").alias("sure"))


@register("seat_repairs", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '2024년 6월 20일 1층' ELSE '1층 B구역 ' || (c_custkey % 20 + 1) || '열 10번' END AS seat, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'row-before-number,one' ELSE 'zero,one' END AS rules FROM customer")
def seat_repairs(spark, sf_dir):
    row = (F.col("c_custkey") % 20 + 1).cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, "2024년 6월 20일 1층").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("l층 B구역 "), row, F.lit("일 10번"))).otherwise(F.concat(F.lit("I층 B구역 "), row, F.lit("열 1O번")))
    c = table(spark, sf_dir, "customer").select("c_custkey", T.repaired_seat(raw).alias("r"))
    return c.select("c_custkey", F.col("r.text").alias("seat"), F.array_join("r.rules", ",").alias("rules"))


@register("forces", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'concerto' WHEN p_size % 4 = 1 THEN 'solo' WHEN p_size % 4 = 2 THEN 'concerto' END AS forces, CASE WHEN p_size % 4 < 2 THEN 0.9 WHEN p_size % 4 = 2 THEN 0.7 END::DOUBLE AS confidence FROM part")
def forces(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, ("Piano Concerto", "sonata ", "triple concerto", "else"))), (F.col("p_size") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", T.forces_of(form, (("piano concerto", "concerto"), ("sonata", "solo"), ("concerto", "concerto"))).alias("f"))
    return p.select("p_partkey", "f.forces", "f.confidence")
