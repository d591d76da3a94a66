"""Selections, lookups, orders and set operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import rounded
from cadenza.functions.parsers import fixed_date, play_dates
from cadenza.functions.text import canonical, catalog_split, hash_key, separators, venue_text
from cadenza.operators import retrieval as R
from cadenza.operators import selection as S
from cadenza.plans.catalogue import register
from cadenza.session import table

CONF = "((doc_id * 37) % 101) / 100.0::DOUBLE"


def confidence():
    """A confidence that is derived from the id."""
    return ((F.col("doc_id") * 37) % 101) / 100.0


def r4(x):
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


@register("core_documents", f"SELECT doc_id, lang FROM documents WHERE {CONF} >= 0.7")
def core_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(S.is_core(confidence())).select("doc_id", "lang")


@register("orders_of_years", "SELECT o_orderkey FROM orders WHERE substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) BETWEEN '1994' AND '1995' AND o_orderkey % 7 <> 0")
def orders_of_years(spark, sf_dir):
    """A date that is empty drops out."""
    date = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").filter(S.in_years(date, "1994", "1995")).select("o_orderkey")


@register("known_composers", "SELECT composer, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_brand END AS composer FROM part) WHERE composer <> '' GROUP BY 1")
def known_composers(spark, sf_dir):
    c = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 != 1, F.col("p_brand"))
    return table(spark, sf_dir, "part").select(c.alias("composer")).filter(S.is_known(F.col("composer"))).groupBy("composer").agg(F.count("*").alias("n"))


@register("labels_before_event", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate + INTERVAL 30 DAY < CAST(l_shipdate AS DATE)")
def labels_before_event(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderdate + INTERVAL 30 DAY").alias("chosen"))
    j = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.filter(S.chosen_before(F.col("chosen"), F.col("l_shipdate"))).select("l_orderkey", "l_partkey", "l_linenumber")


@register("month_calendar", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 GROUP BY 1")
def month_calendar(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").filter(S.in_month(F.col("o_orderdate"), 1995, 3)).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@register("iso_dates", "SELECT count(*) FILTER (regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) AS valid, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d') END AS v FROM orders)")
def iso_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy.MM.dd"))
    return table(spark, sf_dir, "orders").agg(F.count_if(S.is_iso_date(v)).alias("valid"), F.count("*").alias("n"))


@register("intents", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(?:how many)|(?:\\bcount\\b)|(?:the the)') THEN 'statistics' WHEN regexp_matches(text, '[?]') THEN 'question' END AS intent FROM conversations")
def intents(spark, sf_dir):
    rules = {"statistics": ["(?i)how many", r"(?i)\bcount\b", "(?i)the the"], "question": ["[?]"]}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.intent(F.col("text"), rules).alias("intent"))


@register("seat_views", """WITH s AS (SELECT c_custkey AS seat, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS venue, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 END AS floor, chr((65 + c_custkey % 4)::INT) AS block, c_custkey % 5 AS row FROM customer),
v AS (SELECT s_suppkey AS view, s_nationkey AS venue, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 2 END AS floor, chr((65 + s_suppkey % 4)::INT) AS block, s_suppkey % 5 AS row FROM supplier)
SELECT seat, view FROM s JOIN v ON s.venue = v.venue AND s.floor IS NOT DISTINCT FROM v.floor AND s.block IS NOT DISTINCT FROM v.block AND s.row IS NOT DISTINCT FROM v.row""")
def seat_views(spark, sf_dir):
    place = lambda k: [F.when(F.col(k) % 3 != 0, F.col(k) % 2).alias("floor"), F.char(65 + F.col(k) % 4).alias("block"), (F.col(k) % 5).alias("row")]
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seat"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("venue"), *place("c_custkey"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view"), F.col("s_nationkey").alias("venue"), *place("s_suppkey"))
    return S.seat_views(s, v, "seat")


@register("scan_targets", f"SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL AND ((d.doc_id * 37) % 101) / 100.0 >= 0.7 AND n_chars > 0")
def scan_targets(spark, sf_dir):
    """Documents that have no labels yet, are sure enough and not empty."""
    return S.scan_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", S.is_core(confidence()) & (F.col("n_chars") > 0))


@register("first_order_of_day", "SELECT d.day, min(o_orderkey) AS first FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) d LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d.day GROUP BY 1")
def first_order_of_day(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return S.first_on(days, table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey"), "day", "o_orderkey")


@register("segment_or_unknown", "SELECT c_custkey, coalesce(n_name, 'unknown') AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 4 <> 0")
def segment_or_unknown(spark, sf_dir):
    """Lookup that keeps all rows, with a default."""
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place"))
    return S.lookup(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), known, "k", "place", "unknown").select("c_custkey", "place")


@register("asset_numbers", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS number, ((row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1) // 4)::BIGINT AS chunk FROM customer")
def asset_numbers(spark, sf_dir):
    c = S.counter(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], ["c_custkey"])
    return c.select("c_custkey", F.col("number").cast("long").alias("number"), S.chunk_of(F.col("number"), 4).cast("long").alias("chunk"))


@register("last_turns", "SELECT conv_id, array_to_string(list(role ORDER BY turn)[-3:], ',') AS roles FROM conversations GROUP BY 1")
def last_turns(spark, sf_dir):
    """By order of the array; a conversation is a bounded list."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(S.last_items(F.col("t"), 3), ",").alias("roles"))


@register("median_order_nulls", "SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END, 0) DESC, s_suppkey) AS as_zero, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END DESC NULLS LAST, s_suppkey) AS last FROM supplier WHERE s_nationkey = 5")
def median_order_nulls(spark, sf_dir):
    """Two orders of one nation's suppliers: nulls as zero, and nulls last."""
    v = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal"))
    s = table(spark, sf_dir, "supplier").filter("s_nationkey = 5").withColumn("v", v)
    place = lambda *by: F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*by)).cast("long")
    return s.select("s_suppkey", place(F.coalesce("v", F.lit(0.0)).desc(), "s_suppkey").alias("as_zero"), place(F.col("v").desc_nulls_last(), "s_suppkey").alias("last"))


@register("newest_orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def newest_orders(spark, sf_dir):
    """The 25 newest, a top-k report."""
    return S.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 25).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@register("joined_corpora", "SELECT corpus, work, count(*) AS n FROM (SELECT 1 AS corpus, l_partkey AS work FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 2, l_partkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY ALL")
def joined_corpora(spark, sf_dir):
    """Two corpora one behind the other, each row with the ordinal of its own."""
    of = lambda status: table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status).select(F.col("l_partkey").alias("work"))
    return S.joined_corpora([of("O"), of("F")]).groupBy("corpus", "work").agg(F.count("*").alias("n"))


@register("fields_of_runs", "WITH a AS (SELECT conv_id, list_distinct(string_split(role || ',' || lower(substr(text, 1, 3)), ',')) AS x, turn FROM conversations), g AS (SELECT conv_id, list(x ORDER BY turn) AS xs FROM a GROUP BY 1) SELECT conv_id, len(list_distinct(flatten(xs))) AS in_any, len(list_reduce(xs, lambda p, q: list_intersect(p, q))) AS in_all FROM g")
def fields_of_runs(spark, sf_dir):
    x = F.array_distinct(F.split(F.concat_ws(",", "role", F.lower(F.substring("text", 1, 3))), ",", -1))
    g = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", x.alias("x")).alias("s")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("xs"))
    return g.select("conv_id", F.size(S.in_any(F.col("xs"))).cast("long").alias("in_any"), F.size(S.in_all(F.col("xs"))).cast("long").alias("in_all"))


@register("delta_pull", "SELECT user_id, count(*) AS n FROM events WHERE ts > (SELECT max(ts) - INTERVAL 3 DAY FROM events) GROUP BY 1")
def delta_pull(spark, sf_dir):
    """What changed in the last three days, per user; the watermark is one scalar."""
    e = table(spark, sf_dir, "events")
    since = F.broadcast(e.agg(F.max("ts").alias("_last")))  # the one row of a global aggregate
    return S.changed_since(e.join(since), "ts", F.col("_last") - F.expr("INTERVAL 3 DAY")).groupBy("user_id").agg(F.count("*").alias("n"))


@register("feedback_boosts", f"WITH w AS (SELECT 'type' AS axis, event_type AS value, count(*) / (SELECT count(*) FROM events)::DOUBLE AS weight FROM events GROUP BY 2), f AS (SELECT user_id, 'type' AS axis, event_type AS value FROM events) SELECT user_id, {r4('sum(weight)')} AS boost FROM f JOIN w USING (axis, value) GROUP BY 1")
def feedback_boosts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.lit("type").alias("axis"), F.col("event_type").alias("value"))
    n = e.groupBy("axis", "value").agg(F.count("*").alias("n"))
    w = n.select("axis", "value", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("weight"))  # a row for each type
    return S.boosts(e, w, ["user_id"]).select("user_id", rounded(F.col("boost")).alias("boost"))


@register("tagged_by_similarity", """WITH q AS (SELECT user_id, CAST(user_id % 10 AS INTEGER) AS label, embedding::DOUBLE[] AS v FROM (SELECT DISTINCT user_id FROM events) JOIN embeddings ON vec_id = user_id),
s AS (SELECT user_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM q JOIN embeddings USING (label))
SELECT user_id, vec_id, round(c, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, vec_id) <= 5""")
def tagged_by_similarity(spark, sf_dir):
    """Of the works with the tag that a user asks for, the five nearest to the user's taste vector."""
    e = table(spark, sf_dir, "embeddings")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    taste = users.join(e.select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("taste")), "user_id").withColumn("label", (F.col("user_id") % 10).cast("int"))
    return R.cosine_top(e, "vec_id", "embedding", taste, "user_id", "taste", k=5, tag="label").select("user_id", "vec_id", F.round("similarity", 5).alias("similarity"))


@register("uncovered_zones", "SELECT v, c, 'block' AS only FROM (SELECT DISTINCT c_nationkey AS v, c_custkey % 40 AS c FROM customer EXCEPT SELECT s_nationkey, s_suppkey % 40 FROM supplier) UNION ALL SELECT v, c, 'zone' FROM (SELECT DISTINCT s_nationkey AS v, s_suppkey % 40 AS c FROM supplier EXCEPT SELECT c_nationkey, c_custkey % 40 FROM customer)")
def uncovered_zones(spark, sf_dir):
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("v"), (F.col("c_custkey") % 40).alias("c"))
    return S.uncovered(b, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("v"), (F.col("s_suppkey") % 40).alias("c")), ["v", "c"])


MASKS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "number": "[0-9]{10,}"}


@register("masked_documents", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '[email]', 'g'), '[0-9]{10,}', '[number]', 'g')) AS sha, 0::INT AS left_over FROM documents")
def masked_documents(spark, sf_dir):
    """Whole texts masked, with the number of kinds that are still found."""
    m = table(spark, sf_dir, "documents").select("doc_id", S.masked(F.col("text"), MASKS).alias("t"))
    return m.select("doc_id", F.sha2("t", 256).alias("sha"), F.size(S.left_over(F.col("t"), MASKS)).alias("left_over"))


@register("public_ratings", f"SELECT c_nationkey, count(*) AS n, {r4('avg(c_acctbal)')} AS mean FROM customer WHERE c_custkey % 6 <> 0 AND c_acctbal > 0 GROUP BY 1")
def public_ratings(spark, sf_dir):
    """Mean rating per area over rated seats that are not private."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("rating"))
    return S.public_means(c, ["c_nationkey"], "rating", F.col("c_custkey") % 6 == 0).withColumn("mean", rounded(F.col("mean")))


@register("bar_widths", "WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, floor(n * 100 / (max(n) OVER ())::DOUBLE + 0.5)::BIGINT AS width FROM b QUALIFY row_number() OVER (ORDER BY n DESC, p_brand) <= 3")
def bar_widths(spark, sf_dir):
    """The three most frequent, with their width against the first."""
    top = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(3)
    return top.select("p_brand", "n", S.widths("n").alias("width"))


@register("worst_confidence", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 4 THEN 'unknown' WHEN p_size % 3 = 1 OR p_partkey % 3 = 1 THEN 'inferred' ELSE 'confirmed' END AS worst FROM part")
def worst_confidence(spark, sf_dir):
    named = lambda k: F.when(k == 0, "unknown").when(k == 1, "inferred").otherwise("confirmed")
    third = F.when(F.col("p_partkey") % 5 != 4, "confirmed")
    return table(spark, sf_dir, "part").select("p_partkey", S.worst(named(F.col("p_size") % 3), named(F.col("p_partkey") % 3), third).alias("worst"))


@register("row_bands", "WITH h AS (SELECT l_suppkey, l_quantity::INT AS q, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT l_suppkey, q, q - row_number() OVER (PARTITION BY l_suppkey ORDER BY q) AS g FROM h) SELECT l_suppkey, min(q) AS first, max(q) AS last FROM r GROUP BY l_suppkey, g")
def row_bands(spark, sf_dir):
    """Runs of quantities that a supplier has at least twice."""
    h = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    return S.row_bands(h, ["l_suppkey"], "q", "n", 2)


@register("map_status", "SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'unknown-venue' WHEN n_nationkey % 5 = 0 THEN 'unsupported-venue' WHEN c_custkey % 7 = 0 THEN 'seat-unknown' ELSE 'ok' END AS status FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def map_status(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select("n_nationkey")
    j = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    seat = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey"))
    return j.select("c_custkey", S.map_status(F.col("n_nationkey").isNotNull(), F.coalesce(F.col("n_nationkey") % 5 != 0, F.lit(False)), seat).alias("status"))


@register("match_routes", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'review' WHEN p_size % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'matched' WHEN p_partkey % 5 = 0 THEN 'ask' ELSE 'composer-only' END AS route FROM part")
def match_routes(spark, sf_dir):
    composer, work = F.when(F.col("p_size") % 4 != 0, F.col("p_brand")), F.when(F.col("p_size") % 3 != 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.match_route(composer, work, F.col("p_partkey") % 5 == 0).alias("route"))


@register("eras", "SELECT p_brand, CASE p_size % 10 // 3 WHEN 0 THEN 'baroque' WHEN 1 THEN 'classical' WHEN 2 THEN 'romantic' ELSE 'modern' END AS era, count(*) AS n FROM part GROUP BY ALL")
def eras(spark, sf_dir):
    """Ten source epochs to four eras by a table; a work has its composer's."""
    known = {str(i): ("baroque", "classical", "romantic", "modern")[i // 3] for i in range(10)}
    p = table(spark, sf_dir, "part").select("p_brand", S.era_of(F.col("p_size") % 10, known).alias("era"))
    return p.groupBy("p_brand", "era").agg(F.count("*").alias("n"))


@register("birthdays", "SELECT o_orderkey FROM orders WHERE month(o_orderdate) = 2 AND day(o_orderdate) = 29")
def birthdays(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(S.on_day(F.col("o_orderdate"), 2, 29)).select("o_orderkey")


@register("play_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first, strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 4 DAY ELSE o_orderdate END, '%Y-%m-%d') AS last, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS fixed FROM orders")
def run_dates(spark, sf_dir):
    shown = lambda d: F.date_format(d, "yyyy.MM.dd")
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(shown(d), F.lit(" ~ "), shown(F.expr("o_orderdate + INTERVAL 4 DAY")))).otherwise(F.concat(shown(d), F.lit(" 19:30")))
    fixed = F.date_format(d, "yyyyMMdd")
    o = table(spark, sf_dir, "orders").select("o_orderkey", play_dates(raw).alias("p"), fixed_date(F.when(F.col("o_orderkey") % 3 == 0, F.concat(fixed, F.lit("x"))).otherwise(fixed)).alias("fixed"))
    return o.select("o_orderkey", "p.first", "p.last", "fixed")


@register("canonical_names", r"SELECT c_custkey, lower(c_name) AS canonical, regexp_replace(lower(c_name), '[#\s]', '', 'g') AS venue, substr(sha256(c_name), 1, 16) AS key FROM customer")
def canonical_names(spark, sf_dir):
    name = F.concat(F.lit(" "), F.col("c_name"), F.lit("​!"))
    return table(spark, sf_dir, "customer").select("c_custkey", canonical(name, compose=False).alias("canonical"), venue_text(F.concat("c_name", F.lit("　."))).alias("venue"), hash_key(F.col("c_name")).alias("key"))


@register("catalog_parts", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'op' ELSE 'k' END END AS catalogue, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS number, 'a | b' AS line FROM part")
def catalog_parts(spark, sf_dir):
    size = F.col("p_size").cast("string")
    opus = F.when(F.col("p_size") % 3 != 0, F.concat(F.when(F.col("p_size") % 2 == 0, "op.").otherwise("K."), size))
    p = table(spark, sf_dir, "part").select("p_partkey", catalog_split(opus).alias("c"), separators(F.when(F.col("p_size") % 2 == 0, "a I b").otherwise("a ｜ b")).alias("line"))
    return p.select("p_partkey", "c.catalogue", "c.number", "line")


@register("rarity_written_back", f"WITH i AS (SELECT l_partkey AS work, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT work, percent_rank() OVER (ORDER BY n DESC) AS rarity FROM i) SELECT p_partkey, {r4('coalesce(rarity, -1)')} AS rarity FROM part LEFT JOIN r ON work = p_partkey")
def rarity_written_back(spark, sf_dir):
    """A join that updates a column of the catalog; works that never occur keep the old value."""
    from cadenza.operators.frequency import with_rarity

    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    r = with_rarity(counts).select("p_partkey", F.col("rarity").alias("new"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lit(-1.0).alias("rarity")).join(r, "p_partkey", "left").select("p_partkey", rounded(F.coalesce("new", "rarity")).alias("rarity"))
