"""Catalog views and merges on the driver tables.

concert = order, venue = nation of the customer, item = line, work = part,
performer = supplier, role = return flag, user = customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import catalog as K
from cadenza.plans.catalogue import register
from cadenza.session import dealt, shares, table


def nights(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("venue"))
    who = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "venue")  # nations are 25
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    return o.join(who, F.col("c_custkey") == F.col("o_custkey"), "left").drop("c_custkey")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@register("export_concert", """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
a AS (SELECT l_orderkey, string_agg(s_name, ' / ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (l_returnflag = 'R') AS conductors, string_agg(s_name, ' / ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (l_returnflag = 'A') AS soloists FROM i GROUP BY 1)
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, coalesce(n_name, o_orderpriority) AS venue, conductors, soloists FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN a ON l_orderkey = o_orderkey""")
def export_concert(spark, sf_dir):
    """One row per concert; the lists of names come from one grouped pass, not from subqueries."""
    name = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    items = table(spark, sf_dir, "lineitem").join(name, F.col("s_suppkey") == F.col("l_suppkey"))
    role = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("s_name"))
    order = [F.col(c) for c in ORDER]
    lists = items.groupBy("l_orderkey").agg(K.text_list(role("R"), order, " / ").alias("conductors"), K.text_list(role("A"), order, " / ").alias("soloists"))
    return nights(spark, sf_dir).join(lists, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "date", F.coalesce("venue", "o_orderpriority").alias("venue"), "conductors", "soloists")


@register("export_program", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, l_linenumber, l_partkey, p_name, p_brand, s_name AS performer FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def export_program(spark, sf_dir):
    part, name = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    who = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").join(who, F.col("c_custkey") == F.col("o_custkey"))
    j = o.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(part, F.col("p_partkey") == F.col("l_partkey"), "left").join(name, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select("o_orderkey", F.to_date("o_orderdate").alias("date"), "l_linenumber", "l_partkey", "p_name", "p_brand", F.col("s_name").alias("performer"))


def attended(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    lines = table(spark, sf_dir, "lineitem")
    n = shares(lines)
    return dealt(o, n, "o_orderkey").join(dealt(lines, n, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


@register("my_performers", "SELECT o_custkey, l_suppkey, l_returnflag AS role, count(*) AS times, max(CAST(o_orderdate AS DATE)) AS last_seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def my_performers(spark, sf_dir):
    """Counts credit rows."""
    return K.grouped_counts(attended(spark, sf_dir).withColumnRenamed("l_returnflag", "role"), ["o_custkey", "l_suppkey", "role"], "date")


@register("my_performers_distinct", "SELECT o_custkey, l_suppkey, count(DISTINCT o_orderkey) AS concerts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def my_performers_distinct(spark, sf_dir):
    """Counts attendances: each concert once. Rows are dealt by what is counted, so that both steps lie in one task; few of them would combine before."""
    n = shares(table(spark, sf_dir, "lineitem"))
    once = dealt(attended(spark, sf_dir).select("o_custkey", "l_suppkey", "o_orderkey"), n, "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey", "o_orderkey").agg(F.count("*").alias("k"))
    return once.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("concerts"))


@register("my_forces", "SELECT o_custkey, p_type AS forces, count(*) AS times FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' GROUP BY ALL")
def my_forces(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("forces"))
    return K.grouped_counts(attended(spark, sf_dir).filter("l_linestatus = 'O'").join(part, F.col("p_partkey") == F.col("l_partkey")), ["o_custkey", "forces"])


@register("dual_grain_credits", """WITH i AS (SELECT DISTINCT l_orderkey AS concert, l_partkey AS item FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS concert, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS item, l_suppkey AS performer FROM lineitem)
SELECT i.concert, i.item, c.performer, CASE WHEN c.item IS NULL THEN 'concert' ELSE 'item' END AS grain FROM i JOIN c ON c.concert = i.concert AND (c.item = i.item OR c.item IS NULL)""")
def dual_grain_credits(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    items = line.select(F.col("l_orderkey").alias("concert"), F.col("l_partkey").alias("item")).distinct()
    credits = line.select(F.col("l_orderkey").alias("concert"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("item"), F.col("l_suppkey").alias("performer")).distinct()
    return K.resolve_credits(items, credits)


@register("review_queue", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND (l.quality IS NULL OR l.toxic < 0.85)")
def review_queue(spark, sf_dir):
    """Work rows without a match or with a weak one; a null confidence beside a match is in neither."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.filter((F.col("lang") == "en") & (F.col("quality").isNull() | (F.col("toxic") < 0.85))).select("doc_id", "quality", "toxic")


@register("bad_vocab", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1")
def bad_vocab(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(~F.col("event_type").isin("view", "click", "purchase")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("redirects", """WITH RECURSIVE r AS (SELECT c_custkey AS old_id, c_custkey // 2 AS new_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 1), w(id, cur, d) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT w.id, r.new_id, d + 1 FROM w JOIN r ON r.old_id = w.cur WHERE d < 32)
SELECT id AS c_custkey_old, arg_max(cur, d) AS c_custkey FROM w GROUP BY 1""")
def redirects(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    r = c.filter("c_custkey % 3 = 0 AND c_custkey > 1").select(F.col("c_custkey").alias("old_id"), F.expr("c_custkey div 2").alias("new_id"))
    return K.resolve_redirects(c.withColumn("c_custkey_old", F.col("c_custkey")), "c_custkey", r)


@register("upsert_merge", """WITH o AS (SELECT p_partkey, p_size AS rarity_n, p_name AS title, p_type AS forces, 1 AS rarity FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, p_size + 1 AS rarity_n, upper(p_name) AS title, p_brand AS forces, 2 AS rarity FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(o.rarity_n, 0) + coalesce(n.rarity_n, 0) AS rarity_n, coalesce(o.title, n.title) AS title, coalesce(n.forces, o.forces) AS forces, CASE WHEN o.p_partkey IS NULL OR n.p_partkey IS NULL THEN coalesce(o.rarity, n.rarity) END AS rarity FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""")
def upsert_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.filter("p_partkey % 3 <> 0").select("p_partkey", F.col("p_size").alias("rarity_n"), F.col("p_name").alias("title"), F.col("p_type").alias("forces"), F.lit(1).alias("rarity"))
    new = p.filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 1).alias("rarity_n"), F.upper("p_name").alias("title"), F.col("p_brand").alias("forces"), F.lit(2).alias("rarity"))
    return K.merge_upsert(old, new, "p_partkey", added=["rarity_n"], first=["title"], replaced=["forces"], cleared=["rarity"])


@register("gap_scan", "WITH k AS (SELECT DISTINCT doc_id AS k FROM labels), p AS (SELECT k, lag(k) OVER (ORDER BY k) AS prev FROM k) SELECT prev + 1 AS first, k - 1 AS last, k - prev - 1 AS missing FROM p WHERE k - prev > 1")
def gap_scan(spark, sf_dir):
    return K.gaps(table(spark, sf_dir, "labels"), "doc_id")


@register("dedupe_keep_last", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_keep_last(spark, sf_dir):
    return K.keep_last(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@register("dedupe_keep_min", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1")
def dedupe_keep_min(spark, sf_dir):
    return K.keep_first(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")])


@register("drop_reasons", "SELECT CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN source IN ('src1', 'src2') THEN 'source' WHEN n_chars < 500 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_reasons(spark, sf_dir):
    why = K.first_reason([("language", ~F.col("lang").isin("en", "de")), ("source", F.col("source").isin("src1", "src2")), ("short", F.col("n_chars") < 500)])
    return table(spark, sf_dir, "documents").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@register("client_stats", """SELECT o_custkey, count(*) AS total, sum(coalesce(floor(o_totalprice), 0))::BIGINT AS spent, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders GROUP BY 1""")
def client_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("total"), F.sum(F.coalesce(F.floor("o_totalprice"), F.lit(0))).cast("long").alias("spent"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct(F.date_format("date", "yyyy-MM")).alias("months"))


@register("client_top5", "WITH c AS (SELECT o_custkey, p_brand AS composer, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT o_custkey, composer, n, round(n * 100.0 / max(n) OVER (PARTITION BY o_custkey))::BIGINT AS bar FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, composer) <= 5")
def client_top5(spark, sf_dir):
    """Top five composers of a user, ties by name, with a bar relative to the first."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("composer"))
    n = attended(spark, sf_dir).join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("o_custkey", "composer").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("n"), "composer")
    top = n.withColumn("r", F.row_number().over(w)).withColumn("most", F.first("n").over(w)).filter("r <= 5")
    return top.select("o_custkey", "composer", "n", F.round(F.col("n") * 100.0 / F.col("most")).cast("long").alias("bar"))


@register("quality_rules", """SELECT 'discount in 0..1' AS rule, count(*) FILTER (NOT (l_discount BETWEEN 0 AND 1)) AS n FROM lineitem UNION ALL SELECT 'known flag', count(*) FILTER (NOT (l_returnflag IN ('A', 'R'))) FROM lineitem UNION ALL SELECT 'returned means closed', count(*) FILTER (NOT (l_returnflag <> 'R' OR l_linestatus = 'F')) FROM lineitem""")
def quality_rules(spark, sf_dir):
    return K.violations(table(spark, sf_dir, "lineitem"), {"discount in 0..1": F.col("l_discount").between(0, 1), "known flag": F.col("l_returnflag").isin("A", "R"), "returned means closed": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F")})


@register("duplicate_keys", "SELECT l_orderkey AS key0, l_linenumber AS key1, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return K.duplicate_keys(table(spark, sf_dir, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber")])


@register("orphan_labels", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def orphan_labels(spark, sf_dir):
    """Concerts without a programme: the anti-join that data-quality rules use."""
    return K.orphans(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@register("intermission_ordinal", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS breaks FROM lineitem")
def intermission_ordinal(spark, sf_dir):
    """Breaks before each item of a programme."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.coalesce(F.sum((F.col("l_returnflag") == "R").cast("long")).over(w), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER, breaks.alias("breaks"))


@register("nights_of_run", "SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) + i::INT AS date FROM orders, generate_series(0, o_orderkey % 3) t(i)")
def nights_of_run(spark, sf_dir):
    """A source event with a date range becomes one row per night with its run."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("d"))
    return o.select("run_id", F.explode(F.sequence("d", F.date_add("d", (F.col("run_id") % 3).cast("int")))).alias("date"))
