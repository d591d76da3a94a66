"""Profiles on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import axes as A
from cadenza.operators import profiles as P
from cadenza.operators import years as Y
from cadenza.operators.frequency import with_rarity
from cadenza.plans.analytics import R4, counts
from cadenza.plans.catalogue import register
from cadenza.session import scratch_folder, table
from cadenza.streaming.summaries import Summary


def heard(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return line.join(part, F.col("p_partkey") == F.col("l_partkey"))


@register("taste_distribution", f"WITH n AS (SELECT o_custkey, p_type, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type IS NOT NULL GROUP BY ALL) SELECT o_custkey, p_type, n, {R4('n / (sum(n) OVER (PARTITION BY o_custkey))::DOUBLE')} AS share FROM n")
def taste_distribution(spark, sf_dir):
    return P.taste_distribution(heard(spark, sf_dir), "o_custkey", "p_type")


@register("adventurousness", f"WITH i AS (SELECT l_partkey AS work, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT work, percent_rank() OVER (ORDER BY n DESC) AS rarity FROM i) SELECT l_suppkey, count(*) AS n, {R4('avg(rarity)')} AS adventure FROM lineitem JOIN r ON work = l_partkey GROUP BY 1")
def adventurousness(spark, sf_dir):
    r = with_rarity(counts(spark, sf_dir)).select("work", "rarity")
    return P.adventurousness(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("work")).join(r, "work"), "l_suppkey", "rarity")


@register("rating_by_forces", "SELECT p_type, count(*) AS n, floor(avg(p_size) * 100.0 + 0.5) / 100.0 AS mean, count(*) >= 8 AS firm FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def rating_by_forces(spark, sf_dir):
    return P.cross_table(heard(spark, sf_dir), "p_type", "p_size")


@register("comment_marks", "WITH m AS (SELECT user_id, unnest(regexp_extract_all(strftime(ts, 'at %M:%S and %H:%M'), '\\d{1,2}:\\d{2}')) AS k FROM events) SELECT user_id, (split_part(k, ':', 1)::INT * 60 + split_part(k, ':', 2)::INT)::INT AS second, count(*) AS n FROM m GROUP BY ALL")
def comment_marks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("at "), F.date_format("ts", "mm:ss"), F.lit(" and "), F.date_format("ts", "HH:mm")).alias("text"))
    return P.comment_marks(e, "user_id", "text")


@register("life_phase", "SELECT p_partkey, CASE WHEN r BETWEEN 0 AND 1 THEN CASE WHEN r < 0.33 THEN 'early' WHEN r < 0.70 THEN 'middle' ELSE 'late' END END AS phase FROM (SELECT p_partkey, p_size / nullif((p_partkey % 60), 0)::DOUBLE AS r FROM part)")
def life_phase(spark, sf_dir):
    k = F.col("p_partkey") % 60
    return table(spark, sf_dir, "part").select("p_partkey", P.life_phase(F.lit(1800) + F.col("p_size"), F.lit(1800), F.lit(1800) + k).alias("phase"))


@register("run_consensus", f"WITH n AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY ALL), t AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS runs, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS r FROM n) SELECT user_id, event_type AS value, {R4('votes / runs::DOUBLE')} AS confidence FROM t WHERE r = 1")
def run_consensus(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lower("event_type").alias("canon"))
    return P.consensus(e, ["user_id"], "event_id", "event_type", "canon")


@register("first_available", "SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.doc_id % 2 = 0 THEN d.n_chars END) AS value, CASE WHEN l.quality IS NOT NULL THEN 'label' WHEN d.doc_id % 2 = 0 THEN 'length' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def first_available(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    label = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    length = d.filter("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("value"))
    return P.first_available(d.select("doc_id"), "doc_id", [("label", label), ("length", length)], "value")


@register("group_breakdown", f"SELECT coalesce(CASE WHEN lang <> 'es' THEN lang END, '(미상)') AS grp, count(DISTINCT d.doc_id) AS items, {R4('count(*) FILTER (quality = 1) / count(*)::DOUBLE')} AS accuracy, {R4('count(*) FILTER (toxic = 1) / count(*)::DOUBLE')} AS fabricated_rate FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def group_breakdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("lang")).alias("lang")).join(table(spark, sf_dir, "labels"), "doc_id")
    return P.group_breakdown(d.select("doc_id", "lang", (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("bad")), "lang", "doc_id", "ok", "bad")


@register("programme_architecture", """WITH e AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS cut, min(CASE WHEN lower(p_type) LIKE '%promo%' THEN l_linenumber END) AS c, max(CASE WHEN lower(p_type) LIKE '%standard%' THEN l_linenumber END) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN c < cut AND s > cut THEN 'concerto-symphony' WHEN s IS NOT NULL THEN 'symphony' WHEN c IS NOT NULL THEN 'concerto' ELSE 'other' END AS architecture FROM e""")
def programme_architecture(spark, sf_dir):
    """Promo parts stand for concertos, standard ones for symphonies, returned lines for breaks."""
    kind = F.lower("p_type")
    form = F.when(kind.contains("promo"), "concerto").when(kind.contains("standard"), "symphony").otherwise("other")
    return P.architecture(heard(spark, sf_dir).withColumn("form", form), "l_orderkey", "l_linenumber", "form", F.col("l_returnflag") == "R")


@register("composed_years", """
WITH p AS (SELECT p_partkey, p_brand AS c, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 7) % 140 END AS o, CASE WHEN p_partkey % 3 <> 0 THEN (1700 + (p_partkey * 7) % 140 + p_size)::INT END AS y FROM part WHERE p_partkey % 140 >= 0),
k AS (SELECT c, o, sum(y) AS t, count(*) AS w FROM p WHERE o IS NOT NULL AND y IS NOT NULL AND o BETWEEN 5 AND 130 GROUP BY ALL),
s AS (SELECT *, sum(t) OVER v AS st, sum(w) OVER v AS sw FROM k WINDOW v AS (PARTITION BY c ORDER BY o)),
ab AS (SELECT a.c, a.o AS lo, b.o AS hi, (b.st - a.st + a.t) / (b.sw - a.sw + a.w)::DOUBLE AS mean FROM s a JOIN s b ON a.c = b.c AND a.o <= b.o),
m AS (SELECT k.c, k.o, ab.lo, min(ab.mean) AS least FROM k JOIN ab ON ab.c = k.c AND ab.lo <= k.o AND k.o <= ab.hi GROUP BY ALL),
f AS (SELECT c, o, max(least) AS fit FROM m GROUP BY ALL),
q AS (SELECT DISTINCT c, o FROM p WHERE o IS NOT NULL),
lo AS (SELECT q.c, q.o, max(f.o) AS lo FROM q JOIN f ON f.c = q.c AND f.o <= q.o GROUP BY ALL), hi AS (SELECT q.c, q.o, min(f.o) AS hi FROM q JOIN f ON f.c = q.c AND f.o >= q.o GROUP BY ALL),
r AS (SELECT q.c, q.o, CASE WHEN a.fit IS NULL THEN b.fit WHEN b.fit IS NULL OR lo.lo = hi.hi THEN a.fit ELSE a.fit + (b.fit - a.fit) * ((q.o - lo.lo) / (hi.hi - lo.lo)::DOUBLE) END AS y
  FROM q LEFT JOIN lo ON lo.c = q.c AND lo.o = q.o LEFT JOIN hi ON hi.c = q.c AND hi.o = q.o LEFT JOIN f a ON a.c = q.c AND a.o = lo.lo LEFT JOIN f b ON b.c = q.c AND b.o = hi.hi)
SELECT p_partkey, coalesce(CASE WHEN p.o BETWEEN 5 AND 130 OR p.o IS NULL THEN p.y END, floor(round(r.y, 6) + 0.5)::INT) AS composed, (CASE WHEN p.o BETWEEN 5 AND 130 OR p.o IS NULL THEN p.y END) IS NULL AND r.y IS NOT NULL AS interpolated
FROM p LEFT JOIN r ON r.c = p.c AND r.o = p.o""")
def composed_years(spark, sf_dir):
    """Works of brands whose years rise with the number, with scatter; a third of the years, and all at either end, are missing."""
    k = F.col("p_partkey")
    opus = F.when(k % 11 != 0, k * 7 % 140)
    year = F.when((k % 3 != 0) & F.coalesce(opus.between(5, 130), F.lit(True)), (1700 + k * 7 % 140 + F.col("p_size")).cast("int"))
    works = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("composer"), opus.alias("opus"), year.alias("year"))
    return Y.with_years(works, "composer", "opus", "year").select("p_partkey", "composed", "interpolated")


@register("axis_weights")
def axis_weights(spark, sf_dir):
    """Per user, what size, time of day and kind of event say about whether the value was high."""
    e = table(spark, sf_dir, "events")
    axes = e.select("user_id", (F.col("value") > 20).alias("liked"), (F.hour("ts") / 24).alias("hour"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("size"), (F.col("event_type") == "purchase").cast("double").alias("bought"))
    w = A.axis_weights(axes, "user_id", "liked", ["hour", "size", "bought"])
    return w.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("bias", "hour", "size", "bought")])


@register("taste_summaries", "SELECT user_id, event_type, count(*) AS n, sum(CAST(floor(value * 100) AS BIGINT))::BIGINT AS amount FROM events GROUP BY ALL")
def taste_summaries(spark, sf_dir):
    """Sums per user and kind of event, kept by a stream over the events and read without them."""
    files = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's plain path has to be a folder
    rows = stream.select("user_id", "event_type", F.lit(1).cast("long").alias("n"), F.floor(F.col("value") * 100).cast("long").alias("amount"))
    folder = scratch_folder(spark, "summaries")
    kept = Summary(spark, f"{folder}/table", ["user_id", "event_type"], ["n", "amount"])
    kept.keep(rows, f"{folder}/checkpoint").awaitTermination()
    return kept.table()
