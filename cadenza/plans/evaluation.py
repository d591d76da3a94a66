"""Evaluation, sync, retrieval and geometry on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.numbers import rounded
from cadenza.functions.text import latin_ratio, similarity
from cadenza.operators import evaluation as E
from cadenza.operators import geometry as G
from cadenza.operators import retrieval as R
from cadenza.operators import sync as S
from cadenza.plans.catalogue import register
from cadenza.session import table

CONF = "((doc_id * 37) % 101) / 100.0::DOUBLE"
SCORED = f"WITH s AS (SELECT doc_id, {CONF} AS c, quality = 1 AS ok FROM labels)"


def judged(spark, sf_dir):
    """Labels with a confidence derived from the id."""
    return table(spark, sf_dir, "labels").select("doc_id", (((F.col("doc_id") * 37) % 101) / 100.0).alias("c"), (F.col("quality") == 1).alias("ok"), "quality", "toxic")


def r4(x):
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


@register("calibration_bins", SCORED + f" SELECT least(floor(c * 10), 9)::BIGINT AS bin, count(*) AS n, {r4('avg(c)')} AS confidence, {r4('avg(ok::INT)')} AS accuracy FROM s GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return E.calibration_bins(judged(spark, sf_dir), "c", "ok")


@register("calibration_error", SCORED + f", b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, abs(sum(c) - sum(ok::INT)) AS gap FROM s GROUP BY 1) SELECT (SELECT count(*) FROM s) AS n, {r4('sum(gap) / sum(n)')} AS ece, {r4('(SELECT corr(c, ok::INT) FROM s)')} AS pearson FROM b")
def calibration_error(spark, sf_dir):
    return E.calibration_error(judged(spark, sf_dir), "c", "ok")


@register("null_truth_taxonomy", f"""WITH o AS (SELECT CASE WHEN d.n_chars < 200 THEN 'abstain_empty' WHEN ((d.doc_id * 37) % 101) / 100.0 < 0.3 THEN 'abstain_lowconf' WHEN d.lang = 'fr' THEN 'nonnumeric_text' WHEN d.source = 'src0' THEN 'misattributed' ELSE 'fabricated' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL)
SELECT e.outcome, count(o.outcome) AS n FROM (SELECT unnest(['abstain_empty','abstain_lowconf','nonnumeric_text','misattributed','fabricated']) AS outcome) e LEFT JOIN o ON o.outcome = e.outcome GROUP BY 1""")
def null_truth_taxonomy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left").filter("quality IS NULL")
    confidence = ((F.col("doc_id") * 37) % 101) / 100.0
    return E.outcome_distribution(d.withColumn("outcome", E.null_truth_outcome(F.col("n_chars") < 200, confidence, 0.3, F.col("lang") == "fr", F.col("source") == "src0")), "outcome")


@register("set_prf", f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS ws FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.ws AS t, b.ws AS p, len(list_intersect(a.ws, b.ws)) AS hit FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN hit / len(p)::DOUBLE WHEN len(t) > 0 THEN 0.0 ELSE 1.0 END AS pr, CASE WHEN len(t) > 0 THEN hit / len(t)::DOUBLE ELSE 1.0 END AS re FROM p)
SELECT conv_id, turn, {r4('pr')} AS precision, {r4('re')} AS recall, {r4('CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END')} AS f1 FROM q""")
def set_prf(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.lower("text"), "[^a-z]+", -1).alias("ws"))
    nxt = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("p"))
    s = w.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", E.set_score(F.col("ws"), F.col("p")).alias("s"))
    return s.select("conv_id", "turn", rounded(F.col("s.precision")).alias("precision"), rounded(F.col("s.recall")).alias("recall"), rounded(F.col("s.f1")).alias("f1"))


@register("field_stats", f"SELECT d.lang AS field, count(*) AS n, count(*) FILTER (l.quality IS NOT NULL) AS scored, count(*) FILTER (l.quality IS NULL) AS null_truth, {r4('count(*) FILTER (l.quality = 1) / nullif(count(l.quality), 0)::DOUBLE')} AS accuracy, {r4('avg(l.toxic::DOUBLE)')} AS mean_score FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def field_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("field")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return E.field_stats(d.select("field", (F.col("quality") == 1).alias("ok"), F.col("toxic").cast("double").alias("score"), F.col("quality").isNull().alias("nt")), "field", "ok", "score", "nt")


@register("flip_rate", f"WITH e AS (SELECT user_id, event_type, count(*) AS runs, count(DISTINCT coalesce(props, '')) AS k FROM events GROUP BY ALL HAVING count(*) >= 2) SELECT event_type, count(*) FILTER (k > 1) AS unstable, count(*) AS files, {r4('count(*) FILTER (k > 1) / count(*)::DOUBLE')} AS rate FROM e GROUP BY 1")
def flip_rate(spark, sf_dir):
    return E.flip_rate(table(spark, sf_dir, "events"), "user_id", "event_type", "props")


@register("latency_percentiles", "WITH s AS (SELECT event_type, floor(value * 100)::BIGINT AS v FROM events), l AS (SELECT event_type, list_sort(list(v)) AS x, count(*) AS n, sum(v) AS t FROM s GROUP BY 1) SELECT event_type, n, floor(t / n::DOUBLE * 100.0 + 0.5) / 100.0 AS mean, x[n // 2 + 1] AS p50, x[least(n - 1, n * 95 // 100) + 1] AS p95, x[1] AS least, x[n] AS most FROM l")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("v0"))
    return E.latency(e, ["event_type"], "v0")


@register("audit_labels", "SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def audit_labels(spark, sf_dir):
    return E.anti_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@register("text_similarity", f"WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part) SELECT p_partkey, {r4('CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END')} AS similarity FROM p")
def text_similarity(spark, sf_dir):
    """ASCII names, where characters and bytes agree in both engines."""
    return table(spark, sf_dir, "part").select("p_partkey", rounded(similarity(F.lower("p_name"), F.lower("p_type"))).alias("similarity"))


@register("script_shares", f"""WITH l AS (SELECT doc_id, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS x FROM documents), n AS (SELECT doc_id, length(x) AS n, length(regexp_replace(x, '[\\x{{2000}}-\\x{{10FFFF}}]', '', 'g')) AS m FROM l)
SELECT doc_id, {r4('CASE WHEN n > 0 THEN m / n::DOUBLE ELSE 0 END')} AS latin FROM n""")
def script_shares(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rounded(latin_ratio(F.col("text"))).alias("latin"))


LOG = "WITH l AS (SELECT user_id, event_id, (event_id % 4)::BIGINT AS base_rev, event_type, value, ts FROM events)"


@register("sync_replay", LOG + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM l),
f AS (SELECT user_id, list_reduce(list_prepend({'rev': 0::BIGINT, 'out': []::BOOLEAN[], 'b': -1::BIGINT}, list({'rev': 0::BIGINT, 'out': []::BOOLEAN[], 'b': base_rev} ORDER BY i)), lambda a, x: {'rev': CASE WHEN x.b = a.rev THEN a.rev + 1 ELSE a.rev END, 'out': list_append(a.out, x.b = a.rev), 'b': x.b}) AS r FROM o GROUP BY 1)
SELECT o.user_id, o.event_id, f.r.out[o.i] AS applied FROM o JOIN f ON o.user_id = f.user_id""")
def sync_replay(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4).alias("base_rev"))
    return S.replay(log, "user_id", "base_rev", ["event_id"]).select("user_id", "event_id", "applied")


@register("sync_idempotent", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def sync_idempotent(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumn("idem_key", F.concat_ws("+", "user_id", "event_type"))
    return S.idempotent(log, "idem_key", ["event_id"]).select("user_id", "event_type", "event_id")


@register("sync_watermark", "SELECT e.user_id, e.event_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) + 5000 AS m FROM events WHERE user_id % 2 = 0 GROUP BY 1) w ON w.user_id = e.user_id WHERE m IS NULL OR e.event_id > m")
def sync_watermark(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"))
    marks = log.filter("device % 2 = 0").groupBy("device").agg((F.min("seq") + 5000).alias("last_mutation_id"))
    return S.above_watermark(log, marks).select(F.col("device").alias("user_id"), F.col("seq").alias("event_id"))


@register("field_merge", "SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 3 = 0) AS event_type, arg_max(floor(value)::BIGINT, event_id) FILTER (event_id % 2 = 0) AS amount FROM events GROUP BY 1")
def field_merge(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("long")).alias("amount"))
    return S.merge_fields(log, "user_id", ["event_type", "amount"], ["event_id"])


@register("tombstones", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def tombstones(spark, sf_dir):
    last = S.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"])
    return S.live(last.withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("event_id")))).select("user_id", "event_id")


@register("cosine_topk", """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM embeddings, q)
SELECT query, vec_id, round(c, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) <= 20""")
def cosine_topk(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, against all vectors; top 20."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    return R.cosine_top(e, "vec_id", "embedding", q, "query", "qv").select("query", "vec_id", F.round("similarity", 5).alias("similarity"))


ITEMS = "WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM documents), q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS term FROM benchmark), n AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM d), t AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM t JOIN f USING (term) JOIN q USING (term), n GROUP BY ALL)"


@register("bm25", ITEMS + " SELECT item_id, doc_id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, doc_id) <= 50")
def bm25(spark, sf_dir):
    """Top 50 documents of every benchmark item."""
    from pyspark.sql import Window

    q = table(spark, sf_dir, "benchmark")
    s = R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", q.select("item_id", F.col("text").alias("words")), "item_id", "words").withColumn("score", F.round("score", 5))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("place", F.row_number().over(w)).filter("place <= 50").select("item_id", "doc_id", "score")


@register("rrf_fusion", """WITH a AS (SELECT l_suppkey AS q, l_partkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS place FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS q, l_partkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS place FROM lineitem GROUP BY 1, 2)
SELECT q, k, round(sum(1.0::DOUBLE / (60 + place)), 6) AS score FROM (SELECT * FROM a WHERE place <= 50 UNION ALL SELECT * FROM b WHERE place <= 50) GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    from pyspark.sql import Window

    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("s"), F.count("*").alias("n"))
    placed = lambda by: g.select("q", "k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), "k")).alias("place")).filter("place <= 50")
    return R.fuse([placed("s"), placed("n")], "q", "k").withColumn("score", F.round("score", 6))


@register("taste_blend", """WITH u AS (SELECT label, list(vec_id) AS ids FROM embeddings GROUP BY 1), t AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x, count(*) AS n FROM embeddings, generate_series(1, 64) g(i) GROUP BY ALL)
SELECT e.vec_id, round(sum(CASE WHEN n < 3 THEN e.embedding[i]::DOUBLE WHEN n < 10 THEN 0.7 * e.embedding[i]::DOUBLE + 0.3 * x ELSE 0.55 * e.embedding[i]::DOUBLE + 0.45 * x END), 4) AS total FROM embeddings e JOIN t ON t.label = e.label GROUP BY 1""")
def taste_blend(spark, sf_dir):
    """Each vector blended with the mean of its label."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    taste = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("taste"), F.max("n").alias("n"))
    b = e.join(taste, "label").select("vec_id", R.blend(F.col("embedding"), F.col("taste"), F.col("n")).alias("b"))
    return b.select("vec_id", F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@register("nearest_point", "WITH p AS (SELECT s_suppkey, s_nationkey AS venue, s_suppkey % 20 AS r FROM supplier), s AS (SELECT c_custkey, c_nationkey AS venue, c_custkey % 20 AS r FROM customer) SELECT c_custkey, arg_min(s_suppkey, (abs(s.r - p.r), s_suppkey)) AS s_suppkey FROM s JOIN p USING (venue) GROUP BY 1")
def nearest_point(spark, sf_dir):
    point = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("venue"), F.lit(1).alias("floor"), F.lit("A").alias("block"), (F.col("s_suppkey") % 20).alias("row"), F.lit(1).alias("number"))
    seat = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("venue"), F.lit(1).alias("floor"), F.lit("A").alias("block"), (F.col("c_custkey") % 20).alias("row"), F.lit(1).alias("number"))
    return G.nearest_in_block(seat, point, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")
