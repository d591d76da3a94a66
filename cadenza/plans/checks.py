"""Queries over operators of lines, records, seats and scores, on rows made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions.forms import parse_confidence
from cadenza.functions.numbers import band_of, clamp01, lerp, rounded
from cadenza.functions.text import normalize_work, parse_key, similarity, slug
from cadenza.operators import blocks as B
from cadenza.operators import catalog as C
from cadenza.operators import evaluation as E
from cadenza.operators import geometry as G
from cadenza.operators import profiles as P
from cadenza.operators import retrieval as R
from cadenza.operators import scoring as Q
from cadenza.operators import selection as L
from cadenza.operators import sync as S
from cadenza.operators import tickets as T
from cadenza.plans.catalogue import register
from cadenza.plans.evaluation import r4
from cadenza.plans.seats import halls, tickets
from cadenza.session import table


@register("allowed_orders", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND (o_orderkey % 2 = 0 OR o_custkey % 5 = 3) AND (o_orderkey % 3 = 0 OR o_totalprice <= 200000)")
def allowed_orders(spark, sf_dir):
    """Events that may be recommended: to come, in the region or worth a journey, within the budget."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"), (F.col("o_custkey") % 5).alias("region"), F.col("o_totalprice").alias("price_min"))
    budget = F.when(F.col("o_orderkey") % 3 != 0, F.lit(200000.0))
    return R.hard_filter(o, F.lit("1998-01-01").cast("timestamp"), F.lit(3), F.col("o_orderkey") % 2 == 0, budget).select("o_orderkey")


ZONES_SQL = """
s AS (SELECT o_orderkey, (o_custkey % 25)::INT AS venue, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 3 + 1)::INT END AS floor, CASE WHEN o_orderkey % 13 <> 0 THEN (o_custkey % 6)::INT END AS i, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 14)::INT END AS r FROM orders),
k AS (SELECT *, coalesce(floor IN (1, 2) AND i < 4, false) AS ok, r BETWEEN 3 AND 8 + venue % 5 AS inside FROM s),
d AS (SELECT *, CASE WHEN coalesce(inside, false) THEN (r - 3) / (5 + venue % 5)::DOUBLE ELSE 0.5 END AS t FROM k),
z AS (SELECT *, i * 0.2::DOUBLE + 0.3::DOUBLE * t AS x, ['left', 'center', 'right', 'center'][i + 1] AS col FROM d),
q AS (SELECT *, CASE WHEN x < 1 / 3::DOUBLE THEN 'front' WHEN x < 2 / 3::DOUBLE THEN 'mid' ELSE 'rear' END AS band FROM z),
zones AS (SELECT o_orderkey, venue, floor, CASE WHEN NOT ok THEN NULL WHEN i = 3 THEN 'behind-stage' ELSE band || '-' || col END AS zone, CASE WHEN floor IS NULL THEN 'none' WHEN NOT ok THEN 'floor' WHEN r IS NULL OR NOT inside THEN 'block' ELSE 'row' END AS precision FROM q)"""


def plan_zones(spark, sf_dir):
    blocks = halls(spark, sf_dir)[0]
    i = F.instr(F.lit("ABCDE"), F.col("code")) - 1
    col = F.element_at(F.array(*map(F.lit, ["left", "center", "right", "center"])), i + 1)
    zones = blocks.filter(i < 4).select("venue", "floor", "code", col.alias("col"), (i * F.lit(0.2)).alias("d0"), (i * F.lit(0.2) + F.lit(0.3)).alias("d1"), (i == 3).alias("behind"))
    return blocks, zones


@register("seat_zones", f"WITH {ZONES_SQL} SELECT o_orderkey, zone, precision FROM zones")
def seat_zones(spark, sf_dir):
    """Zones of all seats of the orders."""
    return G.seat_zones(tickets(spark, sf_dir), *plan_zones(spark, sf_dir), "o_orderkey").select("o_orderkey", "zone", "precision")


@register("occupied_zones", f"WITH {ZONES_SQL} SELECT venue, floor, zone, count(*) AS seats FROM zones WHERE zone IS NOT NULL GROUP BY ALL")
def occupied_zones(spark, sf_dir):
    t = tickets(spark, sf_dir)
    z = G.seat_zones(t, *plan_zones(spark, sf_dir), "o_orderkey").select("o_orderkey", "zone")
    return T.occupied_zones(t.select("o_orderkey", "venue", "floor").join(z, "o_orderkey"), "zone")


@register("private_lines", r"""
WITH l AS (SELECT doc_id, i - 1 AS i, x[i] AS t FROM (SELECT doc_id, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
m AS (SELECT doc_id, i, CASE WHEN i % 7 = 3 THEN '예매자' ELSE t END AS t FROM l),
n AS (SELECT *, t = '예매자' AS label, coalesce(lag(t) OVER w = '예매자', false) OR coalesce(lead(t) OVER w = '예매자', false) AS near FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]') THEN 'email' WHEN regexp_matches(t, '[0-9]{9,}') THEN 'digits' WHEN label THEN 'label' WHEN near THEN 'neighbour' END AS kind FROM n""")
def private_lines(spark, sf_dir):
    """Lines with addresses or long numbers, and label lines with what stands beside them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t")).withColumn("t", F.when(F.col("i") % 7 == 3, "예매자").otherwise(F.col("t")))
    return B.pii_lines(lines, "doc_id", "i", {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", "digits": "[0-9]{9,}"}, "t", ["예매자"]).select("doc_id", "i", "kind")


@register("reading_positions", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 50.0 / 0.02::DOUBLE), l_linenumber * 7 % 8, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS position FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_linenumber))")
def reading_positions(spark, sf_dir):
    """Boxes of a page in bands and then from left to right."""
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 7 % 8).alias("x"), (F.col("l_quantity") / 50.0).alias("y"))
    plain = boxes.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("k")).filter("n = k").select("l_orderkey")
    return B.reading_order(boxes.join(plain, "l_orderkey"), "l_orderkey", "x", "y").select("l_orderkey", "l_linenumber", "position")


@register("normal_titles", r"""SELECT p_partkey, replace(p_name, ' ', '') || 'op' || p_size || 'no' || (p_partkey % 9) AS work, p_name AS slug, CASE WHEN p_partkey % 2 = 0 THEN 'C sharp minor' ELSE '다장조' END AS key,
  floor((0.45 + 0.3 * (p_partkey % 4) / 4 + 0.25 * (p_partkey % 3) / 4) * 100 + 0.5 + 1e-9) / 100 AS confidence FROM part""")
def normal_titles(spark, sf_dir):
    """Titles as keys, as telling words, their key, and how sure a parse of four works is."""
    k = F.col("p_partkey")
    title = F.concat("p_name", F.lit(", Op. "), "p_size", F.lit(" (No. "), k % 9, F.lit(")"))
    line = F.concat(F.lit("Somebody: the "), "p_name", F.lit(" in C / Op. 5\nsecond line"))
    key = F.when(k % 2 == 0, F.lit("in c-sharp minor")).otherwise(F.lit("제1번 다장조"))
    return table(spark, sf_dir, "part").select("p_partkey", normalize_work(title, compose=False).alias("work"), slug(line).alias("slug"), parse_key(key).alias("key"), parse_confidence(F.lit(0.45), k % 4, k % 3, F.lit(4)).alias("confidence"))


FORCES = [("symphony", "orchestral"), ("concerto", "concerto"), ("sonata", "solo")]


@register("genres_and_forces", """SELECT p_partkey, CASE WHEN contains(p_type, 'ECO') THEN 'economy' WHEN contains(p_type, 'S') THEN 'with s' ELSE p_type END AS genre, CASE WHEN contains(p_type, 'ECO') THEN 0.9 WHEN contains(p_type, 'S') THEN 0.8 ELSE 0.5 END::DOUBLE AS sure,
  CASE p_partkey % 5 WHEN 0 THEN 'chamber' WHEN 1 THEN 'orchestral' WHEN 2 THEN 'concerto' WHEN 3 THEN 'solo' END AS forces, CASE p_partkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 4 THEN NULL ELSE 0.7 END::DOUBLE AS confidence FROM part""")
def genres_and_forces(spark, sf_dir):
    """Genres by the first rule, and forces of titles by a keyword or by their form."""
    title = F.element_at(F.array(*map(F.lit, ["Lieder for voice and piano, symphony", "Symphony in D", "Violin Concerto", "Cello Sonata", "Aufschwung"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", T.genre_class(F.col("p_type"), [("ECO", "economy", 0.9), ("S", "with s", 0.8)], "none").alias("g"), T.forces_of_title(title, [("voice and piano", "chamber")], FORCES).alias("f"))
    return p.select("p_partkey", F.col("g.genre").alias("genre"), F.col("g.confidence").alias("sure"), F.col("f.forces").alias("forces"), F.col("f.confidence").alias("confidence"))


@register("nearest_customers", """WITH p AS (SELECT c_custkey, (c_custkey * 7919) % 1009 AS x, (c_custkey * 104729) % 997 AS y FROM customer), t AS (SELECT n_nationkey AS target, n_nationkey * 40 AS tx, 1000 - n_nationkey * 40 AS ty FROM nation),
j AS (SELECT target, c_custkey, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS d FROM p, t)
SELECT target, c_custkey, floor(d * 10000.0 + 0.5) / 10000.0 AS distance FROM j QUALIFY row_number() OVER (PARTITION BY target ORDER BY (d * d)::BIGINT, c_custkey) <= 3""")
def nearest_customers(spark, sf_dir):
    """The three nearest points of each of the nations' places."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", (k * 7919 % 1009).alias("x"), (k * 104729 % 997).alias("y"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"), (F.col("n_nationkey") * 40).alias("tx"), (1000 - F.col("n_nationkey") * 40).alias("ty"))
    return G.nearest_top(points, "c_custkey", "x", "y", places, "target", "tx", "ty", 3).select("target", "c_custkey", rounded(F.col("distance")).alias("distance"))


@register("merged_readings", f"""
WITH i AS (SELECT l_orderkey AS file, l_linenumber % 2 AS run, l_linenumber * 1000000 + l_partkey AS pos, l_returnflag || l_linestatus AS item FROM lineitem),
c AS (SELECT file, count(DISTINCT run) AS runs, min(run) AS first FROM i GROUP BY 1), p AS (SELECT file, item, count(DISTINCT run) AS k FROM i GROUP BY ALL), u AS (SELECT file, count(*) AS total FROM p GROUP BY 1),
k AS (SELECT i.file, pos, i.item, count(*) OVER (PARTITION BY i.file) AS n FROM i JOIN c USING (file) JOIN p ON p.file = i.file AND p.item = i.item WHERE run = first AND k = runs)
SELECT file, pos, item, {r4('n / total::DOUBLE')} AS confidence FROM k JOIN u USING (file)""")
def merged_readings(spark, sf_dir):
    """Items of the first of two readings that both have."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") % 2).alias("run"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"), F.concat("l_returnflag", "l_linestatus").alias("item"))
    return T.merged_programmes(i, i.select("file", "run"), compose=False).select("file", F.col("at").alias("pos"), "item", "confidence")


@register("typed_records", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad((13 + o_orderkey % 9)::VARCHAR, 2, '0') || ':30' END AS time, (o_custkey % 4 + 1)::INT AS floor, (o_custkey % 30 + 1)::INT AS row, (o_orderkey % 40 + 1)::INT AS number, (1000 + o_custkey)::BIGINT AS price FROM orders""")
def typed_records(spark, sf_dir):
    """Written fields of tickets as dates, times, seats and prices."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    seat = F.concat(c % 4 + 1, F.lit("층 B구역 "), c % 30 + 1, F.lit("열 "), k % 40 + 1, F.lit("번"))
    time = F.when(k % 3 != 0, F.concat(13 + k % 9, F.lit(":30")))
    written = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy.MM.dd").alias("date"), time.alias("time"), seat.alias("seat"), F.concat(F.format_number(1000 + c, 0), F.lit("원")).alias("price"))
    r = T.typed_records(written, "date", "time", "seat", "price")
    return r.select("o_orderkey", F.col("date.value").alias("date"), F.col("time.value").alias("time"), "seat.floor", "seat.row", "seat.number", F.col("price").cast("long").alias("price"))


NAMES = [("red", "Red"), ("ring", "Ring"), ("blue", "Blue"), ("bolt", "Bolt")]


@register("composers_of_items", """SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'red') THEN 'Red' END, CASE WHEN contains(p_name, 'ring') THEN 'Ring' END, CASE WHEN contains(p_name, 'blue') THEN 'Blue' END, CASE WHEN contains(p_name, 'bolt') THEN 'Bolt' END, 'Ostrel') AS names FROM part""")
def composers_of_items(spark, sf_dir):
    """Known names of programme items in the order of the dictionary, else what stands before a dash."""
    items = F.array(F.concat(F.lit("to "), F.upper("p_name")), F.lit("J. Ostrel - Sonata"), F.lit("12 - x"), F.lit("ostrel: again"))
    known = F.regexp_replace(F.upper("p_name"), "RED|RING|BLUE|BOLT", "")
    items = F.when(known == F.upper("p_name"), F.slice(items, 2, 3)).otherwise(items)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.composers_of(items, NAMES), ",").alias("names"))


@register("halls_of_lines", """WITH a AS (SELECT DISTINCT p_name AS alias, 'hall ' || p_name AS hall FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'wing ' || split_part(p_name, ' ', 1) FROM part),
l AS (SELECT DISTINCT p_type, p_name, p_partkey % 3 AS c, CASE p_partkey % 3 WHEN 0 THEN 'at the ' || p_name || ', 2f' WHEN 1 THEN split_part(p_name, ' ', 1) || ' side' ELSE 'elsewhere' END AS line FROM part),
b AS (SELECT line, arg_min(hall, (-length(alias), hall)) AS hall FROM (SELECT DISTINCT line FROM l) JOIN a ON contains(line, alias) GROUP BY 1)
SELECT p_partkey, hall FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'at the ' || p_name || ', 2f' WHEN 1 THEN split_part(p_name, ' ', 1) || ' side' ELSE 'elsewhere' END AS line FROM part) LEFT JOIN b USING (line)""")
def halls_of_lines(spark, sf_dir):
    """The hall whose longest alias a line holds."""
    p, first = table(spark, sf_dir, "part"), F.substring_index("p_name", " ", 1)
    aliases = p.select(F.col("p_name").alias("alias"), F.concat(F.lit("hall "), "p_name").alias("hall")).unionByName(p.select(first.alias("alias"), F.concat(F.lit("wing "), first).alias("hall"))).distinct()
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("at the "), "p_name", F.lit(", 2f"))).when(k == 1, F.concat(first, F.lit(" side"))).otherwise("elsewhere")
    return B.longest_alias(p.select("p_partkey", line.alias("line")), "line", aliases, "hall", "alias").select("p_partkey", "hall")


@register("text_scores", f"""WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', 1) ELSE lower(p_type) END AS b, p_brand || ' ' || p_name AS other FROM part)
SELECT p_partkey, a = b AS correct, {r4("CASE WHEN a = b THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END")} AS score, contains(other, b) OR contains(b, other) AS misattributed FROM p""")
def text_scores(spark, sf_dir):
    """Scores of read names, and whether a wrong one stands in another field."""
    a, k = F.col("p_name"), F.col("p_partkey") % 3
    b = F.when(k == 0, a).when(k == 1, F.substring_index("p_name", " ", 1)).otherwise(F.lower("p_type"))
    p = table(spark, sf_dir, "part").select("p_partkey", E.text_score(a, b, similarity(a, b)).alias("s"), E.is_misattributed(b, F.array(F.concat("p_brand", F.lit(" "), "p_name"))).alias("misattributed"))
    return p.select("p_partkey", "s.correct", rounded(F.col("s.score")).alias("score"), "misattributed")


@register("stale_devices", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id FROM l WHERE last < (SELECT max(ts) FROM events WHERE event_id % 50 = 0) - INTERVAL 1 DAY")
def stale_devices(spark, sf_dir):
    """Devices whose last entry is older than tombstones are kept."""
    e = table(spark, sf_dir, "events")
    now = e.filter("event_id % 50 = 0").agg(F.max("ts"))
    return S.stale_devices(e, "user_id", "ts", now, 1).select("user_id")


@register("own_orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = o_orderkey % 100")
def own_orders(spark, sf_dir):
    """Rows that a user may read, of the tables that anybody may."""
    shown = C.published({"orders": table(spark, sf_dir, "orders"), "events": table(spark, sf_dir, "events")}, ["orders"])
    return C.own_rows(shown["orders"], "o_custkey", F.col("o_orderkey") % 100).select("o_orderkey", "o_custkey")


@register("depth_bands", f"WITH t AS (SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 10000)) AS t FROM customer) SELECT c_custkey, {r4('10 + 30 * t')} AS x, CASE WHEN t < 1 / 3::DOUBLE THEN 'front' WHEN t < 2 / 3::DOUBLE THEN 'mid' ELSE 'rear' END AS band FROM t")
def depth_bands(spark, sf_dir):
    t = clamp01(F.col("c_acctbal") / 10000)
    return table(spark, sf_dir, "customer").select("c_custkey", rounded(lerp(F.lit(10.0), F.lit(40.0), t)).alias("x"), band_of(t).alias("band"))


@register("liking_by_forces", f"SELECT p_type AS forces, count(*) AS n, {r4('corr(p_size, p_retailprice % 7)')} AS correlation FROM part WHERE p_size % 5 <> 0 GROUP BY 1 HAVING count(*) >= 8")
def liking_by_forces(spark, sf_dir):
    """How liking goes with the type of programme, for types with enough ratings."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("forces"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("x"), (F.col("p_retailprice") % 7).alias("y"))
    return P.correlation_by(p, "forces", "x", "y")


@register("grounded_answers", f"""WITH o AS (SELECT l_orderkey, list_distinct(list(l_partkey % 40)) AS cited, list(l_suppkey % 40) AS given FROM lineitem GROUP BY 1)
SELECT l_orderkey, {r4('len(list_filter(cited, lambda x: list_contains(given, x))) / len(cited)::DOUBLE')} AS grounded FROM o""")
def grounded_answers(spark, sf_dir):
    """Share of what each answer names that it was given."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 40).alias("cited"), F.collect_list(F.col("l_suppkey") % 40).alias("given"))
    return o.select("l_orderkey", rounded(Q.groundedness(F.col("cited"), F.col("given"))).alias("grounded"))


@register("mood_axes", f"""WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS tag FROM part),
v AS (SELECT tag, a AS axis, ((length(tag) * (a + 3)) % 9 - 4) / 4.0::DOUBLE AS value FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part), (SELECT unnest([0, 1]) AS a) WHERE NOT (length(tag) = 4 AND a = 1))
SELECT p_partkey, {r4('avg(value) FILTER (axis = 0)')} AS valence, {r4('avg(value) FILTER (axis = 1)')} AS energy FROM t JOIN v USING (tag) GROUP BY 1""")
def mood_axes(spark, sf_dir):
    """Words of works as tags, and their values on two axes."""
    p = table(spark, sf_dir, "part")
    tags = p.select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")).alias("tag"))
    words = p.select(F.explode(F.split("p_name", " ")).alias("tag")).distinct().select("tag", F.posexplode(F.array(F.lit("valence"), F.lit("energy"))).alias("a", "axis"))
    values = words.filter(~((F.length("tag") == 4) & (F.col("a") == 1))).select("tag", "axis", ((F.length("tag") * (F.col("a") + 3) % 9 - 4) / 4.0).alias("value"))
    return P.mood_axes(tags, "p_partkey", "tag", values, ["valence", "energy"])


@register("golden_agreement", f"""WITH g AS (SELECT 'valence' AS field, NULL AS truth, NULL AS value, c_acctbal - 4000 AS tn, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal - 4500 END AS n FROM customer WHERE c_custkey % 6 <> 0 UNION ALL
  SELECT 'segment', CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, NULL, NULL FROM customer)
SELECT field, count(*) AS n, {r4('avg(CASE WHEN tn IS NOT NULL THEN (sign(tn) = sign(coalesce(n, 0)))::INT ELSE (truth IS NOT DISTINCT FROM value)::INT END)')} AS agreement FROM g WHERE tn IS NOT NULL OR truth IS NOT NULL GROUP BY 1""")
def golden_agreement(spark, sf_dir):
    """Tags against a golden set: signs of numbers, and equal words."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    numbers = c.select(F.lit("valence").alias("field"), none("string").alias("truth"), none("string").alias("value"), F.when(k % 4 != 0, F.col("c_acctbal") - 4500).alias("n"), F.when(k % 6 != 0, F.col("c_acctbal") - 4000).alias("tn"))
    words = c.select(F.lit("segment").alias("field"), F.when(k % 9 != 0, F.col("c_mktsegment")).alias("truth"), F.when(k % 3 == 0, "OTHER").when(k % 5 != 0, F.col("c_mktsegment")).alias("value"), none("double").alias("n"), none("double").alias("tn"))
    return Q.golden_agreement(numbers.unionByName(words), "field", "truth", "value", "n", "tn")


@register("halved_batches", """
WITH RECURSIVE i AS (SELECT l_orderkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INT AS pos, l_quantity < 6 AS bad FROM lineitem),
p(b, first, n) AS (SELECT b, 1, count(*)::INT FROM i GROUP BY b
  UNION ALL SELECT b, CASE WHEN h = 0 THEN first ELSE first + (n + 1) // 2 END, CASE WHEN h = 0 THEN (n + 1) // 2 ELSE n - (n + 1) // 2 END FROM (SELECT p.b, first, n FROM p JOIN i ON i.b = p.b AND pos >= first AND pos < first + n GROUP BY ALL HAVING bool_or(bad) AND n > 1), (SELECT unnest([0, 1]) AS h)),
z AS (SELECT i.b, i.pos, min(n) AS n FROM i JOIN p ON p.b = i.b AND pos >= first AND pos < first + n GROUP BY ALL)
SELECT i.b AS l_orderkey, i.pos AS at_, max(p.first) AS first, z.n FROM i JOIN z USING (b, pos) JOIN p ON p.b = i.b AND p.n = z.n AND i.pos >= p.first AND i.pos < p.first + p.n GROUP BY ALL""".replace(" AS at_, max(p.first)", " AS place, max(p.first)"))
def halved_batches(spark, sf_dir):
    """Batches with readings that fail, split in halves until what fails stands alone."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda s: s["l_quantity"] < 6).alias("bad"))
    return b.select("l_orderkey", F.posexplode(L.halved(F.col("bad"), 6)).alias("i", "p")).select("l_orderkey", (F.col("i") + 1).alias("place"), "p.first", "p.n")


@register("collection_summary", """WITH d AS (SELECT n_chars, lang, source, quality, len(string_split(text, chr(10))) AS lines FROM documents LEFT JOIN labels USING (doc_id))
SELECT unnest(['rows', 'labelled', 'good', 'short', 'lines', 'characters']) AS measure, unnest([count(*), count(quality), count(*) FILTER (quality = 1), count(*) FILTER (n_chars < 200), sum(lines)::BIGINT, sum(n_chars)::BIGINT]) AS n FROM d""")
def collection_summary(spark, sf_dir):
    """What a collection holds, in one pass."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.collection_summary(d, {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "short": F.col("n_chars") < 200}, {"lines": F.size(F.split("text", "\n", -1)), "characters": F.col("n_chars")})


@register("success_by_source", "SELECT coalesce(CASE WHEN source = 'src3' THEN NULL ELSE source END, '?') AS source, count(*) AS n, count(*) FILTER (quality IS NOT NULL) AS labelled, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def success_by_source(spark, sf_dir):
    """How far documents of each source come: labelled, and good."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    return P.success_by(d, "source", {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1})


@register("empty_values", "SELECT p_partkey, p_partkey % 4 < 3 AS text, p_partkey % 3 = 0 OR p_partkey % 4 < 3 AS list, p_partkey % 5 IN (0, 1) AS number FROM part")
def empty_values(spark, sf_dir):
    """Texts, lists and numbers that stand for nothing."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.lit(" N/A ")).when(k % 4 == 1, F.lit("알 수 없음")).when(k % 4 == 3, F.col("p_name"))
    number = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 5 != 1, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", X.is_empty_value(text).alias("text"), X.is_empty_list(F.when(k % 3 != 0, F.array(F.lit("-"), text))).alias("list"), X.is_empty_number(number).alias("number"))


@register("composed_names", "SELECT p_partkey, replace(p_name, ' ', '') || p_size || 'カ' AS name FROM part")
def composed_names(spark, sf_dir):
    """Names in full-width letters and half-width kana, composed and normalised."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))
    size = F.translate(F.col("p_size").cast("string"), "0123456789", "".join(chr(0xFF10 + i) for i in range(10)))
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_text(F.concat(wide, F.lit("（"), size, F.lit("）ｶ"))).alias("name"))


@register("line_kinds", """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS c, repeat('가 ', (o_custkey % 30)::INT) AS pad FROM orders)
SELECT o_orderkey, c IN (0, 3) AS noise, (c = 1 AND length(pad) + 4 > 40) OR (c = 3 AND length(pad) + 5 > 40) AS prose FROM o""")
def line_kinds(spark, sf_dir):
    """Lines of programmes, of ticket offices and of prose."""
    pad = F.repeat(F.lit("가 "), (F.col("o_custkey") % 30).cast("int"))
    end = F.element_at(F.array(*map(F.lit, ["예매 안내", "이었다.", "소나타 2", "문의한다."])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = F.concat(pad, end)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.is_noise(line).alias("noise"), X.is_sentence(line).alias("prose"))
