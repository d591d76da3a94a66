"""Seats on a canvas and their labels, in halls made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import seats as L
from cadenza.operators import geometry as G
from cadenza.plans.catalogue import register
from cadenza.session import table

WIDTH, HEIGHT = 160, 90
CODES = "ABCDE"


def halls(spark, sf_dir):
    """Five blocks a floor and two floors a nation: rows in depth, seats in depth both ways, an unknown numbering, one block without an anchor."""
    n = F.col("n_nationkey")
    each = table(spark, sf_dir, "nation").select(n.alias("venue"), F.explode(F.array(F.lit(1), F.lit(2))).alias("floor"), n).select("venue", "floor", F.posexplode(F.array(*map(F.lit, CODES))).alias("i", "code"))
    i, v = F.col("i"), F.col("venue")
    blocks = each.select(
        "venue", "floor", "code", F.lit(3).alias("row_min"), (F.lit(8) + v % 5).alias("row_max"), F.when(i < 2, "depth").otherwise("width").alias("row_axis"), F.when(i.isin(2, 3), "depth").otherwise("width").alias("seat_axis"),
        F.when(i == 3, "toward").otherwise("away").alias("seat_direction"), F.when(i == 1, F.when(v % 3 == 0, "unknown").otherwise("confirmed")).otherwise("confirmed").alias("rows_known"), F.when(v % 2 == 0, "confirmed").otherwise("inferred").alias("geometry"),
    )
    anchors = each.filter("i < 4").select(
        "venue", "floor", "code", (F.lit(10) + v).alias("near_x"), (F.lit(80) - 7 * i).alias("near_y"), (F.lit(150) + v).alias("far_x"), (F.lit(5) - v % 4 * 5).alias("far_y"), F.when(i % 2 == 0, "left").otherwise("right").alias("side"),
        (i == 2).alias("folded"), F.lit(1).alias("seat_min"), (F.lit(11) + i).alias("seat_max"), F.when(i == 0, F.array(F.lit(5))).alias("missing_rows"), F.when(i != 1, F.lit(14)).alias("max_seat"),
    )
    floors = table(spark, sf_dir, "nation").select(n.alias("venue"), F.lit(1).alias("floor"), F.lit(93).alias("x"), F.lit(78).alias("y"))
    return blocks, anchors, floors


def tickets(spark, sf_dir):
    """Seats of orders: floors 1 to 3 or none, six block codes or none, rows, numbers or none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    code = F.element_at(F.array(*map(F.lit, [" a", "B", "C", "d ", "E", "Q"])), (c % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (c % 25).cast("int").alias("venue"), F.when(k % 17 != 0, (k % 3 + 1).cast("int")).alias("floor"), F.when(k % 13 != 0, code).alias("block"),
        F.when(k % 7 != 0, (k % 14).cast("int")).alias("row"), F.when(k % 5 != 0, (k % 19).cast("int")).alias("number"),
    )


@register("seat_points", r"""
WITH s AS (SELECT o_orderkey, (o_custkey % 25)::INT AS v, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 3 + 1)::INT END AS floor, CASE WHEN o_orderkey % 13 <> 0 THEN (o_custkey % 6)::INT END AS i,
    CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 14)::INT END AS r, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 19)::INT END AS n FROM orders),
k AS (SELECT *, floor IN (1, 2) AND coalesce(i, 9) < 4 AS ok, CASE i WHEN 2 THEN 'seat' WHEN 3 THEN 'seat' WHEN 0 THEN 'row' WHEN 1 THEN CASE WHEN v % 3 = 0 THEN 'none' ELSE 'row' END END AS way, 8 + v % 5 AS high FROM s),
d AS (SELECT *, CASE way WHEN 'seat' THEN CASE WHEN n IS NULL THEN 0.5 WHEN i = 3 THEN 1 - least(greatest((n - 1) / (10.0::DOUBLE + i), 0), 1) ELSE least(greatest((n - 1) / (10.0::DOUBLE + i), 0), 1) END
    WHEN 'row' THEN CASE WHEN r IS NULL OR r < 3 OR r > high OR (i = 0 AND r = 5) THEN 0.5 WHEN i = 0 THEN (r - 3 - (r > 5)::INT) / (high - 4.0::DOUBLE) ELSE (r - 3) / (high - 3.0::DOUBLE) END ELSE 0.5 END AS t,
    CASE way WHEN 'seat' THEN CASE WHEN n IS NULL THEN 'block' ELSE 'exact' END WHEN 'row' THEN CASE WHEN r IS NULL OR r < 3 OR r > high OR (i = 0 AND r = 5) THEN 'block' WHEN n IS NULL THEN 'row' ELSE 'exact' END ELSE 'block' END AS p,
    CASE WHEN way = 'row' AND r IS NOT NULL THEN CASE WHEN i = 0 AND r = 5 THEN 'no such row' WHEN r < 3 OR r > high THEN 'row outside block' END END AS w FROM k)
SELECT o_orderkey,
  CASE WHEN ok THEN least(greatest(floor(10 + v + 140 * t + 0.5) + CASE WHEN p = 'exact' AND i <> 1 THEN floor((least(greatest((n - 1) / 13.0::DOUBLE, 0), 1) - 0.5) * 2 + 0.5) ELSE 0 END, 0), 159)::INT WHEN floor = 1 THEN 93 END AS x,
  CASE WHEN ok THEN least(greatest(floor(80 - 7 * i + (5 - v % 4 * 5 - (80 - 7 * i)) * t + 0.5), 0), 89)::INT WHEN floor = 1 THEN 78 END AS y,
  CASE WHEN ok THEN CASE WHEN i % 2 = 0 THEN 'left' ELSE 'right' END WHEN floor = 1 THEN 'center' END AS side, CASE WHEN ok THEN p WHEN floor = 1 THEN 'floor' END AS precision,
  CASE WHEN ok THEN CASE WHEN v % 2 = 0 THEN 'confirmed' ELSE 'inferred' END WHEN floor = 1 THEN 'inferred' END AS geometry, CASE WHEN ok THEN i = 2 WHEN floor = 1 THEN false END AS folded,
  CASE WHEN ok THEN v % 2 <> 0 WHEN floor = 1 THEN true END AS approximate, CASE WHEN ok THEN 'ABCD'[i + 1] END AS block, CASE WHEN ok THEN w WHEN floor = 1 AND i IS NOT NULL THEN 'no such block' END AS warning FROM d""")
def seat_points(spark, sf_dir):
    """Points of all seats of the orders."""
    return G.seat_points(tickets(spark, sf_dir), *halls(spark, sf_dir), "o_orderkey", WIDTH, HEIGHT)


@register("seat_labels", r"""
WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS c, o_custkey % 3 + 1 AS f, chr((65 + o_custkey % 26)::INT) AS b, o_custkey % 30 + 1 AS r, o_orderkey % 40 + 1 AS n FROM orders)
SELECT o_orderkey, CASE c WHEN 0 THEN f || '층 ' || b || '구역 ' || r || '열 ' || n || '번' WHEN 1 THEN f || '층 BOX' || r || '구역 ' || n || '번' WHEN 2 THEN '합창석 1층 ' || b || '구역 ' || r || '열 ' || n || '번' END AS label FROM k""")
def seat_labels(spark, sf_dir):
    """Labels of seat maps read and written again: seats, boxes, seats behind the stage, and texts that are no label."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    floor, block, row, number = c % 3 + 1, F.char(65 + c % 26), c % 30 + 1, k % 40 + 1
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), floor, F.lit("층 "), block, F.lit(" 블럭 "), row, F.lit("열"), number, F.lit("번"))).when(k % 4 == 1, F.concat(floor, F.lit("층 BOX"), row, F.lit(" "), number, F.lit("번")))
    text = text.when(k % 4 == 2, F.concat(F.lit("합창석"), block, F.lit("블록"), row, F.lit("열 "), number, F.lit("번"))).otherwise(F.concat(floor, F.lit("층 출입구")))
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(L.parse_seat_label(text, compose=False))).alias("s"))
    label = L.seat_label(F.col("s.floor"), F.col("s.block"), F.col("s.row"), F.col("s.number"), F.col("s.choir"))
    return s.select("o_orderkey", F.when(F.col("s").isNotNull(), label).alias("label"))
