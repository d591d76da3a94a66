"""Seats: nearest view point, depth in a block, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import saved, small_side


def nearest_in_block(seats: DataFrame, points: DataFrame, seat: str, point: str) -> DataFrame:
    """seats and points with venue, floor, block, row, number: per seat the point of its block nearest by row, then by number, then least key.

    A null row or number counts as distance 0 there.
    """
    keys = ["venue", "floor", "block"]
    # of points at one place only the least key can be the answer; the places of a block are a bounded list
    place = points.groupBy(*keys, F.col("row").alias("_row"), F.col("number").alias("_number")).agg(F.min(point).alias(point))
    p = small_side(saved(place.groupBy(*keys).agg(F.collect_list(F.struct("_row", "_number", point)).alias("_places"))))
    far = lambda a, b: F.coalesce(F.abs(F.col(a) - b), F.lit(0))
    near = F.array_min(F.transform("_places", lambda x: F.struct(far("row", x["_row"]).alias("d_row"), far("number", x["_number"]).alias("d_number"), x[point].alias(point))))
    return seats.join(p, keys).select(seat, near.alias("x")).groupBy(seat).agg(F.min("x").alias("x")).select(seat, "x.*")


def depth_in_block(row: Column, row_min: Column, row_max: Column) -> Column:
    """struct<depth, warning>: 0 at the first row, 1 at the last, the middle where it is unknown or outside."""
    inside = (row >= row_min) & (row <= row_max)
    span = F.when(row_max > row_min, (row - row_min) / (row_max - row_min)).otherwise(0.5)
    return F.struct(F.when(F.coalesce(inside, F.lit(False)), span).otherwise(0.5).alias("depth"), F.coalesce(~inside, F.lit(False)).alias("warning"))


def nearest_top(points: DataFrame, key: str, x: str, y: str, targets: DataFrame, target: str, tx: str, ty: str, k: int = 1) -> DataFrame:
    """The k nearest points of each target (a short list) by distance, ties by key.

    The points are dealt into groups; the k-th best of the groups' nearest points is
    no nearer than the k-th nearest of all. So what is farther goes before anything is
    sorted, and the first pass, a hash aggregate of plain minima, holds a row for each
    target and group. Points as far as the bar stay, and the window decides by key.
    """
    j = points.join(F.broadcast(targets.select(target, F.col(tx).alias("_x"), F.col(ty).alias("_y"))))
    d = F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))
    all_pairs = j.select(target, key, d.alias("distance"))
    nearest = all_pairs.groupBy(target, F.pmod(F.xxhash64(key), F.lit(64 * k)).alias("_group")).agg(F.min("distance").alias("_nearest"))
    bar = nearest.groupBy(F.col(target).alias("_target")).agg(F.get(F.array_sort(F.collect_list("_nearest")), F.lit(k - 1)).alias("_bar"))
    close = all_pairs.join(F.broadcast(bar), F.col(target).eqNullSafe(F.col("_target"))).filter(F.col("_bar").isNull() | F.col("distance").isNull() | (F.col("distance") <= F.col("_bar")))  # a row for each target
    w = Window.partitionBy(target).orderBy("distance", key)
    return close.select(target, key, "distance").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def seat_zones(seats: DataFrame, blocks: DataFrame, zones: DataFrame, seat: str) -> DataFrame:
    """Zone of each seat: struct columns zone, precision, column, band, approximate, warning.

    seats(seat, venue, floor, block, row), blocks(venue, floor, code, row_min, row_max,
    geometry) and zones(venue, floor, code, col, d0, d1, behind). A block that either
    table lacks leaves the floor alone; a seat without floor has no zone. Block codes
    are compared trimmed and in upper case.
    """
    code = lambda c: F.upper(F.trim(F.col(c)))
    b = blocks.select("venue", "floor", code("code").alias("_code"), "row_min", "row_max", "geometry")
    z = zones.select("venue", "floor", code("code").alias("_code"), "col", "d0", "d1", "behind")
    plan = b.join(z, ["venue", "floor", "_code"])  # both are needed, so they meet first
    x = seats.withColumn("_code", code("block")).join(plan, ["venue", "floor", "_code"], "left")
    known = F.col("geometry").isNotNull()
    depth = depth_in_block(F.col("row"), F.col("row_min"), F.col("row_max"))
    t = F.col("d0") + (F.col("d1") - F.col("d0")) * depth["depth"]
    band = F.when(t < 1 / 3, "front").when(t < 2 / 3, "mid").otherwise("rear")
    zone = F.when(F.col("floor").isNull() | ~known, F.lit(None).cast("string")).when(F.col("behind"), "behind-stage").otherwise(F.concat_ws("-", band, F.col("col")))
    precision = F.when(F.col("floor").isNull(), "none").when(~known, "floor").when(F.col("row").isNull() | depth["warning"], "block").otherwise("row")
    warning = F.when(F.col("floor").isNotNull() & ~known & F.col("block").isNotNull(), "unknown block").when(known & depth["warning"], "row outside block")
    flat = known & ~F.col("behind")
    return x.select(seat, zone.alias("zone"), precision.alias("precision"), F.when(flat, F.col("col")).alias("column"), F.when(flat, band).alias("band"), F.coalesce(F.col("geometry") != "confirmed", F.lit(True)).alias("approximate"), warning.alias("warning"))


def half_up(x: Column) -> Column:
    """The nearest integer, halves upwards."""
    return F.floor(x + 0.5).cast("int")


def clamp(x: Column, least, most) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(least))


def depth_share(row: Column, number: Column, block: Column, anchor: Column) -> Column:
    """struct<t, precision, warning>: how far a seat lies from the near end of its block (0) to the far one (1).

    Where seat numbers run in depth they decide, else rows do, counted without those
    that the block lacks. A row that is lacking or outside, an unknown numbering and a
    missing number give the middle of the block.
    """
    told = lambda t, precision, warning=None: F.struct(t.cast("double").alias("t"), F.lit(precision).alias("precision") if isinstance(precision, str) else precision.alias("precision"), F.lit(warning).cast("string").alias("warning"))
    middle = told(F.lit(0.5), "block")
    by_seat = (block["seat_axis"] == "depth") & anchor["seat_min"].isNotNull() & anchor["seat_max"].isNotNull()
    u = clamp((number - anchor["seat_min"]) / F.greatest(anchor["seat_max"] - anchor["seat_min"], F.lit(1)), 0.0, 1.0)
    by_row = (block["row_axis"] == "depth") & row.isNotNull() & block["row_min"].isNotNull() & block["row_max"].isNotNull() & (block["row_min"] <= block["row_max"])
    gaps = F.coalesce(anchor["missing_rows"], F.expr("CAST(array() AS array<int>)"))
    lacking = lambda upto: F.size(F.filter(F.array_distinct(gaps), lambda g: (g >= block["row_min"]) & (g <= upto)))
    at, last = row - block["row_min"] - lacking(row), block["row_max"] - block["row_min"] - lacking(block["row_max"])
    inside = (row >= block["row_min"]) & (row <= block["row_max"])
    rows = F.when(F.array_contains(gaps, row), told(F.lit(0.5), "block", "no such row")).when(~inside, told(F.lit(0.5), "block", "row outside block"))
    rows = rows.otherwise(told(F.when(last <= 0, 0.5).otherwise(at / last), F.when(number.isNotNull(), "exact").otherwise("row")))
    unknown = (block["rows_known"] == "unknown") & ~F.coalesce(block["seat_axis"] == "depth", F.lit(False))
    seats = F.when(number.isNull(), middle).otherwise(told(F.when(block["seat_direction"] == "toward", 1 - u).otherwise(u), "exact"))
    return F.when(F.coalesce(unknown, F.lit(False)), middle).when(F.coalesce(by_seat, F.lit(False)), seats).when(F.coalesce(by_row, F.lit(False)), rows).otherwise(middle)


def lateral(number: Column, seats: Column) -> Column:
    """-1, 0 or 1: from which side of the middle of its row a seat is seen."""
    return F.when(seats > 1, half_up((clamp((number - 1) / (seats - 1), 0.0, 1.0) - 0.5) * 2)).otherwise(0)


def seat_points(seats: DataFrame, blocks: DataFrame, anchors: DataFrame, floors: DataFrame, seat: str, width: int, height: int) -> DataFrame:
    """Points of seats on a canvas: seat, x, y, side, precision, geometry, folded, approximate, block, warning.

    seats(seat, venue, floor, block, row, number); blocks(venue, floor, code, row_min,
    row_max, row_axis, seat_axis, seat_direction, rows_known, geometry); anchors(venue,
    floor, code, near_x, near_y, far_x, far_y, side, folded, seat_min, seat_max,
    missing_rows, max_seat); floors(venue, floor, x, y). A seat lies between the two
    ends of its block's anchor, one pixel to a side if its number is known. Without a
    block or an anchor it falls back to the floor's point; without that, or without a
    floor, it has no point. Codes are compared trimmed and in upper case.
    """
    code = lambda c: F.upper(F.trim(F.col(c)))
    b = blocks.select("venue", "floor", code("code").alias("_code"), F.struct("row_min", "row_max", "row_axis", "seat_axis", "seat_direction", "rows_known", "geometry").alias("_b"))
    a = anchors.select("venue", "floor", code("code").alias("_code"), F.struct("near_x", "near_y", "far_x", "far_y", "side", "folded", "seat_min", "seat_max", "missing_rows", "max_seat").alias("_a"))
    plan = b.join(a, ["venue", "floor", "_code"])  # both are needed, so they meet first
    points = floors.select("venue", "floor", F.struct("x", "y").alias("_f"))
    x = seats.withColumn("_code", code("block")).join(plan, ["venue", "floor", "_code"], "left").join(points, ["venue", "floor"], "left")
    # a generator, so that the depth is not computed again for each of its uses
    x = x.select("*", F.explode(F.array(depth_share(F.col("row"), F.col("number"), F.col("_b"), F.col("_a")))).alias("_d"))
    found, t = F.col("_b").isNotNull(), F.col("_d.t")
    between = lambda axis: half_up(F.col(f"_a.near_{axis}") + (F.col(f"_a.far_{axis}") - F.col(f"_a.near_{axis}")) * t)
    aside = F.when((F.col("_d.precision") == "exact") & F.col("number").isNotNull() & (F.col("_a.max_seat") > 0), lateral(F.col("number"), F.col("_a.max_seat"))).otherwise(0)
    pick = lambda yes, no: F.when(found, yes).when(F.col("_f").isNotNull(), no)
    return x.select(
        seat, pick(clamp(between("x") + aside, 0, width - 1), F.col("_f.x")).alias("x"), pick(clamp(between("y"), 0, height - 1), F.col("_f.y")).alias("y"),
        pick(F.col("_a.side"), F.lit("center")).alias("side"), pick(F.col("_d.precision"), F.lit("floor")).alias("precision"), pick(F.col("_b.geometry"), F.lit("inferred")).alias("geometry"),
        pick(F.col("_a.folded"), F.lit(False)).alias("folded"), pick(F.col("_b.geometry") != "confirmed", F.lit(True)).alias("approximate"), F.when(found, F.col("_code")).alias("block"),
        pick(F.col("_d.warning"), F.when(F.col("block").isNotNull() & (F.trim("block") != ""), "no such block")).alias("warning"),
    )
