"""Labels of seats and of places in a hall, read and written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import nfkc

#: Words for the zones of a hall.
ZONES = (
    ("front-left", "앞쪽 왼편"), ("front-center", "앞쪽 가운데"), ("front-right", "앞쪽 오른편"), ("mid-left", "중간 왼편"), ("mid-center", "중간 가운데"), ("mid-right", "중간 오른편"),
    ("rear-left", "뒤쪽 왼편"), ("rear-center", "뒤쪽 가운데"), ("rear-right", "뒤쪽 오른편"), ("behind-stage", "무대 뒤 합창석"),
)
#: A label of a box, of a seat in a block, and the word for seats behind the stage.
BOX = r"^(\d)층\s+(BOX\d+)\s+(\d+)번$"
SEAT = r"^(\d)층(BOX\d+|[A-Z])블록?(?:(\d+)열)?(\d+)번$"
CHOIR = "합창석"


def parse_seat_label(label: Column, compose: bool = True) -> Column:
    """struct<floor, block, row, number, choir> of a seat's label; null if it is none.

    Boxes are read before spaces go, since their numbers would run together. Seats
    behind the stage count as floor 1. compose=False skips NFKC for composed labels.
    """
    raw = F.trim(F.regexp_replace(F.replace(nfkc(label) if compose else label, F.lit(" "), F.lit(" ")), r"^\s+|\s+$", ""))
    dense = F.replace(raw, F.lit(" "), F.lit(""))
    choir = F.startswith(dense, F.lit(CHOIR))
    seat = F.replace(F.when(choir, F.concat(F.lit("1층"), F.substring(dense, len(CHOIR) + 1, F.length(dense)))).otherwise(dense), F.lit("블럭"), F.lit("블록"))
    number = lambda s, pattern, g: F.regexp_extract(s, pattern, g).try_cast("int")
    box = F.struct(number(raw, BOX, 1).alias("floor"), F.regexp_extract(raw, BOX, 2).alias("block"), F.lit(None).cast("int").alias("row"), number(raw, BOX, 3).alias("number"), F.lit(False).alias("choir"))
    other = F.struct(number(seat, SEAT, 1).alias("floor"), F.regexp_extract(seat, SEAT, 2).alias("block"), number(seat, SEAT, 3).alias("row"), number(seat, SEAT, 4).alias("number"), choir.alias("choir"))
    return F.when(raw.rlike(BOX), box).when(seat.rlike(SEAT), other)


def seat_label(floor: Column, block: Column, row: Column, number: Column, choir: Column, point: Column | None = None) -> Column:
    """The parts of a seat that are known, as one label; a point stands for a row in halls that have view points alone."""
    some = lambda n, unit: F.when(F.coalesce(n, F.lit(0)) != 0, F.concat(n.cast("string"), F.lit(unit)))
    view = F.when(F.coalesce(row, F.lit(0)) == 0, F.concat(F.lit("시점"), point.cast("string"))) if point is not None else F.lit(None).cast("string")
    return F.concat_ws(" ", F.when(choir, CHOIR), F.concat(floor.cast("string"), F.lit("층")), F.concat(block, F.lit("구역")), some(row, "열"), some(number, "번"), view)


def zone_label(zone: Column) -> Column:
    """Words for a zone; empty for none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES for x in pair]), zone), F.lit(""))


def describe_placement(precision: Column, approximate: Column, floor: Column, block: Column, zone: Column, term: str) -> Column:
    """One line on where a seat is, with ≈ before what is not exact; term is the hall's word for a block."""
    place = F.concat(floor.cast("string"), F.lit("층 "))
    exact = F.concat(F.when(approximate, "≈ ").otherwise(""), place, block, F.lit(f"{term} · "), zone_label(zone))
    within = F.concat(F.lit("≈ "), place, block, F.lit(f"{term} 어딘가 · "), zone_label(zone))
    return F.when(precision.isin("exact", "row"), exact).when(precision == "block", within).when(precision == "floor", F.concat(F.lit("≈ "), place, F.lit("어딘가"))).otherwise("좌석 정보 없음")
