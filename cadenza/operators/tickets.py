"""From the lines of a ticket to a record, and from several readings of it to one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import parsers as P
from cadenza.functions.forms import canon_form, first_match
from cadenza.functions.numbers import ratio, rounded
from cadenza.functions.text import bound, canonical, is_empty_value
from cadenza.operators.profiles import consensus
from cadenza.session import saved, small_side

# What a seat line looks like, and what must not be taken for one.
SEAT_CONTEXT = r"(좌석|객석|[0-9OolIi]\s*층|구역|블록|블럭|[0-9OolIi]\s*열|[0-9OolIi]\s*번)"
DATE_CONTEXT = r"(\d{4}\s*[년.\-/]|\d{1,2}\s*월\s*\d{1,2}\s*일|년\s*\d{1,2}\s*월)"
SEAT_POINTS = ((r"\d\s*층", 2), (r"(구역|블록|블럭)", 2), (r"\d\s*열", 3), (r"\d\s*번", 2), (r"(좌석|객석)", 2))
SEAT_CAPTION = r"(?i)^\s*(좌석|객석|SEAT)\s*[:：]\s*"
NOT_A_TITLE = r"(예매|취소|환불|주최|주관|후원|문의|안내|입장|관람|티켓링크|인터파크|예스24|SAMPLE)"
#: Repairs of seat lines by a name of our own, each with its pattern and what takes its place; digits are put right one by one.
REPAIRS = (
    ("row-before-number", r"(\d{1,3})\s*[일월](?=\s*\d{1,3}\s*번)", "$1열"),
    ("row-after-block", r"((?:층|구역|블록|블럭)\s*)(\d{1,3})\s*[일월](?![\d가-힣])", "$1$2열"),
    ("zero", r"[Oo](?=[0-9OolIi]{0,2}\s*(?:층|열|번))", "0"),
    ("one", r"[lIi](?=[0-9OolIi]{0,2}\s*(?:층|열|번))", "1"),
)


def is_seat_line(text: Column) -> Column:
    """Whether a line speaks of a seat and not of a date."""
    return F.coalesce(text.rlike(SEAT_CONTEXT) & ~text.rlike(DATE_CONTEXT) & text.rlike("[0-9OolIi]"), F.lit(False))


def repaired_seat(text: Column) -> Column:
    """struct<text, rules>: misread units and digits of a seat line put right, with the names of the repairs that changed it."""

    def from_step(i: int, now: Column, changed: list[Column]) -> Column:
        if i == len(REPAIRS):
            return F.struct(now.alias("text"), F.filter(F.array(*changed), lambda r: r.isNotNull()).alias("rules"))
        name, pattern, to = REPAIRS[i]
        return bound(F.regexp_replace(now, pattern, to), lambda new: from_step(i + 1, new, [*changed, F.when(new != now, F.lit(name))]))

    same = lambda t: F.struct(t.alias("text"), F.array().cast("array<string>").alias("rules"))
    return bound(text, lambda t: F.when(is_seat_line(t), from_step(0, t, [])).otherwise(same(t)))


@dataclass(frozen=True)
class Rules:
    """Patterns of a ticket: venues as (pattern, name), dates and times in order of trust."""

    venues: Sequence[tuple[str, str]]
    dates: Sequence[str]
    times: Sequence[str]
    gate: str
    booking: str
    grade: str
    price: str
    free: str


def seat_points(text: Column, rules: Rules) -> Column:
    """How much a line looks like a seat: points by its parts, 0 for gates and booking numbers."""
    points = sum((F.when(text.rlike(p), n).otherwise(0) for p, n in SEAT_POINTS), F.lit(0))
    return F.when(text.rlike(rules.gate) | F.trim(text).rlike(rules.booking), 0).otherwise(points)


def record_of(lines: DataFrame, page: str, rules: Rules) -> DataFrame:
    """One row for each page of lines(page, at, text, confidence, height, top): venue, date, time, seat, grade, price, title, each with its confidence.

    All fields are choices of one line, made by one grouped aggregate: by order of
    patterns and lines, by points, by length, or by size of print. What no rule finds
    is null.
    """
    text = F.col("text")

    def first(patterns: Sequence[str], shown: Sequence[str] | None = None) -> tuple[Column, Column]:
        """(rank, value) of a line for a list of patterns in order."""
        rank = F.coalesce(*[F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
        value = F.coalesce(*[F.when(text.rlike(p), F.lit(shown[i]) if shown else F.trim(F.regexp_replace(F.regexp_extract(text, p, 0), r"\s+", " "))) for i, p in enumerate(patterns)])
        return rank, value

    points = seat_points(text, rules)
    v_rank, venue = first([p for p, _ in rules.venues], [n for _, n in rules.venues])
    d_rank, date = first(rules.dates)
    t_rank, time = first(rules.times)
    found = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    grade, price = found(rules.grade), found(rules.price)
    free = F.when(F.length(text) <= 12, found(rules.free))
    plain = F.trim(text)
    titled = (
        F.length(plain).between(3, 60) & v_rank.isNull() & d_rank.isNull() & t_rank.isNull() & (points <= 0) & ~text.rlike(rules.gate) & ~plain.rlike(rules.booking)
        & ~plain.rlike(r"^[\d\s.,:\-/()]+$") & ~plain.rlike(NOT_A_TITLE) & ~(grade.isNotNull() & (F.length(plain) <= 6)) & price.isNull() & free.isNull()
    )
    size = F.coalesce("height", F.lit(0.0)) * F.when(text.rlike("[가-힣]"), 1.15).otherwise(1.0) - 0.01 * F.coalesce("top", F.lit(0.5))
    least = lambda most: F.least(F.lit(most), F.col("confidence"))

    def choice(name: str, value: Column, most: float, *order: Column) -> Column:
        """The value of the line that comes first in order, of those that have one."""
        keys = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("at").alias("at"), value.alias("value"), least(most).alias("confidence"))
        return F.min(F.when(value.isNotNull(), keys)).alias(name)

    chosen = lines.groupBy(page).agg(
        choice("venue", venue, 0.95), choice("date", date, 0.95, d_rank), choice("time", time, 0.9, t_rank),
        choice("seat", F.when(points > 0, F.trim(F.regexp_replace(text, SEAT_CAPTION, ""))), 0.9, -points),
        choice("grade", F.regexp_replace(grade, r"\s+", ""), 0.85, F.length(text)), choice("price", F.trim(price), 0.9), choice("free", free, 0.7), choice("title", F.when(titled, plain), 0.6, -size),
    )
    pair = lambda c: F.struct(F.col(f"{c}.value").alias("value"), F.col(f"{c}.confidence").alias("confidence"))
    return chosen.select(page, *[pair(c).alias(c) for c in ("venue", "date", "time", "seat", "grade")], F.coalesce(F.when(F.col("price").isNotNull(), pair("price")), pair("free")).alias("price"), pair("title").alias("title"))


def _given(text: Column, parse: Callable[[Column], Column]) -> Column:
    return bound(text, lambda x: F.when(~is_empty_value(x), parse(x)))


def _seated(text: Column) -> Column:
    return bound(repaired_seat(text)["text"], P.parse_seat)


def typed_record(date: Column, time: Column, seat: Column, price: Column) -> Column:
    """struct of the parsed fields; a field that is absent stays null and has no confidence."""
    return F.struct(_given(date, P.parse_date).alias("date"), _given(time, P.parse_time).alias("time"), _given(seat, _seated).alias("seat"), _given(price, P.parse_price).alias("price"))


def typed_records(rows: DataFrame, date: str, time: str, seat: str, price: str) -> DataFrame:
    """rows with the fields of typed_record in place of their texts.

    Many tickets share a day or a seat, whose patterns are the dear ones: each of their
    texts is parsed once and joined to its rows. Times and prices are parsed where they are.
    """
    for text, parse in ((date, P.parse_date), (seat, _seated)):
        told = saved(rows.select(F.col(text).alias("_text")).filter("_text IS NOT NULL").distinct().withColumn("_told", _given(F.col("_text"), parse)))
        rows = rows.join(small_side(told), F.col(text) == F.col("_text"), "left").withColumn(text, F.col("_told")).drop("_text", "_told")
    return rows.withColumns({time: _given(F.col(time), P.parse_time), price: _given(F.col(price), P.parse_price)})


def composers_of(items: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """array<string>: composers of programme items, in order and once each: all whose alias an item holds, else what stands before its separator.

    aliases(alias, name) is a short list in order of names.
    """
    known = F.array(*[F.struct(F.lit(a.lower()).alias("alias"), F.lit(n).alias("name")) for a, n in aliases])

    def of(item: Column) -> Column:
        named = F.transform(F.filter(known, lambda k: F.contains(F.lower(item), k["alias"])), lambda k: k["name"])
        front = F.regexp_replace(F.trim(F.regexp_extract(item, r"^\s*([^\-:–—]{2,30}?)\s*[-:–—]\s*\S", 1)), r"^[A-Z]\.\s*", "")
        guessed = F.filter(F.array(front), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
        return F.when(F.size(named) > 0, named).otherwise(guessed)

    found = F.flatten(F.transform(F.filter(items, lambda i: i.isNotNull() & (F.trim(i) != "")), of))
    # once each, whatever the case; the first spelling stays
    return bound(found, lambda f: bound(F.transform(f, lambda x: F.lower(x)), lambda low: F.filter(f, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def merged_fields(values: DataFrame, compose: bool = True) -> DataFrame:
    """values(file, run, field, value) to (file, field, value, confidence): the reading of most runs, and their share."""
    canon = values.withColumn("canon", canonical(F.col("value"), compose))
    return consensus(canon, ["file", "field"], "run", "value", "canon")


def merged_programmes(items: DataFrame, runs: DataFrame, compose: bool = True) -> DataFrame:
    """items(file, run, at, item) and runs(file, run) to (file, at, item, confidence): items of the first run that every run has.

    The confidence is their share of all that any run has.
    """
    x = items.withColumn("canon", canonical(F.col("item"), compose))
    count = runs.select("file", "run").distinct().groupBy("file").agg(F.count("*").alias("runs"), F.min("run").alias("first"))
    per = x.select("file", "canon", "run").distinct().groupBy("file", "canon").agg(F.count("*").alias("in_runs")).join(count, "file")
    w = Window.partitionBy("file")
    per = per.withColumn("union", F.count("*").over(w))
    kept = x.join(per.filter("in_runs = runs"), ["file", "canon"]).filter("run = first")
    return kept.withColumn("n", F.count("*").over(w)).select("file", "at", "item", rounded(ratio(F.col("n"), F.col("union"))).alias("confidence"))


def forces_of(form: Column, forces: Sequence[tuple[str, str]]) -> Column:
    """struct<forces, confidence> of a form: 0.9 for an exact entry, 0.7 for the first entry that begins or ends it, else null."""
    key = F.lower(F.trim(form))
    value = lambda v, c: F.struct(F.lit(v).alias("forces"), F.lit(c).alias("confidence"))
    exact = F.coalesce(*[F.when(key == k, value(v, 0.9)) for k, v in forces])
    loose = F.coalesce(*[F.when(key.startswith(k + " ") | key.endswith(" " + k), value(v, 0.7)) for k, v in forces])
    return F.coalesce(exact, loose)


def genre_class(name: Column, rules: Sequence[tuple[str, str, float]], unknown: str) -> Column:
    """struct<genre, confidence> of the first pattern found; the name itself, or unknown for none, at 0.5."""
    chain = None
    for pattern, genre, confidence in rules:
        value = F.struct(F.lit(genre).alias("genre"), F.lit(confidence).alias("confidence"))
        chain = F.when(name.rlike(pattern), value) if chain is None else chain.when(name.rlike(pattern), value)
    rest = F.struct(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(unknown)).alias("genre"), F.lit(0.5).alias("confidence"))
    return rest if chain is None else chain.otherwise(rest)


def occupied_zones(seats: DataFrame, zone: str) -> DataFrame:
    """The zones of each venue and floor that hold a seat, with how many."""
    return seats.filter(F.col(zone).isNotNull()).groupBy("venue", "floor", zone).agg(F.count("*").alias("seats"))


def column_conflicts(zones: DataFrame) -> DataFrame:
    """Blocks that stand in several columns of their floor."""
    return zones.select("venue", "floor", "code", "col").distinct().groupBy("venue", "floor", "code").agg(F.count("*").alias("columns")).filter("columns > 1")


def forces_of_title(title: Column, keywords: Sequence[tuple[str, str]], forces: Sequence[tuple[str, str]]) -> Column:
    """struct<forces, confidence> of a title: 0.95 by the first keyword pattern in it, else as its canonical form says, else null."""
    said = first_match(title, keywords)
    by_word = F.when(said.isNotNull(), F.struct(said.alias("forces"), F.lit(0.95).alias("confidence")))
    return F.coalesce(by_word, forces_of(canon_form(title), forces))
