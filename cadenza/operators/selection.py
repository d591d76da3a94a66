"""Selections, lookups and orders of the archive that are one expression each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_core(confidence: Column, least: float = 0.7) -> Column:
    """Whether a genre is sure enough for the core corpus; a null confidence is not."""
    return F.coalesce(confidence >= least, F.lit(False))


def in_years(date: Column, first: str, last: str) -> Column:
    """Whether a date string's year lies between two, as strings; an empty or null date is in none."""
    return F.coalesce(F.substring(date, 1, 4).between(first, last), F.lit(False))


def is_known(name: Column) -> Column:
    return F.coalesce(name != "", F.lit(False))


def is_iso_date(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def chosen_before(chosen_at: Column, attended_on: Column) -> Column:
    """Whether a label was given before the day of the event began."""
    return chosen_at < attended_on.cast("date").cast("timestamp")


def in_scope(name: Column, prefixes: Sequence[str]) -> Column:
    """Whether a file name has none of the prefixes that are out of scope."""
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return F.coalesce(~out, F.lit(True))


def in_month(date: Column, year: int, month: int) -> Column:
    """As a range of days, so that it reaches the scan as a filter."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return (date >= first) & (date < F.add_months(first, 1))


def intent(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The first intent of which a pattern matches, else null."""
    chain = None
    for name, patterns in rules.items():
        hit = text.rlike("|".join(f"(?:{p})" for p in patterns))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain if chain is not None else F.lit(None).cast("string")


def seat_views(seats: DataFrame, views: DataFrame, seat: str) -> DataFrame:
    """seats that have views of the same venue, floor, block and row: venue compares plainly, the others take null as equal; a seat without a venue has none."""
    v = views.select(F.col("venue").alias("_venue"), *[F.col(c).alias(f"_{c}") for c in ("floor", "block", "row")], "view")
    same = (F.col("venue") == F.col("_venue")) & F.col("floor").eqNullSafe(F.col("_floor")) & F.col("block").eqNullSafe(F.col("_block")) & F.col("row").eqNullSafe(F.col("_row"))
    return seats.join(v, same).select(seat, "view")


def first_on(dates: DataFrame, records: DataFrame, date: str, order: str) -> DataFrame:
    """Each date with its first record, null where there is none."""
    first = records.groupBy(date).agg(F.min(order).alias("first"))
    return dates.select(date).distinct().join(first, date, "left")


def lookup(rows: DataFrame, known: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with the value of their key, or the default where the key is unknown or has none."""
    return rows.join(known.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def counter(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds number, from 1, within the keys."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def chunk_of(number: Column, size: int) -> Column:
    """The group of a running number from 1 in groups of a size, from 0."""
    return F.floor((number - 1) / size)


def halved(bad: Column, deepest: int = 10) -> Column:
    """array<struct<first, n>>: for each item of a batch the part of it that is answered in the end.

    bad says which items make a batch fail. A part with a bad item is split in halves,
    the first not the smaller, until no part has one or a part is one item. Batches of
    up to 2 ** deepest items; all in the row.
    """

    def part(i: Column) -> Column:
        def step(p: Column, _: Column) -> Column:
            half = F.ceil(p["n"] / 2).cast("int")
            split = (p["n"] > 1) & F.exists(F.slice(bad, p["first"], p["n"]), lambda x: x)
            left = i < p["first"] + half
            return F.struct(F.when(split & ~left, p["first"] + half).otherwise(p["first"]).alias("first"), F.when(split, F.when(left, half).otherwise(p["n"] - half)).otherwise(p["n"]).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.struct(F.lit(1).alias("first"), F.size(bad).alias("n")), step)

    return F.when(F.size(bad) > 0, F.transform(F.sequence(F.lit(1), F.size(bad)), part)).otherwise(F.expr("CAST(array() AS array<struct<first:int,n:int>>)"))


def last_items(items: Column, k: int) -> Column:
    """The last k of an array, all of a shorter one."""
    return F.when(F.size(items) > k, F.slice(items, -k, k)).otherwise(items)


def in_all(arrays: Column) -> Column:
    """Values that every array has, in the order of the first one."""
    return F.aggregate(F.slice(arrays, F.lit(2), F.greatest(F.size(arrays) - 1, F.lit(0))), F.element_at(arrays, 1), lambda acc, a: F.array_intersect(acc, a))


def in_any(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(arrays))


def changed_since(rows: DataFrame, updated: str, since: Column) -> DataFrame:
    """What a client that last synced at since has to pull; null pulls all."""
    return rows.filter(since.isNull() | (F.col(updated) > since))


def boosts(facts: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the weights of each key's (axis, value) pairs; weights(axis, value, weight)."""
    return facts.join(weights, ["axis", "value"]).groupBy(*keys).agg(F.sum("weight").alias("boost"))


def uncovered(blocks: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only the blocks or only the zones have, with the side."""
    b, z = blocks.select(*keys).distinct(), zones.select(*keys).distinct()
    return b.join(z, list(keys), "left_anti").withColumn("only", F.lit("block")).unionByName(z.join(b, list(keys), "left_anti").withColumn("only", F.lit("zone")))


def masked(text: Column, patterns: Mapping[str, str]) -> Column:
    """The text with each kind's matches replaced by its name in brackets, kind after kind."""
    for kind, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def left_over(text: Column, patterns: Mapping[str, str]) -> Column:
    """array<string>: the kinds that still match, empty after a clean redaction."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda k: k.isNotNull())


#: Confidences of a venue model from least to most.
CONFIDENCES = ("unknown", "inferred", "confirmed")


def worst(*confidences: Column) -> Column:
    """The least of several confidences; a value that is none counts as unknown."""
    order = F.array(*map(F.lit, CONFIDENCES))
    places = [F.greatest(F.coalesce(F.array_position(order, c), F.lit(1)), F.lit(1)) for c in confidences]
    return F.element_at(order, (F.least(*places) if len(places) > 1 else places[0]).cast("int"))


def row_bands(profile: DataFrame, keys: Sequence[str], at: str, value: str, least: float) -> DataFrame:
    """Runs of positions at which the value reaches the threshold: keys, first, last."""
    w = Window.partitionBy(*keys).orderBy(at)
    on = profile.filter(F.col(value) >= least).withColumn("_run", F.col(at) - F.row_number().over(w))
    return on.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_run")


def map_status(venue_known: Column, supported: Column, seat: Column) -> Column:
    """Why a seat can or cannot be drawn."""
    return F.when(~venue_known, "unknown-venue").when(~supported, "unsupported-venue").when(seat.isNull(), "seat-unknown").otherwise("ok")


def match_route(composer: Column, work: Column, near: Column) -> Column:
    """Where a line goes after matching in two stages."""
    return F.when(composer.isNull(), "review").when(work.isNotNull() & ~near, "matched").when(near, "ask").otherwise("composer-only")


def scan_targets(rows: DataFrame, done: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Keys of wanted rows that are not done yet."""
    return rows.filter(wanted).select(key).join(done.select(key), key, "left_anti")


def newest(rows: DataFrame, at: str, key: str, k: int) -> DataFrame:
    """The k newest rows, ties by greater key: a top-k report."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(k)


def joined_corpora(corpora: Sequence[DataFrame], name: str = "corpus") -> DataFrame:
    """Corpora one behind the other, each row with the ordinal of its own, from 1."""
    out = None
    for k, one in enumerate(corpora, 1):
        part = one.withColumn(name, F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def public_means(rows: DataFrame, keys: Sequence[str], value: str, private: Column) -> DataFrame:
    """n and the mean value per key over rows that have a value and are not private."""
    seen = rows.filter(~F.coalesce(private, F.lit(True)) & F.col(value).isNotNull())
    return seen.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def widths(n: str) -> Column:
    """Percent of a short list's greatest count, halves upwards; a window over the list."""
    return F.floor(F.col(n) * 100 / F.max(n).over(Window.partitionBy()) + 0.5).cast("long")


def era_of(epoch: Column, eras: Mapping[str, str]) -> Column:
    """The era of a source's epoch by a short table; null for an unknown one."""
    pairs = [x for k, v in eras.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), epoch.cast("string"))


def on_day(date: Column, month: int, day: int) -> Column:
    """Whether a date falls on a day of the year."""
    return (F.month(date) == month) & (F.dayofmonth(date) == day)
