"""Relational catalog: export views, credits, merges, deduplication and data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import saved


def text_list(value: Column, order: Sequence[Column], sep: str, distinct: bool = False) -> Column:
    """Ordered string aggregate: nulls are skipped, and no value at all gives null."""
    items = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("x")))))
    texts = F.transform(items, lambda s: s["x"])
    texts = F.array_distinct(texts) if distinct else texts
    return F.when(F.size(texts) > 0, F.array_join(texts, sep))


def grouped_counts(facts: DataFrame, keys: Sequence[str], date: str | None = None) -> DataFrame:
    """Rows per key, and the last date; null keys are a group."""
    more = [F.max(date).alias("last_seen")] if date else []
    return facts.groupBy(*keys).agg(F.count("*").alias("times"), *more)


def resolve_credits(items: DataFrame, credits: DataFrame) -> DataFrame:
    """Credits that apply to each item: those of the item, and those of its whole concert.

    items(concert, item), credits(concert, item or null, ...). The two grains are two
    equi-joins, never one join on OR.
    """
    own = credits.filter("item IS NOT NULL").join(items.select("concert", "item"), ["concert", "item"], "left_semi")
    whole = credits.filter("item IS NULL").drop("item").join(items.select("concert", "item"), "concert")
    return own.select("concert", "item", *[c for c in credits.columns if c not in ("concert", "item")], F.lit("item").alias("grain")).unionByName(whole.withColumn("grain", F.lit("concert")))


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """(a, b, cycle): each old_id with the end of its pointer chain, or cycle set where it has none.

    Chains are halved in each round (pointer doubling) and each round is saved, so a
    chain of length n takes log2 n joins of the table with itself. The number of
    pointers that still move falls in every round until none or only those on
    cycles, or leading into them, are left.
    """
    to = saved(redirects.filter("old_id IS NOT NULL AND new_id IS NOT NULL AND old_id <> new_id").select(F.col("old_id").alias("a"), F.col("new_id").alias("b")))
    before = -1
    while True:
        nxt = to.select(F.col("a").alias("b"), F.col("b").alias("c"))
        moved = saved(to.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("cycle")))
        still = moved.filter("cycle").count()
        if still in (0, before):
            return moved
        to, before = moved.select("a", "b"), still


def resolve_redirects(rows: DataFrame, key: str, redirects: DataFrame) -> DataFrame:
    """rows with key replaced by the end of its pointer chain, old_id to new_id; a key on or behind a cycle stays."""
    ends = redirect_ends(redirects).filter("NOT cycle").select(F.col("a").alias(key), "b")
    return rows.join(ends, key, "left").withColumn(key, F.coalesce("b", key)).drop("b")


def merge_upsert(old: DataFrame, new: DataFrame, key: str, added: Sequence[str] = (), first: Sequence[str] = (), replaced: Sequence[str] = (), cleared: Sequence[str] = ()) -> DataFrame:
    """Full outer merge: added columns are summed with null as 0, first keeps the older value if any, replaced takes the newer, cleared becomes null on a match."""
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in old.columns if c != key], F.lit(True).alias("_old"))
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    j = o.join(n, key, "full")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    out = [F.col(key)]
    out += [F.when(both, F.coalesce(f"o_{c}", F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0))).otherwise(F.coalesce(f"o_{c}", f"n_{c}")).alias(c) for c in added]
    out += [F.coalesce(f"o_{c}", f"n_{c}").alias(c) for c in first]
    out += [F.when(F.col("_new").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in replaced]
    out += [F.when(~both, F.coalesce(f"o_{c}", f"n_{c}")).alias(c) for c in cleared]
    return j.select(*out)


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*[o.asc() for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def gaps(rows: DataFrame, key: str) -> DataFrame:
    """Ranges of integers between the least and the greatest key that are absent."""
    k = rows.select(F.col(key).cast("long").alias("k")).filter("k IS NOT NULL").distinct()
    step = 1_000_000  # the order is taken inside blocks, and between blocks by their ends
    b = k.withColumn("block", F.floor(F.col("k") / step))
    inside = Window.partitionBy("block").orderBy("k")
    ends = b.groupBy("block").agg(F.max("k").alias("end"))
    before = ends.select("block", F.lag("end").over(Window.orderBy("block")).alias("carried"))
    x = b.withColumn("prev", F.lag("k").over(inside)).join(before, "block").withColumn("prev", F.coalesce("prev", "carried"))
    return x.filter(F.col("k") - F.col("prev") > 1).select((F.col("prev") + 1).alias("first"), (F.col("k") - 1).alias("last"), (F.col("k") - F.col("prev") - 1).alias("missing"))


def first_reason(rules: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first rule that holds, else kept; a null condition does not hold."""
    chain = None
    for name, rule in rules:
        chain = F.when(rule, name) if chain is None else chain.when(rule, name)
    return F.lit(kept) if chain is None else chain.otherwise(kept)


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows per rule that break it. A CHECK that is null passes, so only false counts."""
    counted = rows.agg(*[F.count_if(~rule).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)])).alias("v")).select("v.*")


def duplicate_keys(rows: DataFrame, keys: Sequence[Column], where: Column | None = None) -> DataFrame:
    """Keys of a (partial, expression) unique rule that occur more than once."""
    named = [k.alias(f"key{i}") for i, k in enumerate(keys)]
    base = rows if where is None else rows.filter(where)
    names = [f"key{i}" for i in range(len(keys))]
    return base.select(*named).dropna(subset=names).groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose foreign key has no parent; a null key is allowed."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def published(tables: Mapping[str, DataFrame], allowed: Sequence[str]) -> dict[str, DataFrame]:
    """The allow-listed tables alone; a name that is allowed and missing is an error."""
    missing = [name for name in allowed if name not in tables]
    if missing:
        raise KeyError(f"allow-listed but absent: {missing}")
    return {name: tables[name] for name in allowed}


def own_rows(rows: DataFrame, user: str, who: Column | str) -> DataFrame:
    """Row filter: rows of one user; without a user there are none."""
    return rows.filter(F.col(user) == (F.lit(who) if isinstance(who, str) else who))
