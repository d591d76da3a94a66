"""Ordered lines: runs of hits, line dedup in a window, aliases in texts, reading order."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_runs(lines: DataFrame, page: str, at: str, hit: Column, stop: Column, gap: int = 4) -> DataFrame:
    """Per page the run of lines with most hits: (page, first, last, hits); the first run wins ties.

    A run goes on over at most gap lines that are no hits, and a stop line that is no
    hit ends it. Runs are islands of hits: a hit begins one if the hit before is more
    than gap lines away, or a stop lies between.
    """
    order = Window.partitionBy(page).orderBy(at)
    marked = lines.select(page, at, hit.alias("hit"), F.sum((stop & ~hit).cast("int")).over(order).alias("stops"))
    hits = marked.filter("hit")
    fresh = F.lag(at).over(order).isNull() | (F.col(at) - F.lag(at).over(order) > gap + 1) | (F.col("stops") > F.lag("stops").over(order))
    runs = hits.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order))
    each = runs.groupBy(page, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("hits"))
    return each.groupBy(page).agg(F.max_by(F.struct("first", "last", "hits"), F.struct("hits", -F.col("first"))).alias("x")).select(page, "x.*")


def dedup_recent(lines: DataFrame, page: str, at: str, text: str, window: int = 40) -> DataFrame:
    """Drops a line that equals one of the last `window` kept lines of its page.

    What is kept depends on what was kept before, so pages are folded one by one.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        recent: deque[str] = deque(maxlen=window)
        keep = []
        for value in pdf.sort_values(at)[text]:
            keep.append(value not in recent)
            if keep[-1]:
                recent.append(value)
        return pdf.sort_values(at)[keep]

    return lines.groupBy(page).applyInPandas(fold, lines.schema)


def reading_order(lines: DataFrame, page: str, x: str, y: str, band: float = 0.02) -> DataFrame:
    """Adds position: by bands of the vertical centre, then from left to right."""
    w = Window.partitionBy(page).orderBy(F.floor(F.col(y) / band), F.col(x))
    return lines.withColumn("position", F.row_number().over(w))


def merge_scales(lines: DataFrame, page: str, canonical: str, scale: str, at: str) -> DataFrame:
    """One line per canonical text: that of the first scale, then the first position."""
    w = Window.partitionBy(page, canonical).orderBy(scale, at)
    return lines.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: Letters of an alias that it is looked up by; shorter ones by all they have.
ALIAS_HEAD = 4


def longest_alias(rows: DataFrame, text: str, aliases: DataFrame, key: str, alias: str) -> DataFrame:
    """rows with the key whose alias is the longest substring of the text, ties by key; null if none.

    Aliases are joined by their first letters with the pieces of one to ALIAS_HEAD
    letters of each distinct text, so a text meets only aliases that begin in it, and
    a short alias does not make short pieces for long ones.
    """
    known = aliases.filter(F.length(alias) > 0).select(F.col(key).alias("_k"), F.col(alias).alias("_a"), F.substring(F.col(alias), 1, ALIAS_HEAD).alias("_g"))
    texts = rows.filter(F.length(text) > 0).select(F.col(text).alias("_t")).distinct()
    heads = F.transform(F.sequence(F.lit(1), F.lit(ALIAS_HEAD)), lambda n: F.transform(F.sequence(F.lit(1), F.length("_t")), lambda i: F.substring("_t", i, n)))
    pieces = texts.select("_t", F.explode(F.array_distinct(F.flatten(heads))).alias("_g"))
    met = pieces.join(known, "_g").filter(F.contains("_t", "_a"))
    best = met.groupBy("_t").agg(F.min(F.struct((-F.length("_a")).alias("l"), F.col("_k").alias("k"))).alias("_best"))
    return rows.join(best, F.col(text) == F.col("_t"), "left").withColumn(key, F.col("_best.k")).drop("_t", "_best")


def pii_lines(lines: DataFrame, page: str, at: str, kinds: Mapping[str, str], text: str, labels: Sequence[str] = ()) -> DataFrame:
    """Flags lines by the first kind of pattern, then label lines and their neighbours."""
    kind = None
    for name, pattern in kinds.items():
        hit = F.col(text).rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    w = Window.partitionBy(page).orderBy(at)
    label = F.col(text).isin(*labels) if labels else F.lit(False)
    marked = lines.withColumn("_label", label)
    near = F.coalesce(F.lag("_label").over(w), F.lit(False)) | F.coalesce(F.lead("_label").over(w), F.lit(False))
    return marked.withColumn("kind", F.coalesce(kind if kind is not None else F.lit(None), F.when(F.col("_label"), "label").when(near, "neighbour"))).drop("_label")
