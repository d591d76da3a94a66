"""The minimum slice: the work frequency index with rarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.operators.frequency import rank_and_rarity, work_index
from cadenza.plans.catalogue import register
from cadenza.session import dealt, shares, table


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence facts: one row per (concert, work) of the driver tables."""
    held = table(spark, sf_dir, "lineitem")
    lines = held.selectExpr("l_orderkey AS concert", "l_partkey AS work", "l_linenumber AS seq", "l_suppkey AS performer")
    nights = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS concert", "CAST(o_orderdate AS DATE) AS date")
    n = shares(held)
    return dealt(lines, n, "concert").join(dealt(nights, n, "concert"), "concert")


@register(
    "work_index",
    """
WITH occ AS (SELECT l_partkey AS work, l_orderkey AS concert, CAST(o_orderdate AS DATE) AS date
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
idx AS (SELECT work, count(*) AS n, count(DISTINCT concert) AS concerts, min(date) AS first_date, max(date) AS last_date
        FROM occ GROUP BY work)
SELECT p_partkey AS work, p_name AS label, n, concerts, first_date, last_date,
       row_number() OVER (ORDER BY n DESC, p_partkey) AS position,
       percent_rank() OVER (ORDER BY n DESC) AS rarity
FROM idx JOIN part ON p_partkey = work
""",
)
def query_work_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = work_index(occurrences(spark, sf_dir), "work", "concert", "date")
    labels = table(spark, sf_dir, "part").selectExpr("p_partkey AS work", "p_name AS label")
    ranked = rank_and_rarity(index, "work")
    return ranked.join(labels, "work").select("work", "label", "n", "concerts", "first_date", "last_date", "position", "rarity")
