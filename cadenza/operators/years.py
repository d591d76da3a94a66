"""Composition years that are missing, from catalogue numbers: monotone regression per composer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rising(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The least-squares rising fit of means total / weight: neighbours that fall are pooled until none does."""
    sums, sizes, spans = [], [], []
    for t, w in zip(total.tolist(), weight.tolist()):
        span = 1
        while sums and sums[-1] * w >= t * sizes[-1]:
            t, w, span = t + sums.pop(), w + sizes.pop(), span + spans.pop()
        sums.append(t)
        sizes.append(w)
        spans.append(span)
    return np.repeat(np.divide(sums, sizes), spans) if sums else np.zeros(0)


def fitted(works: DataFrame, composer: str, opus: str, year: str) -> DataFrame:
    """(composer, opus, fit) of the catalogue numbers with known years.

    Works of one number are summed first, so a composer's group is no longer than the
    numbers that the composer used, however many rows there are.
    """
    known = works.filter(F.col(composer).isNotNull() & F.col(opus).isNotNull() & F.col(year).isNotNull())
    each = known.groupBy(F.col(composer).alias("composer"), F.col(opus).cast("long").alias("opus")).agg(F.sum(F.col(year).cast("long")).alias("total"), F.count("*").alias("weight"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("opus")
        return pdf.assign(fit=rising(pdf["total"].to_numpy(), pdf["weight"].to_numpy()))[["composer", "opus", "fit"]]

    kind = dict(each.dtypes)["composer"]
    return each.groupBy("composer").applyInPandas(fit, f"composer {kind}, opus long, fit double")


def with_years(works: DataFrame, composer: str, opus: str, year: str) -> DataFrame:
    """works with composed (the year, or one read from the fit) and interpolated.

    Between two fitted numbers years lie on a line, beyond the first and the last they
    stay, and halves go up. Without a number, or of a composer without any known year,
    the year stays null. Only distinct (composer, number) pairs meet the fit.
    """
    fits = fitted(works, composer, opus, year)
    asked = works.filter(F.col(year).isNull() & F.col(composer).isNotNull() & F.col(opus).isNotNull()).select(F.col(composer).alias("composer"), F.col(opus).cast("long").alias("opus")).distinct()
    rows = fits.select("composer", "opus", "fit", F.lit(False).alias("asked")).unionByName(asked.withColumns({"fit": F.lit(None).cast("double"), "asked": F.lit(True)}))
    point = F.when(F.col("fit").isNotNull(), F.struct("opus", "fit"))
    w = Window.partitionBy("composer").orderBy("opus")  # the default range takes in rows of the same number
    ahead = Window.partitionBy("composer").orderBy(F.col("opus").desc())
    read = rows.withColumns({"lo": F.last(point, ignorenulls=True).over(w), "hi": F.last(point, ignorenulls=True).over(ahead)}).filter("asked")
    share = F.try_divide(F.col("opus") - F.col("lo.opus"), F.col("hi.opus") - F.col("lo.opus"))
    at = F.when(F.col("lo").isNull(), F.col("hi.fit")).when(F.col("hi").isNull() | (F.col("lo.opus") == F.col("hi.opus")), F.col("lo.fit")).otherwise(F.col("lo.fit") + (F.col("hi.fit") - F.col("lo.fit")) * share)
    told = read.select(F.col("composer").alias("_composer"), F.col("opus").alias("_opus"), F.floor(F.round(at, 6) + 0.5).cast("int").alias("_year"))
    out = works.join(told, (F.col(composer) == F.col("_composer")) & (F.col(opus).cast("long") == F.col("_opus")) & F.col(year).isNull(), "left")
    return out.select(*works.columns, F.coalesce(F.col(year).cast("int"), "_year").alias("composed"), (F.col(year).isNull() & F.col("_year").isNotNull()).alias("interpolated"))
