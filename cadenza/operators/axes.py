"""Which axes predict what a user likes: ridge logistic regression of all users at once.

A Newton round is one grouped sum over the ratings - gradient and curvature of each
user, combined on the map side, so a user with a third of all ratings is no hot task
- and a small system to solve for each user. Few ratings leave the weights near
zero, all alike; they part as ratings come in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import saved

RIDGE, ROUNDS = 1.0, 8


def axis_weights(ratings: DataFrame, user: str, liked: str, axes: Sequence[str], ridge: float = RIDGE, rounds: int = ROUNDS) -> DataFrame:
    """(user, n, bias, and a weight for each axis): the penalised maximum of likelihood, the bias too.

    Ratings with a null user, opinion or axis say nothing.
    """
    k = len(axes) + 1
    seen = ratings.filter(F.col(user).isNotNull() & F.col(liked).isNotNull())
    for a in axes:
        seen = seen.filter(F.col(a).isNotNull())
    seen = saved(seen.select(F.col(user).alias("_u"), F.col(liked).cast("boolean").cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[F.col(a).cast("double").alias(f"_x{i + 1}") for i, a in enumerate(axes)]))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    kind = dict(seen.dtypes)["_u"]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            w = np.column_stack([pdf[f"w{i}"] for i in range(k)])
            g = np.column_stack([pdf[f"g{i}"] for i in range(k)]) - ridge * w
            h = np.zeros((len(pdf), k, k))
            for i, j in upper:
                h[:, i, j] = h[:, j, i] = pdf[f"h{i}_{j}"]
            h += ridge * np.eye(k)
            w = w + np.linalg.solve(h, g[:, :, None])[:, :, 0]
            yield pd.DataFrame({"_u": pdf["_u"], "n": pdf["n"]} | {f"w{i}": w[:, i] for i in range(k)})

    shape = f"_u {kind}, n long, " + ", ".join(f"w{i} double" for i in range(k))
    weights = None
    for _ in range(rounds):
        met = seen.withColumns({f"w{i}": F.lit(0.0) for i in range(k)}) if weights is None else seen.join(weights.drop("n"), "_u")
        p = 1 / (1 + F.exp(-sum(F.col(f"w{i}") * F.col(f"_x{i}") for i in range(k))))
        met = met.withColumn("_p", p)
        sums = [F.sum((F.col("_y") - F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k)] + [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i, j in upper]
        each = met.groupBy("_u").agg(F.count("*").alias("n"), *[F.first(f"w{i}").alias(f"w{i}") for i in range(k)], *sums)
        weights = saved(each.mapInPandas(solve, shape))
    return weights.select(F.col("_u").alias(user), "n", F.col("w0").alias("bias"), *[F.col(f"w{i + 1}").alias(a) for i, a in enumerate(axes)])
