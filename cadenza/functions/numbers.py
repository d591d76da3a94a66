"""Numeric helpers with one rounding rule in every compared output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    """Half away from minus infinity on the binary value: floor(x * 10^k + 0.5) / 10^k."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def band_of(depth: Column) -> Column:
    """front below a third, mid below two thirds, else rear."""
    return F.when(depth < 1 / 3, "front").when(depth < 2 / 3, "mid").otherwise("rear")
