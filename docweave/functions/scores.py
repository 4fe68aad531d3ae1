"""Column functions on scores and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def min_max(score: Column, by: Sequence[str]) -> Column:
    """Scores of a query scaled to 0..1 over its candidates; 1 if all are equal."""
    group = W.partitionBy(*by)
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(low == high, F.lit(1.0)).otherwise((score - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def fixed(value: Column, digits: int = 4) -> Column:
    """The value as text with so many (1 to 10) digits behind the point, rounded by its exact binary value, ties to even, as Python and C do.

    Java rounds the shortest decimal form instead, half up. Here two parts of the value, of 24 and 29 bits, are multiplied by
    5**digits without error and compared with the middle of the neighbours. From 2**50 units of the last digit on, Java's form stays.
    """
    a, ten, five = F.abs(value), float(10**digits), float(5**digits)
    below, high = F.floor(a * ten).cast("double"), a.cast("float").cast("double")
    over = (high * five - (2.0 * below + 1.0) / float(2 ** (digits + 1))) + (a - high) * five
    up = (over > 0) | ((over == 0) & (below % 2 == 1))
    near = F.signum(value) * (below + F.when(up, 1.0).otherwise(0.0)) / ten
    return F.format_string(f"%.{digits}f", F.when(a * ten < float(1 << 50), near).otherwise(value))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, qtf: Column, idf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    damped = tf + k1 * (1.0 - b + b * length / F.greatest(mean_length, F.lit(1.0)))
    return qtf * idf * (tf * (k1 + 1.0)) / damped


def blend(judged: Column, coverage: Column, weight: float) -> Column:
    """Weighted mean of the judged score and keyword coverage; the judged score alone without coverage."""
    return F.when(coverage.isNull(), judged).otherwise(weight * judged + (1.0 - weight) * coverage)
