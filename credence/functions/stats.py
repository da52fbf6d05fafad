"""Statistics as column expressions that never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def average_rank(order: Column, partition: list[str]) -> Column:
    """Ranks in which ties share their mean."""
    same = Window.partitionBy(*partition, order)
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def pearson(a: str, b: str, degenerate: float | None = None) -> Column:
    """Correlation of two columns as an aggregate; if one is constant: 1 if all pairs are equal, else 0 (or ``degenerate``)."""
    plain = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    equal = F.max(F.abs(F.col(a) - F.col(b))) < 1e-12
    flat = (F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12)
    other = F.lit(degenerate) if degenerate is not None else F.when(equal, 1.0).otherwise(0.0)
    return F.when(flat, other).otherwise(F.coalesce(plain, F.lit(0.0)))


def grid(df: DataFrame, left: str, right: str) -> DataFrame:
    """All combinations of two small label columns, from one pass that collects neither."""
    return df.select(left).distinct().join(df.select(right).distinct())
