"""Ranks, shares and running sums over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(order: Column, *by: str, ties: Column | None = None) -> Column:
    """Rank in the given order, equal values sharing the mean of their places; ``ties`` is the bare value."""
    w = Window.partitionBy(*by).orderBy(order)
    same = Window.partitionBy(*by, ties) if ties is not None else None
    if same is None:
        raise ValueError("ties needs the ranked value")
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def top_n(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group; the order must break all ties."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def share(c: Column, *by: str) -> Column:
    return c / F.sum(c).over(Window.partitionBy(*by))


def share_of_max(c: Column, *by: str) -> Column:
    return c / F.max(c).over(Window.partitionBy(*by))


def arg_max(df: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """One row per group with the largest value, the least name among equals; partial aggregates meet, so no group is sorted."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("k")))
    return df.groupBy(*by).agg(best.alias("__best")).select(
        *by, F.col("__best.k").alias(name), (-F.col("__best.v")).alias(value)
    )


def running_total(c: Column, order: Column, *by: str) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(c).over(w)


def false_discovery(p: str, *by: str) -> Column:
    """Benjamini-Hochberg: the least p * m / rank from this p upwards. One row per test, so partitions are small."""
    m = F.count("*").over(Window.partitionBy(*by))
    asc = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p)))
    down = Window.partitionBy(*by).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.least(F.min(F.col(p) * m / asc).over(down), F.lit(1.0))
