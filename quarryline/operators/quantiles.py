"""Quantiles that need positions: exclusive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.selection import order_statistics


def p95_exclusive(df: DataFrame, keys: list[str], value: str, into: str = "p95", q: float = 0.95, least: int = 20) -> DataFrame:
    """Per group the quantile at position q (n + 1), between neighbours by line; the maximum for fewer than ``least`` values."""
    position = lambda n: q * (n + 1)
    place = lambda n, more: F.when(n < least, n).otherwise(F.least(F.floor(position(n)) + more, n))
    found = order_statistics(df, keys, value, q, {"__a": lambda n: place(n, 0), "__b": lambda n: place(n, 1)})
    between = F.col("__a") + (position(F.col("n")) - F.floor(position(F.col("n")))) * (F.col("__b") - F.col("__a"))
    return found.select(*keys, F.when(F.col("n") >= least, between).otherwise(F.col("__a")).alias(into))
