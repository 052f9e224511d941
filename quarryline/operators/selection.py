"""Exact order statistics of groups of any size: small groups in one aggregate, large ones by narrowing down, so that no task holds a group's values.

For large groups a mergeable sketch gives two bounds around the wanted place, a share of ``2 / ACCURACY`` on either side; all that is below is one count, and only the values
between the bounds, some ten-thousandths of a group, are counted by value and summed in a total order of groups and values. Two scans of the
input, of which only sketches and counts are shuffled. The sketch's error is bounded, and a place outside its bounds is an error, not a wrong value. Among them, groups
of at most ``SMALL`` values are counted whole: bounds that far apart would hold less than the sketch's error.
Where no group has more than ``IN_TASK`` values the plain aggregate is cheaper; one count of rows per group decides, and the values are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import null_safe, running_totals

ACCURACY = 10_000
SMALL = 2 * ACCURACY
IN_TASK = 200_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0


def order_statistics(df: DataFrame, keys: list[str], value: str, q: float, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group ``n`` and the values at ``places`` (from 1, functions of n) near the quantile ``q``. Null values do not count; null keys are a group."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if not keys:
        return order_statistics(rows.withColumn("__all", F.lit(0)), ["__all"], "__v", q, places).drop("__all")
    if largest_group(rows, keys) <= IN_TASK:
        own = Window.partitionBy(*keys)
        counts = rows.groupBy(*keys, F.col("__v").alias("__at")).agg(F.count("*").alias("__c"))
        placed = counts.withColumns({"__n": F.sum("__c").over(own), "__to": F.sum("__c").over(own.orderBy("__at"))})
        return _picked(placed, keys, places)
    around = F.array(*(F.lit(min(1.0, max(0.0, q + side * 2 / ACCURACY))) for side in (-1, 1)))
    sketches = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", around, ACCURACY).alias("__b"))
    large = F.col("__n") > SMALL
    bounds = sketches.select(*keys, "__n", F.when(large, F.col("__b")[0]).alias("__low"), F.when(large, F.col("__b")[1]).alias("__high"))
    inside = F.when(F.col("__low").isNull() | (F.col("__v") >= F.col("__low")), F.col("__v")).alias("__at")
    near = null_safe(rows, bounds, keys).filter("__high IS NULL OR __v <= __high")
    counts = near.groupBy(*keys, inside).agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    upto = running_totals(counts, [*(F.col(k) for k in keys), F.col("__at").asc_nulls_first()], "__c", "__upto")
    groups = upto.groupBy(*keys).agg(F.min(F.col("__upto") - F.col("__c")).alias("__before"))
    return _picked(null_safe(upto, groups, keys).withColumn("__to", F.col("__upto") - F.col("__before")), keys, places)


def _picked(placed: DataFrame, keys: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at the places, from values (``__at``) with their counts, and the counts up to them."""

    def at(place: Callable[[Column], Column]) -> Column:
        k = place(F.col("__n"))
        return F.max(F.when((F.col("__to") >= k) & (F.col("__to") - F.col("__c") < k), F.col("__at")))

    found = placed.groupBy(*keys).agg(F.first("__n").alias("n"), *(at(f).alias(name) for name, f in places.items()))
    sure = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("a place outside the bounds of its sketch")))
    return found.select(*keys, "n", *(sure(name).alias(name) for name in places))


def medians(df: DataFrame, keys: list[str], value: str, into: str = "med", largest: int | None = None) -> DataFrame:
    """Per group ``n`` and the exact median as a double. ``largest`` is the size of the largest group, where it is known."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if (largest_group(rows, keys) if largest is None else largest) <= IN_TASK:
        found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.median("__v").alias(into))
        return found.filter("n > 0")
    middle = {"__a": lambda n: F.floor((n + 1) / 2), "__b": lambda n: F.floor(n / 2) + 1}
    both = order_statistics(df, keys, value, 0.5, middle)
    return both.select(*keys, "n", ((F.col("__a").cast("double") + F.col("__b")) / 2).alias(into))
