"""Exact robust statistics: medians with a minimum, MAD, quantiles of both kinds, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import null_safe, running_totals
from quarryline.operators.selection import largest_group, medians

MAD_TO_SIGMA = 1.4826


def median_of_at_least(c, k: int) -> Column:
    """Exact median of a group, null for fewer than ``k`` values."""
    return F.when(F.count(c) >= k, F.median(c))


def mad_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group ``n``, ``med`` and ``sigma`` = 1.4826 times the median distance from it, 0 for one value.

    Two selections and a join of group rows; a group is dealt to as many tasks as it has rows for.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    largest = largest_group(known, keys)
    centre = medians(known, keys, value, largest=largest)
    near = null_safe(known, centre, keys).select(*keys, F.abs(F.col(value) - F.col("med")).alias("__d"))
    spread = medians(near, keys, "__d", "__mad", largest).drop("n")
    return null_safe(centre, spread, keys).select(*keys, "n", "med", F.when(F.col("n") > 1, F.col("__mad") * MAD_TO_SIGMA).otherwise(0.0).alias("sigma"))


def robust_z(df: DataFrame, keys: list[str], value: str, into: str = "z") -> DataFrame:
    """Adds (x - median) / sigma within the class; 0 where the class has no spread, null for a null value or class."""
    joined = df.join(mad_sigma(df.dropna(subset=keys), keys, value), keys, "left")
    z = F.when(F.col("sigma") > 0, (F.col(value) - F.col("med")) / F.col("sigma")).when(F.col("sigma") == 0, F.col(value) * 0)
    return joined.withColumn(into, z).drop("n", "med", "sigma")


def mid_rank_factor(df: DataFrame, value: str, into: str) -> DataFrame:
    """Adds 1 + the mid-rank percentile of ``value``; 1 for null.

    Ranks come from counts of distinct values, which are sorted by range and summed per range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__ties"))
    upto = running_totals(counts, [F.col(value)], "__ties", "__upto")
    total = counts.agg(F.sum("__ties").alias("__n"))
    factor = 1 + (2 * F.col("__upto") - F.col("__ties")) / (2 * F.col("__n"))
    ranked = upto.crossJoin(F.broadcast(total)).select(value, factor.alias(into))  # one row
    return df.join(ranked, value, "left").withColumn(into, F.coalesce(into, F.lit(1.0)))


def share_at_most(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Adds the percentage of the group's values that are no larger; null values come first.

    From counts of distinct values in the order of group and value, so a group with a third of all rows is dealt to many tasks.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__ties"))
    upto = running_totals(counts, [F.col(k) for k in [*keys, value]], "__ties", "__upto")
    groups = upto.groupBy(*keys).agg(F.sum("__ties").alias("__n"), F.min(F.col("__upto") - F.col("__ties")).alias("__before"))
    shares = null_safe(upto, groups, keys).withColumn(into, 100 * (F.col("__upto") - F.col("__before")) / F.col("__n"))
    return null_safe(df, shares.select(*keys, value, into), [*keys, value])


def top_fraction(df: DataFrame, keys: list[str], size: str, tie: str, fraction: float) -> DataFrame:
    """The largest rows of each group: ``fraction`` of it, one at least; ties by ``tie``."""
    own = Window.partitionBy(*keys)
    ranked = df.withColumn("__rank", F.row_number().over(own.orderBy(F.col(size).desc_nulls_last(), tie))).withColumn("__n", F.count("*").over(own))
    return ranked.filter(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__n") * fraction))).drop("__rank", "__n")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null value per group, the smallest of equally frequent ones; counts shuffle, rows do not."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("__n").alias("n")), F.struct(-F.col("__n"), value))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.v").alias(value), F.col("__b.n").alias("n"))
