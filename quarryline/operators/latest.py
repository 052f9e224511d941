"""Latest, nearest and as-of rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import times


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """One row per key: the last by ``ts``, the largest ``tie`` of equal ones. An aggregate with map-side combine, no sort."""
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    picked = df.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(ts), F.col(tie))).alias("__r"))
    return picked.select(*keys, "__r.*").select(*df.columns)


def latest_with_ties(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All rows of a key that have its last time."""
    return df.withColumn("__k", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last()))).filter("__k = 1").drop("__k")


def nearest_within(wanted: DataFrame, rows: DataFrame, key: str, at: str, ts: str, tolerance_hours: float, tie: str, prefer=None) -> DataFrame:
    """For each wanted (``key``, ``at``) the row of the same key nearest in time within the tolerance.

    ``prefer`` is a condition that outranks distance; ties go to the smaller ``tie``. Rows join on the key alone, distance filters after.
    """
    gap = F.abs(times.hours_between(F.col(at), F.col(ts)))
    joined = wanted.join(rows, key).withColumn("__gap", gap).filter(F.col("__gap") <= tolerance_hours)
    order = F.struct((~F.coalesce(prefer, F.lit(False))).alias("p") if prefer is not None else F.lit(False).alias("p"), "__gap", tie)
    rest = [c for c in joined.columns if c not in wanted.columns and c != "__gap"]
    picked = joined.groupBy(*wanted.columns).agg(F.min_by(F.struct(*rest, F.col("__gap").alias("gap_hours")), order).alias("__r"))
    return picked.select(*wanted.columns, "__r.*")


def as_of(wanted: DataFrame, series: DataFrame, key: str, at: str, day: str, value: str, into: str) -> DataFrame:
    """Adds the value of the last day that is not after ``at``, null where there is none.

    Wanted rows and series are one stream per key, ordered by time: a running last value instead of a range join.
    """
    kind, when = F.lit(0).alias("__kind"), F.col(day).alias("__at")
    points = series.filter(F.col(value).isNotNull()).select(F.col(key), when, kind, F.col(value).alias("__v"))
    asked = wanted.select(F.col(key), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*wanted.columns).alias("__row"))
    both = points.unionByName(asked, allowMissingColumns=True)
    running = F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy("__at", "__kind"))
    return both.withColumn(into, running).filter("__kind = 1").select("__row.*", into)


def scaled_to_age(rows: DataFrame, key: str, age: str, values: list[str], target: float = 6.0, tolerance: float = 1.5) -> DataFrame:
    """Per key the values at the age nearest to ``target``; beyond the tolerance they are scaled by target / age. Ages of 0 cannot be scaled."""
    row = F.struct(F.col(age).alias("age"), *values)
    best = rows.filter(F.col(age).isNotNull()).groupBy(key).agg(F.min_by(row, F.struct(F.abs(F.col(age) - target), F.col(age))).alias("r"))
    exact = F.abs(F.col("r.age") - target) <= tolerance
    scaled = [F.when(exact, F.coalesce(F.col(f"r.{v}"), F.lit(0)).cast("double")).otherwise(F.bround(F.coalesce(F.col(f"r.{v}"), F.lit(0)) * target / F.col("r.age"))).alias(v) for v in values]
    return best.filter(exact | (F.col("r.age") > 0)).select(key, F.col("r.age").alias("age"), exact.alias("exact"), *scaled)
