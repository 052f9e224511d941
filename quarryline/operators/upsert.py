"""Upserts without a table format: new rows over old ones, as DataFrames that are written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], arrival: str, update: list[str] | None = None, keep_known: bool = False) -> DataFrame:
    """One row per key. Later arrivals of ``new`` win; ``update`` limits the columns that a known key changes ([]: none).

    With ``keep_known`` a null does not replace a value. Null keys are equal to each other.
    """
    columns = [c for c in old.columns if c not in keys]
    changed = columns if update is None else update
    row = F.struct(*columns)
    incoming = new.groupBy(*keys).agg(F.max_by(row, arrival).alias("__new"))
    known = old.withColumn("__old", row).select(*keys, "__old").alias("o")
    match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = known.join(incoming.alias("n"), match, "full")

    def value(c: str):
        before, after = F.col(f"__old.{c}"), F.col(f"__new.{c}")
        if c not in changed:
            return F.when(F.col("__old").isNotNull(), before).otherwise(after)
        return F.when(F.col("__new").isNull(), before).otherwise(F.coalesce(after, before) if keep_known else after)

    return joined.select(*(F.when(F.col("__old").isNotNull(), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys), *(value(c).alias(c) for c in columns))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str], last: list[str], arrival: str) -> DataFrame:
    """Counters add up, other columns take the last value that is not null."""
    stamped = old.withColumn("__order", F.lit(0)).unionByName(new.withColumn("__order", F.lit(1)))
    order = F.struct("__order", arrival)
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in last]
    return stamped.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *newest)


def merge_edges(old: DataFrame, new: DataFrame, keys: list[str], weight: str, detail: str, ts: str) -> DataFrame:
    """Edges seen again: ``seen_count`` adds up, the weight is the largest, the detail the first known, times the first and last."""
    seen = new.withColumn("seen_count", F.lit(1).cast("long")).withColumn("first_seen", F.col(ts)).withColumn("last_seen", F.col(ts))
    both = old.unionByName(seen.select(*old.columns)) if old is not None else seen
    return both.groupBy(*keys).agg(
        F.sum("seen_count").alias("seen_count"),
        F.max(weight).alias(weight),
        F.min_by(F.col(detail), F.when(F.col(detail).isNotNull(), F.col("first_seen"))).alias(detail),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def parity(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Row counts of paired frames and their difference, one row per check."""
    counted = [
        a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b"))).select(F.lit(name).alias("check"), "a", "b", (F.col("a") - F.col("b")).alias("difference"))
        for name, a, b in checks
    ]
    out = counted[0]
    for more in counted[1:]:
        out = out.union(more)
    return out


def migrate(rows: DataFrame, legacy_map: DataFrame, key: str, new_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows under their new key, and the rows that the map does not know."""
    known = rows.join(legacy_map.select(key, new_key), key)
    return known, rows.join(legacy_map.select(key), key, "left_anti")


def migrate_all(rows: DataFrame, legacy_map: DataFrame, keys: list[str], new_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of several databases under their new keys, and those that the map does not know; ``keys`` name the database and its own key."""
    known = legacy_map.select(*keys, new_key)
    return rows.join(known, keys), rows.join(known.select(*keys), keys, "left_anti")
