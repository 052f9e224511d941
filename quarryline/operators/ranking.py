"""Ranked selections: capped, two-level, interleaved, within a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import shared_dir, write_through


def cap_per_key(df: DataFrame, key: str, order: list[Column], per_key: int, limit: int | None = None) -> DataFrame:
    """The best ``per_key`` rows of each key, the best ``limit`` of these. Ranks within a key are cut before the shuffle."""
    kept = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= per_key).drop("__r")
    return kept.orderBy(*order).limit(limit) if limit is not None else kept


def pool_size(section, factor: int = 8, least: int = 200) -> Column:
    """Rows that a section looks at before its filters: a multiple of its size, and not too few."""
    return F.greatest(section * factor, F.lit(least))


def best_of_best(df: DataFrame, key: str, score: str, tie: str, keys: int, per_key: int) -> DataFrame:
    """The ``keys`` keys with the highest single score, and ``per_key`` rows of each."""
    top = df.groupBy(key).agg(F.max(score).alias("__best")).orderBy(F.col("__best").desc_nulls_last(), key).limit(keys)
    own = df.join(F.broadcast(top), key)  # at most ``keys`` rows
    return cap_per_key(own, key, [F.col(score).desc_nulls_last(), F.col(tie)], per_key)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null for none. Null conditions do not hold."""
    return F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules), F.lit(None).cast("string"))


def interleave(a: DataFrame, b: DataFrame, order: list[Column], id_: str, limit: int, shown: DataFrame | None = None) -> DataFrame:
    """Rows of two ranked lists in turn, an id once; ids of ``shown`` go to the end."""
    lists = []
    for k, df in enumerate((a, b)):
        best = df.orderBy(*order).limit(2 * limit)
        lists.append(best.withColumn("__r", F.row_number().over(Window.orderBy(*order))).withColumn("__list", F.lit(k)))
    both = lists[0].unionByName(lists[1])
    once = both.withColumn("__k", F.row_number().over(Window.partitionBy(id_).orderBy("__r", "__list"))).filter("__k = 1")
    if shown is not None:
        once = once.join(shown.select(id_, F.lit(True).alias("__shown")), id_, "left")
    else:
        once = once.withColumn("__shown", F.lit(None).cast("boolean"))
    return once.orderBy(F.col("__shown").isNotNull(), "__r", "__list").limit(limit).drop("__r", "__list", "__k", "__shown")


def within_budget(df: DataFrame, key: list[str], order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows from the best on, until their texts exceed ``budget`` bytes, per key."""
    used = F.sum(F.octet_length(F.coalesce(text, F.lit("")))).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__used", used).filter(F.col("__used") <= budget).drop("__used")


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Every row with its place (from 0) in a total order.

    Rows are sorted by range and numbered per range; the ranges' sizes, one number each, give what comes before. No window runs over the whole table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    stored = write_through(ranged, shared_dir(df.sparkSession))
    part = F.shiftright("__at", 33)  # how Spark lays out these ids: partition, then row
    sizes = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    joined = stored.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row per shuffle partition
    return joined.select(*df.columns, place.alias(name))


def running_totals(df: DataFrame, order: list[Column], weight: str, name: str = "upto") -> DataFrame:
    """Every row with the sum of ``weight`` up to and with it in a total order; ranges are summed apart and shifted by what comes before them."""
    stored = write_through(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), shared_dir(df.sparkSession))
    own = F.sum(weight).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy("__part").agg(F.sum(weight).alias("__w"))
    before = sums.select("__part", F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__before"))  # a row per shuffle partition
    return stored.withColumn(name, own).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def rotation(df: DataFrame, order: list[Column], cursor: int, size: int) -> DataFrame:
    """``size`` rows from position ``cursor`` on in a total order, going on at the beginning."""
    n = df.count()
    if not n:
        return df
    start, size = cursor % n, min(size, n)
    turned = F.pmod(F.col("__place") - start, F.lit(n))
    return positions(df, order, "__place").filter(turned < size).drop("__place")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", keep: bool = False) -> DataFrame:
    """``left`` with the other columns of ``right``, joined on keys of which nulls are equal. ``keep``: keys that only the right side has stay too."""
    named = right.withColumnsRenamed({k: f"__{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)))
    joined = left.join(named, same, how)
    if keep:
        joined = joined.withColumns({k: F.coalesce(k, f"__{i}") for i, k in enumerate(keys)})
    return joined.drop(*(f"__{i}" for i in range(len(keys))))
