"""Migration of linked tables: new keys made where the rows lie, foreign keys in order of dependence, and a comparison that explains every difference.

New keys are numbers without gaps: a key that was migrated before keeps its number, new ones follow in the order of their natural key. Numbers come from ranges of a total
order, so no task sees all keys, and migrating again gives the same ones. A row whose parent was not migrated goes to the rejects with the name of its reference.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ranking import null_safe, positions


def new_keys(rows: DataFrame, natural: list[str], known: DataFrame | None = None, name: str = "id") -> DataFrame:
    """The natural keys of ``rows`` with their numbers from 1, those of ``known`` (the map of an earlier migration) first. Keys with a null have none."""
    keys = rows.select(*natural).dropna().distinct()
    if known is None:
        return positions(keys, [F.col(k) for k in natural], name).withColumn(name, F.col(name) + 1)
    kept = known.select(*natural, name)
    fresh = positions(keys.join(kept, natural, "left_anti"), [F.col(k) for k in natural], "__place")
    base = kept.agg(F.coalesce(F.max(name), F.lit(0)).alias("__base"))
    return kept.unionByName(fresh.crossJoin(F.broadcast(base)).select(*natural, (F.col("__base") + F.col("__place") + 1).alias(name)))  # one row


def remap(rows: DataFrame, references: dict[str, tuple[dict[str, str], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Rows with every reference as a new key, and the rows of which one can't be followed, with ``missing``, the first such reference.

    ``references`` maps a new column to ({column of ``rows``: column of the map}, map with ``id``). A reference that is null in all columns is none and stays null.
    """
    joined = rows
    for into, (columns, keys) in references.items():
        named = keys.select(*(F.col(theirs).alias(f"__{into}_{own}") for own, theirs in columns.items()), F.col("id").alias(into))
        same = reduce(lambda a, b: a & b, (F.col(own) == F.col(f"__{into}_{own}") for own in columns))
        joined = joined.join(named, same, "left").drop(*(f"__{into}_{own}" for own in columns))
    lost = {into: F.col(into).isNull() & reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns)) for into, (columns, _) in references.items()}
    missing = F.coalesce(*(F.when(test, F.lit(into)) for into, test in lost.items()))
    marked = joined.withColumn("missing", missing)
    return marked.filter("missing IS NULL").drop("missing"), marked.filter("missing IS NOT NULL").drop(*references)


def differences(rule: str, before: DataFrame, after: DataFrame, keys: list[str], causes: Iterable[tuple[str, DataFrame]] = (), values: list[str] | None = None) -> DataFrame:
    """One rule of a comparison by key: ``rule``, ``cause``, ``n``.

    Keys on both sides are ``matched``, or ``changed`` where ``values`` differ; keys after only are ``added``. A key before only has the first of ``causes`` that
    names it (frames of keys), else it is ``unexplained``. So matched, changed, causes and unexplained add up to the keys before. Repeated keys count once.
    """
    values = values or []
    side = lambda df, mark: df.select(*keys, *values).dropDuplicates(keys).select(*keys, F.struct(F.lit(mark).alias("__in"), *values).alias(mark))
    left, right = side(before, "b"), side(after, "a")
    joined = null_safe(left, right, keys, "full", keep=True)
    for number, (_, named) in enumerate(causes := list(causes)):
        joined = null_safe(joined, named.select(*keys).distinct().withColumn(f"__c{number}", F.lit(True)), keys, "left")
    same = reduce(lambda x, y: x & y, (F.col(f"b.{v}").eqNullSafe(F.col(f"a.{v}")) for v in values), F.lit(True))
    cause = F.when(F.col("b").isNull(), "added").when(F.col("a").isNotNull(), F.when(same, "matched").otherwise("changed"))
    for number, (label, _) in enumerate(causes):
        cause = cause.when(F.col(f"__c{number}"), label)
    return joined.groupBy(F.lit(rule).alias("rule"), cause.otherwise("unexplained").alias("cause")).agg(F.count("*").alias("n"))


def report(rules: list[DataFrame]) -> DataFrame:
    """All rules, with ``difference``, the keys before less the keys after, and ``explained``, whether no key is unexplained, added or changed."""
    rows = reduce(DataFrame.unionByName, rules)
    lost = F.sum(F.when(F.col("cause").isin("matched", "changed"), 0).when(F.col("cause") == "added", -F.col("n")).otherwise(F.col("n")))
    odd = F.sum(F.when(F.col("cause").isin("unexplained", "added", "changed"), F.col("n")).otherwise(0))
    sums = rows.groupBy("rule").agg(lost.alias("difference"), (odd == 0).alias("explained"))
    return rows.join(sums, "rule")
