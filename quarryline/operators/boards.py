"""Boards of stories, novelties and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(posts: DataFrame, day: str, start: Column, end: Column, judged: Column) -> DataFrame:
    """Posts from ``start`` to ``end`` that have the verdict asked for; an unknown verdict leaves a post out."""
    return posts.filter((F.col(day) >= start) & (F.col(day) <= end) & F.coalesce(judged, F.lit(False)))


def confirmations(members: DataFrame, story: str, author: str, platform: str, ts: str, id_: str, proof: Column) -> DataFrame:
    """Per story its posts, the distinct authors ``xconf`` and platforms, its first author, and ``is_single``: one author and no post that counts as proof."""
    return members.groupBy(story).agg(
        F.count("*").alias("posts"), F.countDistinct(author).alias("xconf"), F.countDistinct(platform).alias("platforms"), F.min_by(author, F.struct(ts, id_)).alias("first_author"),
        ((F.countDistinct(author) == 1) & (F.count_if(proof) == 0)).alias("is_single"),
    )


def novelty_tiers(posts: DataFrame, name: str, author: str, platform: str, day: str, since: Column, external: DataFrame) -> DataFrame:
    """Names first seen after ``since`` with their tier: ``strict`` (three authors on two platforms), ``external`` (other sites have it), ``weak`` (two authors), ``single``."""
    counted = posts.groupBy(name).agg(F.countDistinct(author).alias("authors"), F.countDistinct(platform).alias("platforms"), F.min(day).alias("first_day")).filter(F.col("first_day") > since)
    marked = counted.join(external.select(name, F.lit(True).alias("__out")).distinct(), name, "left")
    tier = F.when((F.col("authors") >= 3) & (F.col("platforms") >= 2), "strict").when(F.col("__out"), "external").when(F.col("authors") >= 2, "weak").otherwise("single")
    return marked.select(name, tier.alias("tier"))


def top_values(rows: DataFrame, group: str, values: Column, into: str, k: int) -> DataFrame:
    """The ``k`` values of an array column that most rows of each group have; counts are ranked, not rows."""
    counts = rows.select(group, F.explode(values).alias(into)).groupBy(group, into).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), into)))
    return ranked.filter(F.col("__k") <= k).drop("__k")


def bucketed(rows: DataFrame, value: Column, borders: list[tuple[float, str]], rest: str, into: str = "bucket") -> DataFrame:
    """Rows with a value, and the name of the bucket that it is in: the first whose border is above it."""
    name = F
    for border, label in borders:
        name = name.when(value < border, label)
    return rows.filter(value.isNotNull()).withColumn(into, name.otherwise(rest))
