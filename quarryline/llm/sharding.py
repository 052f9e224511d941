"""Shards by weighted rendezvous hashing of stable record keys.

Every shard draws a number for a key, from a hash of the key and the shard's own number, and the lowest draw wins: -ln(u) / weight, so a shard wins in
proportion to its weight. What a shard draws does not depend on the others: a new shard takes records into itself only, a removed one gives away only
its own, and a changed weight moves records only to or from that shard. All of it is one native expression per row; nothing is looked up.

``write_shards`` puts the records in order of shard and key, in ranges of bounded size, so that every shard is a run of files of its own
and ``slot`` counts its records from 0 without gaps. Records of one shard are never in one task together: ranges split within a shard, within a key (by
checksum of the text) and among equal rows (by their place in the input, which has to come in the same order when it is read
again, as files do).

Null keys are the empty key, all of them in one shard; null texts are empty. Repeated rows are records each. An empty table gives no rows. Columns named
as the results are replaced; others are kept in the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAW = "key"
#: Bits of the hash that a draw is made of: 13 hex digits of MD5.
DRAW_DIGITS = 13
#: Input bytes for each range that is written, and the most ranges; beyond these, ranges grow in size instead and are sorted through disk.
RANGE_BYTES = 32 << 20
MAX_RANGES = 100_000


def draw(key: Column, shard: int, weight: float) -> Column:
    """What a shard draws for a key: exponentially distributed with the weight as its rate."""
    hashed = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DRAW_DIGITS), 16, 10).cast("long")
    return -F.ln((hashed + 0.5) / F.lit(float(16**DRAW_DIGITS))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key; a weight of 0 takes no records. Equal draws go to the smaller number."""
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights are not negative, and one is positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct(draw(text, k, w).alias("draw"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w]
    return F.array_min(F.array(*draws))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the shard of every record."""
    return docs.withColumn(name, rendezvous(F.col(key), weights))


def moved(docs: DataFrame, before: Sequence[float], after: Sequence[float], key: str = "doc_id") -> DataFrame:
    """The records that change shards, with ``old_shard`` and ``shard``: all that a change of weights has to copy."""
    both = assign(assign(docs, before, key, "old_shard"), after, key)
    return both.filter(F.col("old_shard") != F.col("shard"))


def ranges_for(df: DataFrame) -> int:
    """How many ranges a table is written in, from Spark's estimate of its bytes."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    unknown = size >= 1 << 60  # what Spark assumes of tables that it has no size of
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0 if unknown else min(size // RANGE_BYTES, MAX_RANGES), 1)


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """Write the records by shard and key below ``path``: one folder a shard, files of bounded size in the order of their names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = assign(docs, weights, key).withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    order = ["shard", key, "text_crc32", "size", "__at"]
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(ranges_for(docs), *order).sortWithinPartitions(*order).drop("__at")
    # Spark lays out these ids as partition, then row: the place of a record in its range.
    ranged.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: str, shards: Sequence[int] | None = None) -> DataFrame:
    """Records as written, with ``slot``; ``shards`` prunes folders. ``schema`` are the columns wanted besides shard and slot."""
    rows = spark.read.schema(f"{schema}, place long, shard int").parquet(path)
    if shards is not None:
        rows = rows.filter(F.col("shard").isin(*shards))
    part = F.shiftright("place", 33)
    rows = rows.withColumn("__part", part)
    # A row for each range and shard in it, about as many as files: sent to the records, so that no text is shuffled to meet them.
    runs = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"), F.min("place").alias("__first"))
    earlier = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return rows.join(F.broadcast(runs), ["shard", "__part"]).withColumn("slot", F.col("place") + F.col("__shift")).drop("place", "__part", "__shift")


def digests(rows: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id") -> DataFrame:
    """Size and checksum of the stored texts, and the shard that each record would have with ``grown`` weights."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(
        key,
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
