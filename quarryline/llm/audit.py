"""Interaction of five document filters over all orders of applying them, from one histogram of failure masks.

Native expressions give every document a mask with a bit per filter that it fails. The mask holds all that any order of the filters
needs: a filter removes exactly the documents whose mask has its bit and no bit of an earlier filter. So the corpus is read once, counted
in 32 cells a part, and the 120 orders are enumerated from the cells.

Texts are told apart by SHA-256 (two different texts with equal digests would count as copies). Copies in a document's own id do not count as
smaller ids; rows without id have no smaller id and are none. Null texts are empty, null languages the empty part. A document is good
(toxic) if any label row of its id says so. Labels without id belong to no document. Repeated rows count each.
An empty table has no parts and gives no rows. Further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.session import shared_dir, write_through

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_CAPITALS = 10
SYMBOLS = r"[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
#: Every step of every order, as ``ABCDE:1``.
STEPS = [f"{''.join(order)}:{step}" for order in permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at the text alone (A to D)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = {
        "A": n < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT,
        "C": capitals * 100 > F.length(text) * MAX_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(test, bit(letter)).otherwise(0) for letter, test in failed.items()), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` of the text and ``mask`` of filters A to D, with ``n`` equal rows together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_mask(text).alias("mask"),
    )
    return rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))


def failures(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups of equal rows (``n``) with the whole mask and the labels of their documents.

    The first holder of a text is looked up by digest and id together, so a group of copies is spread by its ids; rows without
    id take part in no join.
    """
    rows = write_through(masks(docs), shared_dir(spark))
    named = rows.filter(F.col("doc_id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    whole = F.col("mask") + F.when(F.col("first"), 0).otherwise(bit("E"))
    known = named.join(firsts, ["digest", "doc_id"], "left").join(flags, "doc_id", "left")
    known = known.select("part", whole.alias("mask"), "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    nameless = rows.filter(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(nameless)


def cells(failed: DataFrame) -> DataFrame:
    """The histogram: documents, good and toxic ones for every part and mask that occurs."""
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return failed.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def interactions(histogram: DataFrame) -> DataFrame:
    """A row per part, order and step from the cells of :func:`cells`, at most 32 for a part."""
    parts = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(F.lit(STEPS)).alias("at"))
    order, step = F.substring_index("at", ":", 1), F.substring_index("at", ":", -1).cast("int")

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), bit(x)).otherwise(0) for x in FILTERS), F.lit(0))

    rows = rows.select("part", "cells", order.alias("filter_order"), step.alias("step"))
    rows = rows.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))

    def total(value, where) -> Column:
        return F.aggregate(F.filter("cells", lambda c: where(c["mask"])), F.lit(0).cast("long"), lambda acc, c: acc + value(c))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    # Of all orders, each filter that a document fails comes first among those in the same share.
    orders = len(STEPS) // len(FILTERS)
    share = lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["n"], lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter removes, repeats and loses at every step of every order, per part."""
    return interactions(cells(failures(spark, docs, labels)))
