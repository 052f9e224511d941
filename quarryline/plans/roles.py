"""The driver's tables in the roles of the shared data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.session import table

#: The present of the two time axes. Fixed values.
ORDERS_NOW = "2001-08-01"
EVENTS_NOW = "2024-01-31 00:00:00"


def contents(spark: SparkSession, d: str) -> DataFrame:
    """Posts: orders, with their customer as source and their price as metric."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("content_id"), F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("published_at"),
        F.col("o_totalprice").alias("views"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("status"),
    )


CONTENTS = "(SELECT o_orderkey AS content_id, o_custkey AS source_id, CAST(o_orderdate AS DATE) AS day, o_orderdate AS published_at, o_totalprice AS views, o_orderpriority AS topic, o_orderstatus AS status FROM orders)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Authors: customers, with their region as platform and their balance as size."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return named.select(
        F.col("c_custkey").alias("source_id"), F.col("c_name").alias("handle"), F.col("r_name").alias("platform"), F.col("n_name").alias("country"), F.col("c_acctbal").alias("size"), F.col("c_mktsegment").alias("tier")
    )


SOURCES = "(SELECT c_custkey AS source_id, c_name AS handle, r_name AS platform, n_name AS country, c_acctbal AS size, c_mktsegment AS tier FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Measurements: events, with their user as content."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("content_id"), F.col("ts").alias("captured_at"), F.col("value").alias("views"), F.col("event_type").alias("stage"), "props")


SNAPSHOTS = "(SELECT event_id AS snapshot_id, user_id AS content_id, ts AS captured_at, value AS views, event_type AS stage, props FROM events)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Links: line items, from supplier to part."""
    i = table(spark, d, "lineitem")
    return i.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("weight"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("content_id"))


EDGES = "(SELECT l_suppkey AS source_id, l_partkey AS target_id, l_returnflag AS kind, l_quantity AS weight, CAST(l_shipdate AS DATE) AS day, l_orderkey AS content_id FROM lineitem)"
