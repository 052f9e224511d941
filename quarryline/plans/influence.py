"""Who takes up whose posts: events as posts that name users and link other events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import influence as I
from quarryline.plans.registration import plan
from quarryline.session import table


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """Every event names the user ``k`` of its props; clicks repeat another, purchases link an earlier event; errors do not count."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    linked = F.col("event_id") - 1 - F.pmod("event_id", F.lit(3))  # below 0 there is no event, and an address would be read without its sign
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("U"), "user_id").alias("author"),
        F.col("ts").alias("at"),
        F.when(k.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("u"), k))).alias("mentions"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("u"), F.pmod("event_id", F.lit(97)))).alias("origin"),
        F.when((F.col("event_type") == "purchase") & (linked >= 0), F.array(F.concat(F.lit("https://h.example/u/status/"), linked))).otherwise(F.array().cast("array<string>")).alias("links"),
        (F.col("event_type") != "error").alias("counts"),
    )


def _verified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'signup' AND value > 100").select(F.concat(F.lit("u"), "user_id").alias("author")).distinct()


_PAIRS = """
p AS (SELECT event_id, user_id, EPOCH_US(ts) AS us, event_type, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events),
v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 100),
signals AS (
  SELECT user_id AS author, us, k AS named, NULL AS linked, event_id FROM p WHERE event_type <> 'error'
  UNION ALL SELECT user_id, us, event_id % 97, NULL, event_id FROM p WHERE event_type = 'click'
  UNION ALL SELECT user_id, us, NULL, event_id - 1 - event_id % 3, event_id FROM p WHERE event_type = 'purchase'),
pairs AS (
  SELECT DISTINCT p.event_id, s.author FROM p JOIN signals s ON s.named = p.user_id AND s.us BETWEEN p.us AND p.us + 259200000000 AND s.author <> p.user_id AND s.event_id <> p.event_id
  UNION SELECT p.event_id, s.author FROM p JOIN signals s ON s.linked = p.event_id AND s.us BETWEEN p.us AND p.us + 259200000000 AND s.author <> p.user_id)"""


@plan(f"""WITH {_PAIRS} SELECT CAST(event_id AS VARCHAR) AS post, 'u' || author AS author, CASE WHEN v.user_id IS NULL THEN 1.5::DOUBLE ELSE 1.65::DOUBLE END AS weight FROM pairs LEFT JOIN v ON v.user_id = author""")
def spread_weights(spark, d):
    """C20: independent authors who took a post up within 72 hours, by name, repetition or link."""
    return I.spread(_posts(spark, d), _verified(spark, d))


@plan(f"""WITH {_PAIRS} SELECT CAST(p.event_id AS VARCHAR) AS id, COALESCE(CAST(ROUND(SUM(CASE WHEN author IS NULL THEN 0 WHEN v.user_id IS NULL THEN 150 ELSE 165 END) / 100, 6) AS DOUBLE), 0) AS score
FROM p LEFT JOIN pairs USING (event_id) LEFT JOIN v ON v.user_id = author GROUP BY 1""")
def spread_scores(spark, d):
    """C20, M4: the score of spread of every post, by running sums instead of pairs."""
    return I.spread_scores(_posts(spark, d), _verified(spark, d))
