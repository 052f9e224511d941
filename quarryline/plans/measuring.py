"""The measurement queue over events: a post is what a user does in four days, its snapshots are some of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import times
from quarryline.operators import measuring as M
from quarryline.plans.registration import plan
from quarryline.plans.roles import EVENTS_NOW
from quarryline.plans.streams import _finished, _stream
from quarryline.session import table
from quarryline.streaming import measuring as S

DAY = 24 * M.HOUR
MEASURES = "event_type IN ('view', 'click', 'purchase') AND value > 30"


def _post(ts: str = "ts"):
    """Id of the post of an event: its user and period of four days."""
    period = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / (4 * DAY))
    return (F.col("user_id") * 16 + period).cast("long")


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(_post().alias("content_id")).agg(F.min("ts").alias("published_at"))


def _measured(events: DataFrame, posts: DataFrame) -> DataFrame:
    """Events with their post; clicks are filed under the stage of their age, purchases under the last, views under none."""
    rows = events.withColumn("content_id", _post()).join(posts, "content_id")
    age = times.hours_between(F.col("published_at"), F.col("ts"))
    bucket = F.when(F.col("event_type") == "click", times.stage(age)).when(F.col("event_type") == "purchase", "72h")
    return rows.select("content_id", "published_at", F.col("ts").alias("captured_at"), bucket.alias("bucket"), (~F.expr(MEASURES)).alias("is_plan"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _measured(table(spark, d, "events"), _posts(spark, d)).filter("NOT is_plan")


_TABLES = """e AS (SELECT *, EPOCH_US(ts) AS us, user_id * 16 + (EPOCH_US(ts) - EPOCH_US(TIMESTAMP '2024-01-01')) // 345600000000 AS content_id FROM events),
c AS (SELECT content_id, MIN(us) AS published FROM e GROUP BY 1),
snap AS (
  SELECT content_id, us AS captured, CASE event_type WHEN 'purchase' THEN '72h' WHEN 'click' THEN
    CASE WHEN us - published < 12600000000 THEN '1h' WHEN us - published < 54000000000 THEN '6h' WHEN us - published < 172800000000 THEN '24h' ELSE '72h' END END AS bucket
  FROM e JOIN c USING (content_id) WHERE event_type IN ('view', 'click', 'purchase') AND value > 30),
stages(stage, h, w) AS (VALUES ('1h', 1, 12), ('6h', 6, 12), ('24h', 24, 12), ('72h', 72, 48)),
q AS (SELECT content_id, stage, w * 3600000000 AS w, published + h * 3600000000 AS due, (published + h * 3600000000 + 86399999999) // 86400000000 * 86400000000 AS first FROM c, stages),
tries AS (SELECT q.*, j, first + (j - 1) * 86400000000 AS tick FROM q, (SELECT UNNEST([1, 2, 3, 4, 5]) AS j)),
hits AS (
  SELECT t.content_id, t.stage, t.j, MIN({'by_time': NOT COALESCE(s.bucket = t.stage, FALSE), 'gap': ABS(s.captured - t.due), 'captured': s.captured}) AS best
  FROM tries t JOIN snap s ON s.content_id = t.content_id AND s.captured <= t.tick AND (s.bucket = t.stage AND ABS(s.captured - t.due) <= t.w OR s.bucket IS NULL AND ABS(s.captured - t.due) <= 10800000000)
  GROUP BY 1, 2, 3),
seen AS (SELECT content_id, MIN(captured) AS seen FROM snap GROUP BY 1),
swept AS (
  SELECT t.*, h.best, seen FROM tries t LEFT JOIN hits h USING (content_id, stage, j) LEFT JOIN seen USING (content_id)
  WHERE h.best IS NOT NULL OR t.j = 5 OR t.tick - t.due >= 345600000000),
settled AS (
  SELECT content_id, stage, due, tick, j AS attempt, CASE WHEN best IS NULL THEN 'closed_no_data' WHEN (best).gap <= 10800000000 THEN 'measured' ELSE 'measured_late' END AS status,
    CASE WHEN best IS NOT NULL THEN NULL WHEN seen IS NULL OR seen > tick THEN 'no_snapshot_ever' WHEN tick - due >= 345600000000 THEN 'grace_expired' ELSE 'attempts_exhausted' END AS close_reason,
    CASE WHEN (best).by_time THEN 'time' WHEN best IS NOT NULL THEN 'bucket' END AS linked_by, COALESCE((best).captured, tick) AS done_us
  FROM swept QUALIFY ROW_NUMBER() OVER (PARTITION BY content_id, stage ORDER BY j) = 1)"""

_QUEUE = f"""{_TABLES}, clock AS (SELECT EPOCH_US(TIMESTAMP '{EVENTS_NOW}') AS us),
queue AS (
  SELECT q.content_id, q.stage, q.due AS due_us, COALESCE(s.attempt, GREATEST(0, CASE WHEN clock.us >= q.first THEN (clock.us - q.first) // 86400000000 + 1 ELSE 0 END)) AS attempt, COALESCE(s.status, 'pending') AS status, s.close_reason, s.linked_by, s.done_us
  FROM q JOIN clock ON TRUE LEFT JOIN settled s ON s.content_id = q.content_id AND s.stage = q.stage AND s.tick <= clock.us)"""


@plan(f"WITH {_QUEUE} SELECT content_id, stage, due_us, CAST(attempt AS INT) AS attempt, status, close_reason, linked_by, done_us FROM queue")
def measurement_queue(spark, d):
    """All sweeps of the queue: links by stage or time, attempts, staleness, reasons of closing."""
    return M.sweep(_posts(spark, d), _snapshots(spark, d), F.lit(EVENTS_NOW))


@plan(f"""WITH {_QUEUE} SELECT COUNT(*) FILTER (status = 'pending') AS pending, COUNT(*) FILTER (status = 'measured') AS measured, COUNT(*) FILTER (status = 'measured_late') AS measured_late,
COUNT(*) FILTER (status = 'closed_no_data') AS closed_no_data, COUNT(*) FILTER (status = 'pending' AND due_us <= (SELECT us FROM clock)) AS overdue_pending FROM queue""")
def measurement_status_counts(spark, d):
    """Stages by status, and pending ones that are overdue."""
    return M.status_counts(M.sweep(_posts(spark, d), _snapshots(spark, d), F.lit(EVENTS_NOW)), F.lit(EVENTS_NOW))


@plan(f"""WITH {_QUEUE}, early AS (
  SELECT q.content_id, q.stage, q.due, s.attempt, s.status, s.close_reason, s.linked_by, s.done_us FROM q JOIN settled s ON s.content_id = q.content_id AND s.stage = q.stage),
again AS (
  SELECT q.content_id, q.stage, MIN({{'gap': ABS(s.captured - q.due), 'taken': s.captured}}) AS found FROM early q JOIN snap s ON s.content_id = q.content_id AND s.bucket = q.stage
  JOIN stages g ON g.stage = q.stage WHERE q.status = 'closed_no_data' AND ABS(s.captured - q.due) <= 2 * g.w * 3600000000 GROUP BY 1, 2)
SELECT e.content_id, e.stage, CASE WHEN found IS NULL THEN e.status ELSE 'measured' END AS status, CASE WHEN found IS NULL THEN close_reason END AS close_reason,
  CASE WHEN found IS NULL THEN linked_by ELSE 'bucket' END AS linked_by, COALESCE((found).taken, done_us) AS done_us FROM early e LEFT JOIN again USING (content_id, stage)""")
def measurement_reconciled(spark, d):
    """Closed stages are linked again where wider windows find a snapshot filed under them."""
    rows, late = _snapshots(spark, d), F.lit("2030-01-01")
    queue = M.sweep(_posts(spark, d), rows, late)
    return M.reconcile(queue, rows, {s: 2 * h for s, h in M.WINDOW_HOURS.items()}).select("content_id", "stage", "status", "close_reason", "linked_by", "done_us")


@plan(f"""WITH {_TABLES} SELECT content_id, stage, CAST(attempt AS INT) AS attempt, status, close_reason, linked_by, done_us FROM settled
WHERE tick < (SELECT (MAX(EPOCH_MS(ts)) - 6 * 3600000) * 1000 FROM events)""")
def stream_measurements(spark, d):
    """The queue as a state machine over the stream of events: what the watermark has settled."""
    posts = _posts(spark, d)
    return _finished(spark, S.measure(_measured(_stream(spark, d), posts)), {"spark.sql.streaming.stateStore.providerClass": S.ROCKS})
