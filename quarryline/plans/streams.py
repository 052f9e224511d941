"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import times
from quarryline.plans.registration import plan
from quarryline.session import shared_dir, table
from quarryline.streaming import incremental
from quarryline.streaming import windows as W
from quarryline.streaming.windows import event_time


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


def _finished(spark: SparkSession, out: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there; results and checkpoints go to the shared folder. ``settings`` hold while it starts."""
    root = shared_dir(spark)
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("append").start(f"{root}/rows").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


@plan("""SELECT DATE_TRUNC('day', ts) AS window_start, event_type, COUNT(*) AS n FROM events WHERE DATE_TRUNC('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""".replace("DATE_TRUNC('day', ts) AS window_start", "CAST(CAST(DATE_TRUNC('day', ts) AS DATE) AS VARCHAR) AS window_start"))
def stream_daily_counts(spark, d):
    """T5: tumbling windows that the watermark has closed."""
    out = _finished(spark, W.windowed_counts(_stream(spark, d), "ts", ["event_type"], "1 day", "2 hours"))
    return out.select(F.to_date("window_start").cast("string").alias("window_start"), "event_type", "n")


@plan("SELECT user_id, event_type, COUNT(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_dedup(spark, d):
    """The first row of each key."""
    return _finished(spark, W.once_per_key(_stream(spark, d), "ts", ["user_id", "event_type"], "60 days")).select("user_id", "event_type", F.lit(True).alias("seen"))


@plan("""
WITH p AS (SELECT user_id, MIN(ts) AS published FROM events GROUP BY 1),
e AS (SELECT user_id, EPOCH_US(published) AS published, EPOCH_US(ts) AS captured FROM events JOIN p USING (user_id)),
s AS (SELECT * FROM (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('72h', 72)) AS v(stage, h)),
w AS (SELECT MAX(EPOCH_MS(ts)) - 6 * 3600000 AS ms FROM events),
due AS (SELECT user_id, EPOCH_US(published) + h * 3600000000 AS due, stage FROM p, s),
m AS (SELECT d.user_id, stage, due, MIN(captured) FILTER (captured BETWEEN due - 3 * 3600000000 AND due + 9 * 3600000000) AS captured FROM due d JOIN e USING (user_id) GROUP BY 1, 2, 3)
SELECT user_id AS content_id, stage, CASE WHEN captured IS NULL THEN 'closed_no_data' WHEN captured <= due + 3 * 3600000000 THEN 'measured' ELSE 'measured_late' END AS status,
  COALESCE(captured, due + 9 * 3600000000) AS at_us
FROM m, w WHERE captured IS NOT NULL OR due + 9 * 3600000000 <= ms * 1000
""")
def stream_stages(spark, d):
    """Measurement stages as state with timers; the table is one micro-batch, then the watermark closes what is overdue."""
    first = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("published_at"))
    rows = _stream(spark, d).join(first, "user_id").select(F.col("user_id").alias("content_id"), "published_at", F.col("ts").alias("captured_at"))
    return _finished(spark, W.stage_tracker(rows)).select("content_id", "stage", "status", F.unix_micros("at").alias("at_us"))


#: Arrivals that the table is dealt to, and its rows for each file of one.
ARRIVALS, ARRIVAL_ROWS = 5, 5_000_000


def _momentum(rows: DataFrame) -> DataFrame:
    """Per user the events, the total value, and the value gained an hour."""
    hours = times.hours_between(F.min("ts"), F.max("ts"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.try_divide(F.sum("value"), hours), 6).alias("speed"))


@plan("""SELECT user_id, COUNT(*) AS n, CAST(ROUND(SUM(value), 4) AS DOUBLE) AS total, CAST(ROUND(SUM(value) / NULLIF((EPOCH_US(MAX(ts)) - EPOCH_US(MIN(ts))) / 3.6e9, 0), 6) AS DOUBLE) AS speed,
EPOCH_US(MAX(ts)) AS scored_us FROM events GROUP BY user_id""")
def stream_scores(spark, d):
    """Scores kept up with arrivals in five micro-batches; each batch scores the users that it has events of again."""
    root = shared_dir(spark)
    events = event_time(table(spark, d, "events"), "ts")
    files = events.count() // ARRIVAL_ROWS + 1  # of one arrival: a batch reads them all, so that history is written again as often for any number of rows
    for part in range(ARRIVALS):  # arrivals: the last digit of the id, so that every batch touches most users
        events.filter(F.pmod("event_id", F.lit(ARRIVALS)) == part).repartition(files).write.parquet(f"{root}/arrivals/part{part}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{root}/arrivals")
    step = incremental.score_changed(f"{root}/scored", "user_id", "event_id", "ts", _momentum, "events", buckets=8)
    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return incremental.scored(spark, f"{root}/scored").select("user_id", "n", "total", "speed", F.unix_micros("scored_at").alias("scored_us"))
