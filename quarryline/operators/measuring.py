"""The measurement queue: every post is to be measured at four ages; sweeps link what was measured, count attempts, and close what never will be.

A sweep runs every ``every_hours`` on a fixed grid. From the first sweep after its due time on, a stage is tried in each: a snapshot that is filed under the stage
and lies in the stage's window measures it; else one filed under no stage within the tolerance of the due time does. Of several the nearest counts, of equally
near ones the earlier. After ``MAX_ATTEMPTS`` tries, or once it is stale, a stage is closed without data and with a reason.

What a sweep sees depends on the snapshots up to it alone, so the outcome of all sweeps is one aggregate: the least (first sweep that sees it, link by time, distance,
capture time) of the snapshots that fit. ``streaming/measuring.py`` keeps the same tuple as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import times

HOUR = 3_600_000_000
#: Fixed values, in hours.
LINK_HOURS = 3
WINDOW_HOURS = {"1h": 12, "6h": 12, "24h": 12, "72h": 48}
STALE_HOURS = 96
MAX_ATTEMPTS = 5
EVERY_HOURS = 24


def _stages() -> Column:
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(h * HOUR).alias("offset"), F.lit(WINDOW_HOURS[s] * HOUR).alias("window")) for s, h in times.STAGE_HOURS.items()]
    return F.array(*rows)


def _ceil_div(a: Column, b: int) -> Column:
    """Whole-number division upwards, exact for microseconds."""
    return ((a + F.pmod(-a, F.lit(b))) / F.lit(b)).cast("long")


def _grid(due: Column, every: int, stale: int) -> tuple[Column, Column]:
    """Time of the first sweep that tries a stage, and the attempt that closes it."""
    first = due + F.pmod(-due, F.lit(every))
    until_stale = F.greatest(F.lit(1), _ceil_div(due + stale - first, every) + 1)
    return first, F.least(F.lit(MAX_ATTEMPTS), until_stale)


def sweep(contents: DataFrame, snapshots: DataFrame, now: Column, every_hours: int = EVERY_HOURS, stale_hours: int = STALE_HOURS) -> DataFrame:
    """The queue after all sweeps up to ``now``: ``content_id``, ``stage``, ``due_us``, ``attempt``, ``status``, ``close_reason``, ``linked_by``, ``done_us``.

    ``contents`` has ``content_id`` and ``published_at``, ``snapshots`` have ``content_id``, ``captured_at`` and ``bucket`` (null: filed under no stage).
    Snapshots are met with the four stages of their content and aggregated before any further shuffle, so a content with very many of them is spread.
    Contents without a time, and snapshots without one, take no part. Times are microseconds.
    """
    every, stale = every_hours * HOUR, stale_hours * HOUR
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    posts = contents.select("content_id", micros("published_at").alias("published")).filter("published IS NOT NULL")
    queue = posts.select("content_id", "published", F.explode(_stages()).alias("s")).select("content_id", "s.stage", "s.window", (F.col("published") + F.col("s.offset")).alias("due"))
    seen = snapshots.select("content_id", micros("captured_at").alias("captured"), "bucket").filter("captured IS NOT NULL")
    first, closing = _grid(F.col("due"), every, stale)
    gap = F.abs(F.col("captured") - F.col("due"))
    by_bucket = F.coalesce(F.col("bucket") == F.col("stage"), F.lit(False)) & (gap <= F.col("window"))
    by_time = F.col("bucket").isNull() & (gap <= LINK_HOURS * HOUR)
    attempt = F.greatest(F.lit(1), _ceil_div(F.col("captured") - first, every) + 1)
    fit = F.when(by_bucket | by_time, F.struct(attempt.alias("attempt"), (~by_bucket).alias("by_time"), gap.alias("gap"), F.col("captured").alias("captured")))
    met = seen.join(posts, "content_id").select("content_id", "captured", "bucket", "published", F.explode(_stages()).alias("s"))
    met = met.select("content_id", "captured", "bucket", "s.stage", "s.window", (F.col("published") + F.col("s.offset")).alias("due"))
    best = met.groupBy("content_id", "stage").agg(F.min(fit).alias("best"), F.min("captured").alias("seen"))
    rows = queue.join(best, ["content_id", "stage"], "left").withColumns({"first": first, "closing": closing, "now": F.unix_micros(now.cast("timestamp"))})
    at = lambda n: F.col("first") + (n - 1) * every
    linked = F.col("best").isNotNull() & (F.col("best.attempt") <= F.col("closing")) & (at(F.col("best.attempt")) <= F.col("now"))
    closed = ~F.coalesce(linked, F.lit(False)) & (at(F.col("closing")) <= F.col("now"))
    linked = F.coalesce(linked, F.lit(False))
    swept = F.greatest(F.lit(0), F.floor((F.col("now") - F.col("first")) / every) + 1)
    reason = F.when(F.col("seen").isNull() | (F.col("seen") > at(F.col("closing"))), "no_snapshot_ever").when(at(F.col("closing")) - F.col("due") >= stale, "grace_expired").otherwise("attempts_exhausted")
    return rows.select(
        "content_id",
        "stage",
        F.col("due").alias("due_us"),
        F.when(linked, F.col("best.attempt")).when(closed, F.col("closing")).otherwise(swept).cast("int").alias("attempt"),
        F.when(linked, F.when(F.col("best.gap") <= LINK_HOURS * HOUR, "measured").otherwise("measured_late")).when(closed, "closed_no_data").otherwise("pending").alias("status"),
        F.when(closed, reason).alias("close_reason"),
        F.when(linked, F.when(F.col("best.by_time"), "time").otherwise("bucket")).alias("linked_by"),
        F.when(linked, F.col("best.captured")).when(closed, at(F.col("closing"))).alias("done_us"),
    )


def reconcile(queue: DataFrame, snapshots: DataFrame, window_hours: dict[str, int] | None = None) -> DataFrame:
    """Closed stages that a snapshot filed under the stage measures after all, if it lies in the stage's window: the same columns for all rows.

    Running it again changes nothing. Other rows, and reasons, stay.
    """
    windows = F.create_map(*(F.lit(x) for s, h in (window_hours or WINDOW_HOURS).items() for x in (s, h * HOUR)))
    points = snapshots.select("content_id", F.col("bucket").alias("stage"), F.unix_micros(F.col("captured_at").cast("timestamp")).alias("__captured")).filter("stage IS NOT NULL AND __captured IS NOT NULL")
    closed = queue.filter("status = 'closed_no_data'")
    gap = F.abs(F.col("__captured") - F.col("due_us"))
    near = closed.select("content_id", "stage", "due_us").join(points, ["content_id", "stage"]).filter(gap <= windows[F.col("stage")])
    found = near.groupBy("content_id", "stage").agg(F.min(F.struct(gap.alias("gap"), "__captured")).alias("__found")).select("content_id", "stage", F.col("__found.__captured").alias("__at"))
    joined = queue.join(found, ["content_id", "stage"], "left")
    late = F.col("__at").isNotNull()
    return joined.select(
        "content_id",
        "stage",
        "due_us",
        "attempt",
        F.when(late, "measured").otherwise(F.col("status")).alias("status"),
        F.when(~late, F.col("close_reason")).alias("close_reason"),
        F.when(late, "bucket").otherwise(F.col("linked_by")).alias("linked_by"),
        F.coalesce("__at", "done_us").alias("done_us"),
    )


def status_counts(queue: DataFrame, now: Column) -> DataFrame:
    """One row: stages by status, and pending ones that are overdue."""
    statuses = ["pending", "measured", "measured_late", "closed_no_data"]
    overdue = (F.col("status") == "pending") & (F.col("due_us") <= F.unix_micros(now.cast("timestamp")))
    return queue.agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.count_if(overdue).alias("overdue_pending"))
