"""Counters over time: deltas and speeds, clamps, growth, measurement stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import times

MIN_PAIR_SECONDS, MIN_SPEED_SECONDS = 600, 3600
TOLERANCE_HOURS, GRACE_HOURS, STALE_HOURS = 3, 6, 96


def deltas(df: DataFrame, key: str, ts: str, counters: list[str], keep_negative: bool = False) -> DataFrame:
    """Adds ``interval_seconds``, ``interval_quality`` (first, short, ok), delta_<counter>, ``per_hour``, ``per_day`` and ``is_anomaly``.

    Deltas need 600 s between snapshots, speeds 3600 s. A counter that falls is an anomaly with a null delta; with ``keep_negative`` the
    delta stays and only the first counter decides on the anomaly.
    """
    order = Window.partitionBy(key).orderBy(ts)
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    previous = F.lag(F.struct(seconds.alias("__s"), *counters)).over(order)
    out = df.withColumn("__p", previous).withColumn("interval_seconds", seconds - F.col("__p.__s"))
    usable = F.col("interval_seconds") >= MIN_PAIR_SECONDS
    raw = {c: F.when(usable, F.col(c) - F.col(f"__p.{c}")) for c in counters}
    fell = [raw[c] < 0 for c in (counters[:1] if keep_negative else counters)]
    anomaly = F.lit(False)
    for f in fell:
        anomaly = anomaly | F.coalesce(f, F.lit(False))
    delta = {c: raw[c] if keep_negative else F.when(raw[c] >= 0, raw[c]) for c in counters}
    fast = F.col("interval_seconds") >= MIN_SPEED_SECONDS
    quality = F.when(F.col("interval_seconds").isNull(), "first").when(fast, "ok").otherwise("short")
    first = delta[counters[0]]
    return out.withColumns(
        {
            "interval_quality": quality,
            **{f"delta_{c}": d for c, d in delta.items()},
            "per_hour": F.when(fast, first / (F.col("interval_seconds") / 3600)),
            "per_day": F.when(fast, first / (F.col("interval_seconds") / 86400)),
            "is_anomaly": anomaly,
        }
    ).drop("__p")


def never_falling(df: DataFrame, key: str, ts: str, counter: str, tie: str) -> DataFrame:
    """The counter as its largest value so far."""
    order = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(counter, F.max(counter).over(order))


def growth(df: DataFrame, key: str, day: str, value: str, today, days: int = 7) -> DataFrame:
    """Per key ``growth`` = (today's value - reference) / reference and ``depth_days``; needs a row of today and a positive reference."""
    ref = F.max_by(F.when(F.col(day) <= F.date_sub(today, days), F.col(value)), F.when(F.col(day) <= F.date_sub(today, days), F.col(day)))
    now = F.max(F.when(F.col(day) == today, F.col(value)))
    found = df.groupBy(key).agg(now.alias("__now"), ref.alias("__ref"), F.datediff(today, F.min(day)).alias("depth_days"))
    return found.select(key, F.when(F.col("__ref") > 0, (F.col("__now") - F.col("__ref")) / F.col("__ref")).alias("growth"), "depth_days")


def stage_schedule(contents: DataFrame, id_: str, published: str) -> DataFrame:
    """One row per content and stage with the time it is due."""
    stages = F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), F.lit(v).alias("stage_hours")) for k, v in times.STAGE_HOURS.items()))).alias("s")
    rows = contents.filter(F.col(published).isNotNull()).select(id_, published, stages).select(id_, published, "s.*")
    return rows.withColumn("due", times.due_at(F.col(published), F.col("stage")))


def stage_status(schedule: DataFrame, snapshots: DataFrame, id_: str, ts: str, now, tolerance: float = TOLERANCE_HOURS, grace: float = GRACE_HOURS) -> DataFrame:
    """``status`` of each planned measurement: measured, measured_late, pending or closed_no_data, and ``n_near``.

    A snapshot within the tolerance of the due time measures it; one in the grace after that measures it late; a stage without either is closed once
    the grace is over. Snapshots join on the content only.
    """
    gap = times.hours_between(F.col("due"), F.col("__ts"))
    points = snapshots.select(F.col(id_), F.col(ts).alias("__ts"))
    near = schedule.join(points, id_, "left").groupBy(*schedule.columns).agg(
        F.count_if(F.abs(gap) <= tolerance).alias("n_near"), F.count_if((gap > tolerance) & (gap <= tolerance + grace)).alias("n_late")
    )
    over = times.hours_between(F.col("due"), now) > tolerance + grace
    status = F.when(F.col("n_near") > 0, "measured").when(F.col("n_late") > 0, "measured_late").when(over, "closed_no_data").otherwise("pending")
    return near.withColumn("status", status)


def missed_slots(contents: DataFrame, snapshots: DataFrame, id_: str, published: str, ts: str, now, tolerance_hours: float = 0.5) -> DataFrame:
    """Expected slots without a snapshot near them."""
    slots = contents.select(id_, F.explode(times.expected_slots(F.col(published), now)).alias("slot"))
    points = snapshots.select(F.col(id_).alias("__id"), F.col(ts).alias("__ts"))
    near = (F.col(id_) == F.col("__id")) & (F.abs(times.hours_between(F.col("slot"), F.col("__ts"))) <= tolerance_hours)
    return slots.join(points, near, "left_anti")


def duplicates_nearby(df: DataFrame, cluster: str, channel: str, ts: str, hours: int = 48) -> DataFrame:
    """Adds ``n_other``: rows of the same cluster within ``hours`` before or after, in other channels."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    reach = hours * 3600
    near = Window.orderBy("__s").rangeBetween(-reach, reach)
    everywhere = F.count("*").over(near.partitionBy(cluster))
    own = F.count("*").over(near.partitionBy(cluster, channel))
    return df.withColumn("__s", seconds).withColumn("n_other", everywhere - own).drop("__s")
