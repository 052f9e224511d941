"""Quality panels of sources and days, posting habits, baselines and health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import stats, times
from quarryline.operators.quantiles import p95_exclusive
from quarryline.operators.ranking import first_reason

#: Limits of the entry check. Fixed values.
MIN_ITEMS, MIN_MENTIONS, MIN_CV, CV_POSTS = 15, 2, 0.15, 10
PER_DAY, MAX_LINKS, MAX_DUPLICATES, MAX_REPOSTS = (0.2, 20.0), 0.7, 0.3, 0.8


def daily_panel(rows: DataFrame, day: str, platform: str, ok: str, text_hash: str, latency: str, likes: str, published: str) -> DataFrame:
    """Per day and platform: rows, fail, duplicate and valid-date rates, median likes and p95 latency."""
    keys = [day, platform]
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col(ok), 0.0).otherwise(1.0)).alias("fail_rate"),
        (1 - F.countDistinct(text_hash) / F.count(text_hash)).alias("dup_rate"),
        F.avg(F.when(times.valid_time(F.col(published)), 1.0).otherwise(0.0)).alias("valid_date_ratio"),
        F.median(likes).alias("likes_median"),
    )
    return base.join(p95_exclusive(rows, keys, latency, "latency_p95"), keys, "left")


def posting_features(posts: DataFrame, source: str, ts: str, has_link: str, is_repost: str, text_hash: str) -> DataFrame:
    """Per source: posts, posts per day, variation of its intervals, shares of links, reposts and repeated texts."""
    order = Window.partitionBy(source).orderBy(ts)
    hours = times.hours_between(F.lag(ts).over(order), F.col(ts))
    spaced = posts.withColumn("__gap", hours)
    days = F.greatest(times.hours_between(F.min(ts), F.max(ts)) / 24, F.lit(1.0))
    found = spaced.groupBy(source).agg(
        F.count("*").alias("n"),
        (F.count("*") / days).alias("posts_per_day"),
        F.when((F.count("*") >= CV_POSTS) & (F.avg("__gap") > 0), F.stddev_pop("__gap") / F.avg("__gap")).alias("cv_interval"),
        F.avg(F.col(has_link).cast("double")).alias("link_ratio"),
        F.avg(F.col(is_repost).cast("double")).alias("rt_ratio"),
        (1 - F.countDistinct(text_hash) / F.count(text_hash)).alias("dup_ratio"),
    )
    return found


def entry_check(features: DataFrame, mentioners: str, need_mentions: bool = True) -> DataFrame:
    """Adds ``reason``, the first check that fails in their order, or null. ``need_mentions=False`` is the provisional variant."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    rules: list[tuple[str, Column]] = [
        ("items_lt_15", bad(F.col("n") >= MIN_ITEMS)),
        *([("cooccurrence_lt_2", bad(F.col(mentioners) >= MIN_MENTIONS))] if need_mentions else []),
        ("posts_per_day_out_of_range", bad(F.col("posts_per_day").between(*PER_DAY))),
        ("cv_too_low", F.col("cv_interval") < MIN_CV),
        ("link_ratio_too_high", bad(F.col("link_ratio") <= MAX_LINKS)),
        ("dup_ratio_too_high", bad(F.col("dup_ratio") <= MAX_DUPLICATES)),
        ("rt_ratio_too_high", bad(F.col("rt_ratio") <= MAX_REPOSTS)),
    ]
    return features.withColumn("reason", first_reason(rules))


def baselines(posts: DataFrame, source: str, views: str, reactions: str, text_hash: str, least: int = 3) -> DataFrame:
    """Per source the medians of views, reactions and reactions per view, null for few posts, and the share of repeated texts."""
    rate = F.when(F.col(views) > 0, F.col(reactions) / F.col(views))
    return posts.withColumn("__er", rate).groupBy(source).agg(
        F.count("*").alias("n"),
        stats.median_of_at_least(views, least).alias("median_views"),
        stats.median_of_at_least(reactions, least).alias("median_reactions"),
        stats.median_of_at_least("__er", least).alias("median_er"),
        (1 - F.countDistinct(text_hash) / F.count(text_hash)).alias("dup_ratio"),
    )


def promo_heavy(posts: DataFrame, source: str, is_promo: str, share: float = 0.5, least: int = 5) -> DataFrame:
    """Sources with enough posts of which at least ``share`` are paid."""
    found = posts.groupBy(source).agg(F.count("*").alias("n"), F.avg(F.col(is_promo).cast("double")).alias("promo_share"))
    return found.filter((F.col("n") >= least) & (F.col("promo_share") >= share))


def coverage(schedule: DataFrame, platform: str, status: str = "status") -> DataFrame:
    """Measured and late measurements over planned ones, per platform."""
    done = F.count_if(F.col(status).isin("measured", "measured_late"))
    return schedule.groupBy(platform).agg(F.count("*").alias("planned"), done.alias("done"), (done / F.count("*")).alias("coverage"))


def health(checks: list[tuple[str, DataFrame, Column, float]]) -> DataFrame:
    """One row per check: ``name``, ``value`` (an aggregate of its frame) and ``alert`` where it is above the limit or unknown."""
    out = None
    for name, df, value, limit in checks:
        row = df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value", F.coalesce(F.col("value") > limit, F.lit(True)).alias("alert"))
        out = row if out is None else out.union(row)
    return out


def fresh_alerts(alerts: DataFrame, sent: DataFrame, key: str, ts: str, now, hours: float = 6.0) -> DataFrame:
    """Alerts whose key was not sent within the last hours."""
    recent = sent.filter(times.hours_between(F.col(ts), now).between(0, hours)).select(key)
    return alerts.join(recent, key, "left_anti")
