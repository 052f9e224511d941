"""Blocks of reports: viral lists with quality gates, rising lists, descriptions of samples, counters of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import cap_per_key

# Floors, caps and limits of the viral blocks.
VIDEO_MIN_SIZE, VIDEO_MIN_VIEWS, VIDEO_MIN_COVERAGE, VIDEO_PER_CHANNEL, VIDEO_LIMIT, VIDEO_FUN_LIMIT = 1_000, 5_000, 3.0, 2, 15, 5
PRODUCT_MIN = {"youtube": 50_000, "x": 500, "telegram": 10_000}
PRODUCT_PER_CHANNEL, PRODUCT_LIMIT = 2, 5
POST_MIN_LIKES, POST_MIN_AUTHOR_POSTS, POST_MIN_AUTHOR_MEDIAN, POST_MIN_RATIO, POST_PER_AUTHOR, POST_LIMIT = 200, 5, 20.0, 3.0, 2, 10
CHANNEL_MIN_VIEWS, CHANNEL_MIN_RATIO, CHANNEL_PER_CHANNEL, CHANNEL_LIMIT = 1_000, 3.0, 2, 10
#: Seconds between two snapshots from which on a growth of comments counts.
MIN_COMMENT_SECONDS = 600


def _gated(passed: DataFrame, skip: Column | None) -> tuple[DataFrame, DataFrame]:
    """Rows that the quality gate lets through, and the number of others by reason."""
    marked = passed.withColumn("skip", F.lit(None).cast("string") if skip is None else skip)
    return marked.filter("skip is null").drop("skip"), marked.filter("skip is not null").groupBy("skip").agg(F.count("*").alias("n"))


def viral_by_coverage(
    posts: DataFrame,
    source: str,
    views: str,
    size: str,
    id_: str,
    fresh: Column,
    skip: Column | None = None,
    per_source: int = VIDEO_PER_CHANNEL,
    limit: int = VIDEO_LIMIT,
    least_size: float = VIDEO_MIN_SIZE,
    least_views: float = VIDEO_MIN_VIEWS,
    least: float = VIDEO_MIN_COVERAGE,
) -> tuple[DataFrame, DataFrame]:
    """Posts by ``coverage``, their views per follower of their own source, at most some of each; and what the quality gate passed over.

    A source of unknown or no size has no coverage. Floors come before the gate, the gate before the ranking.
    """
    coverage = F.when(F.col(size) > 0, F.col(views) / F.col(size))
    passed = posts.withColumn("coverage", coverage).filter(fresh & (F.col(size) >= least_size) & (F.col(views) >= least_views) & (F.col("coverage") >= least))
    kept, skipped = _gated(passed, skip)
    return cap_per_key(kept, source, [F.desc("coverage"), F.desc(views), F.col(id_)], per_source, limit), skipped


def viral_by_author(
    posts: DataFrame,
    author: str,
    likes: str,
    id_: str,
    fresh: Column,
    skip: Column | None = None,
    least_likes: float = POST_MIN_LIKES,
    least_posts: int = POST_MIN_AUTHOR_POSTS,
    least_median: float = POST_MIN_AUTHOR_MEDIAN,
    least: float = POST_MIN_RATIO,
    per_author: int = POST_PER_AUTHOR,
    limit: int = POST_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """Posts by ``ratio`` to the median likes of their author; authors with few posts or hardly any likes have no norm."""
    norms = posts.groupBy(author).agg(F.median(likes).alias("norm"), F.count("*").alias("__n")).filter((F.col("__n") >= least_posts) & (F.col("norm") >= least_median) & (F.col("norm") > 0))
    rated = posts.join(norms.drop("__n"), author).withColumn("ratio", F.col(likes) / F.col("norm"))
    kept, skipped = _gated(rated.filter(fresh & (F.col(likes) >= least_likes) & (F.col("ratio") >= least)), skip)
    return cap_per_key(kept, author, [F.desc("ratio"), F.desc(likes), F.col(id_)], per_author, limit), skipped


def viral_by_baseline(
    posts: DataFrame,
    source: str,
    views: str,
    base: str,
    id_: str,
    fresh: Column,
    skip: Column | None = None,
    least_views: float = CHANNEL_MIN_VIEWS,
    least: float = CHANNEL_MIN_RATIO,
    per_source: int = CHANNEL_PER_CHANNEL,
    limit: int = CHANNEL_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """Posts by ``ratio`` to the stored norm of their source; without a norm there is none."""
    rated = posts.withColumn("ratio", F.when(F.col(base) > 0, F.col(views) / F.col(base)))
    kept, skipped = _gated(rated.filter(fresh & (F.col(views) >= least_views) & (F.col("ratio") >= least)), skip)
    return cap_per_key(kept, source, [F.desc("ratio"), F.desc(views), F.col(id_)], per_source, limit), skipped


def viral_products(
    posts: DataFrame,
    platform: str,
    source: str,
    metric: str,
    id_: str,
    fresh: Column,
    product: Column,
    floors: dict[str, float],
    per_source: int = PRODUCT_PER_CHANNEL,
    limit: int = PRODUCT_LIMIT,
) -> DataFrame:
    """Releases and products of several platforms, each with a floor of its own and its own short list, by their metric."""
    floor = F.create_map(*(F.lit(x) for pair in floors.items() for x in pair))[F.col(platform)]
    passed = posts.filter(fresh & product & (F.col(metric) >= floor))
    order = [F.desc(metric), F.col(id_)]
    capped = passed.withColumn("__k", F.row_number().over(Window.partitionBy(platform, source).orderBy(*order))).filter(F.col("__k") <= per_source)
    return capped.withColumn("place", F.row_number().over(Window.partitionBy(platform).orderBy(*order))).filter(F.col("place") <= limit).drop("__k")


def last_with(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last row of each key that has a value; an aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")


def comment_leaders(deltas: DataFrame, key: str, delta: str, seconds: str, order: str, limit: int, least_seconds: int = MIN_COMMENT_SECONDS) -> DataFrame:
    """Posts by comments a day over their last interval; short intervals are noise."""
    last = last_with(deltas, key, delta, order).filter(F.col(seconds) >= least_seconds)
    return last.withColumn("per_day", F.col(delta) / (F.col(seconds) / 86400)).orderBy(F.desc("per_day"), key).limit(limit)


def by_topic(rows: DataFrame, topics: DataFrame, topic: str, speed: str, id_: str, top: int = 3) -> DataFrame:
    """Every topic of the list with its rows, their speeds in all and the fastest few; topics without rows stay."""
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(topic).orderBy(F.col(speed).desc_nulls_last(), id_)))
    first = F.array_sort(F.collect_list(F.when(F.col("__k") <= top, F.struct("__k", id_))))  # ``top`` ids
    grouped = ranked.groupBy(topic).agg(F.count("*").alias("n"), F.sum(speed).alias("total"), first.alias("__top"))
    joined = topics.join(grouped, topic, "left")
    return joined.select(topic, F.coalesce("n", F.lit(0)).alias("n"), "total", F.coalesce(F.transform("__top", lambda x: x[id_]), F.array()).alias("top"), F.col("n").isNotNull().alias("has_data"))


def index_parts(rows: DataFrame, index: str, views: str, likes: str, least_views: float) -> DataFrame:
    """Each row's ``part`` of a viral list: ``top``, ``small_sample`` (few views), ``likes_zero``, or null for rows without an index."""
    honest = F.col(index).isNotNull() & (F.coalesce(likes, F.lit(-1)) != 0)
    part = F.when(F.coalesce(F.col(likes) == 0, F.lit(False)), "likes_zero").when(honest & (F.coalesce(views, F.lit(0)) >= least_views), "top").when(honest, "small_sample")
    return rows.withColumn("part", part)


def window_stats(rows: DataFrame, index: str, views: str, likes: str, least_views: float, many_views: float = 1e6) -> DataFrame:
    """Counters of a viral window: candidates, with and without index, without likes, honest ones above and below the floor."""
    marked = index_parts(rows, index, views, likes, least_views)
    some = F.col(index).isNotNull()
    counters = {
        "candidates": F.count("*"),
        "indexed": F.count_if(some),
        "null_index": F.count_if(~some),
        "likes_zero": F.count_if(F.col(likes) == 0),
        "likes_null": F.count_if(F.col(likes).isNull()),
        "many_views_likes_null": F.count_if(F.col(likes).isNull() & (F.coalesce(views, F.lit(0)) > many_views)),
        "above_floor": F.count_if(F.col("part") == "top"),
        "below_floor": F.count_if(F.col("part") == "small_sample"),
    }
    totals = marked.agg(*(c.alias(n) for n, c in counters.items()))
    return totals.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counters))).alias("r")).select("r.*")


def shares(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """One row per counter: ``name``, rows that meet the condition and rows in all; frames are read once each."""
    out = None
    for name, df, condition in checks:
        row = df.agg(F.count_if(condition).alias("part"), F.count("*").alias("whole")).select(F.lit(name).alias("name"), "part", "whole")
        out = row if out is None else out.union(row)
    return out


def paired_counts(rules: list[tuple[str, DataFrame, Column, DataFrame, Column]]) -> DataFrame:
    """Rules of a migration: a number before, the number after, and whether they are equal. Missing numbers are zero."""
    out = None
    for name, before, a, after, b in rules:
        left, right = before.agg(F.coalesce(a, F.lit(0)).cast("double").alias("before")), after.agg(F.coalesce(b, F.lit(0)).cast("double").alias("after"))
        row = left.crossJoin(right).select(F.lit(name).alias("rule"), "before", "after", F.col("before").eqNullSafe(F.col("after")).alias("equal"))
        out = row if out is None else out.union(row)
    return out


def outlier_channels(outliers: DataFrame, source: str, outlier: str, limit: int, least: float = 3.0) -> DataFrame:
    """Sources with the most posts at ``least`` times their norm."""
    found = outliers.filter(F.col(outlier) >= least).groupBy(source).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), source).limit(limit)


def channel_audit(rated: DataFrame, source: str, id_: str, score: str, issues: str, top: int = 3) -> DataFrame:
    """Per source: posts, mean score, its most frequent issue with its count, and the posts with the best and the worst score."""
    base = rated.groupBy(source).agg(F.count("*").alias("posts"), F.avg(score).alias("mean_score"), F.max_by(id_, F.struct(score, -F.col(id_))).alias("best"), F.min_by(id_, F.struct(score, id_)).alias("worst"))
    each = rated.select(source, F.explode(issues).alias("issue")).groupBy(source, "issue").agg(F.count("*").alias("n"))
    common = each.groupBy(source).agg(F.min_by(F.struct("issue", "n"), F.struct(-F.col("n"), F.col("issue"))).alias("c"))
    return base.join(common, source, "left").select(source, "posts", "mean_score", "best", "worst", F.col("c.issue").alias("issue"), F.col("c.n").alias("issue_posts"))


def timing(posts: DataFrame, ts: str, zone: str) -> DataFrame:
    """Posts by hour and by weekday (Monday is 1) of a time zone."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    slots = F.array(F.struct(F.lit("hour").alias("kind"), F.hour(local).alias("slot")), F.struct(F.lit("weekday").alias("kind"), (F.weekday(local) + 1).alias("slot")))
    return posts.filter(F.col(ts).isNotNull()).select(F.explode(slots).alias("s")).groupBy("s.kind", "s.slot").agg(F.count("*").alias("n"))


def is_suspect(authors: Column, ratios: Column, least: int = 3, most: float = 0.5) -> Column:
    """A story of several authors who all repeat texts often; an author of unknown habits clears it."""
    known = F.size(F.array_compact(ratios)) == F.size(ratios)
    return (F.size(authors) >= least) & known & F.forall(ratios, lambda r: r > most)
