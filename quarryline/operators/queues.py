"""Work queues, budgets, audits and backfills over the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import positions


def engagement_ranking(posts: DataFrame, latest: DataFrame, scores: DataFrame, id_: str, source: str, views: str, engagement: str, n: int) -> DataFrame:
    """The ``n`` sources with the most engagement: posts, views and engagement over the joined rows.

    A post with several score rows counts once per row, as the join has it; nothing is deduplicated before.
    """
    joined = posts.select(id_, source).join(latest.select(id_, views), id_, "left").join(scores.select(id_, engagement), id_, "left")
    sums = joined.groupBy(source).agg(F.count("*").alias("posts"), F.coalesce(F.sum(views), F.lit(0)).alias("views"), F.coalesce(F.sum(engagement), F.lit(0)).alias("engagement"))
    return sums.orderBy(F.desc("engagement"), F.desc("views"), source).limit(n)


def pending_metrics(posts: DataFrame, measured: Column, deleted: Column, published: str, rank: Column, tie: str, limit: int) -> DataFrame:
    """Posts without numbers that are still there: newest first, then by the rank of their source."""
    return posts.filter(~measured & ~deleted).orderBy(F.desc(published), rank, tie).limit(limit)


def needs_full_text(deleted_at, text_source, attempts, is_long, text, most_attempts: int = 3, cut_at: int = 280) -> Column:
    """Posts whose text is cut: marked long yet no longer than the cut, or from the source that cuts; not those fetched in full or tried often enough."""
    cut = (F.coalesce(is_long, F.lit(0)) == 1) & (F.length(F.coalesce(text, F.lit(""))) <= cut_at)
    source = F.coalesce(text_source, F.lit(""))
    return deleted_at.isNull() & (source != "fxtwitter") & (F.coalesce(attempts, F.lit(0)) < most_attempts) & (cut | (source == "cdn"))


def budgets(log: DataFrame, ts: str, now: Column, limits: list[tuple[str, int, int, Column]]) -> DataFrame:
    """Per limit (name, seconds, cap, condition): requests in the last seconds, whether the cap is reached, and when the oldest one leaves the window.

    One pass over the log; null where the window is empty.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp(ts)
    sums = []
    for name, seconds, _, condition in limits:
        inside = (age <= seconds) & (age >= 0) & condition
        sums += [F.count_if(inside).alias(f"n_{name}"), F.min(F.when(inside, F.col(ts))).alias(f"oldest_{name}")]
    totals = log.agg(*sums)
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("budget"), F.col(f"n_{name}").alias("used"), (F.col(f"n_{name}") >= cap).alias("exhausted"), (F.unix_timestamp(f"oldest_{name}") + seconds).alias("free_at"))
            for name, seconds, cap, _ in limits
        )
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def pending_verification(candidates: DataFrame, registry: DataFrame, blocked: DataFrame, key: str, unjudged: Column, order: list[Column], limit: int) -> DataFrame:
    """Candidates that nobody judged, that no active source has and that are not blocked, best first."""
    left = candidates.filter(unjudged).join(registry.select(key).distinct(), key, "left_anti").join(blocked.select(key).distinct(), key, "left_anti")
    return left.orderBy(*order).limit(limit)


def resume(queue: DataFrame, order: list[Column], offset: int, per_day: int) -> DataFrame:
    """The rows of an ordered queue from a cursor on, with ``position``, ``remaining`` (from the cursor) and the days that they take."""
    placed = positions(queue, order)
    total = placed.agg(F.count("*").alias("__total"))
    left = F.greatest(F.col("__total") - offset, F.lit(0))
    days = F.ceil(left / per_day) if per_day > 0 else F.lit(None).cast("long")
    rest = placed.filter(F.col("position") >= offset).crossJoin(F.broadcast(total))  # one row
    return rest.withColumns({"remaining": left, "days": days}).drop("__total")


def harvest(comments: DataFrame, author: str, likes: str, known: DataFrame, queued: DataFrame, least: int) -> DataFrame:
    """Authors of liked comments who are no source yet: best likes, and whether they are ``added`` to the queue or ``bumped`` in it."""
    best = comments.filter(F.col(author).isNotNull() & (F.col(likes) >= least)).groupBy(author).agg(F.max(likes).alias("best_likes"))
    fresh = best.join(known.select(author).distinct(), author, "left_anti")
    marked = fresh.join(queued.select(author, F.lit(True).alias("__queued")).distinct(), author, "left")
    return marked.select(author, "best_likes", F.when(F.col("__queued"), "bumped").otherwise("added").alias("action"))


def topic_share(stories: DataFrame, topics: Column, ts: str, start: Column, end: Column, days: int = 7) -> DataFrame:
    """Per first topic of stories: those of today (from ``start`` to ``end``), those of the days before and today, and the share of today's."""
    first = F.get(topics, F.lit(0))
    since = start - F.make_interval(days=F.lit(days))
    rows = stories.withColumn("topic", first).filter(F.col("topic").isNotNull() & (F.col(ts) >= since) & (F.col(ts) < end))
    counts = rows.groupBy("topic").agg(F.count_if(F.col(ts) >= start).alias("today"), F.count("*").alias("week"))
    total = counts.agg(F.sum("today").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select("topic", "today", "week", F.when(F.col("__total") > 0, F.col("today") / F.col("__total")).otherwise(0.0).alias("share"))


def filled_platforms(log: DataFrame, runs: DataFrame, legacy: DataFrame) -> DataFrame:
    """Log rows with their platform: as they have it, else that of their run, else by the database that they came from; else null."""
    named = F.when(F.col("legacy_db") == "tg", "telegram").when(F.col("legacy_db") == "os", "youtube").otherwise(F.col("legacy_db"))
    by_run = log.join(runs.select("run_id", F.col("platform").alias("__run")), "run_id", "left")
    both = by_run.join(legacy.select("id", named.alias("__legacy")), "id", "left")
    return both.withColumn("platform", F.coalesce("platform", "__run", "__legacy")).drop("__run", "__legacy")


def repaired_movers(stories: DataFrame, members: DataFrame, sources: DataFrame) -> DataFrame:
    """First movers that were lost by the case of their name: ``story_id``, ``handle`` as written, ``source_id``.

    The first primary member names the author; of sources that differ in case only the one written alike counts, else the smallest id.
    """
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), "^@+", ""))
    named = members.filter((F.col("role") == "primary") & (F.coalesce("handle", F.lit("")) != ""))
    first = named.groupBy("story_id").agg(F.min_by("handle", "content_id").alias("handle"))
    open_ = stories.filter("first_mover is null").select("story_id").join(first, "story_id").withColumn("__key", key(F.col("handle")))
    known = sources.select("source_id", F.col("handle").alias("__own"), key(F.col("handle")).alias("__key")).filter("__key <> ''")
    found = open_.join(known, "__key")
    rank = F.struct((F.col("__own") != F.trim("handle")).alias("other"), "source_id")
    return found.groupBy("story_id", "handle").agg(F.min_by("source_id", rank).alias("source_id"))


def language_mix(rows: DataFrame, lang: str, unknown: str = "unmarked") -> DataFrame:
    """One row with the languages of a list, most frequent first; null where none is marked."""
    counts = rows.groupBy(F.coalesce(F.nullif(lang, F.lit("")), F.lit(unknown)).alias("lang")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang")))  # a row per language
    text = F.array_join(F.transform(listed, lambda s: F.concat(s["lang"], F.lit(" "), (-s["n"]).cast("string"))), ", ")
    return counts.agg(F.when(F.count_if(F.col("lang") != unknown) > 0, text).alias("mix"))


def gap_days(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Days without a row between a key's first and last one."""
    spans = rows.groupBy(key).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    every = spans.select(key, F.explode(F.sequence("__a", "__b")).alias(day))
    return every.join(rows.select(key, day).distinct(), [key, day], "left_anti")


def changed_keys(rows: DataFrame, key: str, ts: str, watermark: DataFrame) -> DataFrame:
    """Keys with a row after the last computation; all keys where nothing was computed yet. ``watermark`` has one row with ``at``."""
    return rows.crossJoin(F.broadcast(watermark.select("at"))).filter(F.col("at").isNull() | (F.col(ts) > F.col("at"))).select(key).distinct()


def mentions_of_candidates(posts: DataFrame, id_: str, text: str, ts: str, handles: Column, hint: Column, examples: int = 2, length: int = 60) -> DataFrame:
    """Per handle named in posts: mentions, posts, first and last time, whether any post hints at the topic, and the first lines of the first posts.

    Every post has one entry per handle, so mentions are partial counts; examples are cut to a few before they are collected.
    """
    each = posts.select(id_, F.explode(handles).alias("handle"), F.col(ts).alias("ts"), hint.alias("hint"), F.substring(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), 1, length).alias("line"))
    sums = each.groupBy("handle").agg(
        F.count("*").alias("mentions"), F.countDistinct(id_).alias("posts"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max(F.coalesce("hint", F.lit(False))).alias("hint")
    )
    order = Window.partitionBy("handle").orderBy(id_)
    few = each.filter("line <> ''").dropDuplicates(["handle", id_]).withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= examples)
    shown = few.groupBy("handle").agg(F.array_sort(F.collect_list(F.struct("__k", "line"))).alias("e")).select("handle", F.transform("e", lambda x: x["line"]).alias("examples"))
    return sums.join(shown, "handle", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def leave_one_out_growth(rows: DataFrame, id_: str, author: str, value: str, times: float = 3.0, least: int = 2) -> DataFrame:
    """Each row with ``median`` of its author's other rows (null for fewer than ``least``) and ``grows``, whether its value is ``times`` that.

    Without one row the middle moves by one place at most, so three values around the middle of each author are enough.
    """
    order = Window.partitionBy(author).orderBy(value, id_)
    ranked = rows.filter(F.col(value).isNotNull()).select(id_, author, value).withColumns({"__r": F.row_number().over(order), "__n": F.count("*").over(Window.partitionBy(author))})
    low, high = F.floor(F.col("__n") / 2), F.floor((F.col("__n") + 1) / 2)  # the middle places (from 1) of the n - 1 others
    near = ranked.filter(F.col("__r").between(low, high + 1))
    middle = near.groupBy(author).agg(F.map_from_entries(F.collect_list(F.struct("__r", value))).alias("__v"))
    at = lambda place: F.col("__v")[(place + F.when(place >= F.col("__r"), 1).otherwise(0)).cast("int")]
    joined = ranked.join(middle, author)
    median = F.when(F.col("__n") - 1 >= least, (at(low) + at(high)) / 2)
    return joined.select(id_, author, value, median.alias("median")).withColumn("grows", F.coalesce(F.col(value) >= times * F.col("median"), F.lit(False)))
