"""Topics and entities in a window against the window before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import word_runs
from quarryline.session import shared_dir, write_through

ACCEL_MIN, MIN_AUTHORS = 0.5, 5


def window_of(ts, end, hours: int):
    """``now`` for the last ``hours`` before ``end``, ``before`` for as many before these, else null; both half-open."""
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    to = F.unix_timestamp(end.cast("timestamp"))
    return F.when((seconds >= to - hours * 3600) & (seconds < to), "now").when((seconds >= to - 2 * hours * 3600) & (seconds < to - hours * 3600), "before")


def acceleration(posts: DataFrame, entities: str, author: str, ts: str, end, hours: int, least_authors: int = MIN_AUTHORS) -> DataFrame:
    """Per entity of the current window: ``posts``, ``authors``, shares of both windows, ``accel`` and ``state`` (trending, new, none).

    Windows are marked once; entities are exploded and counted, totals are one row.
    """
    marked = posts.withColumn("__w", window_of(F.col(ts), end, hours)).filter(F.col("__w").isNotNull())
    totals = marked.agg(F.count_if(F.col("__w") == "now").alias("__n"), F.count_if(F.col("__w") == "before").alias("__p"))
    each = marked.select(author, "__w", F.explode(F.array_distinct(entities)).alias("entity"))
    now = F.col("__w") == "now"
    counted = each.groupBy("entity").agg(F.count_if(now).alias("posts"), F.count_if(~now).alias("posts_before"), F.countDistinct(F.when(now, F.col(author))).alias("authors"))
    shared = counted.filter("posts > 0").crossJoin(F.broadcast(totals))  # totals are one row
    share, before = F.col("posts") / F.col("__n"), F.when(F.col("__p") > 0, F.col("posts_before") / F.col("__p"))
    accel = F.when(before > 0, (share - before) / before)
    many = F.col("authors") >= least_authors
    state = F.when(many & F.coalesce(before == 0, F.lit(True)), "new").when(many & (accel >= ACCEL_MIN), "trending").otherwise("none")
    return shared.select("entity", "posts", "posts_before", "authors", share.alias("share_now"), before.alias("share_before"), accel.alias("accel"), state.alias("state"))


def novelties(posts: DataFrame, entities: str, author: str, platform: str, ts: str, start, least_authors: int = 3, least_platforms: int = 2) -> DataFrame:
    """Entities since ``start`` that no earlier post has, by enough authors and platforms."""
    each = posts.select(author, platform, ts, F.explode(F.array_distinct(entities)).alias("entity"))
    new = each.filter(F.col(ts) >= start).join(each.filter(F.col(ts) < start).select("entity").distinct(), "entity", "left_anti")
    counted = new.groupBy("entity").agg(F.countDistinct(author).alias("authors"), F.countDistinct(platform).alias("platforms"), F.count("*").alias("posts"))
    return counted.filter((F.col("authors") >= least_authors) & (F.col("platforms") >= least_platforms))


def topic_windows(posts: DataFrame, topic: str, day: str, today, days: int) -> DataFrame:
    """Posts per topic in the last ``days`` calendar days and in as many before, and the change."""
    this = (F.col(day) > F.date_sub(today, days)) & (F.col(day) <= today)
    last = (F.col(day) > F.date_sub(today, 2 * days)) & (F.col(day) <= F.date_sub(today, days))
    counted = posts.groupBy(topic).agg(F.count_if(this).alias("current"), F.count_if(last).alias("previous"))
    return counted.withColumn("accel", F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) / F.col("previous")))


def daily_counts(posts: DataFrame, keys: list[str], day: str, start, end) -> DataFrame:
    """Posts per key and day, with zero for days without any."""
    days = posts.select(*keys).distinct().select(*keys, F.explode(F.sequence(start, end)).alias(day))
    counted = posts.groupBy(*keys, F.col(day).alias(day)).agg(F.count("*").alias("n"))
    return days.join(counted, [*keys, day], "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Words that pairs are looked up in; where more are left, all pairs are made.
KNOWN_WORDS = 5000


def phrases(posts: DataFrame, id_: str, words: str, least: int, limit: int) -> DataFrame:
    """Single words and pairs of neighbours by the number of posts that have them; words have no blanks.

    No pair is in more posts than either of its words. So a pair that has a word in fewer posts than the last of the ``limit`` most frequent words comes
    after all of these, and is not made; ties stay.
    """
    spark = posts.sparkSession
    posts = write_through(posts.select(F.col(words).alias("w")), shared_dir(spark))  # words are made once
    count = lambda each: posts.select(F.explode(F.array_distinct(each)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("posts")).filter(F.col("posts") >= least)
    singles = write_through(count(F.col("w")), shared_dir(spark))
    last = singles.orderBy(F.desc("posts")).limit(limit).agg(F.min("posts").alias("posts"), F.count("*").alias("n")).first()
    floor = last.posts if limit and last.n == limit else least
    known = [r.phrase for r in singles.filter(F.col("posts") >= floor).select("phrase").limit(KNOWN_WORDS + 1).collect()]
    runs = word_runs(F.col("w"), 2)
    if len(known) <= KNOWN_WORDS:
        n = F.greatest(F.size("w") - 1, F.lit(0))
        pairs = F.filter(F.arrays_zip(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n)), lambda z: z["0"].isin(known) & z["1"].isin(known))
        runs = F.transform(pairs, lambda z: F.concat_ws(" ", z["0"], z["1"]))
    return singles.unionByName(count(runs)).orderBy(F.desc("posts"), "phrase").limit(limit)


def presence_z(posts: DataFrame, words: str, group: str, least: int = 5) -> DataFrame:
    """Per word the two-proportion z of its presence in posts of the group (flag ``group``) against the others."""
    totals = posts.agg(F.count_if(group).alias("__a"), F.count_if(~F.col(group)).alias("__b"))
    each = posts.select(group, F.explode(F.array_distinct(words)).alias("word"))
    counted = each.groupBy("word").agg(F.count_if(group).alias("in_group"), F.count_if(~F.col(group)).alias("outside")).filter(F.col("in_group") + F.col("outside") >= least)
    joined = counted.crossJoin(F.broadcast(totals))
    p, q = F.col("in_group") / F.col("__a"), F.col("outside") / F.col("__b")
    pooled = (F.col("in_group") + F.col("outside")) / (F.col("__a") + F.col("__b"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("__a") + 1 / F.col("__b")))
    return joined.select("word", "in_group", "outside", F.when(error > 0, (p - q) / error).otherwise(0.0).alias("z"))
