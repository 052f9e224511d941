"""Queues, budgets, audits and backfills: over the driver's tables in their roles, or over hand-made rows where a rule has many branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions import urls
from quarryline.operators import queues as K
from quarryline.operators import ranking as R
from quarryline.operators import verdicts as V
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EDGES, EVENTS_NOW, ORDERS_NOW, SNAPSHOTS, SOURCES, contents, edges, snapshots, sources
from quarryline.session import table

_SINCE = f"DATE '{ORDERS_NOW}' - 30"


@plan(f"""SELECT source_id, COUNT(*) AS posts, CAST(ROUND(COALESCE(SUM(views), 0), 2) AS DOUBLE) AS views, CAST(COALESCE(SUM(weight), 0) AS DOUBLE) AS engagement
FROM {CONTENTS} c LEFT JOIN (SELECT content_id, weight FROM {EDGES}) e USING (content_id) WHERE day >= {_SINCE} GROUP BY 1 ORDER BY engagement DESC, views DESC, source_id LIMIT 50""")
def engagement_ranking(spark, d):
    """R2: sources by engagement in 30 days, with the fan-out of several score rows per post."""
    posts = contents(spark, d).filter(F.col("day") >= F.date_sub(F.lit(ORDERS_NOW).cast("date"), 30))
    found = K.engagement_ranking(posts, contents(spark, d), edges(spark, d), "content_id", "source_id", "views", "weight", 50)
    return found.withColumn("views", F.round("views", 2))


@plan(f"""SELECT content_id, c.source_id FROM {CONTENTS} c JOIN {SOURCES} s USING (source_id) WHERE status = 'O' AND content_id % 7 <> 0
ORDER BY day DESC, CASE tier WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, content_id LIMIT 200""")
def pending_metrics(spark, d):
    """Posts without numbers, newest first, then by tier."""
    posts = contents(spark, d).join(sources(spark, d).select("source_id", "tier"), "source_id")
    rank = F.when(F.col("tier") == "BUILDING", 0).when(F.col("tier") == "MACHINERY", 1).otherwise(2)
    return K.pending_metrics(posts, F.col("status") != "O", F.col("content_id") % 7 == 0, "day", rank, "content_id", 200).select("content_id", "source_id")


@plan(f"""WITH r AS (SELECT EPOCH_MS(TIMESTAMP '{EVENTS_NOW}') // 1000 - EPOCH_MS(DATE_TRUNC('second', captured_at)) // 1000 AS age, stage FROM {SNAPSHOTS}),
l AS (SELECT * FROM (VALUES ('window', 900, 2, ''), ('day', 86400, 20, ''), ('views', 86400, 10, 'view'), ('clicks', 86400, 1000, 'click')) AS v(budget, seconds, cap, kind))
SELECT budget, COUNT(age) AS used, COUNT(age) >= MAX(cap) AS exhausted, EPOCH_MS(TIMESTAMP '{EVENTS_NOW}') // 1000 - MAX(age) + MAX(seconds) AS free_at
FROM l LEFT JOIN r ON age BETWEEN 0 AND seconds AND (kind = '' OR stage = kind) GROUP BY budget""")
def session_budgets(spark, d):
    """Requests in sliding windows by kind, and when the next one is free."""
    log = snapshots(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    every, stage = F.lit(True), F.col("stage")
    limits = [("window", 900, 2, every), ("day", 86400, 20, every), ("views", 86400, 10, stage == "view"), ("clicks", 86400, 1000, stage == "click")]
    return K.budgets(log, "captured_at", F.lit(EVENTS_NOW).cast("timestamp"), limits)


_CANDIDATES = f"(SELECT target_id, COUNT(*) AS seen, CAST(SUM(weight) AS DOUBLE) AS priority, MIN(kind) AS validated FROM {EDGES} GROUP BY target_id)"


@plan(f"""SELECT target_id, seen, priority FROM {_CANDIDATES} c WHERE validated <> 'R' AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = c.target_id AND p.p_size > 40) AND target_id % 11 <> 0
ORDER BY priority DESC, seen DESC, target_id LIMIT 100""")
def pending_verification(spark, d):
    """Candidates nobody judged, without those of the registry and blocked ones."""
    found = edges(spark, d).groupBy("target_id").agg(F.count("*").alias("seen"), F.sum("weight").alias("priority"), F.min("kind").alias("validated"))
    registry = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("target_id"))
    blocked = table(spark, d, "part").filter("p_partkey % 11 = 0").select(F.col("p_partkey").alias("target_id"))
    order = [F.desc("priority"), F.desc("seen"), F.col("target_id")]
    return K.pending_verification(found, registry, blocked, "target_id", F.col("validated") != "R", order, 100).select("target_id", "seen", "priority")


@plan(f"""WITH c AS {_CANDIDATES} SELECT 'queue' AS name, COUNT(*) AS n FROM c UNION ALL SELECT 'pending', COUNT(*) FROM c WHERE validated <> 'R' UNION ALL SELECT 'rejected: ' || validated, COUNT(*) FROM c WHERE validated = 'R' GROUP BY validated
UNION ALL SELECT 'tier ' || tier, COUNT(*) FROM {SOURCES} GROUP BY tier""")
def registry_growth(spark, d):
    """How the registry grows: queue, judged by reason, active by tier."""
    found = edges(spark, d).groupBy("target_id").agg(F.min("kind").alias("validated"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    reasons = found.filter("validated = 'R'").groupBy(F.concat(F.lit("rejected: "), "validated").alias("name")).agg(F.count("*").alias("n"))
    tiers = sources(spark, d).groupBy(F.concat(F.lit("tier "), "tier").alias("name")).agg(F.count("*").alias("n"))
    return one(found, "queue").union(one(found.filter("validated <> 'R'"), "pending")).union(reasons).union(tiers)


@plan(f"""WITH q AS (SELECT source_id, ROW_NUMBER() OVER (ORDER BY size DESC, source_id) - 1 AS position, COUNT(*) OVER () AS total FROM {SOURCES} WHERE tier <> 'BUILDING')
SELECT source_id, position, GREATEST(total - 40, 0) AS remaining, CAST(CEIL(GREATEST(total - 40, 0) / 25) AS BIGINT) AS days FROM q WHERE position >= 40""")
def resumed_queue(spark, d):
    """An ordered queue from its cursor on, and the days that are left."""
    queue = sources(spark, d).filter("tier <> 'BUILDING'").select("source_id", "size")
    return K.resume(queue, [F.desc("size"), F.col("source_id")], 40, 25).select("source_id", "position", "remaining", "days")


@plan(f"""SELECT stage, CAST(CAST(props->>'$.k' AS BIGINT) // 20 AS BIGINT) AS verdict, COUNT(*) AS n FROM {SNAPSHOTS} WHERE CAST(props->>'$.k' AS BIGINT) >= 20 GROUP BY 1, 2""")
def verdict_report(spark, d):
    """Verdicts kept in JSON, counted by platform and verdict."""
    k = F.get_json_object("props", "$.k").cast("long")
    return snapshots(spark, d).filter(k >= 20).groupBy("stage", F.floor(k / 20).alias("verdict")).agg(F.count("*").alias("n"))


@plan(f"""WITH s AS (SELECT topic, day FROM {CONTENTS} WHERE day >= DATE '{ORDERS_NOW}' - 37 AND day < DATE '{ORDERS_NOW}'), c AS (SELECT topic, COUNT(*) FILTER (day >= DATE '{ORDERS_NOW}' - 30) AS today, COUNT(*) AS week FROM s GROUP BY 1)
SELECT topic, today, week, CAST(ROUND(CASE WHEN SUM(today) OVER () > 0 THEN today / SUM(today) OVER () ELSE 0 END, 9) AS DOUBLE) AS share FROM c""")
def topic_shares(spark, d):
    """Stories of a window and of seven days more by their first topic, with the share of the window."""
    now = F.lit(ORDERS_NOW).cast("timestamp")
    rows = contents(spark, d).withColumn("day", F.col("day").cast("timestamp"))
    found = K.topic_share(rows, F.array("topic", "status"), "day", now - F.make_interval(days=F.lit(30)), now)
    return found.withColumn("share", F.round("share", 9))


@plan(f"""WITH b AS (SELECT content_id AS author, MAX(views) AS best_likes FROM {SNAPSHOTS} WHERE views >= 50 GROUP BY 1)
SELECT author, best_likes, CASE WHEN author % 3 = 0 THEN 'bumped' ELSE 'added' END AS action FROM b WHERE author % 10 <> 0""")
def harvested_authors(spark, d):
    """Authors of liked comments, new or already queued."""
    rows = snapshots(spark, d).select(F.col("content_id").alias("author"), "views")
    return K.harvest(rows, "author", "views", rows.filter("author % 10 = 0"), rows.filter("author % 3 = 0"), 50)


@plan(f"""SELECT content_id, target_id, weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY content_id ORDER BY weight DESC, day DESC, target_id DESC) AS k FROM {EDGES}) WHERE k = 1""")
def top_comment_per_post(spark, d):
    """The best comment of each post, the latest of equal ones; an aggregate, no sort."""
    best = edges(spark, d).groupBy("content_id").agg(F.max(F.struct("weight", "day", "target_id")).alias("b"))
    return best.select("content_id", "b.target_id", "b.weight")


@plan(f"""SELECT s.content_id, c.source_id, c.handle FROM {CONTENTS} s LEFT JOIN {SOURCES} c USING (source_id)""")
def denormalised_ids(spark, d):
    """Keys of the source beside every post; posts without one keep null."""
    return contents(spark, d).select("content_id", "source_id").join(sources(spark, d).select("source_id", "handle"), "source_id", "left")


@plan("""WITH c AS (SELECT COALESCE(NULLIF(lang, ''), 'unmarked') AS lang, COUNT(*) AS n FROM (SELECT lang FROM (SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3) GROUP BY 1)
SELECT STRING_AGG(lang || ' ' || n, ', ' ORDER BY n DESC, lang) AS mix FROM c""")
def curated_language_mix(spark, d):
    """The longest three texts of each source, and their languages."""
    kept = R.cap_per_key(table(spark, d, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 3)
    return K.language_mix(kept, "lang")


@plan(f"""WITH m AS (SELECT source_id, MEDIAN(views) AS med, COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 180) AS recent FROM {CONTENTS} GROUP BY 1), o AS (SELECT DISTINCT source_id FROM {CONTENTS} JOIN m USING (source_id) WHERE views >= 1.5 * med),
a AS (SELECT source_id, size, recent, source_id IN (SELECT source_id FROM o) AS hit, source_id % 17 = 0 AS blocked, CASE WHEN source_id % 5 <> 0 THEN (source_id % 13) / 100 END AS growth FROM {SOURCES} JOIN m USING (source_id))
SELECT source_id, CASE WHEN growth IS NULL THEN 'unknown' ELSE 'verified' END AS growth_status, CAST(size AS DOUBLE) AS size FROM a
WHERE size BETWEEN 1000 AND 500000 AND recent >= 3 AND hit AND NOT blocked AND (growth IS NULL OR growth >= CASE WHEN size >= 5000 THEN 0.03 ELSE 0.10 END)""")
def author_selection(spark, d):
    """Authors by size, posts, an outlier and growth; those with unknown growth stand beside the verified ones."""
    posts = contents(spark, d)
    recent = F.count_if(F.col("day") > F.date_sub(F.lit(ORDERS_NOW).cast("date"), 180))
    level = posts.groupBy("source_id").agg(F.median("views").alias("med"), recent.alias("recent"))
    hit = posts.join(level, "source_id").filter("views >= 1.5 * med").select("source_id", F.lit(True).alias("hit")).distinct()
    rows = sources(spark, d).join(level, "source_id").join(hit, "source_id", "left")
    growth = F.when(F.col("source_id") % 5 != 0, F.col("source_id") % 13 / 100)
    gate = V.growth_gate(F.col("size"), F.col("recent"), F.col("hit"), F.col("source_id") % 17 == 0, growth)
    return rows.withColumn("growth_status", gate).filter("growth_status is not null").select("source_id", "growth_status", "size")


@plan(f"""WITH p AS (SELECT source_id, COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 7) AS posts_7d, CAST(MEDIAN(views) FILTER (day > DATE '{ORDERS_NOW}' - 90) AS DOUBLE) AS median_metric FROM {CONTENTS} GROUP BY 1)
SELECT source_id, '{ORDERS_NOW}' AS day, CAST(size AS DOUBLE) AS subs, posts_7d, median_metric FROM (SELECT source_id, CASE WHEN size > 0 THEN size END AS size FROM {SOURCES}) LEFT JOIN p USING (source_id) WHERE size IS NOT NULL OR posts_7d IS NOT NULL OR median_metric IS NOT NULL""")
def daily_capture(spark, d):
    """One row per source and day with what is known of it; sources of which nothing is known have none. Captured again, the day is replaced."""
    from quarryline.operators import upsert

    since = lambda n: F.col("day") > F.date_sub(F.lit(ORDERS_NOW).cast("date"), n)
    posts = contents(spark, d).groupBy("source_id").agg(F.count_if(since(7)).alias("posts_7d"), F.median(F.when(since(90), F.col("views"))).alias("median_metric"))
    known = sources(spark, d).select("source_id", F.when(F.col("size") > 0, F.col("size")).alias("subs")).join(posts, "source_id", "left")
    rows = known.filter("subs is not null or posts_7d is not null or median_metric is not null").withColumn("day", F.lit(ORDERS_NOW))
    first = rows.withColumns({"posts_7d": F.lit(-1).cast("long"), "arrival": F.lit(0)})
    return upsert.merge(first.drop("arrival"), rows.withColumn("arrival", F.lit(1)), ["source_id", "day"], "arrival").select("source_id", "day", "subs", "posts_7d", "median_metric")


@plan(f"""SELECT a.content_id, CAST(ROUND(CASE WHEN COUNT(b.content_id) >= 2 THEN MEDIAN(b.views) END, 4) AS DOUBLE) AS median, COALESCE(COUNT(b.content_id) >= 2 AND ANY_VALUE(a.views) >= 1.3 * MEDIAN(b.views), FALSE) AS grows
FROM {CONTENTS} a LEFT JOIN {CONTENTS} b ON a.source_id = b.source_id AND a.content_id <> b.content_id GROUP BY a.content_id""")
def early_growth(spark, d):
    """Each post against the median of its author's other posts."""
    found = K.leave_one_out_growth(contents(spark, d), "content_id", "source_id", "views", 1.3)
    return found.select("content_id", F.round("median", 4).alias("median"), "grows")


@plan(f"""WITH w AS (SELECT MAX(captured_at) - INTERVAL 3 DAY AS since FROM {SNAPSHOTS}), k AS (SELECT DISTINCT content_id FROM {SNAPSHOTS}, w WHERE captured_at > since)
SELECT content_id, COUNT(*) AS n, CAST(ROUND(SUM(views), 4) AS DOUBLE) AS views FROM {SNAPSHOTS} WHERE content_id IN (SELECT content_id FROM k) GROUP BY 1""")
def changed_since_watermark(spark, d):
    """Only keys with rows after the last computation are computed again, from all of their rows."""
    rows = snapshots(spark, d)
    mark = rows.agg((F.max("captured_at") - F.expr("INTERVAL 3 DAYS")).alias("at"))
    changed = K.changed_keys(rows, "content_id", "captured_at", mark)
    return rows.join(changed, "content_id", "left_semi").groupBy("content_id").agg(F.count("*").alias("n"), F.round(F.sum("views"), 4).alias("views"))


@plan(f"""WITH r AS (SELECT DISTINCT content_id, CAST(captured_at AS DATE) AS day FROM {SNAPSHOTS}), s AS (SELECT content_id, UNNEST(GENERATE_SERIES(CAST(MIN(day) AS TIMESTAMP), CAST(MAX(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM r GROUP BY 1)
SELECT content_id, COUNT(*) AS gaps, CAST(CAST(MIN(day) AS DATE) AS VARCHAR) AS first_gap FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.content_id = s.content_id AND r.day = CAST(s.day AS DATE)) GROUP BY 1""")
def gap_fill(spark, d):
    """Days that a content was not measured on, to be filled."""
    rows = snapshots(spark, d).select("content_id", F.to_date("captured_at").alias("day"))
    return K.gap_days(rows, "content_id", "day").groupBy("content_id").agg(F.count("*").alias("gaps"), F.min("day").cast("string").alias("first_gap"))
