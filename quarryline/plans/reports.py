"""End products: reports composed of the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import scores as S
from quarryline.functions import stats, times
from quarryline.operators import quality as Q
from quarryline.operators import ranking as R
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EVENTS_NOW, ORDERS_NOW, SNAPSHOTS, SOURCES, contents, snapshots, sources
from quarryline.session import table


@plan(f"""WITH a AS (SELECT source_id, MEDIAN(views) AS med, COUNT(*) AS n FROM {CONTENTS} GROUP BY 1), o AS (SELECT source_id, MAX(views / med) AS best FROM {CONTENTS} JOIN a USING (source_id) WHERE n >= 3 AND med > 0 GROUP BY 1),
c AS (SELECT s.source_id, platform || '|' || CASE WHEN size < 5000 THEN '<5k' ELSE '5-25k' END AS class, med FROM {SOURCES} s JOIN a USING (source_id) WHERE size > 0), m AS (SELECT class, COUNT(*) AS n, MEDIAN(med) AS m FROM c GROUP BY 1), g AS (SELECT class, ANY_VALUE(m) AS m, CASE WHEN ANY_VALUE(n) > 1 THEN 1.4826 * MEDIAN(ABS(med - m)) ELSE 0 END AS sigma FROM c JOIN m USING (class) GROUP BY 1)
SELECT c.source_id, CAST(ROUND(CASE WHEN sigma > 0 THEN (med - m) / sigma ELSE 0 END, 6) AS DOUBLE) AS z, CAST(ROUND(best, 6) AS DOUBLE) AS best FROM c JOIN g USING (class) JOIN o USING (source_id) WHERE best >= 2.0 AND CASE WHEN sigma > 0 THEN (med - m) / sigma ELSE 0 END > 0""")
def author_rating(spark, d):
    """Authors with an outlier and a level above their class."""
    posts = contents(spark, d)
    level = posts.groupBy("source_id").agg(F.median("views").alias("med"), F.count("*").alias("n"))
    best = posts.join(level, "source_id").filter("n >= 3 and med > 0").groupBy("source_id").agg(F.max(F.col("views") / F.col("med")).alias("best"))
    classed = sources(spark, d).filter("size > 0").join(level, "source_id").withColumn("class", F.concat_ws("|", "platform", times.size_class(F.col("size"))))
    rated = stats.robust_z(classed.select("source_id", "class", "med").withColumnRenamed("med", "level"), ["class"], "level")
    return rated.join(best, "source_id").filter("best >= 2.0 and z > 0").select("source_id", F.round("z", 6).alias("z"), F.round("best", 6).alias("best"))


@plan(f"""WITH w AS (SELECT source_id, COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 365) AS now, COUNT(*) FILTER (day <= DATE '{ORDERS_NOW}' - 365 AND day > DATE '{ORDERS_NOW}' - 730) AS before FROM {CONTENTS} GROUP BY 1), t AS (SELECT source_id FROM {SOURCES} ORDER BY size DESC, source_id LIMIT 20)
SELECT source_id, now, before FROM w WHERE now > before AND source_id NOT IN (SELECT source_id FROM t)""")
def dark_accounts(spark, d):
    """C11: sources that grow and are not among the twenty largest."""
    back = lambda a, b: (F.col("day") > F.date_sub(F.to_date(F.lit(ORDERS_NOW)), a)) & (F.col("day") <= F.date_sub(F.to_date(F.lit(ORDERS_NOW)), b))
    counts = contents(spark, d).groupBy("source_id").agg(F.count_if(F.col("day") > F.date_sub(F.to_date(F.lit(ORDERS_NOW)), 365)).alias("now"), F.count_if(back(730, 365)).alias("before"))
    top = sources(spark, d).orderBy(F.desc_nulls_last("size"), "source_id").limit(20).select("source_id")
    return counts.filter("now > before").join(top, "source_id", "left_anti")


@plan(f"""WITH m AS (SELECT source_id, MEDIAN(views) AS med, COUNT(*) AS n FROM {CONTENTS} GROUP BY 1) SELECT content_id, c.source_id, CAST(ROUND(views / med, 6) AS DOUBLE) AS outlier FROM {CONTENTS} c JOIN m USING (source_id) JOIN {SOURCES} s USING (source_id) WHERE n >= 5 AND views / med >= 3 AND size < 2000""")
def dark_horses(spark, d):
    """Outliers of small sources."""
    level = contents(spark, d).groupBy("source_id").agg(F.median("views").alias("med"), F.count("*").alias("n")).filter("n >= 5")
    small = sources(spark, d).filter("size < 2000").select("source_id")
    joined = contents(spark, d).join(level, "source_id").join(small, "source_id", "left_semi")
    return joined.filter(F.col("views") / F.col("med") >= 3).select("content_id", "source_id", F.round(F.col("views") / F.col("med"), 6).alias("outlier"))


@plan(f"""SELECT topic, content_id, views, k FROM (SELECT topic, content_id, views, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY views DESC, content_id) AS k FROM {CONTENTS} WHERE day > DATE '{ORDERS_NOW}' - 365) WHERE k <= 5""")
def top_by_topic(spark, d):
    """C14, C17: the best of each topic in a window."""
    recent = contents(spark, d).filter(F.col("day") > F.date_sub(F.to_date(F.lit(ORDERS_NOW)), 365))
    order = [F.desc("views"), F.col("content_id")]
    ranked = recent.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(*order)).cast("long"))
    return ranked.filter("k <= 5").select("topic", "content_id", "views", "k")


@plan(f"""WITH v AS (SELECT platform, size FROM {SOURCES}), x AS (SELECT platform, UNNEST([0.0, 2500.0, 5000.0]) AS x FROM (SELECT DISTINCT platform FROM v)) SELECT x.platform, CAST(x.x AS DOUBLE) AS x, CAST(ROUND(100 * COUNT(*) FILTER (v.size <= x.x) / COUNT(*), 6) AS DOUBLE) AS pct FROM x JOIN v USING (platform) GROUP BY 1, 2""")
def percentile_table(spark, d):
    """Where given values stand among the sources of a platform."""
    marks = F.explode(F.array(*(F.lit(x) for x in (0.0, 2500.0, 5000.0)))).alias("x")
    rows = sources(spark, d).select("platform", "size", marks)
    return rows.groupBy("platform", "x").agg(F.round(100 * F.count_if(F.col("size") <= F.col("x")) / F.count("*"), 6).alias("pct"))


@plan(f"""SELECT source_id, COUNT(*) AS n, MAX(views) AS best FROM {CONTENTS} GROUP BY 1 HAVING COUNT(*) >= 8 AND MAX(views) < 420000 AND COUNT(*) FILTER (status = 'F') <= 2""")
def no_yield_sources(spark, d):
    """Sources that were tried and gave nothing."""
    found = contents(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.max("views").alias("best"), F.count_if(F.col("status") == "F").alias("done"))
    return found.filter("n >= 8 and best < 420000 and done <= 2").drop("done")


@plan(f"""SELECT 'hours_since_last' AS name, CAST(ROUND((EPOCH_US(TIMESTAMP '{EVENTS_NOW}') - EPOCH_US(MAX(captured_at))) / 3.6e9, 6) AS DOUBLE) AS value, (EPOCH_US(TIMESTAMP '{EVENTS_NOW}') - EPOCH_US(MAX(captured_at))) / 3.6e9 > 6 AS alert FROM {SNAPSHOTS}
UNION ALL SELECT 'error_share', CAST(ROUND(AVG(CASE WHEN stage = 'error' THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE), AVG(CASE WHEN stage = 'error' THEN 1.0 ELSE 0.0 END) > 0.1 FROM {SNAPSHOTS} UNION ALL SELECT 'quota_used', CAST(COUNT(*) / 1e6 AS DOUBLE), COUNT(*) / 1e6 > 0.8 FROM {SNAPSHOTS}""")
def health_checks(spark, d):
    """One row per check."""
    rows = snapshots(spark, d)
    age = times.hours_between(F.max("captured_at"), F.lit(EVENTS_NOW).cast("timestamp"))
    checks = [("hours_since_last", rows, age, 6.0), ("error_share", rows, F.avg((F.col("stage") == "error").cast("double")), 0.1), ("quota_used", rows, F.count("*") / 1e6, 0.8)]
    return Q.health(checks).withColumn("value", F.round("value", 6))


@plan(f"""SELECT a.snapshot_id FROM {SNAPSHOTS} a WHERE a.stage = 'error' AND NOT EXISTS (SELECT 1 FROM {SNAPSHOTS} b WHERE b.content_id = a.content_id AND b.stage = 'signup' AND EPOCH_US(TIMESTAMP '{EVENTS_NOW}') - EPOCH_US(b.captured_at) BETWEEN 0 AND 86400000000)""")
def fresh_alerts(spark, d):
    """Alerts whose key was not sent within a day."""
    rows = snapshots(spark, d)
    alerts, sent = rows.filter("stage = 'error'"), rows.filter("stage = 'signup'").select("content_id", "captured_at")
    return Q.fresh_alerts(alerts, sent, "content_id", "captured_at", F.lit(EVENTS_NOW).cast("timestamp"), 24.0).select("snapshot_id")


@plan(f"""SELECT source_id, CAST(ROUND(CASE WHEN size >= 1 THEN m / size END, 6) AS DOUBLE) AS ratio FROM (SELECT source_id, MAX(views) AS m FROM {CONTENTS} GROUP BY 1) JOIN {SOURCES} USING (source_id) ORDER BY CASE WHEN size >= 1 THEN m / size END DESC NULLS LAST, source_id LIMIT 40""")
def search_ratio(spark, d):
    """Views per follower, unknown ones last."""
    best = contents(spark, d).groupBy("source_id").agg(F.max("views").alias("m")).join(sources(spark, d).select("source_id", "size"), "source_id")
    ratio = F.when(F.col("size") >= 1, F.col("m") / F.col("size"))
    return best.withColumn("r", ratio).orderBy(F.col("r").desc_nulls_last(), "source_id").limit(40).select("source_id", F.round("r", 6).alias("ratio"))


@plan(f"""SELECT source_id, CAST(day AS VARCHAR) AS day, ARG_MAX(views, content_id) AS views FROM {CONTENTS} GROUP BY 1, 2""")
def follower_history(spark, d):
    """An embedded series exploded again, the last point of each source and day kept."""
    packed = contents(spark, d).groupBy("source_id").agg(F.to_json(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), "content_id", "views"))).alias("series"))
    each = packed.select("source_id", F.explode(F.from_json("series", "array<struct<day: string, content_id: long, views: double>>")).alias("p")).select("source_id", "p.*")
    return each.groupBy("source_id", "day").agg(F.max_by("views", "content_id").alias("views"))


@plan(f"""WITH q AS (SELECT s.source_id, size, c.n, c.med, ROW_NUMBER() OVER (ORDER BY size DESC, s.source_id) AS k FROM {SOURCES} s LEFT JOIN (SELECT source_id, COUNT(*) AS n, MEDIAN(views) AS med FROM {CONTENTS} GROUP BY 1) c USING (source_id))
SELECT COALESCE(CASE WHEN n IS NULL THEN 'gone' WHEN size <= 0 THEN 'blocked' WHEN n < 6 THEN 'posts' WHEN med < 200000 THEN 'likes' END, 'promote') AS verdict, COUNT(*) AS n FROM q GROUP BY 1""")
def queue_verdicts(spark, d):
    """The verdict on each candidate, counted."""
    level = contents(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.median("views").alias("med"))
    joined = sources(spark, d).join(level, "source_id", "left")
    verdict = R.first_reason([("gone", F.col("n").isNull()), ("blocked", F.col("size") <= 0), ("posts", F.col("n") < 6), ("likes", F.col("med") < 200000)])
    return joined.groupBy(F.coalesce(verdict, F.lit("promote")).alias("verdict")).agg(F.count("*").alias("n"))


@plan(f"""SELECT 'no_size' AS caveat, COUNT(*) FILTER (size <= 0) AS n FROM {SOURCES} UNION ALL SELECT 'no_posts', COUNT(*) FROM {SOURCES} s WHERE NOT EXISTS (SELECT 1 FROM {CONTENTS} c WHERE c.source_id = s.source_id) UNION ALL SELECT 'small', COUNT(*) FROM {CONTENTS} WHERE views < 1000""")
def caveats(spark, d):
    """R14."""
    s, c = sources(spark, d), contents(spark, d)
    parts = [("no_size", s.filter("size <= 0")), ("no_posts", s.join(c, "source_id", "left_anti")), ("small", c.filter("views < 1000"))]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("caveat"), "n")
        out = row if out is None else out.union(row)
    return out


@plan("""SELECT role, ARG_MAX(conv_id, [LENGTH(text), -conv_id]) AS conv_id FROM (SELECT role, conv_id, MAX(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY role""")
def best_comment_per_author(spark, d):
    """The longest comment of each author, the first conversation of equal ones."""
    rows = table(spark, d, "conversations").filter("text is not null").groupBy("role", "conv_id").agg(F.max("text").alias("text"))
    return rows.groupBy("role").agg(F.max_by("conv_id", F.struct(F.length("text"), -F.col("conv_id"))).alias("conv_id"))


@plan(f"""WITH t AS (SELECT source_id, views FROM {CONTENTS} ORDER BY views DESC, content_id LIMIT 200) SELECT source_id, COUNT(*) AS n, CAST(ROUND(SUM(views), 2) AS DOUBLE) AS total FROM t GROUP BY 1""")
def top_sources_of_list(spark, d):
    """Sources of the two hundred best posts."""
    top = contents(spark, d).orderBy(F.desc("views"), "content_id").limit(200)
    return top.groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("views"), 2).alias("total"))


@plan("""SELECT conv_id, turn, role FROM conversations WHERE CONTAINS(text, '?') AND LENGTH(TRIM(text)) BETWEEN 8 AND 400""")
def questions_verbatim(spark, d):
    """R18."""
    return table(spark, d, "conversations").filter(F.col("text").contains("?") & F.length(F.trim("text")).between(8, 400)).select("conv_id", "turn", "role")


@plan("""SELECT conv_id, COUNT(*) AS replies FROM conversations GROUP BY conv_id ORDER BY replies DESC, conv_id LIMIT 20""")
def hot_discussions(spark, d):
    """R19."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("replies")).orderBy(F.desc("replies"), "conv_id").limit(20)


@plan(f"""SELECT p.snapshot_id, EXISTS (SELECT 1 FROM {SNAPSHOTS} v WHERE v.content_id = p.content_id AND v.stage = 'view' AND ABS(EPOCH_US(v.captured_at) - EPOCH_US(p.captured_at)) <= 10800000000) AS done FROM {SNAPSHOTS} p WHERE p.stage = 'signup'""")
def status_by_nearness(spark, d):
    """Whether a row of another kind lies within three hours."""
    rows = snapshots(spark, d)
    asked = rows.filter("stage = 'signup'").select("snapshot_id", "content_id", F.col("captured_at").alias("at"))
    views = rows.filter("stage = 'view'").select(F.col("content_id").alias("c"), "captured_at")
    near = (F.col("content_id") == F.col("c")) & (F.abs(times.hours_between(F.col("at"), F.col("captured_at"))) <= 3)
    hit = asked.join(views, near, "left_semi").select("snapshot_id", F.lit(True).alias("done"))
    return asked.select("snapshot_id").join(hit, "snapshot_id", "left").select("snapshot_id", F.coalesce("done", F.lit(False)).alias("done"))


@plan(f"""SELECT c.content_id, COALESCE(CASE WHEN c.status = 'P' THEN NULL ELSE s.platform END, 'map-' || s.country) AS platform FROM {CONTENTS} c JOIN {SOURCES} s USING (source_id)""")
def backfilled_platform(spark, d):
    """A value from the first key that has it."""
    joined = contents(spark, d).join(sources(spark, d), "source_id")
    return joined.select("content_id", F.coalesce(F.when(F.col("status") != "P", F.col("platform")), F.concat(F.lit("map-"), "country")).alias("platform"))


@plan(f"""SELECT content_id, CASE WHEN status = 'O' AND day < DATE '{ORDERS_NOW}' - 30 THEN 'abandoned' ELSE status END AS status FROM {CONTENTS}""")
def abandoned_runs(spark, d):
    """R22."""
    stale = (F.col("status") == "O") & (F.col("day") < F.date_sub(F.to_date(F.lit(ORDERS_NOW)), 30))
    return contents(spark, d).select("content_id", F.when(stale, "abandoned").otherwise(F.col("status")).alias("status"))


@plan(f"""WITH r AS (SELECT c.*, s.tier FROM {CONTENTS} c JOIN {SOURCES} s USING (source_id) WHERE day > DATE '{ORDERS_NOW}' - 720), m AS (SELECT source_id, MEDIAN(views) AS med FROM r GROUP BY 1 HAVING COUNT(*) >= 4), k AS (SELECT source_id FROM r GROUP BY 1 HAVING AVG(CASE WHEN topic < '3' THEN 1.0 ELSE 0.0 END) >= 0.35)
SELECT content_id, source_id, CAST(ROUND(views / med, 6) AS DOUBLE) AS ratio FROM r JOIN m USING (source_id) WHERE source_id IN (SELECT source_id FROM k) AND views / med >= 1.5""")
def viral_extract(spark, d):
    """Posts far above their source's median, of sources with enough posts on the topic."""
    recent = contents(spark, d).filter(F.col("day") > F.date_sub(F.to_date(F.lit(ORDERS_NOW)), 720))
    level = recent.groupBy("source_id").agg(stats.median_of_at_least("views", 4).alias("med"), F.avg((F.col("topic") < "3").cast("double")).alias("share")).filter("med is not null and share >= 0.35")
    return recent.join(level, "source_id").filter(F.col("views") / F.col("med") >= 1.5).select("content_id", "source_id", F.round(F.col("views") / F.col("med"), 6).alias("ratio"))


@plan(f"""WITH m AS (SELECT source_id, MEDIAN(views) AS med FROM {CONTENTS} GROUP BY 1), y AS (SELECT 'popular' AS block, content_id, views / med AS score FROM {CONTENTS} JOIN m USING (source_id) WHERE day > DATE '{ORDERS_NOW}' - 365 AND status = 'F' ORDER BY score DESC, content_id LIMIT 10),
t AS (SELECT 'recent' AS block, content_id, views / 1000 AS score FROM {CONTENTS} WHERE day > DATE '{ORDERS_NOW}' - 365 AND status = 'O' ORDER BY score DESC, content_id LIMIT 10) SELECT block, content_id, CAST(ROUND(score, 6) AS DOUBLE) AS score FROM y UNION ALL SELECT block, content_id, CAST(ROUND(score, 6) AS DOUBLE) FROM t""")
def unified_report(spark, d):
    """The unified report: blocks of several platforms as rows, each with its own ranking."""
    recent = contents(spark, d).filter(F.col("day") > F.date_sub(F.to_date(F.lit(ORDERS_NOW)), 365))
    level = contents(spark, d).groupBy("source_id").agg(F.median("views").alias("med"))
    popular = recent.filter("status = 'F'").join(level, "source_id").select(F.lit("popular").alias("block"), "content_id", (F.col("views") / F.col("med")).alias("score"))
    fresh = recent.filter("status = 'O'").select(F.lit("recent").alias("block"), "content_id", (F.col("views") / 1000).alias("score"))
    blocks = [b.orderBy(F.desc("score"), "content_id").limit(10) for b in (popular, fresh)]
    return blocks[0].union(blocks[1]).withColumn("score", F.round("score", 6))


@plan(f"""WITH m AS (SELECT source_id, day = MIN(day) OVER (PARTITION BY topic, DATE_TRUNC('month', day)) AS first, DATE_DIFF('day', day, DATE '{ORDERS_NOW}') AS age FROM {CONTENTS}) SELECT source_id, CAST(ROUND(SUM(CASE WHEN first THEN POW(0.5, age / 365.0) ELSE 0 END) / SUM(POW(0.5, age / 365.0)), 6) AS DOUBLE) AS score FROM m GROUP BY 1""")
def decayed_first_share(spark, d):
    """The share of a source's posts that came first in their topic and month, recent ones counting more."""
    posts = contents(spark, d).withColumn("month", F.trunc("day", "month"))
    first = posts.groupBy("topic", "month").agg(F.min("day").alias("first_day"))
    w = S.decay(F.datediff(F.to_date(F.lit(ORDERS_NOW)), "day"), 365.0)
    moves = posts.join(first, ["topic", "month"])
    share = F.sum(F.when(F.col("day") == F.col("first_day"), w).otherwise(0.0)) / F.sum(w)
    return moves.groupBy("source_id").agg(F.round(share, 6).alias("score"))
