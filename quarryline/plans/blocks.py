"""Blocks of the reports over the driver's tables in their roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import scores as S
from quarryline.functions import text as T
from quarryline.functions import times
from quarryline.operators import blocks as B
from quarryline.operators import quality as Q
from quarryline.operators import snapshots as N
from quarryline.operators import verdicts as V
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EDGES, EVENTS_NOW, ORDERS_NOW, SNAPSHOTS, SOURCES, contents, edges, snapshots, sources
from quarryline.session import table

_YEAR = f"day > DATE '{ORDERS_NOW}' - 365"
_STATUS = "CASE tier WHEN 'FURNITURE' THEN 'candidate' WHEN 'HOUSEHOLD' THEN 'dead' ELSE 'active' END"
_SKIP = f"CASE {_STATUS} WHEN 'candidate' THEN 'candidate' WHEN 'dead' THEN 'status' ELSE CASE WHEN source_id % 7 = 0 THEN 'promo_source' WHEN topic = '5-LOW' THEN 'ad' END END"
_POSTS = f"(SELECT c.content_id, c.source_id, c.day, c.views, c.topic, s.size, s.platform, {_SKIP.replace('source_id', 'c.source_id')} AS skip FROM {CONTENTS} c JOIN {SOURCES} s USING (source_id))"


def _posts(spark, d):
    return contents(spark, d).join(sources(spark, d).select("source_id", "size", "platform", "tier"), "source_id")


def _fresh():
    return F.col("day") > F.date_sub(F.lit(ORDERS_NOW).cast("date"), 365)


def _skip():
    status = F.when(F.col("tier") == "FURNITURE", "candidate").when(F.col("tier") == "HOUSEHOLD", "dead").otherwise("active")
    return V.quality_skip(status, F.col("source_id") % 7 == 0, F.col("topic") == "5-LOW")


def _capped(ranked: str, per: int, limit: int, key: str = "source_id") -> str:
    """SQL of a capped list from rows with a total order ``o``."""
    return f"SELECT * EXCLUDE (o, k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY o) AS k FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {ranked}) AS o FROM passed)) WHERE k <= {per} ORDER BY o LIMIT {limit}"


@plan(f"""WITH passed AS (SELECT content_id, source_id, CAST(ROUND(views / size, 6) AS DOUBLE) AS coverage FROM {_POSTS} WHERE {_YEAR} AND size >= 1000 AND views >= 5000 AND views / size >= 3 AND skip IS NULL ORDER BY 1)
SELECT content_id, source_id, coverage FROM ({_capped('coverage DESC, content_id', 2, 15)})""")
def viral_coverage(spark, d):
    """Views per follower, with floors, the quality gate and at most two posts of a source."""
    rows, _ = B.viral_by_coverage(_posts(spark, d), "source_id", "views", "size", "content_id", _fresh(), _skip())
    return rows.select("content_id", "source_id", F.round("coverage", 6).alias("coverage"))


@plan(f"""SELECT skip, COUNT(*) AS n FROM {_POSTS} WHERE {_YEAR} AND size >= 1000 AND views >= 5000 AND views / size >= 3 AND skip IS NOT NULL GROUP BY 1""")
def viral_skips(spark, d):
    """What the quality gate passed over, by reason: the complement of the viral list."""
    return B.viral_by_coverage(_posts(spark, d), "source_id", "views", "size", "content_id", _fresh(), _skip())[1]


@plan(f"""WITH n AS (SELECT source_id, MEDIAN(views) AS norm FROM {_POSTS} GROUP BY 1 HAVING COUNT(*) >= 5 AND MEDIAN(views) >= 20), passed AS (SELECT content_id, source_id, views / norm AS ratio, views FROM {_POSTS} JOIN n USING (source_id) WHERE {_YEAR} AND views >= 200 AND views / norm >= 1.4 AND skip IS NULL)
SELECT content_id, source_id, CAST(ROUND(ratio, 6) AS DOUBLE) AS ratio FROM ({_capped('ratio DESC, views DESC, content_id', 2, 10)})""")
def viral_ratio(spark, d):
    """Posts by their ratio to the author's median, of authors with enough posts."""
    rows, _ = B.viral_by_author(_posts(spark, d), "source_id", "views", "content_id", _fresh(), _skip(), least=1.4)
    return rows.select("content_id", "source_id", F.round("ratio", 6).alias("ratio"))


@plan(f"""WITH b AS (SELECT source_id, CASE WHEN COUNT(*) >= 3 THEN MEDIAN(views) END AS base FROM {CONTENTS} WHERE NOT ({_YEAR}) GROUP BY 1), passed AS (SELECT content_id, source_id, views / base AS ratio, views FROM {_POSTS} JOIN b USING (source_id) WHERE {_YEAR} AND base > 0 AND views >= 1000 AND views / base >= 1.5 AND skip IS NULL)
SELECT content_id, source_id, CAST(ROUND(ratio, 6) AS DOUBLE) AS ratio FROM ({_capped('ratio DESC, views DESC, content_id', 2, 10)})""")
def viral_baseline(spark, d):
    """Posts by their ratio to the norm of their source before the window."""
    from quarryline.functions import stats

    base = contents(spark, d).filter(~_fresh()).groupBy("source_id").agg(stats.median_of_at_least("views", 3).alias("base"))
    rows, _ = B.viral_by_baseline(_posts(spark, d).join(base, "source_id", "left"), "source_id", "views", "base", "content_id", _fresh(), _skip(), least=1.5)
    return rows.select("content_id", "source_id", F.round("ratio", 6).alias("ratio"))


@plan(f"""WITH p AS (SELECT content_id, source_id, platform, views FROM {_POSTS} WHERE {_YEAR} AND topic IN ('1-URGENT', '2-HIGH') AND views >= CASE platform WHEN 'EUROPE' THEN 200000 WHEN 'ASIA' THEN 250000 END),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY platform, source_id ORDER BY views DESC, content_id) AS k FROM p), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY platform ORDER BY views DESC, content_id) AS place FROM k WHERE k <= 2)
SELECT platform, place, content_id FROM r WHERE place <= 5""")
def viral_products(spark, d):
    """Product topics, a list per platform with its own floor; platforms without a floor have none."""
    product = F.col("topic").isin("1-URGENT", "2-HIGH")
    rows = B.viral_products(_posts(spark, d), "platform", "source_id", "views", "content_id", _fresh(), product, {"EUROPE": 200000.0, "ASIA": 250000.0})
    return rows.select("platform", F.col("place").cast("long").alias("place"), "content_id")


_DELTAS = f"""(SELECT *, views - LAG(views) OVER w AS raw, EPOCH_MS(DATE_TRUNC('second', captured_at)) // 1000 - LAG(EPOCH_MS(DATE_TRUNC('second', captured_at)) // 1000) OVER w AS seconds FROM {SNAPSHOTS} WINDOW w AS (PARTITION BY content_id ORDER BY captured_at))"""


def _speeds(spark, d):
    rows = N.deltas(snapshots(spark, d), "content_id", "captured_at", ["views"])
    return rows.join(contents(spark, d).select((F.col("content_id") % 50).alias("k"), "topic").groupBy("k").agg(F.max("topic").alias("topic")), F.col("content_id") % 50 == F.col("k"), "left")


@plan(f"""WITH s AS (SELECT content_id, ARG_MAX(raw, snapshot_id) AS delta, ARG_MAX(seconds, snapshot_id) AS seconds FROM {_DELTAS} WHERE seconds >= 600 AND raw >= 0 GROUP BY 1)
SELECT content_id, CAST(ROUND(delta / (seconds / 86400), 6) AS DOUBLE) AS per_day FROM s WHERE seconds >= 600 ORDER BY delta / (seconds / 86400) DESC, content_id LIMIT 20""")
def comment_leaders(spark, d):
    """C14: growth a day over the last interval."""
    rows = N.deltas(snapshots(spark, d), "content_id", "captured_at", ["views"])
    found = B.comment_leaders(rows, "content_id", "delta_views", "interval_seconds", "snapshot_id", 20)
    return found.select("content_id", F.round("per_day", 6).alias("per_day"))


@plan(f"""WITH s AS (SELECT content_id, ARG_MAX(CASE WHEN raw >= 0 THEN raw / (seconds / 86400) END, snapshot_id) AS speed FROM {_DELTAS} WHERE seconds >= 3600 AND raw >= 0 GROUP BY 1) SELECT content_id, CAST(ROUND(speed, 6) AS DOUBLE) AS per_day FROM s ORDER BY speed DESC, content_id LIMIT 50""")
def rising_contents(spark, d):
    """C14, C17: the last good speed of each content, fastest first."""
    rows = N.deltas(snapshots(spark, d), "content_id", "captured_at", ["views"]).filter("interval_quality = 'ok'")
    last = B.last_with(rows, "content_id", "per_day", "snapshot_id").orderBy(F.desc("per_day"), "content_id").limit(50)
    return last.select("content_id", F.round("per_day", 6).alias("per_day"))


@plan(f"""WITH t AS (SELECT DISTINCT topic FROM {CONTENTS} UNION ALL SELECT '6-NONE'), r AS (SELECT topic, content_id, views, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY views DESC, content_id) AS k FROM {CONTENTS} WHERE {_YEAR}), g AS (SELECT topic, COUNT(*) AS n, SUM(views) AS total, STRING_AGG(CAST(content_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS top FROM r GROUP BY 1)
SELECT topic, COALESCE(n, 0) AS n, CAST(ROUND(total, 2) AS DOUBLE) AS total, COALESCE(top, '') AS top, n IS NOT NULL AS has_data FROM t LEFT JOIN g USING (topic)""")
def topic_board(spark, d):
    """C14, C17: every topic with its posts, their sum and its best three; topics without posts stay."""
    topics = contents(spark, d).select("topic").distinct().union(spark.createDataFrame([("6-NONE",)], "topic string"))
    rows = B.by_topic(contents(spark, d).filter(_fresh()), topics, "topic", "views", "content_id")
    return rows.withColumns({"total": F.round("total", 2), "top": F.array_join(F.transform("top", lambda x: x.cast("string")), ",")})


_INDEX = f"(SELECT content_id, CASE WHEN content_id % 5 <> 0 THEN views / 1000 END AS idx, views, CASE WHEN content_id % 11 = 0 THEN 0 WHEN content_id % 13 <> 0 THEN content_id END AS likes FROM {CONTENTS} WHERE {_YEAR})"


def _indexed(spark, d):
    rows, i = contents(spark, d).filter(_fresh()), F.col("content_id")
    return rows.select("content_id", F.when(i % 5 != 0, F.col("views") / 1000).alias("idx"), "views", F.when(i % 11 == 0, 0).when(i % 13 != 0, i).alias("likes"))


@plan(f"""SELECT content_id, CASE WHEN likes = 0 THEN 'likes_zero' WHEN idx IS NULL THEN NULL WHEN views >= 150000 THEN 'top' ELSE 'small_sample' END AS part FROM {_INDEX}""")
def viral_parts(spark, d):
    """C14: which part of the viral list each post is in."""
    return B.index_parts(_indexed(spark, d), "idx", "views", "likes", 150000).select("content_id", "part")


@plan(f"""WITH r AS (SELECT COUNT(*) AS candidates, COUNT(idx) AS indexed, COUNT(*) FILTER (idx IS NULL) AS null_index, COUNT(*) FILTER (likes = 0) AS likes_zero, COUNT(*) FILTER (likes IS NULL) AS likes_null, COUNT(*) FILTER (likes IS NULL AND views > 400000) AS many_views_likes_null,
  COUNT(*) FILTER (idx IS NOT NULL AND COALESCE(likes, -1) <> 0 AND views >= 150000) AS above_floor, COUNT(*) FILTER (idx IS NOT NULL AND COALESCE(likes, -1) <> 0 AND views < 150000) AS below_floor FROM {_INDEX})
UNPIVOT r ON COLUMNS(*) INTO NAME name VALUE n""")
def viral_window_stats(spark, d):
    """C14: counters of the viral window."""
    return B.window_stats(_indexed(spark, d), "idx", "views", "likes", 150000, 400000)


_HOURS = f"(EPOCH_US(TIMESTAMP '{EVENTS_NOW}') - EPOCH_US(captured_at)) / 3.6e9"


@plan(f"""WITH e AS (SELECT stage, {_HOURS} AS age, props FROM {SNAPSHOTS}), c AS (
SELECT 'freshness_view' AS name, MIN(age) FILTER (stage = 'view') AS value, 6.0 AS lim FROM e UNION ALL SELECT 'freshness_error', MIN(age) FILTER (stage = 'error'), 240.0 FROM e UNION ALL SELECT 'freshness_none', NULL, 6.0
UNION ALL SELECT 'open_runs', COUNT(*) FILTER (stage = 'signup' AND age > 24), 0.0 FROM e UNION ALL SELECT 'overdue_measures', COUNT(*) FILTER (stage = 'purchase' AND age > 48), 1e9 FROM e
UNION ALL SELECT 'fail_rate', CASE WHEN COUNT(*) FILTER (age <= 72) >= 10 THEN COUNT(*) FILTER (age <= 72 AND stage = 'error') / COUNT(*) FILTER (age <= 72) ELSE 0 END, 0.2 FROM e UNION ALL SELECT 'too_many_requests', COUNT(*) FILTER (age <= 24 AND stage = 'error' AND CAST(props->>'$.k' AS BIGINT) > 90), 5.0 FROM e
UNION ALL SELECT 'text_gap', COUNT(*) FILTER (LENGTH(text) > 4000 AND n_chars <> LENGTH(text)) / GREATEST(COUNT(*) FILTER (LENGTH(text) > 4000), 1), 0.1 FROM documents UNION ALL SELECT 'registry_growth', -COUNT(*), -50.0 FROM {SOURCES})
SELECT name, CAST(ROUND(value, 6) AS DOUBLE) AS value, COALESCE(value > lim, TRUE) AS alert FROM c""")
def health_panel(spark, d):
    """Freshness per platform, open runs, overdue measurements, failures (with enough requests), 429s, cut texts, growth of the registry."""
    rows, docs = snapshots(spark, d), table(spark, d, "documents")
    age, stage = times.hours_between(F.col("captured_at"), F.lit(EVENTS_NOW).cast("timestamp")), F.col("stage")
    lately = age <= 72
    failed = F.when(F.count_if(lately) >= 10, F.count_if(lately & (stage == "error")) / F.count_if(lately)).otherwise(0.0)
    long = F.length("text") > 4000
    checks = [
        ("freshness_view", rows, F.min(F.when(stage == "view", age)), 6.0),
        ("freshness_error", rows, F.min(F.when(stage == "error", age)), 240.0),
        ("freshness_none", rows, F.min(F.when(stage == "none", age)), 6.0),
        ("open_runs", rows, F.count_if((stage == "signup") & (age > 24)), 0.0),
        ("overdue_measures", rows, F.count_if((stage == "purchase") & (age > 48)), 1e9),
        ("fail_rate", rows, failed, 0.2),
        ("too_many_requests", rows, F.count_if((age <= 24) & (stage == "error") & (F.get_json_object("props", "$.k").cast("long") > 90)), 5.0),
        ("text_gap", docs, F.count_if(long & (F.col("n_chars") != F.length("text"))) / F.greatest(F.count_if(long), F.lit(1)), 0.1),
        ("registry_growth", sources(spark, d), -F.count("*"), -50.0),
    ]
    return Q.health(checks).withColumn("value", F.round("value", 6))


@plan(f"""SELECT 'size_' || LOWER(platform) AS name, COUNT(*) FILTER (size > 0) AS part, COUNT(*) AS whole FROM {SOURCES} WHERE platform IN ('ASIA', 'EUROPE') GROUP BY platform
UNION ALL SELECT 'no_lang', COUNT(*) FILTER (lang IS NULL), COUNT(*) FROM documents UNION ALL SELECT 'no_views', COUNT(*) FILTER (views IS NULL OR views = 0), COUNT(*) FROM {CONTENTS}
UNION ALL SELECT 'with_baseline', COUNT(*) FILTER (m > 0), COUNT(*) FROM (SELECT CASE WHEN COUNT(c.content_id) >= 3 THEN MEDIAN(views) END AS m FROM {SOURCES} s LEFT JOIN {CONTENTS} c USING (source_id) GROUP BY s.source_id)
UNION ALL SELECT 'author_differs', COUNT(*) FILTER (LOWER(s.handle) <> 'customer#' || LPAD(CAST(c.content_id % 150 AS VARCHAR), 9, '0')), COUNT(*) FROM {CONTENTS} c JOIN {SOURCES} s USING (source_id) WHERE {_YEAR}
UNION ALL SELECT 'several_platforms', COUNT(*) FILTER (n >= 2), COUNT(*) FROM (SELECT topic, COUNT(DISTINCT platform) AS n FROM {_POSTS} GROUP BY topic)""")
def caveat_counters(spark, d):
    """What is missing: sizes per platform, languages, views, norms, authors that are not the feed's, topics of several platforms."""
    s, c, docs, posts = sources(spark, d), contents(spark, d), table(spark, d, "documents"), _posts(spark, d)
    norms = s.select("source_id").join(c, "source_id", "left").groupBy("source_id").agg(F.when(F.count("content_id") >= 3, F.median("views")).alias("m"))
    feeds = c.filter(_fresh()).join(s.select("source_id", "handle"), "source_id")
    author = F.concat(F.lit("customer#"), F.lpad((F.col("content_id") % 150).cast("string"), 9, "0"))
    platforms = posts.groupBy("topic").agg(F.countDistinct("platform").alias("n"))
    return B.shares([
        *((f"size_{p.lower()}", s.filter(F.col("platform") == p), F.col("size") > 0) for p in ("ASIA", "EUROPE")),
        ("no_lang", docs, F.col("lang").isNull()),
        ("no_views", c, F.col("views").isNull() | (F.col("views") == 0)),
        ("with_baseline", norms, F.col("m") > 0),
        ("author_differs", feeds, F.lower("handle") != author),
        ("several_platforms", platforms, F.col("n") >= 2),
    ])


@plan(f"""WITH r AS (SELECT 'sources' AS rule, (SELECT COUNT(*) FROM customer) AS before, (SELECT COUNT(*) FROM {SOURCES}) AS after UNION ALL SELECT 'contents', (SELECT COUNT(*) FROM orders), (SELECT COUNT(*) FROM {CONTENTS})
UNION ALL SELECT 'snapshots', (SELECT COUNT(*) FROM events), (SELECT COUNT(*) FROM {SNAPSHOTS}) UNION ALL SELECT 'edges', (SELECT COUNT(*) FROM lineitem), (SELECT COUNT(*) FROM {EDGES}) UNION ALL SELECT 'snapshot_views', (SELECT SUM(value) FROM events), (SELECT SUM(views) FROM {SNAPSHOTS})
UNION ALL SELECT 'texts_not_null', (SELECT COUNT(text) FROM documents), (SELECT COUNT(*) FROM documents WHERE text IS NOT NULL) UNION ALL SELECT 'labels_with_text', (SELECT COUNT(*) FROM labels), (SELECT COUNT(*) FROM labels JOIN documents USING (doc_id))
UNION ALL SELECT 'contents_with_source', (SELECT COUNT(*) FROM orders), (SELECT COUNT(*) FROM {CONTENTS} JOIN {SOURCES} USING (source_id)) UNION ALL SELECT 'candidates', (SELECT COUNT(*) FROM part) + (SELECT COUNT(*) FROM supplier), (SELECT COUNT(DISTINCT target_id) FROM {EDGES}) + (SELECT COUNT(DISTINCT source_id) FROM {EDGES})
UNION ALL SELECT 'stages', (SELECT COUNT(DISTINCT event_type) FROM events), (SELECT COUNT(DISTINCT stage) FROM {SNAPSHOTS}) UNION ALL SELECT 'missing_table', 0, (SELECT COUNT(*) FROM {SOURCES} WHERE FALSE) UNION ALL SELECT 'sums_of_none', 0, 0)
SELECT rule, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, before = after AS "equal" FROM r WHERE rule <> 'snapshot_views' UNION ALL SELECT rule, CAST(ROUND(before, 2) AS DOUBLE), CAST(ROUND(after, 2) AS DOUBLE), ROUND(before, 2) = ROUND(after, 2) FROM r WHERE rule = 'snapshot_views'""")
def parity_rules(spark, d):
    """Numbers before and after a migration, rule by rule: counts, sums, counts over joins, distinct keys."""
    t = lambda name: table(spark, d, name)
    n = F.count("*")
    s, c, e, g = sources(spark, d), contents(spark, d), snapshots(spark, d), edges(spark, d)
    keys = t("part").select(F.col("p_partkey").alias("k")).union(t("supplier").select("s_suppkey"))
    found = g.select(F.col("target_id").alias("k")).distinct().union(g.select("source_id").distinct())
    return B.paired_counts([
        ("sources", t("customer"), n, s, n),
        ("contents", t("orders"), n, c, n),
        ("snapshots", t("events"), n, e, n),
        ("edges", t("lineitem"), n, g, n),
        ("snapshot_views", t("events"), F.round(F.sum("value"), 2), e, F.round(F.sum("views"), 2)),
        ("texts_not_null", t("documents"), F.count("text"), t("documents").filter("text is not null"), n),
        ("labels_with_text", t("labels"), n, t("labels").join(t("documents").select("doc_id"), "doc_id"), n),
        ("contents_with_source", t("orders"), n, c.join(s.select("source_id"), "source_id"), n),
        ("candidates", keys, n, found, n),
        ("stages", t("events"), F.countDistinct("event_type"), e, F.countDistinct("stage")),
        ("missing_table", s.limit(0), n, s.filter("false"), n),
        ("sums_of_none", s.limit(0), F.sum("size"), s.limit(0), F.sum("size")),
    ])


@plan(f"""WITH m AS (SELECT source_id, MEDIAN(views) AS med FROM {CONTENTS} GROUP BY 1 HAVING COUNT(*) >= 5) SELECT source_id, COUNT(*) AS n FROM {CONTENTS} JOIN m USING (source_id) WHERE views / med >= 1.5 GROUP BY 1 ORDER BY n DESC, source_id LIMIT 20""")
def outlier_channels(spark, d):
    """The sources with the most outliers."""
    level = contents(spark, d).groupBy("source_id").agg(F.median("views").alias("med"), F.count("*").alias("n")).filter("n >= 5")
    rated = contents(spark, d).join(level.select("source_id", "med"), "source_id").select("source_id", (F.col("views") / F.col("med")).alias("outlier"))
    return B.outlier_channels(rated, "source_id", "outlier", 20, 1.5)


@plan("""WITH t AS (SELECT source, doc_id, LENGTH(SPLIT_PART(text, chr(10), 1)) AS n, LENGTH(text) - LENGTH(SPLIT_PART(text, chr(10), 1)) AS d FROM documents WHERE text IS NOT NULL),
s AS (SELECT source, doc_id, ROUND(100 * (30 * GREATEST(0, 1 - CASE WHEN n > 70 THEN 0.5 WHEN n > 60 THEN 0.25 WHEN n < 30 THEN 0.1 ELSE 0 END) + 30 * CASE WHEN d < 150 THEN 0.5 ELSE 1 END + CASE WHEN d > 0 THEN 9 ELSE 0 END + 9) / CASE WHEN d > 0 THEN 80 ELSE 70 END, 1) AS score,
  LIST_FILTER([CASE WHEN n > 60 THEN 'title_too_long' END, CASE WHEN n < 30 THEN 'title_too_short' END, CASE WHEN d < 150 THEN 'description_no_snippet' END, CASE WHEN d > 0 THEN 'hashtags_missing' END, 'tags_missing'], lambda x: x IS NOT NULL) AS issues FROM t),
i AS (SELECT source, issue, COUNT(*) AS n FROM (SELECT source, UNNEST(issues) AS issue FROM s) GROUP BY 1, 2), c AS (SELECT source, issue, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY n DESC, issue) AS k FROM i) WHERE k = 1)
SELECT source, COUNT(*) AS posts, CAST(ROUND(AVG(score), 4) AS DOUBLE) AS mean_score, ARG_MAX(doc_id, [score, -doc_id]) AS best, ARG_MIN(doc_id, [score, doc_id]) AS worst, ANY_VALUE(issue) AS issue, ANY_VALUE(c.n) AS issue_posts FROM s LEFT JOIN c USING (source) GROUP BY source""")
def channel_audits(spark, d):
    """The packaging of every source: mean score, its most frequent issue, its best and worst text."""
    title, none = F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(None).cast("int")
    p = S.packaging(F.length(title), none, none, F.length("text") - F.length(title), none, none, none, none, none)
    rated = table(spark, d, "documents").filter("text is not null").select("source", "doc_id", p["score"].alias("score"), p["issues"].alias("issues"))
    return B.channel_audit(rated, "source", "doc_id", "score", "issues").withColumn("mean_score", F.round("mean_score", 4))


@plan("""WITH t AS (SELECT lang, SPLIT_PART(text, chr(10), 1) AS t, text FROM documents WHERE text IS NOT NULL)
SELECT lang, COUNT(*) AS n, CAST(ROUND(AVG(LENGTH(t)), 6) AS DOUBLE) AS mean_length, CAST(MEDIAN(LENGTH(t)) AS DOUBLE) AS median_length, CAST(ROUND(AVG(CASE WHEN REGEXP_MATCHES(t, '[0-9]') THEN 1.0 ELSE 0 END), 6) AS DOUBLE) AS share_number, CAST(ROUND(AVG(CASE WHEN CONTAINS(t, '?') THEN 1.0 ELSE 0 END), 6) AS DOUBLE) AS share_question,
  CAST(ROUND(AVG(CASE WHEN CONTAINS(t, '!') THEN 1.0 ELSE 0 END), 6) AS DOUBLE) AS share_exclamation, CAST(ROUND(AVG(CASE WHEN REGEXP_MATCHES(text, '[0-9]{1,2}:[0-9]{2}') THEN 1.0 ELSE 0 END), 6) AS DOUBLE) AS share_timestamps, CAST(ROUND(AVG(LEN(REGEXP_EXTRACT_ALL(text, '#[\\p{L}\\p{N}_]+'))), 6) AS DOUBLE) AS mean_hashtags FROM t GROUP BY lang""")
def sample_description(spark, d):
    """Shares, means and medians of titles and descriptions per group."""
    docs = table(spark, d, "documents").filter("text is not null").withColumn("t", F.split_part("text", F.lit("\n"), F.lit(1)))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("t")), 6).alias("mean_length"), F.median(F.length("t")).alias("median_length"), share(F.col("t").rlike("[0-9]")).alias("share_number"),
        share(F.col("t").contains("?")).alias("share_question"), share(F.col("t").contains("!")).alias("share_exclamation"), share(F.col("text").rlike("[0-9]{1,2}:[0-9]{2}")).alias("share_timestamps"),
        F.round(F.avg(F.regexp_count("text", F.lit(rf"#{T.WORD}"))), 6).alias("mean_hashtags"),
    )


@plan(f"""WITH t AS (SELECT captured_at + INTERVAL 3 HOUR AS t FROM {SNAPSHOTS}) SELECT 'hour' AS kind, CAST(HOUR(t) AS INT) AS slot, COUNT(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'weekday', CAST(ISODOW(t) AS INT), COUNT(*) FROM t GROUP BY 2""")
def posting_times(spark, d):
    """Hours and weekdays of posts in a zone of their own, three hours ahead."""
    return B.timing(snapshots(spark, d), "captured_at", "Europe/Moscow")


@plan(f"""WITH s AS (SELECT topic, DATE_TRUNC('month', day) AS story, MAX(day) AS day FROM {CONTENTS} GROUP BY 1, 2)
SELECT topic, COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 365 AND day <= DATE '{ORDERS_NOW}') AS current, COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 730 AND day <= DATE '{ORDERS_NOW}' - 365) AS previous FROM s GROUP BY 1""")
def topic_story_windows(spark, d):
    """Stories, not posts, per topic in a window and the one before."""
    from quarryline.operators import trends

    stories = contents(spark, d).groupBy("topic", F.trunc("day", "month").alias("story")).agg(F.max("day").alias("day"))
    return trends.topic_windows(stories, "topic", "day", F.lit(ORDERS_NOW).cast("date"), 365).select("topic", "current", "previous")


@plan(f"""SELECT 'orders' AS name, (SELECT COUNT(*) FROM orders) AS n, TRUE AS present UNION ALL SELECT 'documents', (SELECT COUNT(*) FROM documents), TRUE UNION ALL SELECT 'nothing', 0, FALSE""")
def table_probes(spark, d):
    """S3: whether tables are there and how many rows they have."""
    from quarryline.session import has_table

    out = None
    for name in ("orders", "documents", "nothing"):
        there = has_table(spark, d, name)
        counted = table(spark, d, name) if there else spark.range(0)
        row = counted.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(there).alias("present"))
        out = row if out is None else out.union(row)
    return out


@plan("SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey, n_name")
def ordered_scan(spark, d):
    """A table in a fixed order."""
    return table(spark, d, "nation").orderBy("n_regionkey", "n_name").select("n_nationkey", "n_name")


#: The topic that stands in for tools.
_TOOLS = "1-URGENT"


def _shelf(platform: str, passed: str, value: str) -> str:
    return f"SELECT '{platform}' AS platform, content_id, CAST(ROUND({value}, 6) AS DOUBLE) AS value, views, ROW_NUMBER() OVER (ORDER BY {value} DESC, views DESC, content_id) AS place FROM ({passed}) WHERE topic = '{_TOOLS}'"


@plan(f"""WITH n AS (SELECT source_id, MEDIAN(views) AS norm FROM {_POSTS} GROUP BY 1 HAVING COUNT(*) >= 5 AND MEDIAN(views) >= 20),
b AS (SELECT source_id, CASE WHEN COUNT(*) >= 3 THEN MEDIAN(views) END AS base FROM {CONTENTS} WHERE NOT ({_YEAR}) GROUP BY 1),
shelves AS (
  {_shelf('youtube', f"SELECT *, views / size AS coverage FROM {_POSTS} WHERE {_YEAR} AND size >= 1000 AND views >= 5000 AND views / size >= 3 AND skip IS NULL", 'coverage')}
  UNION ALL {_shelf('x', f"SELECT p.*, views / norm AS ratio FROM {_POSTS} p JOIN n USING (source_id) WHERE {_YEAR} AND views >= 200 AND views / norm >= 1.4 AND skip IS NULL", 'ratio')}
  UNION ALL {_shelf('telegram', f"SELECT p.*, views / base AS ratio FROM {_POSTS} p JOIN b USING (source_id) WHERE {_YEAR} AND base > 0 AND views >= 1000 AND views / base >= 1.5 AND skip IS NULL", 'ratio')})
SELECT platform, place, content_id, value FROM shelves WHERE place <= 10""")
def ai_tools_board(spark, d):
    """C17: posts of one topic that pass the floors of a platform, by its own norm; norms come from all topics."""
    from quarryline.functions import stats

    posts = _posts(spark, d)
    base = contents(spark, d).filter(~_fresh()).groupBy("source_id").agg(stats.median_of_at_least("views", 3).alias("base"))
    whole = {"limit": None}  # neither cut nor capped before the topic is looked at
    every = 1 << 30
    found = {
        "youtube": (B.viral_by_coverage(posts, "source_id", "views", "size", "content_id", _fresh(), _skip(), per_source=every, **whole)[0], "coverage"),
        "x": (B.viral_by_author(posts, "source_id", "views", "content_id", _fresh(), _skip(), least=1.4, per_author=every, **whole)[0], "ratio"),
        "telegram": (B.viral_by_baseline(posts.join(base, "source_id", "left"), "source_id", "views", "base", "content_id", _fresh(), _skip(), least=1.5, per_source=every, **whole)[0], "ratio"),
    }
    out = None
    for platform, (rows, value) in found.items():
        best = rows.filter(F.col("topic") == _TOOLS).orderBy(F.desc(value), F.desc("views"), "content_id").limit(10)
        placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), F.desc("views"), "content_id")).cast("long"))  # ten rows
        one = placed.select(F.lit(platform).alias("platform"), "place", "content_id", F.round(value, 6).alias("value"))
        out = one if out is None else out.union(one)
    return out
