"""Aggregates: counts, distinct counts, exact medians and quantiles, rollups, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import stats
from quarryline.operators import graph, quality, trends
from quarryline.operators.quantiles import p95_exclusive as p95
from quarryline.operators.selection import medians
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EDGES, EVENTS_NOW, ORDERS_NOW, SNAPSHOTS, SOURCES, contents, edges, snapshots, sources
from quarryline.session import table


@plan(f"SELECT topic, status, COUNT(*) AS n, MIN(views) AS low, MAX(views) AS high, CAST(ROUND(SUM(views), 2) AS DOUBLE) AS total FROM {CONTENTS} GROUP BY topic, status")
def grouped_totals(spark, d):
    """A1."""
    return contents(spark, d).groupBy("topic", "status").agg(F.count("*").alias("n"), F.min("views").alias("low"), F.max("views").alias("high"), F.round(F.sum("views"), 2).alias("total"))


@plan(f"SELECT target_id, COUNT(DISTINCT source_id) AS sources, COUNT(DISTINCT CASE WHEN kind = 'A' THEN 'a' || content_id ELSE 's' || source_id END) AS keys FROM {EDGES} GROUP BY target_id")
def distinct_counts(spark, d):
    """A2: distinct values and distinct values of a conditional key."""
    key = F.when(F.col("kind") == "A", F.concat(F.lit("a"), "content_id")).otherwise(F.concat(F.lit("s"), "source_id"))
    return edges(spark, d).groupBy("target_id").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct(key).alias("keys"))


@plan(f"SELECT content_id, CAST(MEDIAN(views) AS DOUBLE) AS median, CAST(CASE WHEN COUNT(views) >= 65 THEN MEDIAN(views) END AS DOUBLE) AS sure FROM {SNAPSHOTS} GROUP BY content_id")
def exact_medians(spark, d):
    """A3, A4: medians, and medians of groups that are large enough."""
    return snapshots(spark, d).groupBy("content_id").agg(F.median("views").alias("median"), stats.median_of_at_least("views", 65).alias("sure"))


@plan(f"""WITH m AS (SELECT stage, COUNT(views) AS n, MEDIAN(views) AS med FROM {SNAPSHOTS} GROUP BY stage)
SELECT m.stage, m.n, CAST(ANY_VALUE(m.med) AS DOUBLE) AS med, CAST(ROUND(1.4826 * MEDIAN(ABS(s.views - m.med)), 6) AS DOUBLE) AS sigma FROM {SNAPSHOTS} s JOIN m USING (stage) GROUP BY m.stage, m.n""")
def mad_sigma(spark, d):
    """A5."""
    return stats.mad_sigma(snapshots(spark, d), ["stage"], "views").withColumn("sigma", F.round("sigma", 6))


@plan(f"""WITH r AS (SELECT stage, views, ROW_NUMBER() OVER (PARTITION BY stage ORDER BY views) AS k, COUNT(*) OVER (PARTITION BY stage) AS n FROM {SNAPSHOTS}), h AS (SELECT *, 0.95 * (n + 1) AS h FROM r)
SELECT stage, CAST(ROUND(MAX(CASE WHEN k = FLOOR(h) THEN views END) + (MAX(h) - FLOOR(MAX(h))) * (MAX(CASE WHEN k = FLOOR(h) + 1 THEN views END) - MAX(CASE WHEN k = FLOOR(h) THEN views END)), 6) AS DOUBLE) AS p95 FROM h GROUP BY stage""")
def p95_exclusive(spark, d):
    """From counts of distinct values."""
    return p95(snapshots(spark, d), ["stage"], "views").withColumn("p95", F.round("p95", 6))


@plan(f"SELECT stage, CAST(ROUND(QUANTILE_CONT(views, 0.9), 6) AS DOUBLE) AS p90 FROM {SNAPSHOTS} GROUP BY stage")
def percentile_inclusive(spark, d):
    """A7."""
    return snapshots(spark, d).groupBy("stage").agg(F.round(F.percentile("views", 0.9), 6).alias("p90"))


@plan(f"SELECT source_id, COUNT(*) FILTER (status = 'F') AS done, CAST(SUM(CASE WHEN views > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM {CONTENTS} GROUP BY source_id HAVING COUNT(*) >= 12")
def conditional_counts(spark, d):
    """A8, A9."""
    found = contents(spark, d).groupBy("source_id").agg(F.count_if(F.col("status") == "F").alias("done"), F.count_if(F.col("views") > 200000).alias("large"), F.count("*").alias("n"))
    return found.filter("n >= 12").drop("n")


@plan(f"SELECT source_id, topic, n FROM (SELECT source_id, topic, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY COUNT(*) DESC, topic) AS k FROM {CONTENTS} GROUP BY source_id, topic) WHERE k = 1")
def majority_topic(spark, d):
    """The most frequent topic of each source."""
    return stats.most_frequent(contents(spark, d), ["source_id"], "topic")


@plan(f"SELECT LOWER(country) AS country, MIN(platform) AS platform, COUNT(*) AS n FROM {SOURCES} GROUP BY LOWER(country)")
def grouped_by_lower(spark, d):
    """A column that is not grouped gets a fixed aggregate."""
    return sources(spark, d).groupBy(F.lower("country").alias("country")).agg(F.min("platform").alias("platform"), F.count("*").alias("n"))


@plan(f"""WITH e AS (SELECT *, CAST(captured_at AS DATE) AS day FROM {SNAPSHOTS}), b AS (SELECT day, stage, COUNT(*) AS n, ROUND(AVG(CASE WHEN views > 5 THEN 0.0 ELSE 1.0 END), 6) AS fail_rate, ROUND(1 - COUNT(DISTINCT props) / COUNT(props), 6) AS dup_rate, 1.0 AS valid_date_ratio, CAST(MEDIAN(views) AS DOUBLE) AS likes_median FROM e GROUP BY day, stage),
r AS (SELECT day, stage, views, ROW_NUMBER() OVER (PARTITION BY day, stage ORDER BY views) AS k, COUNT(*) OVER (PARTITION BY day, stage) AS n FROM e), h AS (SELECT *, 0.95 * (n + 1) AS h FROM r),
q AS (SELECT day, stage, CASE WHEN MAX(n) < 20 THEN MAX(views) ELSE MAX(CASE WHEN k = LEAST(FLOOR(h), n) THEN views END) + (MAX(h) - FLOOR(MAX(h))) * (MAX(CASE WHEN k = LEAST(FLOOR(h) + 1, n) THEN views END) - MAX(CASE WHEN k = LEAST(FLOOR(h), n) THEN views END)) END AS p FROM h GROUP BY day, stage)
SELECT CAST(b.day AS VARCHAR) AS day, b.stage, b.n, CAST(b.fail_rate AS DOUBLE) AS fail_rate, CAST(b.dup_rate AS DOUBLE) AS dup_rate, CAST(valid_date_ratio AS DOUBLE) AS valid_date_ratio, likes_median, CAST(ROUND(q.p, 6) AS DOUBLE) AS latency_p95 FROM b JOIN q ON b.day = q.day AND b.stage = q.stage""")
def daily_panel(spark, d):
    """Several aggregates of one day and stage."""
    rows = snapshots(spark, d).withColumns({"day": F.to_date("captured_at").cast("string"), "ok": F.col("views") > 5})
    panel = quality.daily_panel(rows, "day", "stage", "ok", "props", "views", "views", "captured_at")
    return panel.withColumns({c: F.round(c, 6) for c in ("fail_rate", "dup_rate", "valid_date_ratio", "latency_p95")})


@plan(f"""WITH g AS (SELECT *, (EPOCH_US(captured_at) - LAG(EPOCH_US(captured_at)) OVER (PARTITION BY content_id ORDER BY captured_at)) / 3.6e9 AS gap FROM {SNAPSHOTS})
SELECT content_id, COUNT(*) AS n, CAST(ROUND(COUNT(*) / GREATEST((MAX(EPOCH_US(captured_at)) - MIN(EPOCH_US(captured_at))) / 8.64e10, 1.0), 6) AS DOUBLE) AS posts_per_day, CAST(ROUND(CASE WHEN COUNT(*) >= 10 AND AVG(gap) > 0 THEN STDDEV_POP(gap) / AVG(gap) END, 6) AS DOUBLE) AS cv_interval,
ROUND(AVG(CASE WHEN stage = 'click' THEN 1.0 ELSE 0.0 END), 6) AS link_ratio, ROUND(AVG(CASE WHEN stage = 'view' THEN 1.0 ELSE 0.0 END), 6) AS rt_ratio, ROUND(1 - COUNT(DISTINCT props) / COUNT(props), 6) AS dup_ratio FROM g GROUP BY content_id""")
def posting_features(spark, d):
    """A13."""
    return _features(spark, d).withColumns({c: F.round(c, 6) for c in ("posts_per_day", "cv_interval", "link_ratio", "rt_ratio", "dup_ratio")})


def _features(spark, d):
    rows = snapshots(spark, d).withColumns({"link": F.col("stage") == "click", "again": F.col("stage") == "view"})
    return quality.posting_features(rows, "content_id", "captured_at", "link", "again", "props")


@plan(f"""WITH g AS (SELECT *, (EPOCH_US(captured_at) - LAG(EPOCH_US(captured_at)) OVER (PARTITION BY content_id ORDER BY captured_at)) / 3.6e9 AS gap FROM {SNAPSHOTS}),
f AS (SELECT content_id, COUNT(*) AS n, COUNT(*) / GREATEST((MAX(EPOCH_US(captured_at)) - MIN(EPOCH_US(captured_at))) / 8.64e10, 1.0) AS ppd, CASE WHEN COUNT(*) >= 10 AND AVG(gap) > 0 THEN STDDEV_POP(gap) / AVG(gap) END AS cv,
AVG(CASE WHEN stage = 'click' THEN 1.0 ELSE 0.0 END) AS lr, AVG(CASE WHEN stage = 'view' THEN 1.0 ELSE 0.0 END) AS rr, 1 - COUNT(DISTINCT props) / COUNT(props) AS dr, COUNT(DISTINCT stage) AS m FROM g GROUP BY content_id)
SELECT content_id, CASE WHEN n < 15 THEN 'items_lt_15' WHEN m < 2 THEN 'cooccurrence_lt_2' WHEN ppd NOT BETWEEN 0.2 AND 20 THEN 'posts_per_day_out_of_range' WHEN cv < 0.15 THEN 'cv_too_low' WHEN lr > 0.7 THEN 'link_ratio_too_high' WHEN dr > 0.3 THEN 'dup_ratio_too_high' WHEN rr > 0.8 THEN 'rt_ratio_too_high' END AS reason FROM f""")
def entry_check(spark, d):
    """The first failing check of a candidate."""
    named = snapshots(spark, d).groupBy("content_id").agg(F.countDistinct("stage").alias("m"))
    return quality.entry_check(_features(spark, d).join(named, "content_id"), "m").select("content_id", "reason")


@plan(f"""SELECT source_id, COUNT(*) AS n, CAST(CASE WHEN COUNT(views) >= 3 THEN MEDIAN(views) END AS DOUBLE) AS median_views, CAST(CASE WHEN COUNT(content_id) >= 3 THEN MEDIAN(content_id) END AS DOUBLE) AS median_reactions,
CAST(ROUND(CASE WHEN COUNT(*) >= 3 THEN MEDIAN(content_id / views) END, 9) AS DOUBLE) AS median_er, CAST(ROUND(1 - COUNT(DISTINCT topic) / COUNT(topic), 6) AS DOUBLE) AS dup_ratio FROM {CONTENTS} GROUP BY source_id""")
def baselines(spark, d):
    """A14."""
    found = quality.baselines(contents(spark, d), "source_id", "views", "content_id", "topic")
    return found.withColumns({"median_er": F.round("median_er", 9), "dup_ratio": F.round("dup_ratio", 6)})


@plan(f"SELECT CAST(ROUND(MEDIAN(content_id / views), 9) AS DOUBLE) AS median_er FROM {CONTENTS} WHERE views > 0")
def global_median(spark, d):
    """One row, broadcast where it is used."""
    rates = contents(spark, d).filter("views > 0").select((F.col("content_id") / F.col("views")).alias("er"))
    return medians(rates, [], "er").select(F.round("med", 9).alias("median_er"))


@plan("SELECT MD5(text) AS text_hash, COUNT(*) AS copies, COUNT(DISTINCT source) AS channels FROM documents GROUP BY MD5(text) HAVING COUNT(*) > 1")
def copies_of_text(spark, d):
    """Copies and channels of equal texts; only hashes are shuffled."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("text_hash"), "source")
    return rows.groupBy("text_hash").agg(F.count("*").alias("copies"), F.countDistinct("source").alias("channels")).filter("copies > 1")


@plan("""SELECT conv_id, COUNT(*) AS comments, COUNT(DISTINCT role) AS authors, CAST(SUM(CASE WHEN CONTAINS(text, '?') THEN 1 ELSE 0 END) AS BIGINT) AS questions, ROUND(AVG(CASE WHEN CONTAINS(text, '?') THEN 1.0 ELSE 0.0 END), 6) AS share, MAX(turn) AS last FROM conversations GROUP BY conv_id""")
def discussions(spark, d):
    """A17."""
    asks = F.col("text").contains("?")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("comments"), F.countDistinct("role").alias("authors"), F.count_if(asks).alias("questions"), F.round(F.avg(F.coalesce(asks, F.lit(False)).cast("double")), 6).alias("share"), F.max("turn").alias("last"))


@plan("SELECT SPLIT_PART(c_name, '#', 1) AS prefix, c_mktsegment AS tier, COUNT(*) AS n, CAST(ROUND(SUM(c_acctbal), 2) AS DOUBLE) AS total FROM customer GROUP BY 1, 2")
def totals_by_prefix(spark, d):
    """A18."""
    return table(spark, d, "customer").groupBy(F.split_part("c_name", F.lit("#"), F.lit(1)).alias("prefix"), F.col("c_mktsegment").alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@plan(f"SELECT topic, status, COUNT(*) AS calls, CAST(ROUND(SUM(views), 2) AS DOUBLE) AS cost FROM {CONTENTS} GROUP BY ROLLUP (topic, status)")
def usage_rollup(spark, d):
    """Usage by two keys with both kinds of totals in one pass."""
    return contents(spark, d).rollup("topic", "status").agg(F.count("*").alias("calls"), F.round(F.sum("views"), 2).alias("cost"))


@plan(f"SELECT topic, COUNT(*) AS planned, COUNT(*) FILTER (status IN ('F', 'P')) AS done, CAST(ROUND(COUNT(*) FILTER (status IN ('F', 'P')) / COUNT(*), 6) AS DOUBLE) AS coverage FROM {CONTENTS} GROUP BY topic")
def coverage(spark, d):
    """A20."""
    rows = contents(spark, d).withColumn("status", F.when(F.col("status") == "F", "measured").when(F.col("status") == "P", "measured_late").otherwise("pending"))
    return quality.coverage(rows, "topic").withColumn("coverage", F.round("coverage", 6))


@plan(f"SELECT source_id, COUNT(*) AS n, CAST(AVG(CASE WHEN topic = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS promo_share FROM {CONTENTS} GROUP BY source_id HAVING COUNT(*) >= 5 AND AVG(CASE WHEN topic = '1-URGENT' THEN 1.0 ELSE 0.0 END) >= 0.5")
def promo_heavy(spark, d):
    """A21."""
    return quality.promo_heavy(contents(spark, d).withColumn("paid", F.col("topic") == "1-URGENT"), "source_id", "paid")


@plan(f"""WITH t AS (SELECT source_id FROM (SELECT s_suppkey AS source_id, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k, COUNT(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE k <= GREATEST(1, FLOOR(n * 0.10)))
SELECT target_id, COUNT(DISTINCT source_id) AS in_degree FROM {EDGES} WHERE source_id IN (SELECT source_id FROM t) GROUP BY target_id""")
def trusted_in_degree(spark, d):
    """A22, W12."""
    sized = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("platform"), F.col("s_acctbal").alias("size"))
    return graph.trusted_in_degree(edges(spark, d), sized, "source_id", "target_id", "platform", "size")


@plan(f"""WITH s AS (SELECT target_id, source_id, COUNT(*) AS n FROM {EDGES} GROUP BY 1, 2), a AS (SELECT target_id, CAST(SUM(n) AS BIGINT) AS n_edges, COUNT(*) AS n_sources, MAX(n) AS most FROM s GROUP BY 1),
k AS (SELECT target_id, kind, SUM(weight) AS w, MAX(weight) AS mw FROM {EDGES} GROUP BY 1, 2), b AS (SELECT target_id, MAX(mw) AS max_weight FROM k GROUP BY 1), m AS (SELECT target_id, kind AS main_kind FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY w DESC, kind) AS r FROM k) WHERE r = 1)
SELECT a.target_id, n_edges, n_sources, max_weight, main_kind, most >= 0.9 * n_edges AS from_one, n_sources >= 2 AND NOT most >= 0.9 * n_edges AS eligible, n_sources * max_weight AS priority FROM a JOIN b USING (target_id) JOIN m USING (target_id)""")
def edge_groups(spark, d):
    """A23."""
    return graph.consume(edges(spark, d), "source_id", "target_id", "kind", "weight")


@plan(f"""SELECT topic, COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 180 AND day <= DATE '{ORDERS_NOW}') AS current, COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 360 AND day <= DATE '{ORDERS_NOW}' - 180) AS previous,
CAST(ROUND((COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 180 AND day <= DATE '{ORDERS_NOW}') - COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 360 AND day <= DATE '{ORDERS_NOW}' - 180)) / NULLIF(COUNT(*) FILTER (day > DATE '{ORDERS_NOW}' - 360 AND day <= DATE '{ORDERS_NOW}' - 180), 0), 6) AS DOUBLE) AS accel FROM {CONTENTS} GROUP BY topic""")
def topic_windows(spark, d):
    """A24, D8, R13."""
    return trends.topic_windows(contents(spark, d), "topic", "day", F.to_date(F.lit(ORDERS_NOW)), 180).withColumn("accel", F.round("accel", 6))


@plan(f"""WITH k AS (SELECT DISTINCT topic FROM {CONTENTS}), g AS (SELECT topic, CAST(UNNEST(RANGE(DATE '2001-07-01', DATE '2001-08-02', INTERVAL 1 DAY)) AS DATE) AS day FROM k)
SELECT g.topic, CAST(g.day AS VARCHAR) AS day, COUNT(c.content_id) AS n FROM g LEFT JOIN {CONTENTS} c ON c.topic = g.topic AND c.day = g.day GROUP BY 1, 2""")
def daily_counts(spark, d):
    """A25."""
    rows = trends.daily_counts(contents(spark, d), ["topic"], "day", F.to_date(F.lit("2001-07-01")), F.to_date(F.lit("2001-08-01")))
    return rows.withColumn("day", F.col("day").cast("string"))


@plan(f"""SELECT tier, COUNT(*) AS n, CAST(ROUND(AVG(LENGTH(country)), 6) AS DOUBLE) AS mean_length, CAST(MEDIAN(size) AS DOUBLE) AS median_size, ROUND(AVG(CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM {SOURCES} GROUP BY tier""")
def group_description(spark, d):
    """Shares, means and medians per group."""
    return sources(spark, d).groupBy("tier").agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("country")), 6).alias("mean_length"), F.median("size").alias("median_size"), F.round(F.avg((F.col("size") > 0).cast("double")), 6).alias("share"))


@plan(f"""WITH w AS (SELECT doc_id, UNNEST(LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{{L}}\\p{{N}}_]+'))) AS word, lang = 'en' AS g FROM documents), t AS (SELECT COUNT(*) FILTER (lang = 'en') AS a, COUNT(*) FILTER (lang <> 'en') AS b FROM documents),
c AS (SELECT word, COUNT(*) FILTER (g) AS i, COUNT(*) FILTER (NOT g) AS o FROM w GROUP BY word HAVING COUNT(*) >= 20)
SELECT word, i AS in_group, o AS outside, CAST(ROUND(CASE WHEN SQRT((i + o) / (a + b) * (1 - (i + o) / (a + b)) * (1 / a + 1 / b)) > 0 THEN (i / a - o / b) / SQRT((i + o) / (a + b) * (1 - (i + o) / (a + b)) * (1 / a + 1 / b)) ELSE 0 END, 6) AS DOUBLE) AS z FROM c, t""")
def telling_words(spark, d):
    """Words that tell a group from the others."""
    from quarryline.functions import text as T

    docs = table(spark, d, "documents").select(T.words("text").alias("w"), (F.col("lang") == "en").alias("g"))
    return trends.presence_z(docs, "w", "g", 20).withColumn("z", F.round("z", 6))


@plan(f"""SELECT target_id, COUNT(*) AS mentions, COUNT(DISTINCT content_id) AS posts, CAST(MIN(day) AS VARCHAR) AS first_seen, CAST(MAX(day) AS VARCHAR) AS last_seen, MIN(content_id) AS example FROM {EDGES} GROUP BY target_id""")
def candidate_mentions(spark, d):
    """Mentions of a candidate, with first and last time and an example."""
    return edges(spark, d).groupBy("target_id").agg(
        F.count("*").alias("mentions"), F.countDistinct("content_id").alias("posts"), F.min("day").cast("string").alias("first_seen"), F.max("day").cast("string").alias("last_seen"), F.min("content_id").alias("example"))


@plan("""WITH w AS (SELECT doc_id, REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), p AS (SELECT doc_id, w, LIST_TRANSFORM(RANGE(1, LEN(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w), e AS (SELECT UNNEST(LIST_DISTINCT(LIST_CONCAT(w, b))) AS phrase FROM p)
SELECT phrase, COUNT(*) AS posts FROM e GROUP BY phrase HAVING COUNT(*) >= 3 ORDER BY posts DESC, phrase LIMIT 500""")
def frequent_phrases(spark, d):
    """Words and word pairs by the number of texts; the 500 most frequent are the report."""
    from quarryline.functions import text as T

    docs = table(spark, d, "documents").select("doc_id", T.words("text").alias("w"))
    return trends.phrases(docs, "doc_id", "w", 3, 500)


@plan(f"SELECT s.source_id, COALESCE(n, 0) AS found FROM {SOURCES} s LEFT JOIN (SELECT source_id, COUNT(*) AS n FROM {CONTENTS} WHERE topic = '5-LOW' GROUP BY source_id) USING (source_id)")
def phrase_yield(spark, d):
    """A correlated count as a join with grouped counts."""
    counted = contents(spark, d).filter("topic = '5-LOW'").groupBy("source_id").agg(F.count("*").alias("n"))
    return sources(spark, d).join(counted, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("found"))


@plan(f"SELECT DISTINCT source_id, topic FROM {CONTENTS}")
def distinct_rows(spark, d):
    """A32."""
    return contents(spark, d).select("source_id", "topic").distinct()


@plan(f"""SELECT COUNT(*) FILTER (views > 0) AS measured, COUNT(*) FILTER (EPOCH(captured_at) >= EPOCH(TIMESTAMP '{EVENTS_NOW}') - 86400) AS last_day, COUNT(*) FILTER (EPOCH(captured_at) >= EPOCH(TIMESTAMP '{EVENTS_NOW}') - 3600) AS last_hour, COUNT(*) FILTER (EPOCH(captured_at) >= EPOCH(TIMESTAMP '{EVENTS_NOW}') - 604800) AS last_week FROM {SNAPSHOTS}""")
def budget_windows(spark, d):
    """Rows in several windows back from the present, in one pass."""
    age = F.unix_timestamp(F.lit(EVENTS_NOW).cast("timestamp")) - F.unix_micros(F.col("captured_at").cast("timestamp")) / 1e6
    return snapshots(spark, d).agg(
        F.count_if(F.expr("views > 0")).alias("measured"), F.count_if(age <= 86400).alias("last_day"), F.count_if(age <= 3600).alias("last_hour"), F.count_if(age <= 604800).alias("last_week"))
