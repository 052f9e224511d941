"""Scoring formulas over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import scores as S
from quarryline.functions import text as T
from quarryline.operators.selection import medians
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, ORDERS_NOW, SOURCES, contents, sources
from quarryline.session import table


@plan(f"""WITH e AS (SELECT content_id, topic, CASE WHEN views > 0 THEN content_id / views END AS er FROM {CONTENTS}), m AS (SELECT topic, MEDIAN(er) AS med FROM e GROUP BY topic), g AS (SELECT MEDIAN(er) AS med FROM e)
SELECT content_id, CAST(ROUND(er, 9) AS DOUBLE) AS er, CAST(ROUND(CASE WHEN er / m.med > 0 AND er / g.med > 0 THEN SQRT(er / m.med * (er / g.med)) ELSE er / m.med END, 6) AS DOUBLE) AS eng FROM e JOIN m USING (topic), g""")
def engagement(spark, d):
    """M1: rate, and its ratio to two medians as one."""
    rows = contents(spark, d).withColumn("er", S.engagement_rate(F.col("views"), F.col("content_id")))
    by_topic = medians(rows, ["topic"], "er", "m").drop("n")
    overall = medians(rows, [], "er", "g").drop("n")
    joined = rows.join(by_topic, "topic").crossJoin(F.broadcast(overall))  # one row
    return joined.select("content_id", F.round("er", 9).alias("er"), F.round(S.combined_engagement(F.col("er") / F.col("m"), F.col("er") / F.col("g")), 6).alias("eng"))


_AGE = f"DATE_DIFF('day', day, DATE '{ORDERS_NOW}')"


@plan(f"""WITH c AS (SELECT *, 1 + content_id % 3 AS copies, content_id % 4 AS reposts, {_AGE} AS age FROM {CONTENTS}) SELECT content_id, CAST(ROUND((1 + (content_id % 10) / 10) * (1 / (1 + reposts)) * copies * (views / 1000) * (1 - (1 - 1 / copies)) * 1.0 * POW(0.5, age / 365.0), 6) AS DOUBLE) AS significance FROM c""")
def channel_significance(spark, d):
    """M2, M16."""
    c, age = F.col("content_id"), F.datediff(F.to_date(F.lit(ORDERS_NOW)), "day")
    value = S.channel_significance(1 + (c % 10) / 10, c % 4, 1 + c % 3, F.col("views") / 1000, F.lit(None).cast("double"), age, 365.0)
    return contents(spark, d).select("content_id", F.round(value, 6).alias("significance"))


@plan(f"""WITH c AS (SELECT content_id, content_id % 100 AS likes, content_id % 7 AS replies, GREATEST(0, content_id % 5 - 1, content_id % 3) AS spread, CAST({_AGE} AS DOUBLE) AS h, content_id % 2 = 0 AS missing FROM {CONTENTS})
SELECT content_id, CAST(ROUND(CASE WHEN missing THEN POW(spread, 0.8) / POW(h + 2, 1.8) ELSE (LN(1 + (likes + 2 * replies) / 6.0) + 0.8 * LN(1 + spread)) / POW(1 + h / 24, 1.8) END, 6) AS DOUBLE) AS significance FROM c""")
def post_significance(spark, d):
    """M3: both branches."""
    c = F.col("content_id")
    value = S.post_significance(c % 100, c % 7, c % 5, c % 3, F.datediff(F.to_date(F.lit(ORDERS_NOW)), "day").cast("double"), c % 2 == 0)
    return contents(spark, d).select("content_id", F.round(value, 6).alias("significance"))


@plan(f"""SELECT content_id, CAST(ROUND(0.45 * LOG10(1 + 10 * (content_id % 50) / 6.0 + 2 * (content_id % 7)) + 0.35 * (content_id % 4) + 0.2 * (1 / (1 + (content_id % 120) / 60.0)), 6) AS DOUBLE) AS score FROM {CONTENTS}""")
def legacy_post_score(spark, d):
    """M4, C20."""
    c = F.col("content_id")
    return contents(spark, d).select("content_id", F.round(S.legacy_post_score((c % 50) / 6.0, c % 7, c % 4, c % 120), 6).alias("score"))


@plan(f"""WITH c AS (SELECT content_id, source_id, views, CAST(content_id % 90 AS DOUBLE) AS likes, CASE WHEN content_id % 3 = 0 THEN NULL ELSE CAST(content_id % 11 AS DOUBLE) END AS comments, {_AGE} AS age FROM {CONTENTS}),
m AS (SELECT source_id, CASE WHEN COUNT(views) >= 3 THEN MEDIAN(views) END AS mv, CASE WHEN COUNT(likes) >= 3 THEN MEDIAN(likes) END AS ml, CASE WHEN COUNT(comments) >= 3 THEN MEDIAN(comments) END AS mc FROM c GROUP BY 1),
r AS (SELECT content_id, age, CASE WHEN views > 0 AND mv > 0 THEN views / mv END AS v, CASE WHEN likes > 0 AND ml > 0 THEN LEAST(likes / ml, 20.0) END AS l, CASE WHEN comments > 0 AND mc > 0 THEN LEAST(comments / mc, 20.0) END AS k FROM c JOIN m USING (source_id)),
n AS (SELECT *, CAST(v IS NOT NULL AS INT) + CAST(l IS NOT NULL AS INT) + CAST(k IS NOT NULL AS INT) AS n FROM r)
SELECT content_id, CAST(ROUND(CASE WHEN n >= 2 THEN EXP((COALESCE(LN(v), 0) + COALESCE(LN(l), 0) + COALESCE(LN(k), 0)) / n) * POW(0.5, age / 7.0) END * 1e6, 4) AS DOUBLE) AS viral FROM n WHERE age < 60""")
def viral_index(spark, d):
    """Geometric mean of the axes that are known, fading with age."""
    from quarryline.functions.stats import median_of_at_least

    c = F.col("content_id")
    rows = contents(spark, d).withColumns({"likes": (c % 90).cast("double"), "comments": F.when(c % 3 != 0, (c % 11).cast("double")), "age": F.datediff(F.to_date(F.lit(ORDERS_NOW)), "day")})
    medians = rows.groupBy("source_id").agg(*(median_of_at_least(a, 3).alias(f"m_{a}") for a in ("views", "likes", "comments")))
    joined = rows.filter("age < 60").join(medians, "source_id")
    index = S.viral_index({a: (F.col(a), F.col(f"m_{a}")) for a in ("views", "likes", "comments")}, F.col("age"))
    return joined.select("content_id", F.round(index * 1e6, 4).alias("viral"))


@plan(f"""WITH z AS (SELECT source_id, size / 1000 AS a, CASE WHEN source_id % 3 = 0 THEN NULL ELSE source_id / 100 END AS b, CASE WHEN source_id % 5 = 0 THEN NULL ELSE 1.5 END AS c FROM {SOURCES})
SELECT source_id, CAST(ROUND((COALESCE(0.45 * a, 0) + COALESCE(0.25 * b, 0) + COALESCE(0.2 * c, 0)) / (0.45 + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6) AS DOUBLE) AS breakout FROM z""")
def breakout(spark, d):
    """M8: weights renormalised over the axes that are present."""
    i = F.col("source_id")
    z = {"g7": F.col("size") / 1000, "median_metric_24h": F.when(i % 3 != 0, i / 100), "trusted_indegree_30d": F.when(i % 5 != 0, F.lit(1.5)), "new_entity_rate": F.lit(None).cast("double")}
    return sources(spark, d).select("source_id", F.round(S.weighted_present(z), 6).alias("breakout"))


@plan(f"""SELECT content_id, CAST(ROUND(CASE topic WHEN '1-URGENT' THEN 2.0 ELSE 1.0 END * (1 + 0.5 * LEAST(1, views / 500000)) * (1 + 0.5 * LEAST(1, (content_id % 9) / 5.0)), 6) AS DOUBLE) AS weight FROM {CONTENTS}""")
def edge_weights(spark, d):
    """M9."""
    base = F.when(F.col("topic") == "1-URGENT", 2.0).otherwise(1.0)
    return contents(spark, d).select("content_id", F.round(S.edge_weight(base, F.col("views") / 500000, F.col("content_id") % 9 + 1), 6).alias("weight"))


@plan(f"""SELECT source_id, CAST(ROUND(CASE WHEN COUNT(*) >= 3 AND ANY_VALUE(size) > 0 THEN 100 * MEDIAN(views) / ANY_VALUE(size) END, 6) AS DOUBLE) AS rate, CAST(ROUND(CASE WHEN SUM(views) > 0 THEN 1000 * COUNT(*) / SUM(views) END, 9) AS DOUBLE) AS per_thousand FROM {CONTENTS} JOIN {SOURCES} USING (source_id) GROUP BY source_id""")
def virality_rate(spark, d):
    """M11, M13."""
    grouped = contents(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.median("views").alias("m"), F.sum("views").alias("v"))
    joined = grouped.join(sources(spark, d).select("source_id", "size"), "source_id")
    rate = F.when((F.col("n") >= 3) & (F.col("size") > 0), 100 * F.col("m") / F.col("size"))
    return joined.select("source_id", F.round(rate, 6).alias("rate"), F.round(S.per_thousand(F.col("n"), F.col("v")), 9).alias("per_thousand"))


@plan("""WITH t AS (SELECT doc_id, SPLIT_PART(text, chr(10), 1) AS t, LENGTH(text) - LENGTH(SPLIT_PART(text, chr(10), 1)) AS d FROM documents),
f AS (SELECT doc_id, LENGTH(t) AS n, d, LEN(REGEXP_EXTRACT_ALL(t, '\\p{L}')) AS letters, LEN(REGEXP_EXTRACT_ALL(t, '\\p{Lu}')) AS upper_ FROM t),
p AS (SELECT *, GREATEST(0, 1 - CASE WHEN n > 70 THEN 0.5 WHEN n > 60 THEN 0.25 WHEN n < 30 THEN 0.1 ELSE 0 END - CASE WHEN letters > 0 AND upper_ / letters > 0.5 THEN 0.25 ELSE 0 END) AS title,
  CASE WHEN d < 150 THEN 0.5 ELSE 1 END AS snippet, d > 0 AS hashed FROM f)
SELECT doc_id, CAST(ROUND(100 * (30 * title + 30 * snippet + CASE WHEN hashed THEN 9 ELSE 0 END + 9) / CASE WHEN hashed THEN 80 ELSE 70 END, 1) AS DOUBLE) AS score FROM p WHERE d IS NOT NULL""")
def packaging_scores(spark, d):
    """M12 over documents: the first line is the title, the rest the description; no tags, hashtags, duration or topic. ``packaging_cases`` has every rule."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    none = F.lit(None).cast("int")
    scored = S.packaging(F.length(title), T.caps_ratio(title), F.lit(0), F.length("text") - F.length(title), none, none, none, none, none)
    return table(spark, d, "documents").filter("text is not null").select("doc_id", scored["score"].alias("score"))


@plan(f"""WITH c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY day, content_id) AS k FROM {CONTENTS}), p AS (SELECT source_id, MAX(views) FILTER (k = 1) AS m1, MAX(views) FILTER (k = 2) AS m6, MAX(views) FILTER (k = 3) AS m24 FROM c GROUP BY 1)
SELECT source_id, CAST(ROUND((m24 - m1) / 23, 6) AS DOUBLE) AS velocity, CAST(ROUND(m6 / m24, 6) AS DOUBLE) AS share_6h, CAST(ROUND(CASE WHEN (m6 - m1) / 5 > 0 THEN ((m24 - m6) / 18) / ((m6 - m1) / 5) END, 6) AS DOUBLE) AS accel FROM p""")
def early_block(spark, d):
    """Stages side by side."""
    from pyspark.sql import Window

    ranked = contents(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("day", "content_id"))).filter("k <= 3")
    m = ranked.groupBy("source_id").agg(*(F.max(F.when(F.col("k") == k, F.col("views"))).alias(f"m{k}") for k in (1, 2, 3)))
    v1, v2 = (F.col("m2") - F.col("m1")) / 5, (F.col("m3") - F.col("m2")) / 18
    return m.select("source_id", F.round((F.col("m3") - F.col("m1")) / 23, 6).alias("velocity"), F.round(F.col("m2") / F.col("m3"), 6).alias("share_6h"), F.round(F.when(v1 > 0, v2 / v1), 6).alias("accel"))


@plan(f"""WITH c AS (SELECT source_id, CASE tier WHEN 'BUILDING' THEN 3.0 WHEN 'MACHINERY' THEN 2.0 END AS w, CAST(FLOOR(size) AS BIGINT) AS size, source_id % 4 AS mentions FROM {SOURCES})
SELECT source_id, CAST(ROUND(COALESCE(w, 1) + LOG10(GREATEST(size, 0) + 1) + 0.5 * (GREATEST(mentions, 1) - 1), 4) AS DOUBLE) AS priority FROM c""")
def candidate_priorities(spark, d):
    """M15 over all sources."""
    weight = F.when(F.col("tier") == "BUILDING", 3.0).when(F.col("tier") == "MACHINERY", 2.0)
    return sources(spark, d).select("source_id", S.channel_candidate_score(weight, F.floor("size"), F.col("source_id") % 4).alias("priority"))


@plan(f"SELECT content_id, CAST(ROUND_EVEN(views / 1000, 0) AS DOUBLE) AS thousands FROM {CONTENTS}")
def half_even(spark, d):
    """M17."""
    return contents(spark, d).select("content_id", F.bround(F.col("views") / 1000).alias("thousands"))
