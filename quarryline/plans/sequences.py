"""Windows and sequences: deltas, clamps, growth, ranks, robust z, stories in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import stats, times
from quarryline.operators import graph, snapshots as S, stories, trends
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EVENTS_NOW, ORDERS_NOW, SNAPSHOTS, SOURCES, contents, snapshots, sources
from quarryline.session import table

_LAGGED = f"""WITH l AS (SELECT *, CAST(FLOOR(EPOCH(captured_at)) AS BIGINT) AS s, LAG(CAST(FLOOR(EPOCH(captured_at)) AS BIGINT)) OVER w AS ps, LAG(views) OVER w AS pv FROM {SNAPSHOTS} WINDOW w AS (PARTITION BY content_id ORDER BY captured_at)),
i AS (SELECT *, s - ps AS iv, CASE WHEN s - ps >= 600 THEN views - pv END AS raw FROM l)"""


@plan(_LAGGED + """ SELECT snapshot_id, iv AS interval_seconds, CASE WHEN iv IS NULL THEN 'first' WHEN iv >= 3600 THEN 'ok' ELSE 'short' END AS interval_quality, CAST(ROUND(CASE WHEN raw >= 0 THEN raw END, 4) AS DOUBLE) AS delta_views,
CAST(ROUND(CASE WHEN iv >= 3600 AND raw >= 0 THEN raw / (iv / 3600) END, 6) AS DOUBLE) AS per_hour, COALESCE(raw < 0, FALSE) AS is_anomaly FROM i""")
def snapshot_deltas(spark, d):
    """Deltas of neighbouring snapshots; a fall is an anomaly without delta."""
    out = S.deltas(snapshots(spark, d), "content_id", "captured_at", ["views"])
    return out.select("snapshot_id", "interval_seconds", "interval_quality", F.round("delta_views", 4).alias("delta_views"), F.round("per_hour", 6).alias("per_hour"), "is_anomaly")


@plan(_LAGGED + """ SELECT snapshot_id, CAST(ROUND(raw, 4) AS DOUBLE) AS delta_views, CAST(ROUND(CASE WHEN iv >= 3600 THEN raw / (iv / 86400) END, 6) AS DOUBLE) AS per_day, COALESCE(raw < 0, FALSE) AS is_anomaly FROM i""")
def signed_deltas(spark, d):
    """The variant that keeps negative deltas and speeds."""
    out = S.deltas(snapshots(spark, d), "content_id", "captured_at", ["views"], keep_negative=True)
    return out.select("snapshot_id", F.round("delta_views", 4).alias("delta_views"), F.round("per_day", 6).alias("per_day"), "is_anomaly")


@plan(f"SELECT snapshot_id, MAX(views) OVER (PARTITION BY content_id ORDER BY captured_at, snapshot_id ROWS UNBOUNDED PRECEDING) AS views FROM {SNAPSHOTS}")
def never_falling(spark, d):
    """S20, W20."""
    return S.never_falling(snapshots(spark, d), "content_id", "captured_at", "views", "snapshot_id").select("snapshot_id", "views")


@plan(f"""WITH s AS (SELECT source_id, day, MAX(views) AS v FROM {CONTENTS} GROUP BY 1, 2), r AS (SELECT source_id, MAX(v) FILTER (day = DATE '{ORDERS_NOW}') AS n, ARG_MAX(v, day) FILTER (day <= DATE '{ORDERS_NOW}' - 7) AS ref, DATE_DIFF('day', MIN(day), DATE '{ORDERS_NOW}') AS depth_days FROM s GROUP BY 1)
SELECT source_id, CAST(ROUND(CASE WHEN ref > 0 THEN (n - ref) / ref END, 6) AS DOUBLE) AS growth, CAST(depth_days AS INTEGER) AS depth_days FROM r""")
def growth_7_days(spark, d):
    """W4, W5."""
    daily = contents(spark, d).groupBy("source_id", "day").agg(F.max("views").alias("views"))
    return S.growth(daily, "source_id", "day", "views", F.to_date(F.lit(ORDERS_NOW))).withColumn("growth", F.round("growth", 6))


@plan(f"""SELECT a.snapshot_id, (SELECT COUNT(*) FROM {SNAPSHOTS} b WHERE b.content_id = a.content_id AND b.stage <> a.stage AND ABS(FLOOR(EPOCH(b.captured_at)) - FLOOR(EPOCH(a.captured_at))) <= 172800) AS n_other FROM {SNAPSHOTS} a""")
def duplicates_nearby(spark, d):
    """Rows of the same cluster in other channels within 48 hours, by two range windows."""
    return S.duplicates_nearby(snapshots(spark, d), "content_id", "stage", "captured_at").select("snapshot_id", "n_other")


_MOVES = f"""WITH m AS (SELECT content_id AS story, stage AS author, snapshot_id AS id, CAST(FLOOR(EPOCH(captured_at)) AS BIGINT) AS s FROM {SNAPSHOTS}), f AS (SELECT story, author, MIN(s) AS s, ARG_MIN(id, s * 1000000 + id) AS i FROM m GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY story ORDER BY s, i) AS k FROM f), p AS (SELECT story, MAX(CASE WHEN k = 1 THEN s END) AS t1, MAX(CASE WHEN k = 1 THEN i END) AS i1, MAX(CASE WHEN k = 2 THEN s END) AS t2 FROM r GROUP BY story),
v AS (SELECT m.story, m.author, m.id, (m.s - p.t2) / 60 AS lead_minutes, m.id = p.i1 AND (p.t2 - p.t1) / 60 >= 10 AS first_move FROM m JOIN p USING (story) WHERE p.t2 IS NOT NULL)"""


@plan(_MOVES + " SELECT story AS content_id, author AS stage, id AS snapshot_id, CAST(ROUND(lead_minutes, 6) AS DOUBLE) AS lead_minutes, first_move FROM v")
def first_movers(spark, d):
    """Lead over the second author of each story."""
    return graph.first_movers(snapshots(spark, d), "content_id", "stage", "snapshot_id", "captured_at").withColumn("lead_minutes", F.round("lead_minutes", 6))


@plan(_MOVES + " SELECT author AS stage, COUNT(DISTINCT story) AS stories, COUNT(*) FILTER (first_move) AS first_moves, CAST(ROUND(MEDIAN(lead_minutes), 6) AS DOUBLE) AS median_lead, CAST(ROUND(COUNT(*) FILTER (first_move) / COUNT(DISTINCT story), 6) AS DOUBLE) AS share FROM v GROUP BY author")
def first_mover_ledger(spark, d):
    """C10, M10."""
    moves = graph.first_movers(snapshots(spark, d), "content_id", "stage", "snapshot_id", "captured_at")
    return graph.first_mover_ledger(moves, "content_id", "stage").withColumns({"median_lead": F.round("median_lead", 6), "share": F.round("share", 6)})


@plan(f"""SELECT a.snapshot_id, CAST(ROUND(MIN(EPOCH_US(b.captured_at) - EPOCH_US(a.captured_at)) / 6e7, 6) AS DOUBLE) AS minutes FROM {SNAPSHOTS} a JOIN {SNAPSHOTS} b ON a.content_id = b.content_id AND b.stage <> a.stage AND b.captured_at > a.captured_at AND b.captured_at <= a.captured_at + INTERVAL 72 HOUR GROUP BY 1""")
def minutes_to_next_author(spark, d):
    """The next row of another author on the same key within 72 hours, by one ordered pass per key."""
    order = Window.partitionBy("content_id").orderBy(F.desc("at"))
    rows = snapshots(spark, d).withColumn("at", F.unix_micros(F.col("captured_at").cast("timestamp")))
    # Going backwards, the next time of each author is known; the least of the others' is the answer.
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    kinds = ["view", "error", "signup", "click", "purchase"]
    nexts = rows.withColumns({f"n_{k}": F.min(F.when(F.col("stage") == k, F.col("at"))).over(ahead) for k in kinds})
    least = F.least(*(F.when(F.col("stage") != k, F.col(f"n_{k}")) for k in kinds))
    gap = least - F.col("at")
    return nexts.filter(gap <= 72 * 3_600_000_000).select("snapshot_id", F.round(gap / 6e7, 6).alias("minutes"))


@plan(f"""WITH v AS (SELECT CAST(FLOOR(views) AS BIGINT) AS f, snapshot_id FROM {SNAPSHOTS}), r AS (SELECT *, RANK() OVER (ORDER BY f) - 1 AS below, COUNT(*) OVER (PARTITION BY f) AS ties, COUNT(*) OVER () AS n FROM v) SELECT snapshot_id, CAST(ROUND(1 + (2 * below + ties) / (2 * n), 9) AS DOUBLE) AS factor FROM r""")
def mid_rank_factor(spark, d):
    """The mid-rank, from counts of distinct values."""
    rows = snapshots(spark, d).select("snapshot_id", F.floor("views").alias("f"))
    return stats.mid_rank_factor(rows, "f", "factor").select("snapshot_id", F.round("factor", 9).alias("factor"))


@plan(f"SELECT source_id, CAST(ROUND(100 * CUME_DIST() OVER (PARTITION BY platform ORDER BY size), 6) AS DOUBLE) AS pct FROM {SOURCES}")
def share_at_most(spark, d):
    """W11."""
    return stats.share_at_most(sources(spark, d), ["platform"], "size", "pct").select("source_id", F.round("pct", 6).alias("pct"))


@plan(f"SELECT source_id, platform FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY platform ORDER BY size DESC, source_id) AS k, COUNT(*) OVER (PARTITION BY platform) AS n FROM {SOURCES}) WHERE k <= GREATEST(1, FLOOR(n * 0.1))")
def top_tenth(spark, d):
    """W12, W13."""
    return stats.top_fraction(sources(spark, d), ["platform"], "size", "source_id", 0.1).select("source_id", "platform")


@plan(f"""WITH c AS (SELECT *, platform || '|' || CASE WHEN size < 5000 THEN '<5k' ELSE '5-25k' END AS class FROM {SOURCES} WHERE size > 0), m AS (SELECT class, COUNT(*) AS n, MEDIAN(size) AS med FROM c GROUP BY class), s AS (SELECT class, MEDIAN(ABS(size - med)) * 1.4826 AS sigma FROM c JOIN m USING (class) GROUP BY class)
SELECT source_id, CAST(ROUND(CASE WHEN n > 1 AND sigma > 0 THEN (size - med) / sigma ELSE 0 END, 6) AS DOUBLE) AS z FROM c JOIN m USING (class) JOIN s USING (class)""")
def robust_z(spark, d):
    """Robust z within platform and size class."""
    classed = sources(spark, d).filter("size > 0").withColumn("class", F.concat_ws("|", "platform", times.size_class(F.col("size"))))
    return stats.robust_z(classed, ["class"], "size").select("source_id", F.round("z", 6).alias("z"))


@plan(f"""WITH s AS (SELECT content_id, CAST(captured_at AS DATE) AS day, stage, MAX(views) AS v FROM {SNAPSHOTS} WHERE captured_at >= TIMESTAMP '2024-01-28' AND captured_at < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3), m AS (SELECT day, stage, MEDIAN(v) AS med FROM s GROUP BY 1, 2),
g AS (SELECT s.day, s.stage, ANY_VALUE(med) AS med, CASE WHEN COUNT(*) > 1 THEN 1.4826 * MEDIAN(ABS(v - med)) ELSE 0 END AS sigma FROM s JOIN m USING (day, stage) GROUP BY 1, 2)
SELECT content_id, COUNT(DISTINCT s.day) AS hits FROM s JOIN g USING (day, stage) WHERE v >= med + 2 * sigma GROUP BY 1 HAVING COUNT(DISTINCT s.day) >= 2""")
def rising(spark, d):
    """Above the median by two sigma of the class on two of three days."""
    recent = snapshots(spark, d).filter("captured_at >= timestamp_ntz'2024-01-28' and captured_at < timestamp_ntz'2024-01-31'")
    daily = recent.groupBy("content_id", F.to_date("captured_at").alias("day"), "stage").agg(F.max("views").alias("v"))
    limits = stats.mad_sigma(daily, ["day", "stage"], "v")
    hits = daily.join(limits, ["day", "stage"]).filter(F.col("v") >= F.col("med") + 2 * F.col("sigma"))
    return hits.groupBy("content_id").agg(F.countDistinct("day").alias("hits")).filter("hits >= 2")


@plan("""WITH m AS (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k, LIST_DISTINCT(w) AS e, w[1] AS handle FROM (SELECT conv_id, turn, REGEXP_EXTRACT_ALL(LOWER(COALESCE(MIN(text), '')), '[\\p{L}\\p{N}_]+') AS w FROM conversations GROUP BY 1, 2)),
f AS (SELECT conv_id, handle FROM m WHERE k = 1), u AS (SELECT conv_id, k, UNNEST(e) AS x FROM m), n AS (SELECT conv_id, k FROM (SELECT conv_id, x, MIN(k) AS k FROM u GROUP BY 1, 2) GROUP BY 1, 2)
SELECT m.conv_id, turn, CASE WHEN m.k = 1 THEN 'primary' WHEN LIST_CONTAINS(e, f.handle) THEN 'amplifier' WHEN n.k IS NOT NULL THEN 'extender' ELSE 'echo' END AS role
FROM m JOIN f USING (conv_id) LEFT JOIN n ON n.conv_id = m.conv_id AND n.k = m.k""")
def story_roles(spark, d):
    """Roles in a conversation; a turn points to the first one by using its handle, its first word."""
    from quarryline.functions import text as T

    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = rows.select("conv_id", "turn", T.words("text").alias("w"))
    first = rows.groupBy("conv_id").agg(F.min_by(F.struct("turn", F.get("w", F.lit(0)).alias("handle")), "turn").alias("f"))
    linked = rows.join(first, "conv_id").select("conv_id", "turn", F.array_distinct("w").alias("ents"), F.when(F.array_contains("w", F.col("f.handle")), F.col("f.turn")).alias("points_to"))
    return stories.roles(linked, "conv_id", "turn", "turn", "ents", "points_to").select("conv_id", "turn", "role")


@plan(f"""WITH w AS (SELECT content_id, stage, props, CASE WHEN FLOOR(EPOCH(captured_at)) >= EPOCH(TIMESTAMP '{EVENTS_NOW}') - 86400 THEN 'now' ELSE 'before' END AS w FROM {SNAPSHOTS} WHERE FLOOR(EPOCH(captured_at)) >= EPOCH(TIMESTAMP '{EVENTS_NOW}') - 172800 AND FLOOR(EPOCH(captured_at)) < EPOCH(TIMESTAMP '{EVENTS_NOW}')),
t AS (SELECT COUNT(*) FILTER (w = 'now') AS n, COUNT(*) FILTER (w = 'before') AS p FROM w), c AS (SELECT stage AS entity, COUNT(*) FILTER (w = 'now') AS posts, COUNT(*) FILTER (w = 'before') AS pb, COUNT(DISTINCT CASE WHEN w = 'now' THEN content_id END) AS authors FROM w GROUP BY stage)
SELECT entity, posts, pb AS posts_before, authors, CAST(ROUND(posts / n, 9) AS DOUBLE) AS share_now, CAST(ROUND(CASE WHEN p > 0 THEN pb / p END, 9) AS DOUBLE) AS share_before, CAST(ROUND(CASE WHEN pb / p > 0 THEN (posts / n - pb / p) / (pb / p) END, 6) AS DOUBLE) AS accel,
CASE WHEN authors >= 5 AND COALESCE(pb / p, 0) = 0 THEN 'new' WHEN authors >= 5 AND (posts / n - pb / p) / (pb / p) >= 0.5 THEN 'trending' ELSE 'none' END AS state FROM c, t WHERE posts > 0""")
def entity_acceleration(spark, d):
    """W17, C6."""
    rows = snapshots(spark, d).withColumn("ents", F.array("stage"))
    out = trends.acceleration(rows, "ents", "content_id", "captured_at", F.lit(EVENTS_NOW).cast("timestamp"), 24)
    return out.withColumns({"share_now": F.round("share_now", 9), "share_before": F.round("share_before", 9), "accel": F.round("accel", 6)})


@plan(f"""WITH c AS (SELECT COUNT(*) FILTER (captured_at >= TIMESTAMP '2024-02-10' - INTERVAL 6 HOUR AND captured_at < TIMESTAMP '2024-02-10') AS n, MAX(captured_at) AS last FROM {SNAPSHOTS}) SELECT n < 20 AS shifted, CAST(DATE_TRUNC('second', CASE WHEN n < 20 THEN last ELSE TIMESTAMP '2024-02-10' END) AS VARCHAR) AS anchor FROM c""")
def window_anchor(spark, d):
    """The end of the window, moved to the last row where too few lie in it; one row."""
    end = F.lit("2024-02-10").cast("timestamp_ntz")
    inside = (F.col("captured_at") >= end - F.expr("interval 6 hours")) & (F.col("captured_at") < end)
    one = snapshots(spark, d).agg(F.count_if(inside).alias("n"), F.max("captured_at").alias("last"))
    anchor = F.date_trunc("second", F.when(F.col("n") < 20, F.col("last")).otherwise(end))
    return one.select((F.col("n") < 20).alias("shifted"), F.date_format(anchor, "yyyy-MM-dd HH:mm:ss").alias("anchor"))


@plan(f"""SELECT source_id, COUNT(*) FILTER (day >= DATE '{ORDERS_NOW}' - 30) AS posts_30, COUNT(*) FILTER (day >= DATE '{ORDERS_NOW}' - 180) AS posts_180, COUNT(*) FILTER (day >= DATE '{ORDERS_NOW}' - 365) AS posts_365 FROM {CONTENTS} GROUP BY source_id""")
def posts_in_windows(spark, d):
    """W19."""
    back = lambda n: F.count_if(F.col("day") >= F.date_sub(F.to_date(F.lit(ORDERS_NOW)), n))
    return contents(spark, d).groupBy("source_id").agg(back(30).alias("posts_30"), back(180).alias("posts_180"), back(365).alias("posts_365"))
