"""Joins: star joins, latest and nearest rows, semi and anti joins, time ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import times
from quarryline.operators import influence
from quarryline.operators import latest as L
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EDGES, EVENTS_NOW, SNAPSHOTS, SOURCES, contents, edges, snapshots, sources
from quarryline.session import table


@plan(f"""SELECT platform, COUNT(*) AS posts, CAST(ROUND(SUM(views), 2) AS DOUBLE) AS views FROM {CONTENTS} c JOIN {SOURCES} s USING (source_id) GROUP BY platform""")
def star_join(spark, d):
    """Facts with their dimensions; the small ones are broadcast by their size at run time."""
    return contents(spark, d).join(sources(spark, d), "source_id").groupBy("platform").agg(F.count("*").alias("posts"), F.round(F.sum("views"), 2).alias("views"))


@plan(f"""SELECT s.source_id, COUNT(c.content_id) AS posts, CAST(MAX(c.views) AS DOUBLE) AS best FROM {SOURCES} s LEFT JOIN (SELECT * FROM {CONTENTS} WHERE status = 'F' AND topic = '1-URGENT') c ON c.source_id = s.source_id GROUP BY s.source_id""")
def outer_join(spark, d):
    """Every source, with its posts where it has any."""
    urgent = contents(spark, d).filter("status = 'F' and topic = '1-URGENT'")
    return sources(spark, d).join(urgent, "source_id", "left").groupBy("source_id").agg(F.count("content_id").alias("posts"), F.max("views").alias("best"))


@plan(f"""SELECT content_id, snapshot_id, views FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY content_id ORDER BY captured_at DESC, snapshot_id DESC) AS k FROM {SNAPSHOTS}) WHERE k = 1""")
def latest_snapshot(spark, d):
    """The last snapshot of each content, by an aggregate."""
    return L.latest(snapshots(spark, d), ["content_id"], "captured_at", "snapshot_id").select("content_id", "snapshot_id", "views")


@plan(f"""SELECT c.source_id, c.content_id FROM {CONTENTS} c JOIN (SELECT source_id, MAX(day) AS day FROM {CONTENTS} GROUP BY source_id) m ON c.source_id = m.source_id AND c.day = m.day""")
def latest_with_ties(spark, d):
    """All posts of the last day of each source."""
    return L.latest_with_ties(contents(spark, d), ["source_id"], "day").select("source_id", "content_id")


@plan(f"""SELECT content_id, MAX(snapshot_id) AS snapshot_id, ARG_MAX(views, snapshot_id) AS views FROM {SNAPSHOTS} WHERE stage <> 'error' GROUP BY content_id""")
def last_good_snapshot(spark, d):
    """The row with the largest id among good ones; filtered before it is grouped."""
    good = snapshots(spark, d).filter("stage <> 'error'").groupBy("content_id")
    return good.agg(F.max("snapshot_id").alias("snapshot_id"), F.max_by("views", "snapshot_id").alias("views"))


@plan(f"""SELECT source_id, handle FROM {SOURCES} s WHERE EXISTS (SELECT 1 FROM {CONTENTS} c WHERE c.source_id = s.source_id AND c.views > 400000)""")
def semi_join(spark, d):
    """Sources with a post above a mark."""
    return sources(spark, d).join(contents(spark, d).filter("views > 400000"), "source_id", "left_semi").select("source_id", "handle")


@plan(f"""SELECT source_id, handle FROM {SOURCES} s WHERE NOT EXISTS (SELECT 1 FROM {CONTENTS} c WHERE c.source_id = s.source_id AND c.views > 400000)""")
def anti_join(spark, d):
    """Sources without one; nulls on either side never match."""
    return sources(spark, d).join(contents(spark, d).filter("views > 400000"), "source_id", "left_anti").select("source_id", "handle")


@plan(f"""SELECT a.snapshot_id, COUNT(DISTINCT b.stage) AS authors FROM {SNAPSHOTS} a LEFT JOIN {SNAPSHOTS} b ON b.content_id = a.content_id AND b.stage <> a.stage AND b.captured_at >= a.captured_at AND b.captured_at <= a.captured_at + INTERVAL 6 HOUR GROUP BY a.snapshot_id""")
def later_echoes(spark, d):
    """Other kinds of event on the same content within six hours after; equality joins, time filters."""
    rows = snapshots(spark, d)
    later = rows.select("content_id", F.col("stage").alias("by"), F.col("captured_at").alias("at"))
    gap = times.hours_between(F.col("captured_at"), F.col("at"))
    near = rows.join(later, "content_id").filter((F.col("by") != F.col("stage")) & (gap >= 0) & (gap <= 6))
    found = near.groupBy("snapshot_id").agg(F.countDistinct("by").alias("authors"))
    return rows.select("snapshot_id").join(found, "snapshot_id", "left").select("snapshot_id", F.coalesce("authors", F.lit(0)).alias("authors"))


@plan(f"""WITH s AS (SELECT snapshot_id, content_id, EPOCH_US(captured_at) AS us, TRY_CAST(props->>'$.k' AS BIGINT) AS named FROM {SNAPSHOTS})
SELECT a.snapshot_id, COUNT(DISTINCT b.content_id) AS authors FROM s a LEFT JOIN s b ON b.named = a.content_id AND b.content_id <> a.content_id AND b.us BETWEEN a.us AND a.us + 259200000000 GROUP BY 1""")
def later_echoes_by_name(spark, d):
    """J8 in full: other contents whose snapshots name this one's content within 72 hours after; ``k`` of the props is the name."""
    rows = snapshots(spark, d)
    named = F.array(F.get_json_object("props", "$.k").try_cast("long"))
    return influence.later_echoes(rows.withColumn("names", named), "names", "content_id", "snapshot_id", "captured_at")


@plan(f"""WITH p AS (SELECT snapshot_id AS wanted, content_id, captured_at AS at FROM {SNAPSHOTS} WHERE stage = 'purchase'), v AS (SELECT * FROM {SNAPSHOTS} WHERE stage = 'view')
SELECT wanted, snapshot_id FROM (SELECT p.wanted, v.snapshot_id, ROW_NUMBER() OVER (PARTITION BY p.wanted ORDER BY ABS(EPOCH_US(v.captured_at) - EPOCH_US(p.at)), v.snapshot_id) AS k
FROM p JOIN v USING (content_id) WHERE ABS(EPOCH_US(v.captured_at) - EPOCH_US(p.at)) <= 10800000000) WHERE k = 1""")
def nearest_in_time(spark, d):
    """The view nearest to each purchase on the same content, within three hours."""
    rows = snapshots(spark, d)
    wanted = rows.filter("stage = 'purchase'").select(F.col("snapshot_id").alias("wanted"), "content_id", F.col("captured_at").alias("at"))
    views = rows.filter("stage = 'view'").select("content_id", "snapshot_id", "captured_at")
    return L.nearest_within(wanted, views, "content_id", "at", "captured_at", 3.0, "snapshot_id").select("wanted", "snapshot_id")


@plan(f"""SELECT wanted, (SELECT ARG_MAX(v.views, v.captured_at) FROM {SNAPSHOTS} v WHERE v.stage = 'view' AND v.content_id = p.content_id AND v.captured_at <= p.at) AS views
FROM (SELECT snapshot_id AS wanted, content_id, captured_at AS at FROM {SNAPSHOTS} WHERE stage = 'purchase') p""")
def as_of_join(spark, d):
    """The last view's value at each purchase, as one ordered stream per content."""
    rows = snapshots(spark, d)
    wanted = rows.filter("stage = 'purchase'").select(F.col("snapshot_id").alias("wanted"), "content_id", F.col("captured_at").alias("at"))
    return L.as_of(wanted, rows.filter("stage = 'view'"), "content_id", "at", "captured_at", "views", "views").select("wanted", "views")


@plan(f"""WITH a AS (SELECT content_id, views, (EPOCH_US(captured_at) - MIN(EPOCH_US(captured_at)) OVER (PARTITION BY content_id)) / 3.6e9 AS age FROM {SNAPSHOTS}),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY content_id ORDER BY ABS(age - 6.0), age) AS k FROM a)
SELECT content_id, ABS(age - 6.0) <= 1.5 AS exact, CAST(CASE WHEN ABS(age - 6.0) <= 1.5 THEN views ELSE ROUND_EVEN(views * 6.0 / age, 0) END AS DOUBLE) AS views FROM b WHERE k = 1 AND (ABS(age - 6.0) <= 1.5 OR age > 0)""")
def value_at_age(spark, d):
    """The value at the age nearest to six hours, scaled where that is not near."""
    rows = snapshots(spark, d)
    born = rows.groupBy("content_id").agg(F.min("captured_at").alias("born"))
    aged = rows.join(born, "content_id").withColumn("age", times.hours_between(F.col("born"), F.col("captured_at")))
    return L.scaled_to_age(aged, "content_id", "age", ["views"]).select("content_id", "exact", "views")


@plan(f"""SELECT s.source_id, r.rank FROM {SOURCES} s JOIN (SELECT UPPER(handle) AS name, CAST(source_id % 7 AS BIGINT) AS rank FROM {SOURCES}) r ON LOWER(s.handle) = LOWER(r.name)""")
def case_blind_join(spark, d):
    """Names that differ in case only; keys are lowered once on each side."""
    own = sources(spark, d)
    other = own.select(F.lower(F.upper("handle")).alias("key"), (F.col("source_id") % 7).alias("rank"))
    return own.withColumn("key", F.lower("handle")).join(other, "key").select("source_id", "rank")


@plan(f"""SELECT s.source_id, COALESCE(a.n, b.n) AS n FROM {SOURCES} s LEFT JOIN (SELECT source_id, COUNT(*) AS n FROM {CONTENTS} WHERE views > 300000 GROUP BY source_id) a ON a.source_id = s.source_id
LEFT JOIN (SELECT country, COUNT(*) AS n FROM {SOURCES} GROUP BY country) b ON b.country = s.country""")
def fallback_match(spark, d):
    """A match by id, else by another key."""
    own = sources(spark, d)
    by_id = contents(spark, d).filter("views > 300000").groupBy("source_id").agg(F.count("*").alias("a"))
    by_country = own.groupBy("country").agg(F.count("*").alias("b"))
    return own.join(by_id, "source_id", "left").join(by_country, "country", "left").select("source_id", F.coalesce("a", "b").alias("n"))


@plan(f"""SELECT big.source_id AS big, small.source_id AS small, COUNT(DISTINCT a.target_id) AS shared FROM {EDGES} a JOIN {EDGES} b ON a.target_id = b.target_id JOIN (SELECT s_suppkey AS source_id, s_acctbal AS size FROM supplier) big ON big.source_id = a.source_id
JOIN (SELECT s_suppkey AS source_id, s_acctbal AS size FROM supplier) small ON small.source_id = b.source_id WHERE small.size > 0 AND big.size >= 10 * small.size GROUP BY 1, 2""")
def big_and_small(spark, d):
    """Pairs of sources with a common target of which one is ten times as large; equal keys join, sizes filter."""
    pairs = edges(spark, d).select("source_id", "target_id").distinct()
    sized = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_acctbal").alias("size"))
    known = pairs.join(sized, "source_id")
    other = known.select("target_id", F.col("source_id").alias("small"), F.col("size").alias("small_size"))
    near = known.join(other, "target_id").filter((F.col("small_size") > 0) & (F.col("size") >= 10 * F.col("small_size")))
    return near.groupBy(F.col("source_id").alias("big"), "small").agg(F.count("*").alias("shared"))


@plan("""SELECT d.doc_id, COALESCE(l.quality, -1) AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 0""")
def verdict_join(spark, d):
    """Cached verdicts by key."""
    labels = table(spark, d, "labels").filter("toxic = 0")
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@plan(f"""WITH x AS (SELECT content_id, published_at, source_id, CASE WHEN status = 'P' THEN NULL ELSE source_id END AS owner FROM {CONTENTS}) SELECT content_id, COALESCE(owner, source_id % 10) AS author FROM x""")
def author_of_post(spark, d):
    """The author from several columns, the first that is known."""
    rows = contents(spark, d).withColumn("owner", F.when(F.col("status") != "P", F.col("source_id")))
    return rows.select("content_id", F.coalesce("owner", F.col("source_id") % 10).alias("author"))


@plan(f"""WITH s AS (SELECT content_id, MIN(captured_at) AS born FROM {SNAPSHOTS} GROUP BY content_id), p AS (SELECT content_id, born, stage, h, born + TO_HOURS(h) AS due FROM s, (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('72h', 72)) v(stage, h)),
n AS (SELECT p.content_id, p.stage, ANY_VALUE(p.due) AS due, COUNT(*) FILTER (ABS(EPOCH_US(c.captured_at) - EPOCH_US(p.due)) <= 10800000000) AS near, COUNT(*) FILTER (EPOCH_US(c.captured_at) - EPOCH_US(p.due) > 10800000000 AND EPOCH_US(c.captured_at) - EPOCH_US(p.due) <= 32400000000) AS late FROM p JOIN {SNAPSHOTS} c USING (content_id) GROUP BY 1, 2)
SELECT content_id, stage, near AS n_near, CASE WHEN near > 0 THEN 'measured' WHEN late > 0 THEN 'measured_late' WHEN EPOCH_US(TIMESTAMP '{EVENTS_NOW}') - EPOCH_US(DATE_TRUNC('second', due)) > 32400000000 THEN 'closed_no_data' ELSE 'pending' END AS status FROM n""")
def measurement_stages(spark, d):
    """T3, T4 as a batch: the status of each planned measurement."""
    from quarryline.operators import snapshots as S

    rows = snapshots(spark, d)
    born = rows.groupBy("content_id").agg(F.min("captured_at").alias("born"))
    micros = F.timestamp_micros(F.unix_micros(F.col("born").cast("timestamp")) + F.col("stage_hours") * 3_600_000_000)
    schedule = S.stage_schedule(born, "content_id", "born").withColumn("due", micros)
    return S.stage_status(schedule, rows, "content_id", "captured_at", F.lit(EVENTS_NOW).cast("timestamp")).select("content_id", "stage", "n_near", "status")
