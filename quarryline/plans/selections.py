"""Filters with reasons, ranked selections, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import times
from quarryline.operators import ranking as R
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EDGES, ORDERS_NOW, SNAPSHOTS, SOURCES, contents, edges, snapshots, sources
from quarryline.session import table

_MEDIANS = f"""WITH a AS (SELECT *, CASE WHEN DATE_DIFF('day', day, DATE '{ORDERS_NOW}') < 365 THEN 'new' ELSE 'old' END AS bucket FROM {CONTENTS}), m AS (SELECT source_id, bucket, MEDIAN(views) AS med FROM a GROUP BY 1, 2 HAVING COUNT(*) >= 3),
o AS (SELECT content_id, source_id, CAST(ROUND(views / med, 6) AS DOUBLE) AS outlier FROM a JOIN m USING (source_id, bucket) WHERE med > 0)"""


def _outliers(spark, d):
    """Posts against the median of their author in the same age bucket."""
    rows = contents(spark, d).withColumn("bucket", F.when(F.datediff(F.to_date(F.lit(ORDERS_NOW)), "day") < 365, "new").otherwise("old"))
    medians = rows.groupBy("source_id", "bucket").agg(F.median("views").alias("med"), F.count("*").alias("n")).filter("n >= 3 and med > 0").drop("n")
    return rows.join(medians, ["source_id", "bucket"]).select("content_id", "source_id", F.round(F.col("views") / F.col("med"), 6).alias("outlier"))


@plan(_MEDIANS + " SELECT content_id, source_id, outlier FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY outlier DESC, content_id) AS k FROM o) WHERE k <= 2 ORDER BY outlier DESC, content_id LIMIT 100")
def author_outliers(spark, d):
    """M7, K2: the flagship: outliers of each author, two of each at most, the best hundred."""
    return R.cap_per_key(_outliers(spark, d), "source_id", [F.desc("outlier"), F.col("content_id")], 2, 100)


@plan(_MEDIANS + " SELECT content_id, source_id, outlier FROM o")
def all_outliers(spark, d):
    """M6, M7: the map over all posts."""
    return _outliers(spark, d)


@plan(f"SELECT content_id FROM {CONTENTS} WHERE day >= DATE '2001-01-01' AND day < DATE '2001-02-01' AND COALESCE(status, 'O') <> 'P'")
def time_window(spark, d):
    """A half-open window and a null-safe flag, pushed into the scan."""
    o = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'2001-01-01' and o_orderdate < timestamp_ntz'2001-02-01'")
    return o.filter(F.coalesce("o_orderstatus", F.lit("O")) != "P").select(F.col("o_orderkey").alias("content_id"))


@plan(f"""SELECT platform, COUNT(*) AS n, COUNT(*) FILTER (views >= 100000) AS v1, COUNT(*) FILTER (views >= 200000) AS v2, COUNT(*) FILTER (views >= 300000) AS v3, COUNT(DISTINCT CASE WHEN views >= 300000 THEN source_id END) AS authors FROM {CONTENTS} JOIN {SOURCES} USING (source_id) GROUP BY platform""")
def threshold_table(spark, d):
    """P5: what several thresholds would leave, in one pass."""
    rows = contents(spark, d).join(sources(spark, d), "source_id")
    counts = [F.count_if(F.col("views") >= t).alias(f"v{i}") for i, t in enumerate((100000, 200000, 300000), 1)]
    return rows.groupBy("platform").agg(F.count("*").alias("n"), *counts, F.countDistinct(F.when(F.col("views") >= 300000, F.col("source_id"))).alias("authors"))


@plan(f"""SELECT COALESCE(CASE WHEN status = 'P' THEN 'candidate' WHEN topic = '5-LOW' THEN 'status' WHEN views < 50000 THEN 'small' WHEN size <= 0 THEN 'source' END, 'kept') AS reason, COUNT(*) AS n FROM {CONTENTS} JOIN {SOURCES} USING (source_id) GROUP BY 1""")
def gate_reasons(spark, d):
    """The first reason that keeps a post out, counted."""
    rows = contents(spark, d).join(sources(spark, d), "source_id")
    reason = R.first_reason([("candidate", F.col("status") == "P"), ("status", F.col("topic") == "5-LOW"), ("small", F.col("views") < 50000), ("source", F.col("size") <= 0)])
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@plan(f"SELECT a.content_id FROM (SELECT content_id, CASE WHEN topic = '5-LOW' THEN NULL ELSE topic END AS t FROM {CONTENTS}) a JOIN (SELECT NULL AS t UNION ALL SELECT '1-URGENT') k ON a.t IS NOT DISTINCT FROM k.t")
def null_safe_lookup(spark, d):
    """P12."""
    rows = contents(spark, d).withColumn("t", F.when(F.col("topic") != "5-LOW", F.col("topic")))
    return rows.filter(F.col("t").isNull() | (F.col("t") == "1-URGENT")).select("content_id")


@plan("SELECT COUNT(*) FILTER (o_orderdate IS NULL OR YEAR(o_orderdate) = 1970) AS bad, COUNT(*) FILTER (o_orderdate IS NOT NULL AND YEAR(o_orderdate) <> 1970) AS good FROM orders")
def valid_dates(spark, d):
    """P13."""
    ok = times.valid_time(F.col("o_orderdate"))
    return table(spark, d, "orders").agg(F.count_if(~ok).alias("bad"), F.count_if(ok).alias("good"))


@plan("SELECT page_id FROM pages WHERE url ILIKE '%/EN/%'")
def substring_filter(spark, d):
    """A pattern without regard to case."""
    return table(spark, d, "pages").filter(F.col("url").ilike("%/EN/%")).select("page_id")


@plan(f"SELECT content_id, views FROM {CONTENTS} ORDER BY CASE WHEN status = 'P' THEN NULL ELSE views END DESC NULLS LAST, content_id DESC LIMIT 50")
def ordered_top(spark, d):
    """K1: nulls last, ties by id."""
    key = F.when(F.col("status") != "P", F.col("views"))
    return contents(spark, d).orderBy(key.desc_nulls_last(), F.desc("content_id")).limit(50).select("content_id", "views")


@plan(f"""WITH t AS (SELECT source_id FROM {CONTENTS} GROUP BY source_id ORDER BY MAX(views) DESC, source_id LIMIT 12) SELECT content_id, source_id, views FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY views DESC, content_id) AS k FROM {CONTENTS} WHERE source_id IN (SELECT source_id FROM t)) WHERE k <= 2""")
def best_of_best(spark, d):
    """K3: the twelve best sources, two posts of each."""
    return R.best_of_best(contents(spark, d), "source_id", "views", "content_id", 12, 2).select("content_id", "source_id", "views")


@plan(f"SELECT content_id, views FROM {CONTENTS} ORDER BY CASE WHEN topic = '1-URGENT' AND status = 'F' THEN 0 ELSE 1 END, views DESC, content_id LIMIT 60")
def priority_first(spark, d):
    """K4, K6: rows with both conditions first."""
    both = (F.col("topic") == "1-URGENT") & (F.col("status") == "F")
    return contents(spark, d).orderBy(F.when(both, 0).otherwise(1), F.desc("views"), "content_id").limit(60).select("content_id", "views")


@plan(f"""WITH a AS (SELECT content_id, ROW_NUMBER() OVER (ORDER BY views DESC, content_id) AS r, 0 AS l FROM {CONTENTS} WHERE status = 'F' ORDER BY r LIMIT 40), b AS (SELECT content_id, ROW_NUMBER() OVER (ORDER BY views DESC, content_id) AS r, 1 AS l FROM {CONTENTS} WHERE topic = '1-URGENT' ORDER BY r LIMIT 40),
u AS (SELECT content_id, r, l, ROW_NUMBER() OVER (PARTITION BY content_id ORDER BY r, l) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT content_id FROM u WHERE k = 1 ORDER BY content_id % 2 = 0, r, l LIMIT 20""")
def interleaved(spark, d):
    """Two lists in turn, what was shown before (even ids) last."""
    rows = contents(spark, d).select("content_id", "views", "topic", "status")
    shown = rows.filter("content_id % 2 = 0").select("content_id")
    return R.interleave(rows.filter("status = 'F'"), rows.filter("topic = '1-URGENT'"), [F.desc("views"), F.col("content_id")], "content_id", 20, shown).select("content_id")


@plan("SELECT doc_id, lang FROM (SELECT doc_id, lang, SUM(OCTET_LENGTH(ENCODE(COALESCE(text, '')))) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000")
def within_budget(spark, d):
    """The first texts that fit into a byte budget."""
    return R.within_budget(table(spark, d, "documents"), ["lang"], [F.col("doc_id")], "text", 20000).select("doc_id", "lang")


@plan(f"WITH r AS (SELECT source_id, ROW_NUMBER() OVER (ORDER BY source_id) - 1 AS i, COUNT(*) OVER () AS n FROM {SOURCES}) SELECT source_id FROM r WHERE (i - (n - 20) + n) % n < 50")
def rotation(spark, d):
    """K8: a slice of a list from a cursor on, around its end."""
    rows = sources(spark, d).select("source_id")
    return R.rotation(rows, [F.col("source_id")], rows.count() - 20, 50)


@plan(f"SELECT source_id, k FROM (SELECT source_id, ROW_NUMBER() OVER (ORDER BY size DESC NULLS LAST, handle) AS k FROM {SOURCES} ORDER BY size DESC NULLS LAST, handle LIMIT 130) WHERE k > 100")
def ordered_queue(spark, d):
    """The part of an ordered queue after a cursor."""
    from pyspark.sql import Window

    order = [F.desc_nulls_last("size"), F.col("handle")]
    front = sources(spark, d).orderBy(*order).limit(130)  # the limit comes first, so one task numbers 130 rows
    return front.withColumn("k", F.row_number().over(Window.orderBy(*order)).cast("long")).filter("k > 100").select("source_id", "k")


@plan(f"SELECT source_id, UNNEST(RANGE(1, n + 1)) AS unit FROM (SELECT source_id, COUNT(*) AS n FROM {CONTENTS} WHERE topic = '2-HIGH' GROUP BY source_id)")
def unit_rows(spark, d):
    """A counted row as that many rows."""
    counted = contents(spark, d).filter("topic = '2-HIGH'").groupBy("source_id").agg(F.count("*").alias("n"))
    return counted.select("source_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("unit"))


@plan(f"SELECT DISTINCT target_id FROM {EDGES} e WHERE day >= DATE '2001-06-01' AND NOT EXISTS (SELECT 1 FROM {EDGES} b WHERE b.target_id = e.target_id AND b.day < DATE '2001-06-01' AND b.kind = 'A')")
def new_targets(spark, d):
    """Targets of a window that an earlier one does not have."""
    rows = edges(spark, d)
    old = rows.filter("day < date'2001-06-01' and kind = 'A'").select("target_id").distinct()
    return rows.filter("day >= date'2001-06-01'").select("target_id").distinct().join(old, "target_id", "left_anti")


@plan(f"SELECT a.source_id, LIST_SORT(LIST_INTERSECT(a.t, b.t))::VARCHAR[] AS shared, LEN(LIST_DISTINCT(LIST_CONCAT(a.t, b.t))) AS n FROM (SELECT source_id, LIST(DISTINCT topic) AS t FROM {CONTENTS} WHERE status = 'F' GROUP BY 1) a JOIN (SELECT source_id, LIST(DISTINCT topic) AS t FROM {CONTENTS} WHERE status = 'O' GROUP BY 1) b USING (source_id)".replace("LIST_SORT(LIST_INTERSECT(a.t, b.t))::VARCHAR[] AS shared", "ARRAY_TO_STRING(LIST_SORT(LIST_INTERSECT(a.t, b.t)), ',') AS shared"))
def shared_topics(spark, d):
    """What two sets share, and the size of both together."""
    of = lambda s, name: contents(spark, d).filter(F.col("status") == s).groupBy("source_id").agg(F.collect_set("topic").alias(name))
    both = of("F", "a").join(of("O", "b"), "source_id")
    return both.select("source_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("n"))


@plan(f"SELECT s.snapshot_id FROM {SNAPSHOTS} s WHERE NOT EXISTS (SELECT 1 FROM {SNAPSHOTS} m WHERE m.content_id = s.content_id AND m.stage = 'purchase' AND m.captured_at < s.captured_at AND m.captured_at >= s.captured_at - INTERVAL 24 HOUR) AND s.stage = 'view'")
def not_shown_lately(spark, d):
    """Rows whose content was not shown within a day before."""
    rows = snapshots(spark, d)
    memory = rows.filter("stage = 'purchase'").select(F.col("content_id").alias("c"), F.col("captured_at").alias("at"))
    recent = (F.col("content_id") == F.col("c")) & (F.col("at") < F.col("captured_at")) & (F.col("at") >= F.col("captured_at") - F.expr("interval 24 hours"))
    return rows.filter("stage = 'view'").join(memory, recent, "left_anti").select("snapshot_id")


@plan(f"SELECT platform, COUNT(*) AS n FROM (SELECT platform, ROW_NUMBER() OVER (PARTITION BY platform ORDER BY source_id) AS k FROM {SOURCES}) WHERE k <= 20 GROUP BY platform")
def sample_per_platform(spark, d):
    """A sample of twenty per platform; which rows it takes is random, how many is not."""
    from pyspark.sql import Window

    order = Window.partitionBy("platform").orderBy(F.rand(7))
    return sources(spark, d).withColumn("k", F.row_number().over(order)).filter("k <= 20").groupBy("platform").agg(F.count("*").alias("n"))
