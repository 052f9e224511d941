"""Upserts, edges and parity: writes as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import upsert
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EDGES, SOURCES, contents, edges, sources


@plan(f"""WITH o AS (SELECT source_id, handle, size FROM {SOURCES} WHERE source_id % 3 <> 0), n AS (SELECT source_id, handle || '!' AS handle, CASE WHEN source_id % 5 = 0 THEN NULL ELSE size + 1 END AS size FROM {SOURCES} WHERE source_id % 2 = 0)
SELECT COALESCE(o.source_id, n.source_id) AS source_id, CASE WHEN n.source_id IS NULL THEN o.handle ELSE n.handle END AS handle, CASE WHEN n.source_id IS NULL THEN o.size ELSE COALESCE(n.size, o.size) END AS size FROM o FULL JOIN n ON o.source_id = n.source_id""")
def upsert_sources(spark, d):
    """New rows over old ones; nulls do not replace values."""
    rows = sources(spark, d).select("source_id", "handle", "size")
    old = rows.filter("source_id % 3 <> 0")
    new = rows.filter("source_id % 2 = 0").select("source_id", F.concat("handle", F.lit("!")).alias("handle"), F.when(F.col("source_id") % 5 != 0, F.col("size") + 1).alias("size"), F.lit(1).alias("arrival"))
    return upsert.merge(old, new, ["source_id"], "arrival", keep_known=True)


@plan(f"""SELECT topic, COUNT(*) AS calls, ARG_MAX(status, content_id) AS status FROM {CONTENTS} GROUP BY topic""")
def accumulated_usage(spark, d):
    """Counters of old and new rows add up, the last status stays."""
    rows = contents(spark, d).select("topic", F.lit(1).cast("long").alias("calls"), "status", F.col("content_id").alias("arrival"))
    old, new = rows.filter("arrival < 5000"), rows.filter("arrival >= 5000")
    return upsert.accumulate(old, new, ["topic"], ["calls"], ["status"], "arrival").select("topic", "calls", "status")


@plan(f"""SELECT source_id, target_id, COUNT(*) AS seen_count, MAX(weight) AS weight, CAST(MIN(day) AS VARCHAR) AS first_seen, CAST(MAX(day) AS VARCHAR) AS last_seen FROM {EDGES} GROUP BY 1, 2""")
def upsert_edges(spark, d):
    """Edges seen again."""
    out = upsert.merge_edges(None, edges(spark, d), ["source_id", "target_id"], "weight", "kind", "day")
    return out.select("source_id", "target_id", "seen_count", "weight", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


@plan(f"""SELECT 'posts' AS "check", (SELECT COUNT(*) FROM orders) AS a, (SELECT COUNT(*) FROM {CONTENTS}) AS b, (SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM {CONTENTS}) AS difference UNION ALL SELECT 'sources', (SELECT COUNT(*) FROM customer), (SELECT COUNT(DISTINCT source_id) FROM {CONTENTS}), (SELECT COUNT(*) FROM customer) - (SELECT COUNT(DISTINCT source_id) FROM {CONTENTS})""")
def parity(spark, d):
    """Counts of paired frames."""
    from quarryline.session import table

    posts = contents(spark, d)
    return upsert.parity([("posts", table(spark, d, "orders"), posts), ("sources", table(spark, d, "customer"), posts.select("source_id").distinct())])


@plan(f"""SELECT c.content_id, m.new_id FROM {CONTENTS} c JOIN (SELECT source_id, source_id * 10 + 1 AS new_id FROM {SOURCES} WHERE tier <> 'BUILDING') m USING (source_id)""")
def migrated_ids(spark, d):
    """Rows under their new keys."""
    known, _ = upsert.migrate(contents(spark, d), sources(spark, d).filter("tier <> 'BUILDING'").select("source_id", (F.col("source_id") * 10 + 1).alias("new_id")), "source_id", "new_id")
    return known.select("content_id", "new_id")
