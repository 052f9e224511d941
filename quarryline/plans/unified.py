"""The unified report: blocks of all platforms and of what lies across them, as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.plans import blocks, boards, reports, selections, sequences  # noqa: F401
from quarryline.plans.registration import ORACLE_SQL, QUERIES, plan
from quarryline.session import table


@plan("""WITH m AS (SELECT MD5(text) AS h, MIN(doc_id) AS story, COUNT(*) AS members, COUNT(DISTINCT source) AS platforms, STRING_AGG(DISTINCT source, ', ' ORDER BY source) AS names FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT story, members, platforms, names FROM m WHERE platforms >= 2""")
def cross_story_members(spark, d):
    """2.10: stories with posts of two platforms or more; copies of a text are a story, sources are the platforms."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.md5("text").alias("h"), "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    stories = docs.groupBy("h").agg(F.min("first").alias("story"), F.sum("n").alias("members"), F.count("*").alias("platforms"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("names"))
    return stories.filter("platforms >= 2").drop("h")  # a name per platform


def _sql(block: str, query: str, item: str, value: str) -> str:
    return f"SELECT '{block}' AS block, CAST({item} AS VARCHAR) AS item, CAST({value} AS DOUBLE) AS value FROM ({ORACLE_SQL[query]})"


#: Blocks of the unified report: the query, what names a row, and its figure.
REPORT = [
    ("youtube", "viral_coverage", "content_id", "coverage"),
    ("x", "viral_ratio", "content_id", "ratio"),
    ("telegram", "viral_baseline", "content_id", "ratio"),
    ("products", "viral_products", "content_id", "place"),
    ("topics", "topic_board", "topic", "n"),
    ("rising", "rising_contents", "content_id", "per_day"),
    ("growth", "comment_leaders", "content_id", "per_day"),
    ("viral_window", "viral_window_stats", "name", "n"),
    ("passed_over", "viral_skips", "skip", "n"),
    ("cross_story", "cross_story_members", "story", "members"),
    ("first_movers", "first_mover_ledger", "stage", "share"),
    ("comments", "hot_discussions", "conv_id", "replies"),
    ("dark_horses", "dark_horses", "content_id", "outlier"),
    ("tools", "ai_tools_board", "content_id", "value"),
    ("caveats", "caveat_counters", "name", "part"),
    ("health", "health_panel", "name", "value"),
]


@plan(" UNION ALL ".join(_sql(*block) for block in REPORT))
def unified_report_blocks(spark, d):
    """2.10: all blocks of the unified report as rows: platforms, products, topics, rising, the viral window, what was passed over, cross-platform stories, first movers, comments, dark horses, tools, caveats and health."""
    out = None
    for block, query, item, value in REPORT:
        rows = QUERIES[query](spark, d).select(F.lit(block).alias("block"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
        out = rows if out is None else out.union(rows)
    return out
