"""Boards, tiers of novelties, samples and migrations of several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions import urls
from quarryline.operators import boards, upsert
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, ORDERS_NOW, SOURCES, contents, sources
from quarryline.session import table

_WINDOW = f"day > DATE '{ORDERS_NOW}' - 90 AND day <= DATE '{ORDERS_NOW}' AND status <> 'P'"
_STORY = f"(SELECT c.*, platform, tier, DATE_TRUNC('week', day) AS week FROM {CONTENTS} c JOIN {SOURCES} s USING (source_id) WHERE {_WINDOW})"


def _members(spark, d) -> DataFrame:
    now = F.lit(ORDERS_NOW).cast("date")
    rows = contents(spark, d).join(sources(spark, d).select("source_id", "platform", "tier"), "source_id")
    return boards.in_window(rows, "day", F.date_sub(now, 89), now, F.col("status") != "P").withColumn("story", F.concat_ws("|", "topic", F.date_format(F.trunc("day", "week"), "yyyy-MM-dd")))


@plan(f"""SELECT topic || '|' || STRFTIME(week, '%Y-%m-%d') AS story, COUNT(*) AS posts, COUNT(DISTINCT source_id) AS xconf, COUNT(DISTINCT platform) AS platforms, ARG_MIN(source_id, [EPOCH_MS(CAST(day AS TIMESTAMP)), content_id]) AS first_author,
  COUNT(DISTINCT source_id) = 1 AND COUNT(*) FILTER (tier = 'BUILDING') = 0 AS is_single FROM {_STORY} GROUP BY topic, week""")
def story_confirmations(spark, d):
    """C4: stories of a window: only posts with a verdict, the independent authors who confirm each, its first author, and whether one author stands alone without a source that counts as proof."""
    out = boards.confirmations(_members(spark, d), "story", "source_id", "platform", "day", "content_id", F.col("tier") == "BUILDING")
    return out.select("story", "posts", "xconf", "platforms", "first_author", "is_single")


@plan(f"""WITH s AS (SELECT topic || '|' || STRFTIME(week, '%Y-%m-%d') AS story, COUNT(*) AS posts, COUNT(DISTINCT source_id) AS xconf, COUNT(DISTINCT platform) AS platforms FROM {_STORY} GROUP BY topic, week)
SELECT story, posts, xconf, platforms FROM s WHERE xconf >= 2 ORDER BY platforms DESC, xconf DESC, posts DESC, story LIMIT 20""")
def story_board(spark, d):
    """C17: the stories that most platforms and authors confirm."""
    found = boards.confirmations(_members(spark, d), "story", "source_id", "platform", "day", "content_id", F.lit(False)).filter("xconf >= 2")
    return found.orderBy(F.desc("platforms"), F.desc("xconf"), F.desc("posts"), "story").limit(20).select("story", "posts", "xconf", "platforms")


@plan("""WITH h AS (SELECT page_id, LOWER(REGEXP_EXTRACT(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1)) AS host FROM pages) SELECT host, COUNT(*) AS pages FROM h GROUP BY 1 ORDER BY pages DESC, host LIMIT 20""")
def tool_board(spark, d):
    """C17: the hosts that most pages are of."""
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "host").limit(20)


@plan(f"""WITH n AS (SELECT topic || ' ' || tier AS name, COUNT(DISTINCT source_id) AS authors, COUNT(DISTINCT platform) AS platforms, MIN(day) AS first_day FROM {CONTENTS} JOIN {SOURCES} USING (source_id) WHERE views > 400000 GROUP BY 1),
x AS (SELECT DISTINCT topic || ' ' || tier AS name FROM {CONTENTS} JOIN {SOURCES} USING (source_id) WHERE source_id % 9 = 0 AND status = 'P')
SELECT name, CASE WHEN authors >= 3 AND platforms >= 2 THEN 'strict' WHEN name IN (SELECT name FROM x) THEN 'external' WHEN authors >= 2 THEN 'weak' ELSE 'single' END AS tier FROM n WHERE first_day > DATE '1995-02-01'""")
def novelty_tiers(spark, d):
    """New names by how they are confirmed: by several authors and platforms, by news of other sites, by two authors, or by one."""
    rows = contents(spark, d).join(sources(spark, d).select("source_id", "platform", "tier"), "source_id").withColumn("name", F.concat_ws(" ", "topic", "tier"))
    external = rows.filter("source_id % 9 = 0 and status = 'P'").select("name")
    return boards.novelty_tiers(rows.filter("views > 400000"), "name", "source_id", "platform", "day", F.lit("1995-02-01").cast("date"), external)


@plan("""WITH w AS (SELECT lang, UNNEST(LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(SPLIT_PART(text, chr(10), 1)), '[\\p{L}\\p{N}_]+'), lambda x: LENGTH(x) >= 4))) AS word FROM documents), c AS (SELECT lang, word, COUNT(*) AS n FROM w GROUP BY 1, 2)
SELECT lang, word, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM c) WHERE k <= 15""")
def top_title_words(spark, d):
    """The most frequent words of titles per group."""
    words = F.array_distinct(F.filter(T.words(F.split_part("text", F.lit("\n"), F.lit(1))), lambda w: F.length(w) >= 4))
    return boards.top_values(table(spark, d, "documents"), "lang", words, "word", 15)


@plan(f"""WITH b AS (SELECT *, CASE WHEN views < 50000 THEN 'under 50k' WHEN views < 100000 THEN '50-100k' WHEN views < 200000 THEN '100-200k' ELSE 'over 200k' END AS bucket FROM {CONTENTS} WHERE views IS NOT NULL)
SELECT bucket, COUNT(*) AS n, CAST(MEDIAN(content_id) AS DOUBLE) AS median FROM b GROUP BY 1""")
def value_buckets(spark, d):
    """A measure in buckets with the median of another, as durations and views."""
    borders = [(50_000, "under 50k"), (100_000, "50-100k"), (200_000, "100-200k")]
    return boards.bucketed(contents(spark, d), F.col("views"), borders, "over 200k").groupBy("bucket").agg(F.count("*").alias("n"), F.median("content_id").alias("median"))


@plan("""WITH m AS (SELECT 'os' AS db, c_custkey AS id, c_custkey * 10 + 1 AS new_id FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'x', s_suppkey, s_suppkey * 10 + 2 FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'tg', p_partkey, p_partkey * 10 + 3 FROM part),
r AS (SELECT 'os' AS db, c_custkey AS id FROM customer UNION ALL SELECT 'x', s_suppkey FROM supplier UNION ALL SELECT 'tg', p_partkey FROM part)
SELECT r.db, COUNT(*) AS rows_, COUNT(new_id) AS mapped, COUNT(*) - COUNT(new_id) AS unmapped, CAST(COALESCE(SUM(new_id), 0) AS BIGINT) AS checksum FROM r LEFT JOIN m ON m.db = r.db AND m.id = r.id GROUP BY r.db""")
def migrated_databases(spark, d):
    """Three databases under one map of keys, with what the map does not know."""
    parts = [("os", "customer", "c_custkey", 7, 1), ("x", "supplier", "s_suppkey", 3, 2), ("tg", "part", "p_partkey", None, 3)]
    rows = reduce(DataFrame.union, (table(spark, d, t).select(F.lit(db).alias("db"), F.col(k).alias("id")) for db, t, k, _, _ in parts))
    known = reduce(
        DataFrame.union,
        (table(spark, d, t).filter(F.col(k) % gap != 0 if gap else F.lit(True)).select(F.lit(db).alias("db"), F.col(k).alias("id"), (F.col(k) * 10 + n).alias("new_id")) for db, t, k, gap, n in parts),
    )
    mapped, missing = upsert.migrate_all(rows, known, ["db", "id"], "new_id")
    found = mapped.groupBy("db").agg(F.count("*").alias("mapped"), F.sum("new_id").alias("checksum"))
    lost = missing.groupBy("db").agg(F.count("*").alias("unmapped"))
    joined = rows.groupBy("db").agg(F.count("*").alias("rows_")).join(found, "db", "left").join(lost, "db", "left")
    return joined.select("db", "rows_", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"), F.coalesce("checksum", F.lit(0)).alias("checksum"))


@plan("""SELECT p_partkey, TRIM('  ' || p_name || ' ') AS trimmed, LENGTH(p_name) AS n, LOWER(p_type) AS lower_, REPLACE(p_name, ' ', '_') AS replaced, SUBSTRING(p_name, 2, 3) AS part, INSTR(p_type, 'STEEL') AS place, p_type LIKE '%STEEL' AS ends, p_type ILIKE 'promo%' AS begins,
  p_brand GLOB 'Brand#[1-3]*' AS globbed, p_brand || '/' || p_type AS joined FROM part""")
def text_functions(spark, d):
    """trim, length, lower, replace, substr, instr, like, glob and concatenation."""
    p, name, kind = table(spark, d, "part"), F.col("p_name"), F.col("p_type")
    return p.select(
        "p_partkey", F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.length(name).alias("n"), F.lower(kind).alias("lower_"), F.replace(name, F.lit(" "), F.lit("_")).alias("replaced"), F.substring(name, 2, 3).alias("part"),
        F.instr(kind, "STEEL").alias("place"), kind.like("%STEEL").alias("ends"), kind.ilike("promo%").alias("begins"), F.col("p_brand").rlike("^Brand#[1-3]").alias("globbed"), F.concat("p_brand", F.lit("/"), kind).alias("joined"),
    )
