"""Feeds, timelines and answers of other sites: written as XML, HTML and JSON from the rows of tables, then read as they come."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.plans.registration import plan
from quarryline.session import table
from quarryline.sources import external, markup


def _turns(spark, d):
    """One text per turn, with a time: conversations begin an hour apart, turns come six hours apart."""
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return rows.withColumn("at", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("conv_id") % 500 * 3600 + F.col("turn") * 21600))


_TURNS = "t AS (SELECT conv_id, turn, MIN(role) AS role, TIMESTAMP '2024-01-01 00:00:00' + TO_SECONDS(CAST(conv_id % 500 * 3600 + turn * 21600 AS BIGINT)) AS at_, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations GROUP BY conv_id, turn)"


@plan(f"""WITH {_TURNS}, s AS (SELECT conv_id, COUNT(*) AS n, MAX(at_) FILTER (k <= 20) AS last_at, COUNT(*) FILTER (k <= 20) AS few, (EPOCH(MAX(at_) FILTER (k <= 20)) - EPOCH(MIN(at_) FILTER (k <= 20))) / 86400 AS days FROM t GROUP BY 1)
SELECT conv_id, 'Talk ' || conv_id || ' & more' AS title, CASE WHEN conv_id % 3 = 0 THEN 'en-us' END AS lang, n AS entries, STRFTIME(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, CAST(CASE WHEN days > 0 THEN ROUND(few / days, 3) ELSE few END AS DOUBLE) AS per_day FROM s""")
def feed_summaries(spark, d):
    """Title, language, entries, last entry and frequency of feeds; every conversation is a feed, of every second kind (RSS, Atom)."""
    rss = F.concat(F.lit("<item><title>"), "role", F.lit("</title><pubDate>"), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), "role", F.lit("</title><updated>"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    item = F.when(F.col("conv_id") % 2 == 0, rss).otherwise(atom)
    feeds = _turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("xml")))).alias("items"))
    items = F.array_join(F.transform("items", lambda x: x["xml"]), "\n")
    name = F.concat(F.lit("<title>Talk "), "conv_id", F.lit(" &amp; more</title>"))
    lang = F.col("conv_id") % 3 == 0
    as_rss = F.concat(F.lit("<rss><channel>"), name, F.when(lang, "<language>en-us</language>").otherwise(""), items, F.lit("</channel></rss>"))
    as_atom = F.concat(F.when(lang, '<feed xml:lang="en-us">').otherwise("<feed>"), name, items, F.lit("</feed>"))
    bodies = feeds.select("conv_id", F.when(F.col("conv_id") % 2 == 0, as_rss).otherwise(as_atom).alias("body"))
    found = markup.feed_summary(bodies, "body", ["conv_id"])
    return found.select("conv_id", "title", "lang", F.col("entries").cast("long").alias("entries"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), "per_day")


@plan(f"""WITH {_TURNS} SELECT conv_id AS page, CAST(conv_id * 1000 + turn AS VARCHAR) AS external_id, CASE WHEN turn % 3 = 1 THEN 'RT @bob: ' ELSE '' END || role || ' says "hi"' AS text, CASE WHEN turn % 2 = 0 THEN turn * 10 END AS likes, turn AS reposts, conv_id AS replies, 'en' AS lang,
'ann' || conv_id AS handle, turn % 3 = 1 AS is_repost, k = 1 AS pinned FROM t WHERE role <> 'system'""")
def timeline_posts(spark, d):
    """Posts of the timelines that pages carry, with the pinned one and reposts marked; every conversation is a page."""
    text = F.concat(F.when(F.col("turn") % 3 == 1, "RT @bob: ").otherwise(""), "role", F.lit(' says "hi"'))
    tweet = F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id_str"), text.alias("full_text"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 10).alias("favorite_count"),
        F.col("turn").alias("retweet_count"), F.col("conv_id").alias("reply_count"), F.lit("en").alias("lang"), F.struct(F.concat(F.lit("Ann"), "conv_id").alias("screen_name")).alias("user"),
    )
    entry = F.struct("turn", F.when(F.col("role") == "system", "cursor").otherwise("tweet").alias("type"), F.struct(tweet.alias("tweet")).alias("content"))
    pages = _turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct("entries").alias("timeline")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>"))
    return markup.timeline_posts(pages.select(F.col("conv_id").alias("page"), html.alias("html")), "html", ["page"])


_NOW = "2024-01-30 12:00:00"


@plan(f"""WITH s AS (SELECT *, CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '{_NOW}' - TO_HOURS(CAST(doc_id % 97 AS INT)) END AS at_ FROM documents), r AS (
SELECT 'hackernews' AS platform, 'Show & tell: ' || source AS title, 'https://news.ycombinator.com/item?id=' || doc_id AS url, n_chars AS score, doc_id % 7 AS comments, at_ FROM s WHERE doc_id % 4 = 0
UNION ALL SELECT 'github', source || '/tool: does ' || lang, 'https://github.com/' || source, n_chars, NULL, at_ FROM s WHERE doc_id % 4 = 1
UNION ALL SELECT 'producthunt', 'Product ' || doc_id, 'https://p.example/' || doc_id, NULL, NULL, at_ FROM s WHERE doc_id % 4 = 2
UNION ALL SELECT 'huggingface', 'my ' || lang || ' model', 'https://huggingface.co/' || source || '/my-' || lang || '_model', n_chars, NULL, at_ FROM s WHERE doc_id % 4 = 3)
SELECT platform, title, url, score, comments, STRFTIME(at_, '%Y-%m-%d %H:%M:%S') AS published_at FROM r WHERE at_ IS NULL OR at_ >= TIMESTAMP '{_NOW}' - INTERVAL 48 HOUR""")
def external_news(spark, d):
    """News of four sites from answers in their formats, one a document, of the last 48 hours and those without a time."""
    at = F.when(F.col("doc_id") % 10 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - F.col("doc_id") % 97 * 3600))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, d, "documents").withColumns({"at": iso, "id": F.col("doc_id").cast("string")})
    one = lambda k: rows.filter(F.col("doc_id") % 4 == k)
    json = lambda s, name=None: F.to_json(F.struct(F.array(s).alias(name)) if name else F.array(s)).alias("body")
    hit = F.struct(F.col("id").alias("objectID"), F.concat(F.lit("Show &amp; tell: "), "source").alias("title"), F.col("n_chars").alias("points"), (F.col("doc_id") % 7).alias("num_comments"), F.col("at").alias("created_at"))
    tool = F.struct(F.concat("source", F.lit("/tool")).alias("full_name"), F.concat(F.lit("does <b>"), "lang", F.lit("</b>")).alias("description"), F.concat(F.lit("https://github.com/"), "source").alias("html_url"), F.col("n_chars").alias("stargazers_count"), F.col("at").alias("created_at"))
    entry = F.concat(F.lit("<feed><entry><title>Product "), "id", F.lit('</title><link rel="alternate" href="https://p.example/'), "id", F.lit('"/>'), F.coalesce(F.concat(F.lit("<published>"), "at", F.lit("</published>")), F.lit("")), F.lit("</entry></feed>"))
    model = F.struct(F.concat("source", F.lit("/my-"), "lang", F.lit("_model")).alias("id"), F.col("n_chars").alias("trendingScore"), F.col("at").alias("createdAt"))
    found = external.hackernews(one(0).select(json(hit, "hits")), "body").union(external.github(one(1).select(json(tool, "items")), "body"))
    found = found.union(external.atom(one(2).select(entry.alias("body")), "body", "producthunt")).union(external.models(one(3).select(json(model)), "body"))
    recent = external.within(found, F.lit(_NOW).cast("timestamp"))
    return recent.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
