"""RSS, HTML and embedded JSON as columns: built-in XML, JSON and pattern functions, no parser of one's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.times import parse_any

ITEM = "title string, link string, guid string, pubDate string, description string, author string"


def rss_items(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """One row per item of each feed; broken feeds have none."""
    items = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)(<item(?:\s[^>]*)?>.*?</item>)"), 1)
    parsed = df.select(*keep, F.posexplode(items).alias("pos", "__xml")).withColumn("__item", F.from_xml("__xml", ITEM))
    return parsed.select(*keep, "pos", "__item.*")


def _feed_date(c: Column) -> Column:
    """A time as feeds write it: day, month's name, year, clock and zone, or ISO."""
    mail = F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} (?:[+-][0-9]{4}|GMT|UTC|Z))", 1)
    zoned = F.regexp_replace(mail, "(?:GMT|UTC|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(F.nullif(zoned, F.lit("")), F.lit("d MMM yyyy HH:mm:ss Z")), parse_any(c))


def feed_summary(df: DataFrame, body: str, keep: list[str], recent: int = 20) -> DataFrame:
    """Title, language, number of entries, last entry and entries a day of each feed, RSS or Atom; the last two from its first ``recent`` entries."""
    text = F.coalesce(F.col(body), F.lit(""))
    head = F.regexp_replace(text, r"(?s)<(?:item|entry)[\s>].*$", "")
    entries = F.slice(F.regexp_extract_all(text, F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), 1), 1, recent)
    part = lambda e, tag: F.nullif(F.regexp_extract(e, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))
    dated = F.array_compact(F.transform(entries, lambda e: _feed_date(F.coalesce(part(e, "pubDate"), part(e, "updated"), part(e, "published")))))
    days = (F.unix_timestamp(F.array_max("__d")) - F.unix_timestamp(F.array_min("__d"))) / 86400
    lang = F.coalesce(F.nullif(F.regexp_extract(head, r"<language>\s*([a-zA-Z-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r'<feed[^>]*xml:lang="([^"]+)"', 1), F.lit("")))
    summed = df.withColumn("__d", dated)
    return summed.select(
        *keep,
        plain_text(F.regexp_extract(head, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        lang.alias("lang"),
        F.regexp_count(text, F.lit(r"<(?:item|entry)[\s>]")).alias("entries"),
        F.array_max("__d").alias("last_at"),
        F.when(F.size("__d") == 0, 0.0).when(days > 0, F.round(F.size("__d") / days, 3)).otherwise(F.size("__d").cast("double")).alias("per_day"),
    )


def plain_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; the five named entities resolved, blanks single."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</?(?:b|i|em|strong|a|span)(?:\s[^>]*)?>", ""), "(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title(html: Column) -> Column:
    return plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]+)"', 1), F.lit(""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)


def paragraphs(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """One row per paragraph that has text, with its place."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=<p[\s>]|</p>|</article>|$)"), 1)
    return df.select(*keep, F.posexplode(blocks).alias("pos", "__p")).select(*keep, "pos", plain_text(F.col("__p")).alias("text")).filter("text <> ''")


def alternate_feeds(html: Column) -> Column:
    """Addresses of the feeds that a page names in <link rel="alternate">."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)(<link[^>]*rel="alternate"[^>]*>)'), 1)
    feeds = F.filter(tags, lambda t: t.rlike(r"(?i)type=\"application/(?:rss|atom)\+xml\""))
    return F.transform(feeds, lambda t: F.regexp_extract(t, r'(?i)href="([^"]*)"', 1))


def next_data(html: Column) -> Column:
    """The JSON that a page carries in its __NEXT_DATA__ script, as a variant; null where there is none or it is broken."""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    return F.try_parse_json(F.nullif(raw, F.lit("")))


TWEET = "id_str string, full_text string, created_at string, favorite_count long, reply_count long, retweet_count long, user struct<screen_name: string>"


def posts_from_json(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Fields of posts that come as JSON objects; objects without id are left out."""
    parsed = df.select(*keep, F.from_json(body, TWEET).alias("p"))
    return parsed.filter("p.id_str is not null").select(
        *keep, F.col("p.id_str").alias("external_id"), F.lower("p.user.screen_name").alias("handle"), F.col("p.full_text").alias("text"),
        F.col("p.favorite_count").alias("likes"), F.col("p.reply_count").alias("replies"), F.col("p.retweet_count").alias("reposts"), F.col("p.created_at").alias("created_at"),
    )


def timeline_posts(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Posts of the timeline that a page carries as JSON: the first entry is the pinned one, texts that begin with RT @ are reposts; entries of other types are left out."""
    entries = F.try_variant_get(next_data(F.col(html)), "$.props.pageProps.timeline.entries", "array<variant>")
    each = df.select(*keep, F.posexplode(entries).alias("pos", "__e"))
    field = lambda path, kind: F.try_variant_get("__e", path, kind)
    kind, id_ = field("$.type", "string"), F.coalesce(field("$.content.tweet.id_str", "string"), field("$.content.tweet.id", "string"))
    text = F.coalesce(field("$.content.tweet.full_text", "string"), field("$.content.tweet.text", "string"), F.lit(""))
    counts = {"likes": "favorite_count", "reposts": "retweet_count", "replies": "reply_count"}
    rows = each.filter((F.coalesce(kind, F.lit("tweet")).isin("tweet", "")) & field("$.content.tweet", "variant").isNotNull())
    return rows.select(
        *keep, id_.alias("external_id"), text.alias("text"), *(field(f"$.content.tweet.{v}", "long").alias(k) for k, v in counts.items()), field("$.content.tweet.lang", "string").alias("lang"),
        F.lower(field("$.content.tweet.user.screen_name", "string")).alias("handle"), text.startswith("RT @").alias("is_repost"), (F.col("pos") == 0).alias("pinned"),
    )
