"""News of other sites from saved answers: JSON of searches and Atom feeds as rows of one shape; fetching them is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import times
from quarryline.sources.markup import plain_text

COLUMNS = ["platform", "title", "url", "score", "comments", "published_at"]


def _row(platform: str, title: Column, url: Column, score=None, comments=None, published=None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(platform).alias("platform"), title.alias("title"), url.alias("url"), (null if score is None else score).cast("long").alias("score"),
        (null if comments is None else comments).cast("long").alias("comments"), (null if published is None else times.parse_any(published)).cast("timestamp").alias("published_at"),
    )


def _rows(df: DataFrame, items: Column, row) -> DataFrame:
    """One row per item that has a title; broken answers have no items."""
    found = df.select(F.explode(F.transform(items, row)).alias("r")).select("r.*")
    return found.filter(F.coalesce("title", F.lit("")) != "")


def hackernews(df: DataFrame, body: str) -> DataFrame:
    hits = F.from_json(body, "hits array<struct<objectID: string, title: string, url: string, points: long, num_comments: long, created_at: string>>")["hits"]
    place = lambda h: F.coalesce(F.concat(F.lit("https://news.ycombinator.com/item?id="), h["objectID"]), h["url"])
    return _rows(df, hits, lambda h: _row("hackernews", plain_text(h["title"]), place(h), h["points"], h["num_comments"], h["created_at"]))


def github(df: DataFrame, body: str) -> DataFrame:
    items = F.from_json(body, "items array<struct<full_name: string, name: string, description: string, html_url: string, stargazers_count: long, created_at: string>>")["items"]

    def row(r: Column) -> Column:
        name, told = F.coalesce(r["full_name"], r["name"], F.lit("")), plain_text(r["description"])
        return _row("github", F.when(told != "", F.concat(name, F.lit(": "), told)).otherwise(name), r["html_url"], r["stargazers_count"], None, r["created_at"])

    return _rows(df, items, row)


def atom(df: DataFrame, body: str, platform: str) -> DataFrame:
    """Entries of an Atom feed; the address is the link's, else the entry's id."""
    entries = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)<entry[^>]*>(.*?)</entry>"), 1)
    part = lambda e, pattern: F.nullif(F.regexp_extract(e, pattern, 1), F.lit(""))
    url = lambda e: F.coalesce(part(e, r'(?s)<link[^>]*href="([^"]+)"'), part(e, r"(?s)<id>(.*?)</id>"))
    return _rows(df, entries, lambda e: _row(platform, plain_text(F.regexp_extract(e, r"(?s)<title[^>]*>(.*?)</title>", 1)), url(e), None, None, part(e, r"(?s)<published>(.*?)</published>")))


def models(df: DataFrame, body: str) -> DataFrame:
    items = F.from_json(body, "array<struct<id: string, trendingScore: long, createdAt: string>>")
    name = lambda i: F.trim(F.translate(F.regexp_replace(i, "^[^/]*/", ""), "-_", "  "))
    return _rows(df, items, lambda m: _row("huggingface", name(m["id"]), F.concat(F.lit("https://huggingface.co/"), m["id"]), m["trendingScore"], None, m["createdAt"]))


def papers(df: DataFrame, body: str) -> DataFrame:
    items = F.from_json(body, "array<struct<title: string, publishedAt: string, paper: struct<id: string, title: string, upvotes: long, publishedAt: string>>>")
    place = lambda p: F.concat(F.lit("https://huggingface.co/papers/"), p["paper"]["id"])
    return _rows(df, items, lambda p: _row("huggingface", plain_text(F.coalesce(p["paper"]["title"], p["title"])), place(p), p["paper"]["upvotes"], None, F.coalesce(p["paper"]["publishedAt"], p["publishedAt"])))


def within(items: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Items of the last hours; those without a time stay."""
    return items.filter(F.col("published_at").isNull() | (times.hours_between(F.col("published_at"), now) <= hours))
