"""Rules over hand-made rows, one row per branch and border: inputs, and what must come of them. tests/test_rule_cases.py runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import scores as S
from quarryline.functions import text as T
from quarryline.functions import urls
from quarryline.operators import blocks as B
from quarryline.operators import queues as K
from quarryline.operators import ranking as R
from quarryline.operators import verdicts as V
from quarryline.sources import external, markup

Query = Callable[[SparkSession, str], DataFrame]
CASES: dict[str, tuple[Query, str]] = {}


def plan(sql: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        assert query.__name__ not in CASES
        CASES[query.__name__] = (query, sql)
        return query

    return register


def _hand_made(spark, text: str):
    return spark.sql(f"SELECT * FROM {text}")


def literal(columns: str, rows: list[tuple]) -> str:
    """Hand-made rows as a table that both engines read; whole numbers are BIGINT, others DOUBLE."""

    def written(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, (int, float)):
            return f"CAST({value!r} AS {'BIGINT' if isinstance(value, int) else 'DOUBLE'})"
        return "'" + str(value).replace("'", "''") + "'"

    body = ",\n  ".join("(" + ", ".join(map(written, row)) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"


def cases(inputs: str, outputs: str, rows: list[tuple]) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """A case over hand-made rows; ``rows`` hold the inputs and what must come of them.

    The function gets the rows of the inputs and adds the outputs.
    """
    n = len(inputs.split(","))

    def register(function: Callable[[DataFrame], DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            given = spark.sql(f"SELECT * FROM {literal(inputs, [row[:n] for row in rows])}")
            return function(given).select(*(c.strip() for c in f"{inputs},{outputs}".split(",")))

        query.__name__, query.__doc__ = function.__name__, function.__doc__
        return plan(f"SELECT * FROM {literal(f'{inputs}, {outputs}', rows)}")(query)

    return register


NOW = "2024-01-31 00:00:00"


@cases("id, is_ad, status, flood_until", "honest", [
    (1, None, None, None, True),
    (2, True, "active", None, False),
    (3, False, "flooded", None, False),
    (4, False, "active", "2024-02-01 00:00:00", False),
    (5, False, "active", "2024-01-31 00:00:00", True),
    (6, False, "active", "2024-01-01 00:00:00", True),
])
def honest_posts(rows):
    """Not paid, source not flooded, flood window over."""
    return rows.withColumn("honest", V.honest(F.col("is_ad"), F.col("status"), F.col("flood_until").cast("timestamp"), F.lit(NOW).cast("timestamp")))


@cases("id, is_retweet, pinned, deleted_at, metrics_src", "left_out", [
    (1, None, None, None, None, False),
    (2, True, None, None, None, True),
    (3, None, True, None, None, True),
    (4, None, None, "2024-01-01", None, True),
    (5, None, None, None, "cdn_rt", True),
    (6, False, False, None, "cdn", False),
])
def excluded_posts(rows):
    """Reposts, pinned, deleted, and numbers of a repeated post."""
    return rows.withColumn("left_out", V.left_out(F.col("is_retweet"), F.col("pinned"), F.col("deleted_at"), F.col("metrics_src")))


@cases("id, status, promo_source, text", "reason", [
    (1, "active", False, "calm words", None),
    (2, None, None, None, None),
    (3, "candidate", True, "скидка", "candidate"),
    (4, "dead", True, "скидка", "status"),
    (5, "Provisional", True, "скидка", "promo_source"),
    (6, "active", False, "скидка", "ad"),
])
def quality_skips(rows):
    """Why a post is passed over, the first reason that holds."""
    return rows.withColumn("reason", V.quality_skip(F.col("status"), F.col("promo_source"), T.promo_reason("text").isNotNull()))


@cases("id, is_short, lang, channel_russian, title", "format, russian, looks", [
    (1, 1, "ru", None, "Привет", "short", True, True),
    (2, 0, "en", 1, "hello ё", "long", True, True),
    (3, None, "en", 0, "hello", "long", False, False),
    (4, 2, None, None, None, "long", False, False),
])
def formats_and_languages(rows):
    """Short and long videos, where an unknown format is long; Russian by language or by channel."""
    russian = F.coalesce(F.col("lang") == "ru", F.lit(False)) | (F.coalesce("channel_russian", F.lit(0)) == 1)
    return rows.withColumns({"format": F.when(F.col("is_short") == 1, "short").otherwise("long"), "russian": russian, "looks": T.looks_russian(F.col("title"))})


@cases("id, handles", "has", [
    (1, '["ann","bob"]', True),
    (2, '["anna"]', False),
    (3, "[]", False),
    (4, "broken", False),
    (5, None, False),
])
def handle_in_list(rows):
    """Membership in a list kept as JSON text, by the whole value."""
    return rows.withColumn("has", T.json_list_has(F.col("handles"), "ann"))


@cases("id, known, blocked, outcome, posts30, size", "verdict, reason, status", [
    (1, True, True, "gone", 0, None, "reject", "duplicate", "rejected"),
    (2, False, True, "gone", 0, None, "reject", "blocked", "rejected"),
    (3, False, False, "gone", 9, 5, "reject", "gone", "rejected"),
    (4, False, False, "no_feed", 9, 5, "reject", "no_feed", "rejected"),
    (5, False, False, "unreadable", 9, 5, "reject", "no_feed", "rejected"),
    (6, False, False, "fetch_error", 9, 5, "hold", "no_answer", "hold"),
    (7, None, None, None, 9, 5, "hold", "no_answer", "hold"),
    (8, False, False, "ok", None, 5, "reject", "no_posts_30d", "rejected"),
    (9, False, False, "ok", 2, 5, "hold", "few_posts_30d", "hold"),
    (10, False, False, "ok", 3, None, "hold", "size_unknown", "hold"),
    (11, False, False, "ok", 3, 5, "promote", "posts_and_size", "promoted"),
])
def channel_verdicts(rows):
    """Verdicts on channels of short posts."""
    v = V.channel_verdict(F.col("known"), F.col("blocked"), F.col("outcome"), F.col("posts30"), F.col("size"))
    status = F.create_map(*(F.lit(x) for pair in V.STATUS_OF.items() for x in pair))
    return rows.withColumns({"verdict": v["verdict"], "reason": v["reason"], "status": status[v["verdict"]]})


@cases("id, found, videos30, subs", "verdict, reason", [
    (1, False, 9, 5, "reject", "gone"),
    (2, None, 9, 5, "hold", "no_answer"),
    (3, True, None, 5, "reject", "no_videos_30d"),
    (4, True, 2, 5, "hold", "few_videos_30d"),
    (5, True, 3, None, "hold", "size_unknown"),
    (6, True, 3, 0, "promote", "videos_and_size"),
])
def video_channel_verdicts(rows):
    """Verdicts on video channels."""
    v = V.video_channel_verdict(F.col("found"), F.col("videos30"), F.col("subs"))
    return rows.withColumns({"verdict": v["verdict"], "reason": v["reason"]})


@cases("id, known, blocked, place, outcome, posts30, median_likes", "verdict, reason", [
    (1, True, False, None, "gone", 0, None, "reject", "duplicate"),
    (2, False, True, None, "gone", 0, None, "reject", "blocked"),
    (3, False, False, 3, "ok", 9, 99.0, "hold", "budget"),
    (4, False, False, 2, "gone", 9, 99.0, "reject", "gone"),
    (5, False, False, 1, "protected", 9, 99.0, "reject", "protected"),
    (6, False, False, 1, "budget", 9, 99.0, "hold", "no_answer"),
    (7, False, False, 1, None, 9, 99.0, "hold", "no_answer"),
    (8, False, False, 1, "ok", 0, 99.0, "reject", "no_posts_30d"),
    (9, False, False, 1, "ok", 2, 99.0, "hold", "few_posts_30d"),
    (10, False, False, 1, "ok", 3, 19.9, "hold", "few_likes"),
    (11, False, False, 1, "ok", 3, None, "hold", "few_likes"),
    (12, False, False, 2, "ok", 3, 20.0, "promote", "posts_and_likes"),
])
def account_verdicts(rows):
    """Verdicts on accounts under a budget of two requests."""
    v = V.account_verdict(F.col("known"), F.col("blocked"), F.col("place"), F.lit(2), F.col("outcome"), F.col("posts30"), F.col("median_likes"))
    return rows.withColumns({"verdict": v["verdict"], "reason": v["reason"]})


@cases("id, antifraud, posts, vr_state, vr", "reason, reason_without_vr", [
    (1, 1, 0, "few", None, "antifraud", "antifraud"),
    (2, None, 9, "ok", 5.0, "too_few_posts", "too_few_posts"),
    (3, 0, 10, "few", 5.0, "vr_unknown", None),
    (4, 0, 10, None, 5.0, "vr_unknown", None),
    (5, 0, 10, "ok", 4.9, "vr_low", None),
    (6, 0, 10, "ok", None, "vr_low", None),
    (7, None, 10, "ok", 5.0, None, None),
])
def promotion_reasons(rows):
    """Why a candidate is not promoted, with and without the rate of views."""
    given = [F.col(c) for c in ("antifraud", "posts", "vr_state", "vr")]
    return rows.withColumns({"reason": V.promotion_reason(*given, 10, 5.0), "reason_without_vr": V.promotion_reason(*given, 10, 5.0, need_vr=False)})


@cases("id, size, posts14, has_outlier, blocked, growth", "gate", [
    (1, 999, 3, True, False, 0.5, None),
    (2, 1000, 3, True, False, 0.10, "verified"),
    (3, 4999, 3, True, False, 0.09, None),
    (4, 5000, 3, True, False, 0.03, "verified"),
    (5, 500000, 3, True, False, 0.02, None),
    (6, 500001, 3, True, False, 0.5, None),
    (7, 5000, 2, True, False, 0.5, None),
    (8, 5000, None, True, False, 0.5, None),
    (9, 5000, 3, False, False, 0.5, None),
    (10, 5000, 3, True, True, 0.5, None),
    (11, 5000, 3, True, None, None, "unknown"),
    (12, None, 3, True, False, 0.5, None),
])
def growth_gates(rows):
    """The gates of the author selection."""
    return rows.withColumn("gate", V.growth_gate(F.col("size"), F.col("posts14"), F.col("has_outlier"), F.col("blocked"), F.col("growth")))


@cases("id, title, caps, emoji, description, hashtags, tags, duration, marks, topic", "score, issues, not_applicable", [
    (1, 45, 0.1, 0, 200, 4, 10, 100, 0, 1, 100.0, "", ""),
    (2, 71, 0.6, 4, 100, 0, 0, 480, 0, 0, 52.5, "title_too_long,title_caps,title_emoji,description_no_snippet,hashtags_missing,tags_missing,description_no_chapters,topic_mismatch", ""),
    (3, 61, 0.5, 3, 150, 2, 7, 480, 1, None, 89.4, "title_too_long,hashtags_few,tags_few", "topic"),
    (4, 29, None, None, 0, 9, 13, None, None, None, 72.9, "title_too_short,description_no_snippet,tags_many", "hashtags,chapters,topic"),
    (5, 30, 0.0, 0, 149, 6, 51, 479, 0, 1, 81.5, "description_no_snippet,hashtags_many,tags_spam_risk", ""),
    (6, 60, 0.0, 0, 150, 16, 50, 480, 5, 1, 94.0, "hashtags_over_limit,tags_many", ""),
    (7, None, None, None, None, None, None, None, None, None, 72.9, "title_too_short,description_no_snippet,tags_missing", "hashtags,chapters,topic"),
])
def packaging_cases(rows):
    """The packaging score of a video with its issues and the parts that do not apply."""
    p = S.packaging(*(F.col(c) for c in ("title", "caps", "emoji", "description", "hashtags", "tags", "duration", "marks", "topic")))
    return rows.withColumns({"score": p["score"], "issues": F.array_join(p["issues"], ","), "not_applicable": F.array_join(p["not_applicable"], ",")})


@cases("id, weight, size, mentions", "score", [
    (1, 3.0, 999, 1, 6.0),
    (2, 2.0, None, None, 2.0),
    (3, None, 9, 3, 3.0),
    (4, 1.0, -5, 0, 1.0),
])
def channel_candidate_scores(rows):
    """Where a channel was found, its size, and repeated mentions."""
    return rows.withColumn("score", S.channel_candidate_score(F.col("weight"), F.col("size"), F.col("mentions")))


@cases("id, sources, trusted, first_rubric, found_via, handle", "priority", [
    (1, 4, 2, True, "author:search", "ann", 13.0),
    (2, None, None, None, None, "ann", 1.0),
    (3, 0, 0, False, "mention", "1234567", -1.0),
    (4, 2, 0, False, "orig", "a12345678bcde", 1.0),
])
def account_candidate_priorities(rows):
    """The place of an account in the queue of candidates."""
    from quarryline.functions import urls

    return rows.withColumn("priority", S.account_candidate_priority(F.col("sources"), F.col("trusted"), F.col("first_rubric"), F.col("found_via"), urls.is_spam_handle(F.col("handle"))))


@cases("topic", "weight", [("модели и релизы", 1.4), ("прочее", 0.6), ("запуски и анонсы", 1.0), ("gardening", 1.0), ("", 1.0), (None, 1.0)])
def topic_weights(rows):
    """The weight of a post's topic."""
    return rows.withColumn("weight", S.topic_weight(F.col("topic")))


@cases("text, query", "lang", [
    ("Привет", "lang:en", "ru"),
    ("hello", "x lang:ru", "ru"),
    ("hello", "x lang:en", "en"),
    ("hello", "x", None),
    (None, None, None),
])
def guessed_languages(rows):
    """Cyrillic letters first, then what the search asked for."""
    return rows.withColumn("lang", T.guess_language("text", F.col("query")))


@cases("text, links", "hit", [
    ("New LLM today", None, True),
    ("calm words", "https://huggingface.co/x", True),
    ("calm words", "https://a.b/x", False),
    (None, None, False),
])
def topic_signs(rows):
    """words of a topic in the text, or its hosts in the links."""
    return rows.withColumn("hit", T.shows_topic("text", F.col("links"), ["llm", "нейросет"], ["huggingface.co"]))


@cases("words", "templates", [
    ("a", ""),
    ("a,b", "a: b — {итог одной фразой}|Как a меняет b: {разбор за N минут}|{N} фактов о a и b"),
    ("a,b,c,d", "a: b — {итог одной фразой}|Как a меняет b: {разбор за N минут}|{N} фактов о a и b|a против b: {честное сравнение}"),
    ("a,b,c,d,e", "a: b — {итог одной фразой}|Как a меняет b: {разбор за N минут}|{N} фактов о a и b|a против b: {честное сравнение}|Почему c без a не работает"),
])
def title_template_cases(rows):
    """titles from the most frequent words."""
    return rows.withColumn("templates", F.array_join(T.title_templates(F.split("words", ",")), "|"))


@cases("word", "variants", [("abc", "acb,bac"), ("aa", ""), ("a b", ""), ("ab cd", "ab dc,ba cd"), ("", ""), (None, "")])
def typo_cases(rows):
    """neighbouring letters exchanged, never across a blank."""
    return rows.withColumn("variants", F.array_join(T.typo_variants(F.coalesce("word", F.lit(""))), ","))


@cases("title", "inside, first_word, every_word", [
    ("ZCode beats Gpt-4 today", "gpt-4,zcode", "gpt-4,zcode", "gpt-4,zcode"),
    ("Radius shows Maps", "", "radius", "maps,radius"),
    ("8gb and 4k of it", "", "", ""),
    ("The new Tool", "", "", "tool"),
    (None, "", "", ""),
])
def names_by_capitals(rows):
    """names inside a title, by the three ways to take capitals."""
    named = {out: T.distinctive_names("title", mode) for out, mode in (("inside", "none"), ("first_word", "first"), ("every_word", "all"))}
    return rows.withColumns({k: F.array_join(F.array_sort(v), ",") for k, v in named.items()})


@cases("text", "pieces", [
    ("ab\ncd\nef", "ab\ncd|ef"),
    ("abcdefghij\nk", "abcdefghij|k"),
    ("a\n\nb", "a\n\nb"),
    ("abcd\n  \n", "abcd"),
    ("", ""),
    (None, ""),
])
def text_pieces(rows):
    """Pieces of whole lines, six characters with their ends."""
    return rows.withColumn("pieces", F.array_join(T.split_pieces("text", 6), "|"))


@cases("id, authors, ratios", "suspect", [
    (1, "a,b,c", "0.6,0.7,0.8", True),
    (2, "a,b", "0.6,0.7", False),
    (3, "a,b,c", "0.6,0.5,0.8", False),
    (4, "a,b,c", "0.6,,0.8", False),
])
def suspect_stories(rows):
    """C4: stories of authors who all repeat texts."""
    ratios = F.transform(F.split("ratios", ","), lambda x: F.nullif(x, F.lit("")).try_cast("double"))
    return rows.withColumn("suspect", B.is_suspect(F.split("authors", ","), ratios))


@cases("title, tags, published", "emoji, n_tags, hour, weekday", [
    ("🎁 plain ✅", '["a","b"]', "2024-01-01 21:30:00", 2, 2, 0, 2),
    ("none", "[]", "2024-01-07 00:00:00", 0, 0, 3, 7),
    ("", "broken", None, 0, 0, None, None),
    (None, None, "2024-01-06 20:59:59", 0, 0, 23, 6),
])
def title_details(rows):
    """emoji, tags, and the hour and weekday (Monday is 1) of a zone three hours ahead."""
    local = F.from_utc_timestamp(F.col("published").cast("timestamp"), "Europe/Moscow")
    tags = F.size(F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")))
    return rows.withColumns({"emoji": T.title_emoji("title").cast("long"), "n_tags": tags.cast("long"), "hour": F.hour(local).cast("long"), "weekday": (F.weekday(local) + 1).cast("long")})


@cases("text", "reason, origin", [
    ("Скидка 20 % только сегодня", "marker", "original"),
    ("нескидка", None, "original"),
    ("Промокод внутри", "marker", "original"),
    ("жмите сюда", "marker", "original"),
    ("Реклама: новый сервис", "marker", "original"),
    ("Воркфлоу рекламы Firefox", None, "original"),
    ("a giveaway today", "marker", "original"),
    ("employer-sponsored insurance", None, "original"),
    ("sponsored by Acme", "marker", "original"),
    ("the referral of Iran", None, "original"),
    ("referral link below", "marker", "original"),
    ("скачай https://a.b/c?x=1&REF=2", "call_link", "original"),
    ("скачай https://a.b?ref=2", None, "original"),
    ("скачай https://a.b/c?refer=2", None, "original"),
    ("смотри https://a.b/c?ref=2", None, "original"),
    ("оформи t.me/some_bot", "call_link", "original"),
    ("КУПИ СЕЙЧАС ЛУЧШИЙ ТЕЛЕФОН https://a.b/c", "caps", "original"),
    ("КУПИ СЕЙЧАС ЛУЧШИЙ ТЕЛЕФОН", None, "original"),
    ("КУПИ ТУТ https://a.b/c", None, "original"),
    ("купи 🎁🎁🎁🎁🎁 https://a.b/c", "emoji", "original"),
    ("купи 🎁🎁🎁🎁 https://a.b/c", None, "original"),
    ("новости 🎁🎁🎁🎁🎁 https://a.b/c", None, "original"),
    ("По материалам газеты", None, "retelling"),
    ("Источник: газета", None, "retelling"),
    ("news via @someone", None, "retelling"),
    ("https://a.b/c - смотрите", None, "retelling"),
    ("https://a.b/c\n\nдлинный собственный текст после первого абзаца", None, "retelling"),
    ("https://a.b/c и ещё много собственных слов автора в том же первом абзаце поста", None, "original"),
    ("@ann https://a.b/c", None, "retelling"),
    ("", None, "original"),
    (None, None, "original"),
])
def promo_cases(rows):
    """The first sign of a paid post and whose the text is, one row per rule and border."""
    return rows.withColumns({"reason": T.promo_reason("text"), "origin": T.origin("text")})


@cases("url", "kind, platform, value, cleaned, competitor, skip", [
    (None, None, None, None, None, 0, "bad_url"),
    ("  ", None, None, None, None, 0, "bad_url"),
    ("https://bit.ly/x", None, None, None, None, 0, "skip_host"),
    ("https://docs.google.com/d", None, None, None, None, 0, "skip_host"),
    ("https://telegram.org/faq", None, None, None, None, 0, "skip_host"),
    ("https://nitter.net/ann", None, None, None, None, 0, "skip_host"),
    ("https://google.com/a", "domain", "web", "google.com", "https://google.com/a", 0, None),
    ("https://x.com/", None, None, None, None, 0, "no_target"),
    ("https://X.com/@Ann", "account", "x", "ann", None, 0, None),
    ("https://m.twitter.com/Search?q=1", None, None, None, None, 0, "service_path"),
    ("https://twitter.com/ann/status/12", None, None, None, None, 0, "service_path"),
    ("https://twitter.com/a-b", None, None, None, None, 0, "no_target"),
    ("https://x.com/sixteen_letters_", None, None, None, None, 0, "no_target"),
    ("t.me/s/Some_Channel", "channel", "telegram", "some_channel", None, 0, None),
    ("https://t.me/Abc/12", "channel", "telegram", "abc", None, 0, None),
    ("https://t.me/+secret", None, None, None, None, 0, "invite"),
    ("https://t.me/s", None, None, None, None, 0, "no_target"),
    ("https://telegram.dog/ab", None, None, None, None, 0, "no_target"),
    ("https://youtu.be/abcDEF", "video", "youtube", "abcDEF", None, 0, None),
    ("https://youtu.be/abc", None, None, None, None, 0, "no_target"),
    ("https://piped.video/watch?t=1&v=abcdefghijk", "video", "youtube", "abcdefghijk", None, 0, None),
    ("https://youtube.com/watch?v=abc", None, None, None, None, 0, "no_target"),
    ("https://www.youtube.com/shorts/abcdef_-1", "video", "youtube", "abcdef_-1", None, 0, None),
    ("https://youtube.com/shorts/abc?v=abcdefgh", None, None, None, None, 0, "no_target"),
    ("https://youtube.com/live?v=abcdefgh", "video", "youtube", "abcdefgh", None, 0, None),
    ("https://youtube.com/channel/UC0123456789abcdefABCD", "channel", "youtube", "UC0123456789abcdefABCD", None, 0, None),
    ("https://youtube.com/channel/UCshort", None, None, None, None, 0, "service_path"),
    ("https://youtube.com/user/Some.One/videos", "channel", "youtube", "some.one", None, 0, None),
    ("https://youtube.com/playlist?list=PL1", None, None, None, None, 0, "service_path"),
    ("https://m.youtube.com/@Some.One", "channel", "youtube", "some.one", None, 0, None),
    ("https://youtube.com/", None, None, None, None, 0, "no_target"),
    ("https://youtube.com/x", None, None, None, None, 0, "no_target"),
    ("https://user@WWW.Rutube.ru:80/v?utm_source=a&id=1&yclid=2#top", "domain", "web", "rutube.ru", "https://user@WWW.Rutube.ru:80/v?id=1#top", 1, None),
    ("news.org/a?b&REF=1", "domain", "web", "news.org", "http://news.org/a?b=", 0, None),
])
def link_target_cases(rows):
    """typed targets and reasons of literal links, one row per rule and border."""
    t = urls.target(F.col("url"))
    found = rows.withColumn("t", t)
    named = {"kind": "kind", "platform": "platform", "value": "value", "cleaned": "url", "competitor": "competitor", "skip": "skip"}
    return found.withColumns({new: F.col("t").getField(old) for new, old in named.items()}).withColumn("competitor", F.col("competitor").cast("long"))


_LONG = "x" * 281


@cases("id, deleted_at, text_src, attempts, is_long, text", "needed", [
    (1, None, None, None, 1, "short", True),
    (2, None, None, None, 1, _LONG, False),
    (3, None, "cdn", 0, 0, _LONG, True),
    (4, None, "fxtwitter", 0, 1, "short", False),
    (5, None, "cdn", 3, 1, "short", False),
    (6, "2024-01-01", "cdn", 0, 1, "short", False),
    (7, None, None, 2, 1, None, True),
    (8, None, None, 0, 0, "short", False),
])
def full_text_needed(rows):
    """Posts whose text was cut."""
    return rows.withColumn("needed", K.needs_full_text(*(F.col(c) for c in ("deleted_at", "text_src", "attempts", "is_long", "text"))))


_LOG = literal("id, run_id, platform", [(1, 10, None), (2, 11, None), (3, None, None), (4, None, None), (5, None, None), (6, 10, "web"), (7, 99, None)])


_RUNS = literal("run_id, platform", [(10, "x"), (11, None)])


_LEGACY = literal("id, legacy_db", [(2, "tg"), (3, "os"), (4, "x"), (6, "os"), (7, "news")])


@plan(f"SELECT * FROM {literal('id, platform', [(1, 'x'), (2, 'telegram'), (3, 'youtube'), (4, 'x'), (5, None), (6, 'web'), (7, 'news')])}")
def filled_platforms(spark, d):
    """The platform of log rows, by their run, then by where they came from."""
    return K.filled_platforms(_hand_made(spark, _LOG), _hand_made(spark, _RUNS), _hand_made(spark, _LEGACY)).select("id", "platform")


@cases("id, platform, external_id, url, author_handle, source_handle", "filled", [
    (1, "x", "12", None, "ann", "feed", "https://x.com/ann/status/12"),
    (2, "x", "12", "", "  ", "feed", "https://x.com/feed/status/12"),
    (3, "youtube", "abc", None, None, None, "https://www.youtube.com/watch?v=abc"),
    (4, "telegram", "chan/5", None, None, "chan", "https://t.me/chan/5"),
    (5, "x", "12", None, None, None, None),
    (6, "web", "1", None, "a", "b", None),
    (7, "x", "12", "https://kept", "ann", None, "https://kept"),
])
def filled_urls(rows):
    """Addresses of posts that have none, where their parts are known."""
    handle = F.coalesce(F.nullif(F.trim("author_handle"), F.lit("")), F.col("source_handle"))
    return rows.withColumn("filled", F.coalesce(F.nullif("url", F.lit("")), urls.content_url(F.col("platform"), F.col("external_id"), handle)))


_STORIES = literal("story_id, first_mover", [(1, None), (2, None), (3, 7), (4, None), (5, None)])


_MEMBERS = literal("story_id, content_id, role, handle", [
    (1, 5, "primary", "@Ann"), (1, 4, "primary", "bob"), (1, 1, "echo", "cat"), (2, 1, "primary", "ANN"), (3, 1, "primary", "ann"), (4, 1, "primary", ""), (5, 1, "primary", "nobody"),
])


_HANDLES = literal("source_id, handle", [(1, "ann"), (2, "Ann"), (3, "ANN"), (4, "BOB"), (5, "@Bob"), (6, None)])


@plan(f"SELECT * FROM {literal('story_id, handle, source_id', [(1, 'bob', 4), (2, 'ANN', 3)])}")
def repaired_first_movers(spark, d):
    """First movers found again by a name that differs in case only."""
    return K.repaired_movers(_hand_made(spark, _STORIES), _hand_made(spark, _MEMBERS), _hand_made(spark, _HANDLES))


_POSTS = literal("id, text, at, ai", [
    (1, "see @Ann and @bob", 5, None),
    (2, "thanks @ann\nmore of @ann", 3, True),
    (3, "about @ann again", 9, False),
    (4, "no names", 1, True),
    (5, None, 1, True),
])


@plan(f"SELECT * FROM {literal('handle, mentions, posts, first_seen, last_seen, hint, examples', [('ann', 3, 3, 3, 9, True, 'see @Ann and @bob|thanks @ann'), ('bob', 1, 1, 5, 5, False, 'see @Ann and @bob')])}")
def candidate_mention_details(spark, d):
    """Mentions of candidates with a hint of the topic and the first two lines that name them."""
    found = K.mentions_of_candidates(_hand_made(spark, _POSTS), "id", "text", "at", T.mentions("text"), F.col("ai"))
    return found.withColumn("examples", F.array_join("examples", "|"))


@plan("SELECT section, GREATEST(section * 8, 200) AS pool FROM (VALUES (CAST(10 AS BIGINT)), (25), (26), (100)) AS t(section)")
def candidate_pools(spark, d):
    """K6: how many rows a section of a report looks at."""
    return _hand_made(spark, "(VALUES (CAST(10 AS BIGINT)), (25), (26), (100)) AS t(section)").select("section", R.pool_size(F.col("section")).alias("pool"))


_RSS = "<rss><channel><title>News &amp; more</title><language>en-us</language><item><title>a</title><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><pubDate>Wed, 03 Jan 2024 12:00:00 +0200</pubDate></item><item><pubDate>soon</pubDate></item></channel></rss>"


_ATOM = '<feed xml:lang="de"><title>Blatt</title><entry><updated>2024-01-05T00:00:00Z</updated><published>2023-01-01T00:00:00Z</published></entry></feed>'


@cases("id, body", "title, lang, entries, last_at, per_day", [
    (1, _RSS, "News & more", "en-us", 3, "2024-01-03 10:00:00", 1.0),
    (2, _ATOM, "Blatt", "de", 1, "2024-01-05 00:00:00", 1.0),
    (3, "<rss><channel><title>Empty</title></channel></rss>", "Empty", None, 0, None, 0.0),
    (4, None, "", None, 0, None, 0.0),
])
def feed_summaries(rows):
    """Title, language, entries, last entry and frequency of feeds."""
    found = markup.feed_summary(rows, "body", ["id", "body"])
    return found.withColumns({"entries": F.col("entries").cast("long"), "last_at": F.date_format("last_at", "yyyy-MM-dd HH:mm:ss")})


_TIMELINE = (
    '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"timeline":{"entries":['
    '{"type":"tweet","content":{"tweet":{"id_str":"7","full_text":"old but pinned","favorite_count":5,"retweet_count":1,"reply_count":0,"lang":"en","user":{"screen_name":"Ann"}}}},'
    '{"type":"cursor","content":{"tweet":{"id_str":"8","full_text":"no"}}},'
    '{"content":{"tweet":{"id_str":"9","text":"RT @bob: hi","user":{"screen_name":"ANN"}}}},'
    '{"type":"tweet","content":{}}]}}}}</script></html>'
)


_PAGES = literal("page, html", [(1, _TIMELINE), (2, "<html></html>"), (3, '<script id="__NEXT_DATA__">broken</script>'), (4, None)])


@plan(f"SELECT * FROM {literal('page, external_id, text, likes, reposts, replies, lang, handle, is_repost, pinned', [(1, '7', 'old but pinned', 5, 1, 0, 'en', 'ann', False, True), (1, '9', 'RT @bob: hi', None, None, None, None, 'ann', True, False)])}")
def timeline_posts(spark, d):
    """Posts of an embedded timeline, with the pinned one and reposts marked."""
    return markup.timeline_posts(spark.sql(f"SELECT * FROM {_PAGES}"), "html", ["page"])


_ANSWERS = literal("site, body", [
    ("hn", '{"hits":[{"objectID":"1","title":"Show HN: Radius","points":10,"num_comments":3,"created_at":"2024-01-30T10:00:00Z"},{"objectID":"2","title":null},{"title":"bare","url":"https://a.b"}]}'),
    ("gh", '{"items":[{"full_name":"ann/tool","description":"does <b>things</b>","html_url":"https://github.com/ann/tool","stargazers_count":99,"created_at":"2024-01-29T00:00:00Z"},{"name":"old","html_url":"https://github.com/old","stargazers_count":5,"created_at":"2023-01-01T00:00:00Z"}]}'),
    ("ph", '<feed><entry><title>Supacut</title><link rel="alternate" href="https://p.h/s"/><published>2024-01-30T01:00:00Z</published></entry><entry><title></title></entry></feed>'),
    ("ax", "<feed><entry><title>On\n things</title><id>http://arxiv.org/abs/1</id><published>2024-01-28T00:00:00Z</published></entry></feed>"),
    ("hm", '[{"id":"org/my-big_model","trendingScore":7,"createdAt":"2024-01-30T00:00:00.000Z"},{"id":null}]'),
    ("hp", '[{"title":"outer","paper":{"id":"2401.1","title":"A paper","upvotes":4,"publishedAt":"2024-01-30T00:00:00.000Z"}},{"title":"no paper"}]'),
    ("hn", "broken"),
])


_NEWS = [
    ("hackernews", "Show HN: Radius", "https://news.ycombinator.com/item?id=1", 10, 3, "2024-01-30 10:00:00"),
    ("hackernews", "bare", "https://a.b", None, None, None),
    ("github", "ann/tool: does things", "https://github.com/ann/tool", 99, None, "2024-01-29 00:00:00"),
    ("producthunt", "Supacut", "https://p.h/s", None, None, "2024-01-30 01:00:00"),
    ("huggingface", "my big model", "https://huggingface.co/org/my-big_model", 7, None, "2024-01-30 00:00:00"),
    ("huggingface", "A paper", "https://huggingface.co/papers/2401.1", 4, None, "2024-01-30 00:00:00"),
    ("huggingface", "no paper", None, None, None, None),
]


@plan(f"SELECT * FROM {literal('platform, title, url, score, comments, published_at', _NEWS)}")
def external_news(spark, d):
    """News of six sites from saved answers, of the last 48 hours."""
    of = lambda site: spark.sql(f"SELECT * FROM {_ANSWERS}").filter(F.col("site") == site)
    found = external.hackernews(of("hn"), "body").union(external.github(of("gh"), "body")).union(external.atom(of("ph"), "body", "producthunt"))
    found = found.union(external.atom(of("ax"), "body", "arxiv")).union(external.models(of("hm"), "body")).union(external.papers(of("hp"), "body"))
    recent = external.within(found, F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return recent.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
