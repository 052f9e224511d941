"""Text, address, time and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions import times, urls
from quarryline.plans.registration import plan
from quarryline.plans.roles import EVENTS_NOW, SNAPSHOTS, snapshots
from quarryline.session import table
from quarryline.sources import feeds, markup, walker

_W = "REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+')"


@plan("SELECT doc_id, SHA1(REGEXP_REPLACE(LOWER(TRIM(text, ' ')), '\\s+', ' ', 'g')) AS h FROM documents")
def text_hashes(spark, d):
    """F1."""
    return table(spark, d, "documents").select("doc_id", T.text_hash("text").alias("h"))


@plan(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT doc_id, LIST_DISTINCT(CASE WHEN LEN(w) >= 3 THEN LIST_TRANSFORM(RANGE(1, LEN(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS s FROM w) SELECT doc_id, LEN(s) AS n, LIST_AGGREGATE(s, 'min') AS first FROM s""")
def word_shingles(spark, d):
    """F2."""
    docs = table(spark, d, "documents").select("doc_id", T.words("text").alias("w"))
    return docs.select("doc_id", T.shingles_of(F.col("w")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("first"))


@plan(f"""WITH w AS (SELECT conv_id, turn, role, LIST_DISTINCT({_W}) AS w FROM conversations WHERE LEN({_W}) > 0) SELECT a.conv_id, a.turn, a.role AS a, b.role AS b, b.turn AS other, CAST(ROUND(LEN(LIST_INTERSECT(a.w, b.w)) / LEN(LIST_DISTINCT(LIST_CONCAT(a.w, b.w))), 9) AS DOUBLE) AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def neighbour_similarity(spark, d):
    """shared words of neighbouring turns."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(T.words("text")).alias("w")).filter("size(w) > 0")
    other = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("other"), F.col("role").alias("b"), F.col("w").alias("w2"))
    return rows.join(other, ["conv_id", "turn"]).select("conv_id", "turn", F.col("role").alias("a"), "b", "other", F.round(T.jaccard("w", "w2"), 9).alias("similarity"))


_STOP = "['" + "', '".join(T.STOP_WORDS) + "']"


@plan(f"SELECT doc_id, LEN(LIST_DISTINCT(LIST_FILTER({_W}, lambda x: LENGTH(x) >= 3 AND NOT LIST_CONTAINS({_STOP}, x)))) AS n FROM documents")
def content_words(spark, d):
    """F5."""
    return table(spark, d, "documents").select("doc_id", F.size(T.content_tokens("text")).cast("long").alias("n"))


@plan("""SELECT doc_id, LEN(LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(text), '(?:^|[^a-z0-9_@.])@([a-z0-9_]{2,32})', 1))) AS mentions, LEN(REGEXP_EXTRACT_ALL(text, 'https?://[^\\s<>"'')\\]]+')) AS links, LEN(LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(text), '#([\\p{L}\\p{N}_]+)', 1))) AS hashtags FROM documents""")
def names_in_text(spark, d):
    """F6, F18."""
    return table(spark, d, "documents").select("doc_id", *(F.size(f("text")).cast("long").alias(f.__name__) for f in (T.mentions, T.links, T.hashtags)))


@plan("""WITH t AS (SELECT doc_id, text, LEN(REGEXP_EXTRACT_ALL(text, '\\p{L}')) AS letters FROM documents)
SELECT doc_id, CAST(ROUND(CASE WHEN letters > 0 THEN LEN(REGEXP_EXTRACT_ALL(text, '\\p{Lu}')) / letters END, 9) AS DOUBLE) AS caps,
  REGEXP_MATCHES(text, '(?i)\\b(?:promo\\s*code|giveaway|referral\\s+(?:code|link|program|bonus)|affiliate\\s+(?:link|program|code)|sponsored\\s+(?:by|post|content))\\b|промокод|промоакци|скидк|к[еэ]шб[еэ]к|розыгрыш|подписывайт|регистрируйс|тариф|спонсор|партн[её]рск') AS marked
FROM t""")
def promo_signs(spark, d):
    """F8: capitals among the letters, and markers of paid posts. The table has no Cyrillic text, so borders of Cyrillic words are left to ``promo_cases``."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.round(T.caps_ratio("text"), 9).alias("caps"), T.promo_signs("text")["marker"].alias("marked"))


@plan()
def promo_reasons(spark, d):
    """F8, F9 over all documents; tests/rule_cases.py holds the rules to hand-made rows."""
    return table(spark, d, "documents").select("doc_id", T.promo_reason("text").alias("reason"), T.origin("text").alias("origin"))


@plan("""WITH t AS (SELECT doc_id, SPLIT_PART(text, chr(10), 1) AS t FROM documents) SELECT doc_id, LENGTH(t) AS n_chars, LEN(REGEXP_EXTRACT_ALL(LOWER(t), '[\\p{L}\\p{N}_]+')) AS n_words, REGEXP_MATCHES(t, '[0-9]') AS has_number, CONTAINS(t, '?') AS is_question, CONTAINS(t, ':') AS has_colon, LEN(REGEXP_EXTRACT_ALL(t, 'https?://')) AS n_links, LEN(REGEXP_EXTRACT_ALL(t, '[0-9]{1,2}:[0-9]{2}')) AS n_timestamps FROM t""")
def title_features(spark, d):
    """F10."""
    f = T.title_features(F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", *(f[c].cast("long").alias(c) for c in ("n_chars", "n_words")), *(f[c].alias(c) for c in ("has_number", "is_question", "has_colon")), *(f[c].cast("long").alias(c) for c in ("n_links", "n_timestamps")))


@plan("""WITH t AS (SELECT SPLIT_PART(text, chr(10), 1) AS t FROM documents), p AS (SELECT CONCAT_WS('+', CASE WHEN REGEXP_MATCHES(t, '[0-9]') THEN 'number' END, CASE WHEN CONTAINS(t, '?') THEN 'question' END, CASE WHEN CONTAINS(t, ':') THEN 'colon' END, CASE WHEN LEN(LIST_FILTER(REGEXP_EXTRACT_ALL(t, '\\p{L}+'), lambda w: LENGTH(w) >= 2 AND w = UPPER(w))) > 0 THEN 'caps' END) AS p FROM t) SELECT CASE WHEN p = '' THEN 'plain' ELSE p END AS pattern, COUNT(*) AS n FROM p GROUP BY 1""")
def title_patterns(spark, d):
    """F11."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").groupBy(T.title_pattern(first).alias("pattern")).agg(F.count("*").alias("n"))


@plan(f"SELECT doc_id FROM documents WHERE LEN(LIST_FILTER({_W}, lambda w: w[1:5] IN ('tione', 'edthe', 'stand') OR w = 'with')) > 0")
def topic_match(spark, d):
    """F12."""
    return table(spark, d, "documents").filter(T.matches_topic("text", ["tioned", "edthe", "stand"], ["with"])).select("doc_id")


@plan("""WITH w AS (SELECT DISTINCT LOWER(SPLIT_PART(p_type, ' ', 1)) AS word FROM part), v AS (SELECT word, UNNEST(RANGE(1, LENGTH(word))) AS i FROM w)
SELECT DISTINCT word, LEFT(word, i - 1) || word[i + 1] || word[i] || SUBSTR(word, i + 2) AS variant FROM v WHERE word[i] <> word[i + 1] AND NOT CONTAINS(word[i:i + 1], ' ')""")
def typo_variants(spark, d):
    """each part type with neighbouring letters exchanged."""
    word = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    return table(spark, d, "part").select(word.alias("word")).distinct().select("word", F.explode(T.typo_variants("word")).alias("variant"))


@plan("""WITH h AS (SELECT page_id, LOWER(REGEXP_EXTRACT(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1)) AS h, url FROM pages)
SELECT page_id, 'domain' AS kind, 'web' AS platform, h AS value, CAST(NULL AS VARCHAR) AS skip FROM h""")
def link_targets(spark, d):
    """the target of each page's address."""
    rows = table(spark, d, "pages").select("page_id", urls.target(F.col("url")).alias("t"))
    return rows.select("page_id", *(F.col("t").getField(c).alias(c) for c in ("kind", "platform", "value", "skip")))


@plan("""WITH u AS (SELECT page_id, REGEXP_EXTRACT(url, '^[^?#]*') AS p, REGEXP_EXTRACT(url, '^[^?#]*[?]([^#]*)', 1) AS q, REGEXP_EXTRACT(url, '#.*$') AS f FROM pages),
k AS (SELECT page_id, p, f, LIST_FILTER(STRING_SPLIT(q, '&'), lambda x: x <> '' AND NOT REGEXP_MATCHES(LOWER(x), '^(?:utm_[^=]*|ref|ref_src|fbclid|gclid|igshid|mc_cid|yclid)(?:=|$)')) AS q FROM u)
SELECT page_id, p || CASE WHEN LEN(q) = 0 THEN '' ELSE '?' || ARRAY_TO_STRING(LIST_TRANSFORM(q, lambda x: CASE WHEN CONTAINS(x, '=') THEN x ELSE x || '=' END), '&') END || f AS url FROM k""")
def clean_urls(spark, d):
    """addresses without tracking parameters."""
    return table(spark, d, "pages").select("page_id", urls.clean_url(F.col("url")).alias("url"))


@plan("""SELECT c_custkey AS source_id, LOWER(TRIM(c_name)) AS handle, LENGTH(c_name) >= 13 AND LEN(REGEXP_EXTRACT_ALL(c_name, '[0-9]')) >= 8 AS spam FROM customer""")
def handles(spark, d):
    """F15."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), urls.normal_handle(F.col("c_name")).alias("handle"), urls.is_spam_handle(F.col("c_name")).alias("spam"))


@plan("""SELECT c_custkey AS source_id, CASE c_custkey % 3 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || c_custkey WHEN 1 THEN 'https://x.com/' || c_name || '/status/' || c_custkey ELSE 'https://t.me/' || c_custkey END AS url FROM customer""")
def content_urls(spark, d):
    """F16."""
    platform = F.when(F.col("c_custkey") % 3 == 0, "youtube").when(F.col("c_custkey") % 3 == 1, "x").otherwise("telegram")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), urls.content_url(platform, F.col("c_custkey").cast("string"), F.col("c_name")).alias("url"))


@plan("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.5K' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' 000' WHEN 2 THEN CAST(p_size AS VARCHAR) || ',25M' ELSE 'n/a' END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(REPLACE(t, '.5K', '') AS BIGINT) * 1000 + 500 WHEN 1 THEN CAST(REPLACE(t, ' ', '') AS BIGINT) WHEN 2 THEN CAST(REPLACE(t, ',25M', '') AS BIGINT) * 1000000 + 250000 END AS n FROM t""")
def parsed_counts(spark, d):
    """F17."""
    size = F.col("p_size").cast("string")
    written = F.when(F.col("p_partkey") % 4 == 0, F.concat(size, F.lit(".5K"))).when(F.col("p_partkey") % 4 == 1, F.concat(size, F.lit(" 000"))).when(F.col("p_partkey") % 4 == 2, F.concat(size, F.lit(",25M"))).otherwise("n/a")
    return table(spark, d, "part").select("p_partkey", T.parse_count(written).alias("n"))


@plan("""SELECT p_partkey, CAST(ROUND(p_retailprice, 2) * CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 1 END AS DOUBLE) AS amount FROM part""")
def amounts(spark, d):
    """F19."""
    price = F.format_string("%.2f", "p_retailprice")
    written = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("raised $"), price, F.lit("K"))).otherwise(F.concat(F.lit("paid $"), price))
    return table(spark, d, "part").select("p_partkey", T.money(written).alias("amount"))


@plan("""SELECT doc_id, LEN(REGEXP_EXTRACT_ALL(text, '\\p{L}')) > 0 AND LEN(REGEXP_EXTRACT_ALL(text, '\\p{Cyrillic}')) >= 0.5 * LEN(REGEXP_EXTRACT_ALL(text, '\\p{L}')) AS cyrillic, CAST(ROUND(CASE WHEN LEN(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+')) > 0 THEN LEN(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+'), lambda w: w IN ('the', 'and', 'of'))) / LEN(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+')) ELSE 0 END, 9) AS DOUBLE) AS density FROM documents""")
def language_signs(spark, d):
    """F20."""
    return table(spark, d, "documents").select("doc_id", T.is_cyrillic("text").alias("cyrillic"), F.round(T.term_density("text", ["the", "and", "of"]), 9).alias("density"))


@plan(f"""SELECT snapshot_id, DATE_TRUNC('second', captured_at) AS t0, DATE_TRUNC('second', captured_at) AS t1, DATE_TRUNC('minute', captured_at) AS t2, CAST(captured_at AS DATE) AS t3, CAST(NULL AS VARCHAR) AS t4 FROM {SNAPSHOTS}""".replace("DATE_TRUNC('second', captured_at) AS t0", "STRFTIME(captured_at, '%Y-%m-%d %H:%M:%S') AS t0").replace("DATE_TRUNC('second', captured_at) AS t1", "STRFTIME(captured_at, '%Y-%m-%d %H:%M:%S') AS t1").replace("DATE_TRUNC('minute', captured_at) AS t2", "STRFTIME(DATE_TRUNC('minute', captured_at), '%Y-%m-%d %H:%M:%S') AS t2").replace("CAST(captured_at AS DATE) AS t3", "STRFTIME(CAST(captured_at AS DATE), '%Y-%m-%d %H:%M:%S') AS t3"))
def parsed_times(spark, d):
    """One time in five written forms, parsed again."""
    at = F.col("captured_at").cast("timestamp")
    forms = [F.unix_timestamp(at).cast("string"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyy-MM-dd HH:mm"), F.date_format(at, "yyyy-MM-dd"), F.lit("soon")]
    return snapshots(spark, d).select("snapshot_id", *(F.date_format(times.parse_any(f), "yyyy-MM-dd HH:mm:ss").alias(f"t{i}") for i, f in enumerate(forms)))


@plan(f"""WITH a AS (SELECT snapshot_id, (EPOCH_US(TIMESTAMP '{EVENTS_NOW}') - EPOCH_US(captured_at)) / 3.6e9 AS age FROM {SNAPSHOTS}) SELECT snapshot_id, CAST(ROUND(age, 6) AS DOUBLE) AS age, CASE WHEN age < 3.5 THEN '1h' WHEN age < 15 THEN '6h' WHEN age < 48 THEN '24h' ELSE '72h' END AS stage, CASE WHEN age < 1 THEN '<1h' WHEN age < 6 THEN '1-6h' WHEN age < 24 THEN '6-24h' WHEN age < 72 THEN '24-72h' ELSE '>72h' END AS bucket FROM a""")
def ages(spark, d):
    """D3, D4, D5."""
    age = times.hours_between(F.col("captured_at"), F.lit(EVENTS_NOW).cast("timestamp"))
    return snapshots(spark, d).select("snapshot_id", F.round(age, 6).alias("age"), times.stage(age).alias("stage"), times.age_bucket(age).alias("bucket"))


@plan(f"SELECT snapshot_id, EPOCH_US(captured_at) // 1000 AS ms FROM {SNAPSHOTS}")
def times_in_ids(spark, d):
    """An id that holds its time, read back."""
    epoch = 1_288_834_974_657
    ident = F.shiftleft(F.unix_millis(F.col("captured_at").cast("timestamp")) - epoch, 22) + F.col("snapshot_id") % 4096
    return snapshots(spark, d).select("snapshot_id", F.unix_millis(times.id_time(ident)).alias("ms"))


@plan("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 3600 + (p_partkey % 60) * 60 + 7 END AS seconds FROM part")
def durations(spark, d):
    """D7."""
    written = F.when(F.col("p_partkey") % 5 == 0, "soon").otherwise(F.concat(F.lit("PT"), "p_size", F.lit("H"), F.col("p_partkey") % 60, F.lit("M7S")))
    return table(spark, d, "part").select("p_partkey", times.iso_duration(written).alias("seconds"))


@plan(f"SELECT snapshot_id, CAST(CAST(captured_at - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day FROM {SNAPSHOTS}")
def quota_day(spark, d):
    """The calendar day of a quota in its zone (in January)."""
    return snapshots(spark, d).select("snapshot_id", times.day_in_zone(F.col("captured_at"), "America/Los_Angeles").cast("string").alias("day"))


@plan(f"""WITH s AS (SELECT content_id, CAST(FLOOR(EPOCH(MIN(captured_at))) AS BIGINT) AS s FROM {SNAPSHOTS} GROUP BY 1), h AS (SELECT content_id, CAST(FLOOR((EPOCH(TIMESTAMP '{EVENTS_NOW}') - s) / 3600) AS BIGINT) AS h FROM s) SELECT content_id, CAST(LEAST(h, 6) + 1 + h // 12 AS BIGINT) AS slots FROM h""")
def expected_slots(spark, d):
    """Times at which a content should have been measured."""
    born = snapshots(spark, d).groupBy("content_id").agg(F.min("captured_at").alias("born"))
    return born.select("content_id", F.size(times.expected_slots(F.col("born"), F.lit(EVENTS_NOW).cast("timestamp"))).cast("long").alias("slots"))


@plan(f"""WITH s AS (SELECT content_id, CAST(FLOOR(EPOCH(MIN(captured_at))) AS BIGINT) AS s FROM {SNAPSHOTS} GROUP BY 1), h AS (SELECT content_id, s, CAST(FLOOR((EPOCH(TIMESTAMP '{EVENTS_NOW}') - s) / 3600) AS BIGINT) AS h FROM s), a AS (SELECT content_id, s + 3600 * UNNEST(LIST_CONCAT(RANGE(0, LEAST(h, 6) + 1), RANGE(12, h + 1, 12))) AS slot FROM h)
SELECT content_id, COUNT(*) AS missed FROM a WHERE NOT EXISTS (SELECT 1 FROM {SNAPSHOTS} x WHERE x.content_id = a.content_id AND ABS(EPOCH_US(x.captured_at) - slot * 1000000) <= 1800000000) GROUP BY content_id""")
def missed_slots(spark, d):
    """Expected measurements that no snapshot is near."""
    from quarryline.operators import snapshots as S

    rows = snapshots(spark, d)
    born = rows.groupBy("content_id").agg(F.min("captured_at").alias("born"))
    missed = S.missed_slots(born, rows, "content_id", "born", "captured_at", F.lit(EVENTS_NOW).cast("timestamp"))
    return missed.groupBy("content_id").agg(F.count("*").alias("missed"))


@plan("SELECT event_id, CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    """G1."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@plan("SELECT event_id, CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events")
def json_patch(spark, d):
    """A field added to a JSON object without losing the others."""
    patched = F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("t"), "event_type")))
    return table(spark, d, "events").select("event_id", patched.alias("p")).select("event_id", F.get_json_object("p", "$.k").cast("long").alias("k"), F.get_json_object("p", "$.t").alias("t"))


@plan("SELECT user_id, COUNT(*) AS items, STRING_AGG(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def json_list(spark, d):
    """Lists in JSON, unnested and joined again."""
    rows = table(spark, d, "events").withColumn("raw", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit('["'), "event_type", F.lit('"]'))))
    each = rows.select("user_id", F.explode(feeds.as_list(F.col("raw"))).alias("kind"))
    return each.groupBy("user_id").agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@plan("SELECT user_id, STRING_AGG(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS last FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5 GROUP BY user_id")
def capped_history(spark, d):
    """The last five entries of each key; the window cuts each key before the shuffle of its rows ends in lists."""
    from quarryline.operators.ranking import cap_per_key

    kept = cap_per_key(table(spark, d, "events").select("user_id", "event_id"), "user_id", [F.desc("event_id")], 5)
    return kept.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("last"))


@plan("""SELECT page_id, REPLACE(REPLACE(REPLACE(REPLACE(TRIM(REGEXP_REPLACE(REGEXP_EXTRACT(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title, REGEXP_EXTRACT(html, '<html[^>]*\\slang="([^"]+)"', 1) AS lang, LEN(REGEXP_EXTRACT_ALL(html, '<a\\s[^>]*href="([^"]*)"')) AS links FROM pages""")
def page_heads(spark, d):
    """Title, language and links of raw pages."""
    return table(spark, d, "pages").select("page_id", markup.title(F.col("html")).alias("title"), markup.page_lang(F.col("html")).alias("lang"), F.size(markup.hrefs(F.col("html"))).cast("long").alias("links"))


@plan()
def page_paragraphs(spark, d):
    """Paragraphs of raw pages as posts. No SQL: nested markup; tested by hand."""
    return markup.paragraphs(table(spark, d, "pages"), "html", ["page_id"])


@plan()
def names_in_titles(spark, d):
    """words of first lines that look like names. No SQL; tested by hand."""
    return table(spark, d, "documents").select("doc_id", T.distinctive_names(F.split_part("text", F.lit("\n"), F.lit(1))).alias("names"))


@plan()
def page_blocks(spark, d):
    """All blocks of text of every page by its tags, nested or unclosed. No SQL; tests/test_walker.py has pages by hand and the table's."""
    return walker.page_blocks(table(spark, d, "pages"), "page_id", "html")


@plan(r"""WITH h AS (SELECT page_id, REGEXP_REPLACE(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g') AS html FROM pages)
SELECT page_id, LEN(REGEXP_EXTRACT_ALL(html, '(?i)<p[ >]')) AS paragraphs, LEN(REGEXP_EXTRACT_ALL(html, '(?i)<li[ >]')) AS items, LEN(REGEXP_EXTRACT_ALL(html, '(?i)<a ')) AS links FROM h""")
def page_outlines(spark, d):
    """Paragraphs, items of lists and links of every page, from its blocks."""
    count = lambda tag: F.count_if(F.col("tag") == tag)
    counted = walker.page_blocks(table(spark, d, "pages"), "page_id", "html").groupBy("page_id").agg(count("p").alias("paragraphs"), count("li").alias("items"), F.sum("links").alias("links"))
    known = table(spark, d, "pages").select("page_id").join(counted, "page_id", "left")
    return known.select("page_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("paragraphs", "items", "links")))
