"""Rules with many branches over whole tables: verdicts, reasons, priorities, repairs; tests/rule_cases.py holds them to hand-made rows.

The tables have no such columns, so the inputs of a rule are derived from those that they have, in the same way here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import scores as S
from quarryline.functions import text as T
from quarryline.functions import urls
from quarryline.operators import blocks as B
from quarryline.operators import queues as K
from quarryline.operators import ranking as R
from quarryline.operators import verdicts as V
from quarryline.operators.selection import medians
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, EDGES, ORDERS_NOW, SNAPSHOTS, SOURCES, contents, edges, snapshots, sources
from quarryline.session import table


@plan(f"""WITH p AS (SELECT content_id, CASE WHEN source_id % 7 <> 0 THEN status = 'P' END AS ad, CASE WHEN source_id % 11 = 0 THEN 'flooded' WHEN source_id % 5 <> 0 THEN 'active' END AS state,
  CASE WHEN content_id % 4 = 0 THEN published_at + INTERVAL 40 DAY END AS until FROM {CONTENTS})
SELECT content_id, NOT COALESCE(ad, FALSE) AND NOT COALESCE(state = 'flooded', FALSE) AND NOT COALESCE(until > TIMESTAMP '{ORDERS_NOW}', FALSE) AS honest FROM p""")
def honest_posts(spark, d):
    """Not paid, source not flooded, flood window over."""
    rows = contents(spark, d)
    ad = F.when(F.col("source_id") % 7 != 0, F.col("status") == "P")
    state = F.when(F.col("source_id") % 11 == 0, "flooded").when(F.col("source_id") % 5 != 0, "active")
    until = F.when(F.col("content_id") % 4 == 0, F.col("published_at").cast("timestamp") + F.expr("interval 40 days"))
    return rows.select("content_id", V.honest(ad, state, until, F.lit(ORDERS_NOW).cast("timestamp")).alias("honest"))


@plan(f"""SELECT snapshot_id, stage = 'click' OR COALESCE(snapshot_id % 50 = 0, FALSE) OR stage = 'error' OR (snapshot_id % 3 <> 0 AND content_id % 9 = 0) AS left_out FROM {SNAPSHOTS}""")
def excluded_posts(spark, d):
    """Reposts, pinned, deleted, and numbers of a repeated post."""
    source = F.when(F.col("snapshot_id") % 3 != 0, F.when(F.col("content_id") % 9 == 0, "cdn_rt").otherwise("cdn"))
    deleted = F.when(F.col("stage") == "error", F.col("captured_at"))
    return snapshots(spark, d).select("snapshot_id", V.left_out(F.col("stage") == "click", F.col("snapshot_id") % 50 == 0, deleted, source).alias("left_out"))


@plan("""SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END AS format, lang = 'de' OR SUBSTR(source, -1) = '3' AS russian, REGEXP_MATCHES(LOWER(LEFT(text, 60)), '[а-яё]') AS looks FROM documents""")
def formats_and_languages(spark, d):
    """Short and long posts; one language by post or by channel (German stands in for Russian, which the tables lack)."""
    rows = table(spark, d, "documents")
    channel = F.when(F.substring("source", -1, 1) == "3", 1).otherwise(0)
    wanted = F.coalesce(F.col("lang") == "de", F.lit(False)) | (F.coalesce(channel, F.lit(0)) == 1)
    return rows.select("doc_id", F.when(F.col("n_chars") < 500, "short").otherwise("long").alias("format"), wanted.alias("russian"), T.looks_russian(F.left("text", F.lit(60))).alias("looks"))


@plan("SELECT conv_id, BOOL_OR(role = 'system') AS has FROM conversations GROUP BY conv_id")
def handle_in_list(spark, d):
    """Membership in a list kept as JSON text, by the whole value: the roles of each conversation."""
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_set("role")).alias("roles"))  # a few roles
    return lists.select("conv_id", T.json_list_has(F.col("roles"), "system").alias("has"))


_CANDIDATES = f"""c AS (
  SELECT s.source_id, s.source_id % 19 = 0 AS known, s.country = 'FRANCE' AS blocked, CASE s.tier WHEN 'BUILDING' THEN 'fetch_error' WHEN 'MACHINERY' THEN CASE WHEN s.source_id % 2 = 0 THEN 'gone' ELSE 'unreadable' END
    WHEN 'HOUSEHOLD' THEN CASE WHEN s.source_id % 3 <> 0 THEN 'ok' END ELSE 'ok' END AS outcome,
    CASE WHEN s.size > 500 THEN s.size END AS size, COUNT(c.content_id) FILTER (c.day > DATE '{ORDERS_NOW}' - 540) AS posts, CAST(MEDIAN(c.views) / 10000 AS DOUBLE) AS likes, COUNT(c.content_id) AS n
  FROM {SOURCES} s LEFT JOIN {CONTENTS} c USING (source_id) GROUP BY ALL)"""


def _candidates(spark, d) -> DataFrame:
    """Sources as candidates: what is known of them, what asking them gave, and their posts of the last 540 days."""
    recent = F.count_if(F.col("day") > F.date_sub(F.lit(ORDERS_NOW).cast("date"), 540))
    level = contents(spark, d).groupBy("source_id").agg(recent.alias("posts"), F.count("*").alias("n"))
    rows = sources(spark, d).join(level, "source_id", "left").join(medians(contents(spark, d), ["source_id"], "views").drop("n"), "source_id", "left")
    outcome = (
        F.when(F.col("tier") == "BUILDING", "fetch_error")
        .when(F.col("tier") == "MACHINERY", F.when(F.col("source_id") % 2 == 0, "gone").otherwise("unreadable"))
        .when((F.col("tier") != "HOUSEHOLD") | (F.col("source_id") % 3 != 0), "ok")
    )
    return rows.select(
        "source_id",
        (F.col("source_id") % 19 == 0).alias("known"),
        (F.col("country") == "FRANCE").alias("blocked"),
        outcome.alias("outcome"),
        F.when(F.col("size") > 500, F.col("size")).alias("size"),
        F.coalesce("posts", F.lit(0)).alias("posts"),
        (F.col("med") / 10000).alias("likes"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


@plan(f"""WITH {_CANDIDATES}, v AS (SELECT source_id, CASE WHEN known THEN 'reject/duplicate' WHEN blocked THEN 'reject/blocked' WHEN outcome = 'gone' THEN 'reject/gone' WHEN outcome IN ('no_feed', 'unreadable') THEN 'reject/no_feed'
  WHEN outcome IS NULL OR outcome = 'fetch_error' THEN 'hold/no_answer' WHEN posts = 0 THEN 'reject/no_posts_30d' WHEN posts < 3 THEN 'hold/few_posts_30d' WHEN size IS NULL THEN 'hold/size_unknown' ELSE 'promote/posts_and_size' END AS v FROM c)
SELECT source_id, SPLIT_PART(v, '/', 1) AS verdict, SPLIT_PART(v, '/', 2) AS reason, CASE SPLIT_PART(v, '/', 1) WHEN 'promote' THEN 'promoted' WHEN 'reject' THEN 'rejected' ELSE 'hold' END AS status FROM v""")
def channel_verdicts(spark, d):
    """Verdicts on channels of short posts."""
    v = V.channel_verdict(*(F.col(c) for c in ("known", "blocked", "outcome", "posts", "size")))
    status = F.create_map(*(F.lit(x) for pair in V.STATUS_OF.items() for x in pair))
    return _candidates(spark, d).select("source_id", v["verdict"].alias("verdict"), v["reason"].alias("reason"), status[v["verdict"]].alias("status"))


@plan(f"""WITH {_CANDIDATES}, f AS (SELECT *, CASE WHEN outcome = 'ok' THEN TRUE WHEN outcome IN ('gone', 'unreadable') THEN FALSE END AS found FROM c),
v AS (SELECT source_id, CASE WHEN NOT found THEN 'reject/gone' WHEN found IS NULL THEN 'hold/no_answer' WHEN posts = 0 THEN 'reject/no_videos_30d' WHEN posts < 3 THEN 'hold/few_videos_30d' WHEN size IS NULL THEN 'hold/size_unknown' ELSE 'promote/videos_and_size' END AS v FROM f)
SELECT source_id, SPLIT_PART(v, '/', 1) AS verdict, SPLIT_PART(v, '/', 2) AS reason FROM v""")
def video_channel_verdicts(spark, d):
    """Verdicts on video channels."""
    found = F.when(F.col("outcome") == "ok", True).when(F.col("outcome").isin("gone", "unreadable"), False)
    v = V.video_channel_verdict(found, F.col("posts"), F.col("size"))
    return _candidates(spark, d).select("source_id", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


@plan(f"""WITH {_CANDIDATES}, q AS (SELECT source_id, ROW_NUMBER() OVER (ORDER BY n DESC, source_id) AS place FROM c WHERE NOT known AND NOT blocked),
v AS (SELECT source_id, CASE WHEN known THEN 'reject/duplicate' WHEN blocked THEN 'reject/blocked' WHEN place > (SELECT COUNT(*) FROM c) // 2 THEN 'hold/budget' WHEN outcome = 'gone' THEN 'reject/gone' WHEN outcome = 'unreadable' THEN 'reject/protected'
  WHEN outcome IS NULL OR outcome IN ('budget', 'fetch_error') THEN 'hold/no_answer' WHEN posts = 0 THEN 'reject/no_posts_30d' WHEN posts < 3 THEN 'hold/few_posts_30d' WHEN likes IS NULL OR likes < 20 THEN 'hold/few_likes' ELSE 'promote/posts_and_likes' END AS v FROM c LEFT JOIN q USING (source_id))
SELECT source_id, SPLIT_PART(v, '/', 1) AS verdict, SPLIT_PART(v, '/', 2) AS reason FROM v""")
def account_verdicts(spark, d):
    """Verdicts on accounts under a budget of requests for half of them; the busiest are asked first."""
    rows = _candidates(spark, d)
    budget = rows.count() // 2
    places = R.positions(rows.filter("NOT known AND NOT blocked").select("source_id", "n"), [F.desc("n"), F.col("source_id")], "place").select("source_id", (F.col("place") + 1).alias("place"))
    outcome = F.when(F.col("outcome") == "unreadable", "protected").otherwise(F.col("outcome"))
    v = V.account_verdict(F.col("known"), F.col("blocked"), F.col("place"), F.lit(budget), outcome, F.col("posts"), F.col("likes"))
    return rows.join(places, "source_id", "left").select("source_id", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


@plan(f"""WITH {_CANDIDATES}, r AS (SELECT source_id, CASE WHEN source_id % 13 <> 0 THEN CAST(source_id % 17 = 0 AS INT) END AS antifraud, n, CASE WHEN n >= 8 THEN 'ok' WHEN n > 0 THEN 'few' END AS vr_state, likes / 4 AS vr FROM c)
SELECT source_id, CASE WHEN COALESCE(antifraud, 0) <> 0 THEN 'antifraud' WHEN n < 6 THEN 'too_few_posts' WHEN COALESCE(vr_state, '') <> 'ok' THEN 'vr_unknown' WHEN vr IS NULL OR vr < 6 THEN 'vr_low' END AS reason,
  CASE WHEN COALESCE(antifraud, 0) <> 0 THEN 'antifraud' WHEN n < 6 THEN 'too_few_posts' END AS reason_without_vr FROM r""")
def promotion_reasons(spark, d):
    """Why a candidate is not promoted, with and without the rate of views."""
    fraud = F.when(F.col("source_id") % 13 != 0, (F.col("source_id") % 17 == 0).cast("int"))
    given = [fraud, F.col("n"), F.when(F.col("n") >= 8, "ok").when(F.col("n") > 0, "few"), F.col("likes") / 4]
    return _candidates(spark, d).select("source_id", V.promotion_reason(*given, 6, 6.0).alias("reason"), V.promotion_reason(*given, 6, 6.0, need_vr=False).alias("reason_without_vr"))


@plan(f"""WITH t AS (SELECT e.target_id, COUNT(DISTINCT e.source_id) AS sources, COUNT(DISTINCT CASE WHEN s_acctbal > 5000 THEN e.source_id END) AS trusted, MIN(e.kind) = 'A' AS first_rubric, ARG_MIN(e.kind, (e.day, e.content_id)) AS kind FROM {EDGES} e JOIN supplier ON s_suppkey = e.source_id GROUP BY 1),
h AS (SELECT *, CASE WHEN target_id % 10 = 0 THEN CAST(target_id * 100003 AS VARCHAR) WHEN target_id % 10 = 1 THEN 'user' || LPAD(CAST(target_id AS VARCHAR), 9, '0') ELSE 'part' || target_id END AS handle FROM t)
SELECT target_id, CAST(ROUND(sources + 3.0 * trusted + CASE WHEN first_rubric THEN 2 ELSE 0 END + CASE WHEN kind IN ('A', 'N') THEN 1 ELSE 0 END - CASE WHEN target_id % 10 <= 1 THEN 2 ELSE 0 END, 4) AS DOUBLE) AS priority FROM h""")
def account_candidate_priorities(spark, d):
    """Places in the queue of candidates, for parts that suppliers name."""
    trusted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 5000).alias("t"))
    first = F.min_by("kind", F.struct("day", "content_id"))
    each = edges(spark, d).join(trusted, "source_id").groupBy("target_id").agg(
        F.countDistinct("source_id").alias("sources"), F.countDistinct(F.when(F.col("t"), F.col("source_id"))).alias("trusted"), (F.min("kind") == "A").alias("first_rubric"), first.alias("kind")
    )
    via = F.when(F.col("kind") == "A", "author:search").when(F.col("kind") == "N", "orig").otherwise("mention")
    digit = F.col("target_id") % 10
    handle = F.when(digit == 0, (F.col("target_id") * 100003).cast("string")).when(digit == 1, F.concat(F.lit("user"), F.lpad(F.col("target_id").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("part"), "target_id"))
    return each.select("target_id", S.account_candidate_priority(F.col("sources"), F.col("trusted"), F.col("first_rubric"), via, urls.is_spam_handle(handle)).alias("priority"))


@plan(f"""SELECT content_id, CAST(CASE topic WHEN '1-URGENT' THEN 1.4 WHEN '2-HIGH' THEN 0.6 WHEN '3-MEDIUM' THEN 0.7 ELSE 1.0 END AS DOUBLE) AS weight FROM {CONTENTS}""")
def topic_weights(spark, d):
    """The weight of a post's topic; three priorities stand in for topics of the list."""
    named = F.when(F.col("topic") == "1-URGENT", "модели и релизы").when(F.col("topic") == "2-HIGH", "прочее").when(F.col("topic") == "3-MEDIUM", "влоги и личный опыт").otherwise(F.col("topic"))
    return contents(spark, d).select("content_id", S.topic_weight(named).alias("weight"))


@plan("""SELECT doc_id, CASE WHEN REGEXP_MATCHES(text, '\\p{Cyrillic}') OR doc_id % 10 = 0 THEN 'ru' WHEN doc_id % 3 = 0 THEN 'ru' WHEN doc_id % 3 = 1 AND lang = 'en' THEN 'en' END AS lang FROM documents""")
def guessed_languages(spark, d):
    """Cyrillic letters first, then what the search asked for; every tenth text has a Cyrillic word put before it."""
    asked = F.when(F.col("doc_id") % 3 == 0, "news lang:ru").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x lang:"), "lang"))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Привет "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.guess_language(text, asked).alias("lang"))


@plan("""SELECT page_id, CONTAINS(LOWER(html), 'thther') OR CONTAINS(LOWER(html), 'schung') OR CONTAINS(LOWER(url), 'example.org') AS hit FROM pages""")
def topic_signs(spark, d):
    """words of a topic in the page, or its hosts in the address."""
    return table(spark, d, "pages").select("page_id", T.shows_topic("html", F.col("url"), ["thther", "schung"], ["example.org"]).alias("hit"))


@plan("""WITH w AS (SELECT lang, UNNEST(LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+'), lambda x: LENGTH(x) >= 5))) AS w FROM documents),
k AS (SELECT lang, w, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY COUNT(*) DESC, w) AS k FROM w GROUP BY 1, 2),
t AS (SELECT lang, MAX(w) FILTER (k = 1) AS a, MAX(w) FILTER (k = 2) AS b, MAX(w) FILTER (k = 3) AS c FROM k WHERE k <= 5 GROUP BY 1)
SELECT lang, a || ': ' || b || ' — {итог одной фразой}|Как ' || a || ' меняет ' || b || ': {разбор за N минут}|{N} фактов о ' || a || ' и ' || b AS templates FROM t""")
def title_templates(spark, d):
    """three titles from the most frequent long words of each language."""
    each = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(F.filter(T.words("text"), lambda w: F.length(w) >= 5))).alias("w"))
    counted = each.groupBy("lang", "w").agg(F.count("*").alias("n"))
    best = R.cap_per_key(counted, "lang", [F.desc("n"), F.col("w")], 5).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "w"))).alias("t"))
    return best.select("lang", F.array_join(F.slice(T.title_templates(F.transform("t", lambda x: x["w"])), 1, 3), "|").alias("templates"))


@plan("""WITH s AS (SELECT s_nationkey AS story, COUNT(*) AS authors, MIN(CASE WHEN s_suppkey % 9 <> 0 THEN ABS(s_acctbal) / 10000 END) AS least, COUNT(*) FILTER (s_suppkey % 9 = 0) AS unknown FROM supplier GROUP BY 1)
SELECT story, authors >= 3 AND unknown = 0 AND least > 0.03 AS suspect FROM s""")
def suspect_stories(spark, d):
    """C4: stories of authors who all repeat texts; a story is a nation's suppliers, an author unknown here and there."""
    ratio = F.when(F.col("s_suppkey") % 9 != 0, F.abs(F.col("s_acctbal")) / 10000)
    told = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("story")).agg(F.collect_list("s_suppkey").alias("authors"), F.collect_list(F.struct(ratio.alias("r"))).alias("ratios"))
    return told.select("story", B.is_suspect(F.col("authors"), F.transform("ratios", lambda x: x["r"]), most=0.03).alias("suspect"))


@plan(f"""SELECT doc_id, COALESCE(doc_id % 23 <> 0, TRUE) AND doc_id % 4 <> 1 AND doc_id % 5 < 3 AND (n_chars < 400 AND LENGTH(text) <= 280 OR doc_id % 4 = 2) AS needed FROM documents""")
def full_text_needed(spark, d):
    """Posts whose text was cut: marked long (here: under 400 letters) yet no longer than the cut, or from the source that cuts."""
    deleted = F.when(F.col("doc_id") % 23 == 0, "2024-01-01")
    source = F.when(F.col("doc_id") % 4 == 1, "fxtwitter").when(F.col("doc_id") % 4 == 2, "cdn")
    attempts = F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5)
    return table(spark, d, "documents").select("doc_id", K.needs_full_text(deleted, source, attempts, F.when(F.col("n_chars") < 400, 1), F.col("text")).alias("needed"))


@plan(f"""SELECT snapshot_id AS id, COALESCE(CASE WHEN stage = 'error' THEN 'web' END, CASE content_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'telegram' END, CASE snapshot_id % 5 WHEN 0 THEN 'telegram' WHEN 1 THEN 'youtube' WHEN 2 THEN 'news' END) AS platform FROM {SNAPSHOTS}""")
def filled_platforms(spark, d):
    """The platform of log rows (events), by their run (the user), then by where they came from."""
    rows = snapshots(spark, d)
    log = rows.select(F.col("snapshot_id").alias("id"), F.col("content_id").alias("run_id"), F.when(F.col("stage") == "error", "web").alias("platform"))
    runs = rows.select(F.col("content_id").alias("run_id")).distinct().withColumn("platform", F.when(F.col("run_id") % 4 == 0, "x").when(F.col("run_id") % 4 == 1, "telegram"))
    came = F.when(F.col("snapshot_id") % 5 == 0, "tg").when(F.col("snapshot_id") % 5 == 1, "os").when(F.col("snapshot_id") % 5 == 2, "news")
    return K.filled_platforms(log, runs, rows.select(F.col("snapshot_id").alias("id"), came.alias("legacy_db"))).select("id", "platform")


@plan(f"""SELECT content_id, CASE WHEN content_id % 9 = 0 THEN 'https://kept/' || content_id WHEN platform = 'ASIA' THEN 'https://www.youtube.com/watch?v=' || content_id WHEN platform = 'EUROPE' THEN 'https://x.com/' || CASE WHEN content_id % 2 = 0 THEN handle ELSE country END || '/status/' || content_id
WHEN platform = 'AFRICA' THEN 'https://t.me/' || content_id END AS filled FROM {CONTENTS} LEFT JOIN {SOURCES} USING (source_id)""")
def filled_urls(spark, d):
    """Addresses of posts that have none, where their parts are known; the author's handle, else the source's."""
    rows = contents(spark, d).join(sources(spark, d), "source_id", "left")
    platform = F.when(F.col("platform") == "ASIA", "youtube").when(F.col("platform") == "EUROPE", "x").when(F.col("platform") == "AFRICA", "telegram")
    handle = F.coalesce(F.nullif(F.trim(F.when(F.col("content_id") % 2 == 0, F.col("handle")).otherwise(" ")), F.lit("")), F.col("country"))
    kept = F.when(F.col("content_id") % 9 == 0, F.concat(F.lit("https://kept/"), "content_id")).otherwise("")
    return rows.select("content_id", F.coalesce(F.nullif(kept, F.lit("")), urls.content_url(platform, F.col("content_id").cast("string"), handle)).alias("filled"))


@plan(f"""WITH m AS (SELECT target_id AS story_id, content_id, source_id, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY content_id, source_id) AS k FROM {EDGES} WHERE kind <> 'R' AND target_id % 3 <> 0)
SELECT story_id, CASE WHEN source_id % 2 = 0 THEN '@' || UPPER(s_name) ELSE s_name END AS handle, source_id FROM m JOIN supplier ON s_suppkey = source_id WHERE k = 1""")
def repaired_first_movers(spark, d):
    """First movers of a part's story found again by a supplier's name that differs in case only."""
    e = edges(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name"), "source_id")
    written = F.when(F.col("source_id") % 2 == 0, F.concat(F.lit("@"), F.upper("s_name"))).otherwise(F.col("s_name"))
    members = e.select(F.col("target_id").alias("story_id"), F.struct("content_id", "source_id").alias("content_id"), F.when(F.col("kind") != "R", "primary").otherwise("echo").alias("role"), written.alias("handle"))
    stories = e.select(F.col("target_id").alias("story_id")).distinct().withColumn("first_mover", F.when(F.col("story_id") % 3 == 0, F.lit(1)))
    return K.repaired_movers(stories, members, e.select("source_id", F.col("s_name").alias("handle")).distinct())


@plan(f"""WITH p AS (SELECT snapshot_id, EPOCH_US(captured_at) AS us, stage, TRY_CAST(props->>'$.k' AS BIGINT) AS k, content_id FROM {SNAPSHOTS}),
n AS (SELECT snapshot_id, us, stage = 'view' AS hint, 'k' || k AS handle, 'see @K' || k || ' and @u' || content_id AS line FROM p UNION ALL SELECT snapshot_id, us, stage = 'view', 'u' || content_id, 'see @K' || k || ' and @u' || content_id FROM p),
e AS (SELECT handle, STRING_AGG(line, '|' ORDER BY snapshot_id) AS examples FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY handle ORDER BY snapshot_id) AS r FROM n) WHERE r <= 2 GROUP BY 1)
SELECT n.handle, COUNT(*) AS mentions, COUNT(DISTINCT snapshot_id) AS posts, MIN(us) AS first_seen, MAX(us) AS last_seen, BOOL_OR(hint) AS hint, ANY_VALUE(e.examples) AS examples FROM n JOIN e USING (handle) GROUP BY 1""")
def candidate_mention_details(spark, d):
    """Mentions of candidates with a hint of the topic and the first two lines that name them, in texts written from events."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("see @K"), k, F.lit(" and @u"), "content_id", F.lit("\nmore words"))
    posts = snapshots(spark, d).select("snapshot_id", text.alias("text"), F.unix_micros(F.col("captured_at").cast("timestamp")).alias("at"), F.when(F.col("stage") == "view", True).alias("ai"))
    found = K.mentions_of_candidates(posts, "snapshot_id", "text", "at", T.mentions("text"), F.col("ai"))
    return found.withColumn("examples", F.array_join("examples", "|"))


@plan(f"SELECT topic AS section, COUNT(*) AS posts, GREATEST(COUNT(*) // 100 * 8, 200) AS pool FROM {CONTENTS} GROUP BY 1")
def candidate_pools(spark, d):
    """K6: how many rows a section of a report looks at; a section shows a hundredth of a topic."""
    return contents(spark, d).groupBy(F.col("topic").alias("section")).agg(F.count("*").alias("posts")).select("section", "posts", R.pool_size(F.floor(F.col("posts") / 100)).alias("pool"))


@plan("""WITH RECURSIVE l AS (SELECT conv_id, turn, STRING_SPLIT(COALESCE(text, ''), chr(10)) AS ls FROM (SELECT conv_id, turn, MIN(text) AS text FROM conversations GROUP BY 1, 2)),
w AS (SELECT conv_id, turn, 0 AS i, 1 AS piece, CAST('' AS VARCHAR) AS held FROM l
  UNION ALL SELECT w.conv_id, w.turn, i + 1, CASE WHEN held <> '' AND LENGTH(held) + LENGTH(ls[i + 1]) + 1 > 120 THEN piece + 1 ELSE piece END,
    CASE WHEN held <> '' AND LENGTH(held) + LENGTH(ls[i + 1]) + 1 > 120 THEN '' ELSE held END || ls[i + 1] || chr(10)
  FROM w JOIN l ON l.conv_id = w.conv_id AND l.turn = w.turn WHERE i < LEN(ls)),
p AS (SELECT conv_id, turn, piece, ARG_MAX(held, i) AS held FROM w WHERE i > 0 GROUP BY 1, 2, 3)
SELECT conv_id, turn, COUNT(*) AS pieces, MD5(STRING_AGG(REGEXP_REPLACE(held, '\\s+$', ''), '|' ORDER BY piece)) AS text_hash FROM p
WHERE NOT (REGEXP_MATCHES(held, '^\\s*$') AND piece = (SELECT MAX(q.piece) FROM p q WHERE q.conv_id = p.conv_id AND q.turn = p.turn)) GROUP BY 1, 2""")
def text_pieces(spark, d):
    """Turns in pieces of whole lines of 120 characters with their ends."""
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    pieces = rows.select("conv_id", "turn", T.split_pieces("text", 120).alias("p")).filter(F.size("p") > 0)
    return pieces.select("conv_id", "turn", F.size("p").cast("long").alias("pieces"), F.md5(F.array_join("p", "|")).alias("text_hash"))


@plan("""WITH t AS (SELECT doc_id, lang, source, TIMESTAMP '2024-01-01' + TO_MINUTES(CAST(doc_id * 37 AS INT)) + INTERVAL 3 HOUR AS at_ FROM documents)
SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS emoji, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_tags, HOUR(at_) AS hour, ISODOW(at_) AS weekday FROM t""")
def title_details(spark, d):
    """emoji and tags of titles, the hour and weekday (Monday is 1) of a zone three hours ahead."""
    rows = table(spark, d, "documents")
    title = F.concat(F.when(F.col("doc_id") % 4 == 0, "🎁✅ ").when(F.col("doc_id") % 4 == 1, "⭐").otherwise(""), "source")
    tags = F.when(F.col("doc_id") % 5 == 0, "broken").otherwise(F.to_json(F.array("lang", "source")))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 37 * 60)
    local = F.from_utc_timestamp(at, "Europe/Moscow")
    n_tags = F.size(F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>")))
    return rows.select("doc_id", T.title_emoji(title).cast("long").alias("emoji"), n_tags.cast("long").alias("n_tags"), F.hour(local).cast("long").alias("hour"), (F.weekday(local) + 1).cast("long").alias("weekday"))
