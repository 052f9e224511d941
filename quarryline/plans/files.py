"""Sources and sinks over files: lines, registries, exports and journals written from tables to the shared folder and read as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans.registration import plan
from quarryline.plans.roles import SOURCES, sources
from quarryline.session import shared_dir, table
from quarryline.sources import feeds, markup

_ROW = "conv_id long, turn long, role string, text string"


def _lines(spark: SparkSession, d: str) -> str:
    """Conversations as JSON lines; of every seventh line the end is lost, every eleventh is no JSON at all."""
    rows = table(spark, d, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    broken = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.left(line, F.lit(20))).when((F.col("conv_id") * 8 + F.col("turn")) % 11 == 0, "not json").otherwise(line)
    path = shared_dir(spark)
    rows.select(broken.alias("value")).write.text(path)
    return path


def _feed(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    return feeds.read_jsonl(spark, _lines(spark, d), _parse_datatype_string(_ROW))


_GOOD = "(conv_id + turn) % 7 <> 0 AND (conv_id * 8 + turn) % 11 <> 0"


@plan(f"SELECT conv_id, turn, role, MD5(text) AS text_hash FROM conversations WHERE {_GOOD} AND role IN ('user', 'system')")
def feed_rows(spark, d):
    """Lines of wanted kinds; broken lines are left out."""
    wanted, _ = feeds.observed_feed(_feed(spark, d), "role", ["user", "system"])
    return wanted.select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


@plan(f"SELECT COUNT(*) AS lines, COUNT(*) FILTER (NOT ({_GOOD})) AS bad, COUNT(*) FILTER ({_GOOD} AND role IN ('user', 'system')) AS wanted, COUNT(*) FILTER ({_GOOD} AND role NOT IN ('user', 'system')) AS other FROM conversations")
def feed_counters(spark, d):
    """Lines, broken, wanted and other ones, counted while the wanted are read."""
    wanted, counters = feeds.observed_feed(_feed(spark, d), "role", ["user", "system"])
    wanted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(counters.get[k] for k in ("lines", "bad", "wanted", "other"))], "lines long, bad long, wanted long, other long")


@plan("""WITH k AS (SELECT conv_id, turn, role, (conv_id + turn) % 8 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN turn WHEN 1 THEN turn WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 7 THEN turn END AS n,
CASE k WHEN 0 THEN CAST(turn AS VARCHAR) WHEN 1 THEN CAST(turn AS VARCHAR) WHEN 2 THEN role || ',x' WHEN 3 THEN CAST(conv_id AS VARCHAR) || ',' || role || turn WHEN 5 THEN role WHEN 6 THEN role ELSE '' END AS ids FROM k WHERE k <> 7
UNION ALL SELECT conv_id, turn, turn, CAST(turn AS VARCHAR) || '.5' FROM k WHERE k = 7""")
def tolerant_fields(spark, d):
    """A field that is a number, text, a list of ids or objects, a truth or an object, as a count and as ids."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    k, turn, conv = (F.col("conv_id") + F.col("turn")) % 8, F.col("turn").cast("string"), F.col("conv_id").cast("string")
    raw = (
        F.when(k == 0, turn)
        .when(k == 1, q(F.concat(F.lit(" "), turn, F.lit(" "))))
        .when(k == 2, F.concat(F.lit("["), q("role"), F.lit(', "x", '), q("role"), F.lit(", null, true]")))
        .when(k == 3, F.concat(F.lit('[{"id": '), conv, F.lit('}, {"id": "", "url": '), q(F.concat("role", turn)), F.lit("}, {}]")))
        .when(k == 4, "true")
        .when(k == 5, F.concat(F.lit('{"link": '), q("role"), F.lit("}")))
        .when(k == 6, q("role"))
        .otherwise(F.concat(turn, F.lit(".5")))
    )
    v = F.try_parse_json(raw)
    return table(spark, d, "conversations").select("conv_id", "turn", feeds.as_count(v).alias("n"), F.array_join(feeds.as_ids(v), ",").alias("ids"))


@plan(f"SELECT LOWER(handle) AS handle, MIN(country) AS country FROM {SOURCES} WHERE source_id % 10 <> 0 GROUP BY 1")
def registry_rows(spark, d):
    """A CSV registry with names in several forms, a row for each; rows without a name are left out."""
    rows = sources(spark, d)
    name = F.when(F.col("source_id") % 10 == 0, "").when(F.col("source_id") % 3 == 0, F.concat(F.lit(" @"), F.upper("handle"))).otherwise(F.col("handle"))
    path = shared_dir(spark)
    written = rows.select(name.alias("handle"), "country")
    written.unionByName(written.filter("handle LIKE '%7'")).write.option("header", True).csv(path)  # some of them twice
    return feeds.read_registry(spark, path, "handle").select("handle", "country")


@plan("SELECT conv_id, turn, role, '2024-01-01' AS exported_at, ROW_NUMBER() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations")
def exported_lines(spark, d):
    """An export in order with its time, read back in the order of its files, their blocks and lines."""
    path = shared_dir(spark)
    feeds.export_jsonl(table(spark, d, "conversations").select("conv_id", "turn", "role"), path, ["conv_id", "turn"], "2024-01-01")
    stored = spark.read.schema("conv_id long, turn long, role string, exported_at string").json(path)
    # Tasks read blocks of a file, in any order, so only the lines of a block are numbered one after another.
    placed = stored.withColumns({"__file": F.col("_metadata.file_name"), "__block": F.col("_metadata.file_block_start"), "__line": F.monotonically_increasing_id()})
    counts = placed.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__line").alias("__first"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block
    starts = counts.select("__file", "__block", (before - F.col("__first")).alias("__shift"))
    return placed.join(starts, ["__file", "__block"]).select("conv_id", "turn", "role", "exported_at", (F.col("__line") + F.col("__shift")).alias("place"))


@plan("SELECT event_type AS kind, COUNT(*) + COUNT(*) FILTER (value > 100) AS n, CAST(ROUND(SUM(value) + SUM(CASE WHEN value > 100 THEN value ELSE 0 END), 2) AS DOUBLE) AS total FROM events GROUP BY 1")
def journal_rows(spark, d):
    """A journal that is only appended to, by kind; a second run adds what it has seen."""
    path, events = shared_dir(spark), table(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id", "value")
    feeds.append_journal(events, path, ["kind"])
    feeds.append_journal(events.filter("value > 100"), path, ["kind"])
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@plan("SELECT conv_id, CAST(turn AS VARCHAR) AS external_id, 'ann' || conv_id AS handle, MD5(text) AS text_hash, CASE WHEN turn % 2 = 0 THEN turn * 3 END AS likes, turn AS replies, conv_id AS reposts FROM conversations WHERE (conv_id + turn) % 5 <> 0")
def posts_from_json(spark, d):
    """Posts from JSON objects as a site gives them; objects without id are left out."""
    post = F.struct(
        F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.col("turn").cast("string")).alias("id_str"), F.col("text").alias("full_text"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 3).alias("favorite_count"),
        F.col("turn").alias("reply_count"), F.col("conv_id").alias("retweet_count"), F.struct(F.concat(F.lit("Ann"), "conv_id").alias("screen_name")).alias("user"), F.lit(True).alias("truncated"),
    )
    found = markup.posts_from_json(table(spark, d, "conversations").select("conv_id", F.to_json(post).alias("body")), "body", ["conv_id"])
    return found.select("conv_id", "external_id", "handle", F.md5("text").alias("text_hash"), "likes", "replies", "reposts")
