"""Near-duplicates, stories, novelties. Iterative operators have no SQL; tests hold them against plain versions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import neardup, stories, trends
from quarryline.operators.components import connected_components
from quarryline.plans.registration import plan
from quarryline.plans.roles import CONTENTS, SNAPSHOTS, contents, snapshots
from quarryline.session import shared_dir, table, write_through


@plan("""WITH RECURSIVE w AS (SELECT doc_id, REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
r AS (SELECT doc_id, UNNEST(LIST_DISTINCT(CASE WHEN LEN(w) < 3 THEN w ELSE LIST_TRANSFORM(RANGE(1, LEN(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS r FROM w),
h AS (SELECT doc_id, CAST('0x' || LEFT(MD5(r), 16) AS UBIGINT) AS h FROM r),
bits AS (SELECT doc_id, b, 2 * SUM((h >> b) & 1) > COUNT(*) AS one FROM h, (SELECT CAST(UNNEST(RANGE(64)) AS UBIGINT) AS b) GROUP BY 1, 2),
prints AS (SELECT doc_id, CAST(SUM(CASE WHEN one THEN CAST(1 AS HUGEINT) << CAST(b AS INT) ELSE 0 END) AS UBIGINT) AS fp FROM bits GROUP BY 1),
nodes AS (SELECT fp, MIN(doc_id) AS rep FROM prints GROUP BY 1),
links AS (SELECT x.fp AS a, y.fp AS b FROM nodes x JOIN nodes y ON BIT_COUNT(CAST(XOR(x.fp, y.fp) AS BIT)) <= 6),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
found AS (SELECT a AS fp, MIN(rep) AS cluster FROM reached JOIN nodes ON nodes.fp = b GROUP BY 1)
SELECT doc_id, COALESCE(cluster, doc_id) AS cluster FROM documents LEFT JOIN prints USING (doc_id) LEFT JOIN found USING (fp)""")
def near_duplicate_clusters(spark, d):
    """F3, J15, C1."""
    return neardup.clusters(table(spark, d, "documents"), "doc_id", "text")


#: Words of the invented texts that stand in for a lexicon of names.
LEXICON = ["ther", "ing", "ment", "ung"]


@plan()
def story_clusters(spark, d):
    """C2 over the turns of conversations: all words of three letters or more, names and hosts as entities, twenty minutes apart, so that a window of 30 hours holds ninety turns either side."""
    turns = table(spark, d, "conversations")
    rows = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("w", T.words("text"))
    posts = rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.timestamp_seconds(F.col("conv_id") * 1200 + F.col("turn") * 60).alias("ts"), T.content_of(F.col("w")).alias("tokens"), T.entities("text", LEXICON, F.col("w")).alias("ents")
    )
    return stories.stories(posts, "id", "ts", "tokens", "ents")


@plan("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS a, CAST((s_suppkey * 7 + 3) % 40 AS BIGINT) AS b FROM supplier), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT a AS n, a AS m FROM u UNION SELECT u.a, r.m FROM r JOIN u ON u.b = r.n) SELECT n AS node, MIN(m) AS component FROM r GROUP BY n""")
def link_components(spark, d):
    """Components of links between suppliers."""
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % 40).alias("dst"))
    return connected_components(e)


@plan("""WITH w AS (SELECT doc_id, lang, source, UNNEST(LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+'), lambda x: LENGTH(x) >= 6))) AS entity FROM documents), o AS (SELECT DISTINCT entity FROM w WHERE doc_id < 600)
SELECT entity, COUNT(DISTINCT source) AS authors, COUNT(DISTINCT lang) AS platforms, COUNT(*) AS posts FROM w WHERE doc_id >= 600 AND entity NOT IN (SELECT entity FROM o) GROUP BY entity HAVING COUNT(DISTINCT source) >= 2 AND COUNT(DISTINCT lang) >= 1""")
def novel_words(spark, d):
    """What later texts have that no earlier one has, in two sources or more."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.filter(T.words("text"), lambda w: F.length(w) >= 6).alias("ents"))
    return trends.novelties(docs, "ents", "source", "lang", "doc_id", F.lit(600), 2, 1)


@plan(f"""WITH p AS (SELECT a.source_id AS a, b.source_id AS b FROM (SELECT DISTINCT source_id, day FROM {CONTENTS}) a JOIN (SELECT DISTINCT source_id, day FROM {CONTENTS}) b ON a.day = b.day AND a.source_id < b.source_id) SELECT a, b, COUNT(*) AS shared FROM p GROUP BY 1, 2""")
def pairs_by_rare_value(spark, d):
    """J16 over all rows: pairs of sources that share a day, however many sources it has."""
    return _shared(contents(spark, d).select("source_id", "day").distinct())


@plan(f"""WITH e AS (SELECT DISTINCT source_id, day FROM {CONTENTS}), f AS (SELECT day FROM e GROUP BY 1 HAVING COUNT(*) <= 50), r AS (SELECT source_id, day FROM e JOIN f USING (day))
SELECT x.source_id AS a, y.source_id AS b, COUNT(*) AS shared FROM r x JOIN r y ON x.day = y.day AND x.source_id < y.source_id GROUP BY 1, 2""")
def pairs_by_rare_day(spark, d):
    """J16 in full: pairs of sources that share a day of at most ``RARE_DF`` sources, over all rows, so no value brings together more."""
    each = contents(spark, d).select("source_id", "day").distinct()
    few = each.groupBy("day").agg(F.count("*").alias("df")).filter(F.col("df") <= stories.RARE_DF).select("day")
    rare = each.join(few, "day")
    return _shared(rare)


#: Pairs that one task makes and counts, and sources of a block that meet the other block at once.
PAIRS_IN_TASK, SOURCES_AT_ONCE = 1_000_000, 2000


def _shared(rare):
    """Pairs of sources and the days that they share, from distinct (``source_id``, ``day``).

    Sources are dealt to blocks and two blocks meet in one place, which makes all of their pairs and counts them there: no pair is shuffled, a source is sent once per block. Blocks and
    tasks grow with the pairs, so that memory does not.
    """
    rare = write_through(rare.dropna(), shared_dir(rare.sparkSession))
    days = rare.groupBy("day").agg(F.count("*").alias("n"))
    pairs = days.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n")).first().n or 0
    tasks = pairs // PAIRS_IN_TASK + 1
    blocks = math.isqrt(2 * tasks) + 1
    own = rare.groupBy("day", F.pmod(F.xxhash64("source_id"), F.lit(blocks)).alias("block")).agg(F.collect_list("source_id").alias("sources"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    placed = met.select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("place"), "day", "block", "sources").repartition(tasks, "place")
    kind, at_once = rare.schema["source_id"].dataType.simpleString(), SOURCES_AT_ONCE

    def counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(*divmod(key[0].as_py(), blocks), pa.Table.from_batches(batches), at_once)

    return placed.groupBy("place").applyInArrow(counted, f"a {kind}, b {kind}, shared long")


def _counted(x, y, rows, at_once):
    """Pairs of the sources of two blocks with their days, or of one block with itself, for so many sources of the first at once."""
    lists = rows.column("sources").combine_chunks()
    source, at = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    kind = source.type
    day = rows.column("day").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[at]
    names, source = np.unique(source.to_numpy(zero_copy_only=False), return_inverse=True)
    block = rows.column("block").to_numpy()[at]
    right = np.flatnonzero(block == y)
    right = right[np.argsort(day[right], kind="stable")]
    starts = np.searchsorted(day[right], np.arange(len(rows) + 1))
    left = np.flatnonzero(block == x)
    left = left[np.argsort(source[left], kind="stable")]
    cuts = np.flatnonzero(np.diff(source[left], prepend=-1))  # where each source begins
    for first in range(0, len(cuts), at_once):
        stop = cuts[first + at_once] if first + at_once < len(cuts) else len(left)
        part = left[cuts[first] : stop]
        lo, n = starts[day[part]], starts[day[part] + 1] - starts[day[part]]
        partner = right[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        a, b = np.repeat(source[part], n), source[partner]
        if x == y:
            a, b = a[a < b], b[a < b]
        pair, shared = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names[pair // len(names)], kind), pa.array(names[pair % len(names)], kind), pa.array(shared, pa.int64())], names=["a", "b", "shared"])


@plan(f"""WITH b AS (SELECT snapshot_id AS id, stage, captured_at AS t, content_id, CAST(FLOOR(EPOCH(captured_at) / 108000) AS BIGINT) AS k FROM {SNAPSHOTS} WHERE stage IN ('purchase', 'signup')) SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON x.content_id = y.content_id AND x.id < y.id AND x.stage <> y.stage WHERE ABS(EPOCH_US(x.t) - EPOCH_US(y.t)) <= 108000000000""")
def pairs_in_time(spark, d):
    """Pairs within thirty hours, by equal keys and time buckets instead of a nested loop."""
    return _pairs_in_time(snapshots(spark, d).filter("stage in ('purchase', 'signup')"))


@plan(f"""WITH b AS (SELECT snapshot_id AS id, stage, EPOCH_US(captured_at) AS t, content_id FROM {SNAPSHOTS}) SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON x.content_id = y.content_id AND x.id < y.id AND x.stage <> y.stage AND ABS(x.t - y.t) <= 108000000000""")
def pairs_in_time_all_stages(spark, d):
    """J17 in full: pairs of any two stages."""
    return _pairs_in_time(snapshots(spark, d))


def _pairs_in_time(rows):
    at = F.unix_micros(F.col("captured_at").cast("timestamp"))
    bucketed = rows.select("content_id", "snapshot_id", "stage", at.alias("t"), F.floor(at / 108e9).alias("k"))
    left = bucketed.select("content_id", F.col("snapshot_id").alias("a"), F.col("stage").alias("sa"), F.col("t").alias("ta"), F.explode(F.array(F.col("k") - 1, "k", F.col("k") + 1)).alias("k"))
    right = bucketed.select("content_id", F.col("snapshot_id").alias("b"), F.col("stage").alias("sb"), F.col("t").alias("tb"), "k")
    near = left.join(right, ["content_id", "k"]).filter((F.col("a") < F.col("b")) & (F.col("sa") != F.col("sb")) & (F.abs(F.col("ta") - F.col("tb")) <= 108_000_000_000))
    return near.select("a", "b")


@plan("""WITH c AS (SELECT doc_id, MD5(text) AS c FROM documents), l AS (SELECT a.doc_id AS a, b.doc_id AS b, a.quality = b.quality AS same FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1), j AS (SELECT same, x.c = y.c AS said FROM l JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b)
SELECT COUNT(*) FILTER (said AND same) AS hit, COUNT(*) FILTER (said AND NOT same) AS wrong, COUNT(*) FILTER (same AND NOT said) AS missed FROM j""")
def pair_quality(spark, d):
    """A clustering against labelled pairs."""
    groups = table(spark, d, "documents").select("doc_id", F.md5("text").alias("c"))
    labels = table(spark, d, "labels")
    other = labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b_id"), F.col("quality").alias("q2"))
    pairs = labels.join(other, "doc_id").select(F.col("doc_id").alias("a_id"), "b_id", (F.col("quality") == F.col("q2")).alias("same"))
    return stories.pair_quality(groups, pairs, "doc_id", "c").select("hit", "wrong", "missed")


@plan()
def cross_platform_stories(spark, d):
    """C3, C5 over documents, with the language as platform, one minute apart each."""
    docs = table(spark, d, "documents").withColumn("w", T.words("text")).select(
        "doc_id", F.col("lang").alias("platform"), F.timestamp_seconds(F.col("doc_id") * 60).alias("ts"),
        F.filter("w", lambda w: F.length(w) >= 3).alias("words"), F.array_union(T.entities("text"), T.content_of(F.col("w"))).alias("ents"),
    )
    return stories.cross_stories(docs, "doc_id", "ts", "platform", "words", "ents")


@plan("""WITH w AS (SELECT doc_id, source, lang, LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]+'), lambda x: LENGTH(x) >= 8)) AS e FROM documents), o AS (SELECT DISTINCT UNNEST(e) AS e FROM w WHERE doc_id < 100),
n AS (SELECT DISTINCT lang FROM (SELECT lang, UNNEST(e) AS e FROM w WHERE doc_id >= 100) WHERE e NOT IN (SELECT e FROM o))
SELECT lang, COUNT(*) AS posts, COUNT(DISTINCT LOWER(source)) AS authors, MIN(doc_id) AS first_id, COUNT(DISTINCT LOWER(source)) = 1 AS is_single, lang IN (SELECT lang FROM n) AS is_new FROM w WHERE doc_id >= 100 GROUP BY lang""")
def story_summary(spark, d):
    """C4: what a story consists of, with the language as story."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.array_distinct(F.filter(T.words("text"), lambda w: F.length(w) >= 8)).alias("e"))
    out = stories.build(docs.filter("doc_id >= 100"), docs.filter("doc_id < 100"), "lang", "doc_id", "source", "doc_id", "e")
    return out.select("lang", "posts", "authors", "first_id", "is_single", "is_new")
