"""Feeds, markup and streams on small inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarryline.sources import feeds, markup
from quarryline.streaming import windows


def test_jsonl_counts_bad_lines(spark, tmp_path):
    (tmp_path / "feed.jsonl").write_text('{"kind": "x", "n": 1}\nnot json\n{"kind": "y"}\n\n{"kind": "x"}\n')
    schema = StructType([StructField("kind", StringType()), StructField("n", LongType())])
    rows = feeds.read_jsonl(spark, f"file://{tmp_path}/feed.jsonl", schema)
    wanted, counters = feeds.split_feed(rows, "kind", ["x"])
    assert sorted(str(r.n) for r in wanted.collect()) == ["1", "None"]
    assert tuple(counters.first()) == (4, 1, 2, 1)


def test_tolerant_fields(spark):
    df = spark.createDataFrame([('["a","b"]',), ("a",), ('{"k":1}',), ("",), (None,), ('"q"',)], "t string")
    assert [r[0] for r in df.select(feeds.as_list(F.col("t"))).collect()] == [["a", "b"], ["a"], ['{"k":1}'], [], [], ["q"]]
    df = spark.createDataFrame([("1 234.5",), ("1,000",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(feeds.as_number(F.col("t"))).collect()] == [1234.5, 1000.0, None, None]


def test_registry_and_export(spark, tmp_path):
    (tmp_path / "r.csv").write_text("handle,tier\n@Ann,1\nann,2\n,3\nbob,1\n")
    rows = feeds.read_registry(spark, f"file://{tmp_path}/r.csv", "handle")
    assert sorted(r.handle for r in rows.collect()) == ["ann", "bob"]
    feeds.export_jsonl(rows.select("handle"), f"file://{tmp_path}/out", ["handle"], "2024-01-01", single=True)
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*.json")) for x in f.read_text().splitlines()]
    assert lines == [{"handle": "ann", "exported_at": "2024-01-01"}, {"handle": "bob", "exported_at": "2024-01-01"}]


def test_rss_items_and_summaries(spark):
    rss = "<rss><channel><title>A &amp; B</title><language>en</language><item><title>One</title><link>http://a.b/1</link><guid>g1</guid></item><item><title>Two</title></item></channel></rss>"
    df = spark.createDataFrame([(1, rss), (2, "<html>no feed"), (3, None)], "id long, body string")
    items = markup.rss_items(df, "body", ["id"]).orderBy("pos").collect()
    assert [(r.id, r.title, r.link) for r in items] == [(1, "One", "http://a.b/1"), (1, "Two", None)]
    heads = {r.id: (r.title, r.lang, r.entries) for r in markup.feed_summary(df, "body", ["id"]).collect()}
    assert heads == {1: ("A & B", "en", 2), 2: ("", None, 0), 3: ("", None, 0)}


def test_html(spark):
    page = '<html lang="fr"><head><title> T &lt;1&gt; </title><link rel="alternate" type="application/rss+xml" href="/f.xml"><script id="__NEXT_DATA__" type="application/json">{"a": {"b": 7}}</script></head><body><!-- x --><p>One <b>bo</b>ld<p class="c">Two</p><p> </p><a class="l" href="/u">u</a></body></html>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "plain")], "id long, html string")
    h = F.col("html")
    r = df.filter("id = 1").select(markup.title(h).alias("t"), markup.page_lang(h).alias("l"), markup.hrefs(h).alias("u"), markup.alternate_feeds(h).alias("f"), F.try_variant_get(markup.next_data(h), "$.a.b", "int").alias("b")).first()
    assert tuple(r) == ("T <1>", "fr", ["/u"], ["/f.xml"], 7)
    assert [(r.id, r.text) for r in markup.paragraphs(df, "html", ["id"]).orderBy("pos").collect()] == [(1, "One bold"), (1, "Two")]
    assert df.filter("id > 1").select(markup.next_data(h).isNull()).distinct().first()[0]


def test_posts_from_json(spark):
    body = json.dumps({"id_str": "5", "full_text": "hi", "favorite_count": 3, "user": {"screen_name": "Ann"}})
    df = spark.createDataFrame([(1, body), (2, "{}"), (3, "broken")], "id long, body string")
    assert [(r.external_id, r.handle, r.likes, r.replies) for r in markup.posts_from_json(df, "body", ["id"]).collect()] == [("5", "ann", 3, None)]


def run(spark, tmp_path, frames, build, schema, mode="append"):
    """Feed frames as files, one per micro-batch."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{source}")
    out = build(stream)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).outputMode(mode).start(f"file://{tmp_path}/o")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"file://{tmp_path}/o").collect()


T0 = dt.datetime(2024, 1, 1)


def h(x):
    return T0 + dt.timedelta(hours=x)


def test_measurement_stages_with_timers(spark, tmp_path):
    frames = [[(1, T0, h(1)), (2, T0, h(2))], [(1, T0, h(14)), (3, h(14), h(15))], [(9, h(200), h(201))], [(9, h(200), h(202))]]
    rows = run(spark, tmp_path, frames, windows.stage_tracker, "content_id long, published_at timestamp, captured_at timestamp")
    got = {(r.content_id, r.stage): r.status for r in rows}
    assert got[1, "1h"] == "measured" and got[1, "6h"] == "measured_late" and got[1, "24h"] == "closed_no_data"
    assert got[2, "1h"] == "measured" and got[2, "6h"] == "closed_no_data" and got[3, "1h"] == "measured"


def test_late_rows_and_sessions(spark, tmp_path):
    # Spark judges lateness by the watermark that held one batch earlier, so a batch lies between.
    frames = [[("a", h(1)), ("a", h(1.1)), ("b", h(3))], [("a", h(40))], [("c", h(60))], [("a", h(2)), ("c", h(90))], [("c", h(91))]]
    rows = run(spark, tmp_path, frames, lambda s: windows.windowed_counts(s, "ts", ["k"], "1 hour", "2 hours"), "k string, ts timestamp")
    assert {(r.k, r.window_start.hour, r.n) for r in rows if r.window_start < h(24)} == {("a", 1, 2), ("b", 3, 1)}


def test_upsert_of_micro_batches(spark, tmp_path):
    step = windows.upsert_into(f"file://{tmp_path}/t", ["k"], "v")
    step(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long"), 0)
    step(spark.createDataFrame([("a", 5), ("c", 2)], "k string, v long"), 1)
    for _ in range(2):  # the same batch again changes nothing
        step(spark.createDataFrame([("b", 7)], "k string, v long"), 2)
    assert sorted(map(tuple, windows.upserted(spark, f"file://{tmp_path}/t").collect())) == [("a", 5), ("b", 7), ("c", 2)]
    step(spark.createDataFrame([], "k string, v long"), 3)
    written = {p.parent.name for p in (tmp_path / "t" / "version=3").rglob("*.parquet")}
    assert len(written) == 1  # one bucket of one key


def test_measurement_stages_at_microseconds(spark, tmp_path):
    """Times that are no whole seconds; of two snapshots in one micro-batch the earlier one measures, whatever their order."""
    at = T0 + dt.timedelta(microseconds=123_457)
    frames = [[(1, at, h(7)), (1, at, h(5)), (1, at, h(1))], [(9, h(300), h(301))], [(9, h(300), h(302))]]
    rows = run(spark, tmp_path, frames, windows.stage_tracker, "content_id long, published_at timestamp, captured_at timestamp")
    got = {(r.content_id, r.stage): (r.status, r.at) for r in rows}
    assert got[1, "1h"] == ("measured", h(1)) and got[1, "6h"] == ("measured", h(5))
    assert got[1, "24h"] == ("closed_no_data", at + dt.timedelta(hours=33))


def test_exported_lines_keep_their_places_in_split_files(spark, sf_dir):
    """A file that several tasks read is numbered through."""
    from quarryline.plans import registry

    small = {"spark.sql.files.maxPartitionBytes": "512b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = registry.QUERIES["exported_lines"](spark, sf_dir).orderBy("conv_id", "turn").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.place for r in found] == list(range(len(found)))
    assert len(found) > 20


def test_stream_scores_takes_an_arrival_a_batch_however_many_files_it_has(spark, tmp_path, monkeypatch):
    """A batch for each file would write the history again as often as there are files."""
    from quarryline.plans import streams

    shared = tmp_path / "shared"
    monkeypatch.setattr(streams, "shared_dir", lambda _: f"file://{shared}")
    rows = spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS ts", "id % 7 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'{}' AS props")
    rows.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "ARRIVAL_ROWS", 150)
    found = streams.stream_scores(spark, str(tmp_path)).collect()
    assert {r.user_id: (r.n, r.total) for r in found} == {u: (len(range(u, 400, 7)), float(sum(range(u, 400, 7)))) for u in range(7)}
    assert len(list((shared / "arrivals").glob("part*/part-*.parquet"))) == 15
    assert sorted(p.name for p in (shared / "state" / "commits").glob("[0-9]*")) == ["0", "1", "2", "3", "4"]


def test_times_of_a_key_are_an_array():
    import numpy as np
    import pandas as pd

    from quarryline.streaming.windows import _micros

    got = _micros(pd.Series(pd.to_datetime(["2024-01-01 00:00:00.000001", "1969-12-31 23:59:59.5"], format="ISO8601")))
    assert isinstance(got, np.ndarray) and got.tolist() == [1_704_067_200_000_001, -500_000]
