"""Column functions on hand-made edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.functions import scores, stats, times, urls
from quarryline.functions import text as T


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_text_hash_ignores_case_and_blanks(spark):
    a, b, c, d = values(spark, [("  Ab\n c ",), ("ab c",), (None,), ("",)], "t string", T.text_hash("t"))
    assert a == b and c == d and a != c


def test_shingles_of_short_texts_are_words(spark):
    assert values(spark, [("A b C d",), ("a a",), ("",), (None,)], "t string", T.shingles("t")) == [["a b c", "b c d"], ["a"], [], []]


def test_jaccard_of_empty_sets(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    assert values(spark, rows, "a array<string>, b array<string>", T.jaccard("a", "b")) == [0.0, 0.0, pytest.approx(1 / 3)]


def test_names_in_text(spark):
    text = "see @Ann_b and a@b.cd, #Тема https://www.news.org/x?y=1 http://t.co/z"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.mentions("t").alias("m"), T.hashtags("t").alias("h"), T.link_hosts("t").alias("l"), T.entities("t", ["see"]).alias("e")).first()
    assert (r.m, r.h, r.l) == (["ann_b"], ["тема"], ["news.org"])
    assert r.e == ["@ann_b", "news.org", "see"]


def test_promo_and_origin(spark):
    """Borders are in the query ``promo_cases``; here the whole-text rules and nulls."""
    rows = [("Промокод внутри",), ("скачай https://a.b/c?ref=1",), ("a calm note",), (None,)]
    assert values(spark, rows, "t string", T.promo_reason("t")) == ["marker", "call_link", None, None]
    rows = [("via @Example",), ("https://a.b/c look",), ("own words",), (None,)]
    assert values(spark, rows, "t string", T.origin("t")) == ["retelling", "retelling", "original", "original"]


def test_title_patterns(spark):
    assert values(spark, [("Top 10: WHY?",), ("plain words",), (None,)], "t string", T.title_pattern("t")) == ["number+question+colon+caps", "plain", "plain"]
    assert values(spark, [("abc",), ("a",), ("",)], "t string", T.typo_variants("t")) == [["acb", "bac"], [], []]


def test_counts_and_money(spark):
    rows = [("10.7K",), ("1 234",), ("2,5M",), ("12 345",), ("about 7 of",), ("none",), (None,), ("",)]
    assert values(spark, rows, "t string", T.parse_count("t")) == [10700, 1234, 2500000, 12345, 7, None, None, None]
    assert values(spark, [("raised $1.5M",), ("€ 20",), ("20",)], "t string", T.money("t")) == [1.5e6, 20.0, None]


def test_language(spark):
    assert values(spark, [("Привет мир",), ("hello мир",), ("",), (None,)], "t string", T.is_cyrillic("t")) == [True, False, False, False]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.com/Ann", ("account", "x", "ann", None)),
        ("https://twitter.com/ann/status/1", (None, None, None, "service_path")),
        ("https://x.com/", (None, None, None, "no_target")),
        ("t.me/s/Some_Channel", ("channel", "telegram", "some_channel", None)),
        ("https://t.me/+secret", (None, None, None, "invite")),
        ("https://youtu.be/abcdefghijk", ("video", "youtube", "abcdefghijk", None)),
        ("https://www.youtube.com/watch?v=abcdefghijk&t=1", ("video", "youtube", "abcdefghijk", None)),
        ("https://www.youtube.com/@Some.One", ("channel", "youtube", "some.one", None)),
        ("https://bit.ly/x", (None, None, None, "skip_host")),
        ("https://user@WWW.News.org:80/a", ("domain", "web", "news.org", None)),
        ("", (None, None, None, "bad_url")),
        (None, (None, None, None, "bad_url")),
    ],
)
def test_link_targets(spark, url, want):
    found = values(spark, [(url,)], "u string", urls.target(F.col("u")))[0]
    assert (found.kind, found.platform, found.value, found.skip) == want


def test_clean_urls_and_handles(spark):
    rows = [("https://a.b/c?utm_source=x&id=1&ref=y#z",), ("https://a.b/?fbclid=1",), (None,)]
    assert values(spark, rows, "u string", urls.clean_url(F.col("u"))) == ["https://a.b/c?id=1#z", "https://a.b/", ""]
    assert values(spark, [(" @Ann",), (None,)], "h string", urls.normal_handle(F.col("h"))) == ["ann", ""]
    assert values(spark, [("12345",), ("user123456789",), ("ann",), (None,)], "h string", urls.is_spam_handle(F.col("h"))) == [True, True, False, False]


def test_times_in_any_form(spark):
    rows = [("1700000000",), ("2023-11-14T22:13:20Z",), ("2023-11-15 01:13:20+0300",), ("2023-11-14 22:13",), ("2023-11-14",), ("soon",), ("",), (None,)]
    got = values(spark, rows, "t string", F.date_format(times.parse_any(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2023-11-14 22:13:20"] * 3 + ["2023-11-14 22:13:00", "2023-11-14 00:00:00", None, None, None]


def test_stages_buckets_and_sizes(spark):
    assert values(spark, [(0.0,), (3.5,), (15.0,), (48.0,), (None,)], "a double", times.stage(F.col("a"))) == ["1h", "6h", "24h", "72h", None]
    assert values(spark, [(0.5,), (1.0,), (72.0,), (None,)], "a double", times.age_bucket(F.col("a"))) == ["<1h", "1-6h", ">72h", ">72h"]
    assert values(spark, [(4999,), (5000,), (0,), (500000,), (None,)], "s long", times.size_class(F.col("s"))) == ["<5k", "5-25k", None, ">500k", None]
    assert values(spark, [("PT1H2M3S",), ("P1DT1S",), ("soon",), (None,)], "d string", times.iso_duration(F.col("d"))) == [3723, 86401, None, None]


def test_expected_slots(spark):
    slots = times.expected_slots(F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.col("n")))
    got = values(spark, [("2024-01-01 02:30:00",), ("2024-01-02 01:00:00",), ("2023-12-31 00:00:00",)], "n string", slots)
    assert [len(x) for x in got] == [3, 9, 0]
    assert got[1][-2:] == [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2)]


def test_engagement_and_penalties(spark):
    df = spark.createDataFrame([(0, 1), (None, 1), (10, None), (10, 2)], "v long, r long")
    assert [r[0] for r in df.select(scores.engagement_rate(F.col("v"), F.col("r"))).collect()] == [None, None, None, 0.2]
    rows = [(None, None), (None, 2.0), (4.0, None), (4.0, 1.0), (0.0, 3.0), (0.0, 0.0)]
    assert values(spark, rows, "a double, b double", scores.combined_engagement(F.col("a"), F.col("b"))) == [None, 2.0, 4.0, 2.0, 3.0, 0.0]
    assert values(spark, [(0,), (1,), (4,), (None,)], "c long", scores.copy_penalty(F.col("c"))) == [0.0, 0.0, 0.75, 0.0]


def test_viral_index_needs_two_axes_and_caps(spark):
    axes = {"views": (F.col("v"), F.lit(1.0)), "likes": (F.col("l"), F.lit(1.0))}
    got = values(spark, [(4.0, 100.0), (4.0, None), (4.0, 0.0)], "v double, l double", scores.viral_index(axes, F.lit(0.0)))
    assert got == [pytest.approx((4 * 20) ** 0.5), None, None]


def test_weights_are_renormalised(spark):
    z = {"g7": F.col("a"), "median_metric_24h": F.col("b"), "trusted_indegree_30d": F.lit(None).cast("double"), "new_entity_rate": F.lit(None).cast("double")}
    assert values(spark, [(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double", scores.weighted_present(z)) == [pytest.approx(1.2 / 0.7), 3.0, None]


def test_robust_z_edges(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", 5.0), (4, "b", 7.0), (5, None, 1.0), (6, "a", None)], "id long, k string, x double")
    got = {r.id: r.z for r in stats.robust_z(df, ["k"], "x").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: None, 6: None}


def test_mid_ranks_and_top_fraction(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, None)], "id long, f long")
    assert {r.id: r.x for r in stats.mid_rank_factor(df, "f", "x").collect()} == {1: pytest.approx(4 / 3), 2: pytest.approx(4 / 3), 3: pytest.approx(11 / 6), 4: 1.0}
    assert [r.id for r in stats.top_fraction(df, [], "f", "id", 0.1).collect()] == [3]
    assert stats.most_frequent(df.withColumn("k", F.lit(1)), ["k"], "f").first().f == 5


def test_names(spark):
    assert values(spark, [("@News.org",), ("the",), ("--x--",), ("42",), (None,), ("Qwen-3.",)], "t string", T.normal_name("t")) == ["news", None, None, None, None, "qwen-3"]
    assert values(spark, [("Dynamic ZCode meets gpt-4 in 2024",), (None,)], "t string", T.distinctive_names("t")) == [["zcode", "gpt-4"], []]


def test_word_shingles_make_the_words_of_a_text_once(spark, sf_dir):
    from quarryline.plans import registry

    plan = registry.QUERIES["word_shingles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
