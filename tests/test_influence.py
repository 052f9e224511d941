"""Echoes and spread against plain versions; a name that a third of all posts use."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quarryline.operators import influence

T0 = dt.datetime(2024, 1, 1)
POST = "id string, author string, at timestamp, mentions array<string>, origin string, links array<string>, counts boolean"


def test_spread_of_one_post(spark):
    at = lambda text: dt.datetime.fromisoformat(text)
    rows = [
        ("101", "Ann", at("2024-01-01 00:00:00"), [], None, [], True),
        ("102", "bob", at("2024-01-01 05:00:00"), ["ANN"], None, [], True),
        ("103", "cat", at("2024-01-04 00:00:00"), [], "ann", [], True),
        ("104", "dan", at("2024-01-04 00:00:01"), ["ann"], None, [], True),
        ("105", "eve", at("2024-01-02 00:00:00"), [], None, ["https://x.com/ann/status/101"], True),
        ("106", "fay", at("2024-01-02 00:00:00"), ["ann"], None, [], False),
        ("107", "ann", at("2024-01-02 00:00:00"), ["ann"], None, ["https://x.com/ann/status/101"], True),
        ("108", "gus", at("2023-12-31 00:00:00"), ["ann"], None, [], True),
        ("109", "bob", at("2024-01-02 00:00:00"), ["ann", "cat"], None, [], True),
    ]
    posts, verified = spark.createDataFrame(rows, POST), spark.createDataFrame([("Bob",)], "author string")
    want = {("101", "bob", 1.65), ("101", "cat", 1.5), ("101", "eve", 1.5), ("107", "cat", 1.5), ("107", "dan", 1.5), ("107", "bob", 1.65)}
    assert set(map(tuple, influence.spread(posts, verified).collect())) == want
    scores = dict(map(tuple, influence.spread_scores(posts, verified).collect()))
    assert scores == {i: round(sum(w for p, _, w in want if p == i), 6) for i, *_ in rows}
    assert influence.spread(posts.limit(0), verified).count() == influence.spread_scores(posts.limit(0), verified).count() == 0


def plain(rows, verified, hours):
    out = set()
    for i, author, t, *_ in rows:
        if author is None or t is None:
            continue
        for j, by, s, mentions, origin, links, counts in rows:
            if not counts or by is None or s is None or by.lower() == author.lower() or not t <= s <= t + dt.timedelta(hours=hours):
                continue
            named = author.lower() in [m.lower() for m in [*mentions, *([origin] if origin else [])]]
            if named or (j != i and any(x.rstrip("/").endswith(f"/{i}") for x in links)):
                out.add((i, by.lower(), 1.65 if by.lower() in verified else 1.5))
    return out


def test_spread_against_all_pairs(spark):
    rnd = random.Random(7)
    names = ["Ann", "bob", "Cat", "dan", "eve", None]
    rows = []
    for i in range(300):
        t = T0 + dt.timedelta(hours=rnd.choice([0, 71.5, 72, 72.5, 144]) + rnd.random() * 3)
        t = rnd.choice([t, t.replace(minute=0, second=0, microsecond=0), None]) if rnd.random() < 0.5 else t
        mentions = ["ann"] if rnd.random() < 0.34 else rnd.sample(["bob", "CAT", "eve"], rnd.choice([0, 1, 2]))
        rows.append((str(i), rnd.choice(names), t, mentions, rnd.choice([None, None, "dan"]), [f"https://x/s/{rnd.randint(0, 299)}/"] if rnd.random() < 0.3 else [], rnd.random() < 0.9))
    posts, verified = spark.createDataFrame(rows, POST).repartition(5), spark.createDataFrame([("ann",), ("eve",)], "author string")
    for hours in (72.0, 1.0):
        want = plain(rows, {"ann", "eve"}, hours)
        assert set(map(tuple, influence.spread(posts, verified, hours).collect())) == want and len(want) > 20
        scores = {r.id: r.score for r in influence.spread_scores(posts, verified, hours).collect()}
        assert scores == {i: round(sum(w for p, _, w in want if p == i), 6) for i, a, t, *_ in rows if a is not None and t is not None}


def test_a_name_in_a_third_of_all_posts(spark):
    """20,000 posts of one author, named by 20,000 others in one window: 400 million pairs, counted in sums over many tasks."""
    posts = spark.range(60_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), "id")).alias("author"),
        F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("at"),
        F.when(F.col("id") % 3 == 1, F.array(F.lit("hot"))).otherwise(F.array().cast("array<string>")).alias("names"),
    )
    got = influence.later_echoes(posts, "names", "author", "id", "at", hours=72.0)
    assert got.filter("id % 3 = 0 AND authors <> (60000 - id) div 3").count() == 0 and got.count() == 60_000
    assert got.filter("id % 3 <> 0 AND authors > 0").count() == 0
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "BroadcastNestedLoop" not in plan


def test_first_events_link_no_event(spark, tmp_path):
    """What the first three events would link lies before the table; its sign is no part of an id."""
    from quarryline.plans import registry

    at = "CAST(timestamp_seconds(1704067200 + id * 60) AS timestamp_ntz) AS ts"
    spark.range(5).selectExpr("id AS event_id", at, "200 + id AS user_id", "IF(id IN (2, 4), 'purchase', 'view') AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["spread_weights"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("2", "u204", 1.5)]
    scores = dict(map(tuple, registry.QUERIES["spread_scores"](spark, str(tmp_path)).collect()))
    assert scores == {"0": 0.0, "1": 0.0, "2": 1.5, "3": 0.0, "4": 0.0}
