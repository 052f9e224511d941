"""New keys, references and comparisons; scores that follow a stream."""

import datetime as dt

from pyspark.sql import functions as F

from quarryline.operators import migration
from quarryline.streaming import incremental, windows


def test_keys_stay_when_migrated_again(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("a", 1), (None, 5)], "db string, own long")
    once = migration.new_keys(rows, ["db", "own"])
    assert sorted(map(tuple, once.collect())) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]
    more = rows.union(spark.createDataFrame([("a", 0), ("c", 9)], rows.schema))
    twice = migration.new_keys(more, ["db", "own"], once)
    assert sorted(map(tuple, twice.collect())) == [("a", 0, 4), ("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("c", 9, 5)]
    assert sorted(migration.new_keys(more, ["db", "own"], twice).collect()) == sorted(twice.collect())
    assert migration.new_keys(rows.limit(0), ["db", "own"]).count() == 0
    assert migration.new_keys(rows, ["db", "own"], once.limit(0)).count() == 3


def test_references_and_rejects(spark):
    owners = spark.createDataFrame([("x", 1, 10), ("x", 2, 20)], "db string, own long, id long")
    posts = spark.createDataFrame([(1, "x", 1, None), (2, "x", 9, None), (3, None, None, 2), (4, "x", 2, 7), (5, "y", 1, 1)], "post long, db string, owner long, quoted long")
    quoted = owners.select(F.col("own"), "id")
    good, lost = migration.remap(posts, {"owner_id": ({"db": "db", "owner": "own"}, owners), "quote_id": ({"quoted": "own"}, quoted)})
    assert {r.post: (r.owner_id, r.quote_id) for r in good.collect()} == {1: (10, None), 3: (None, 20)}
    assert {r.post: r.missing for r in lost.collect()} == {2: "owner_id", 4: "quote_id", 5: "owner_id"}
    assert lost.columns == [*posts.columns, "missing"]


def test_a_parent_of_a_third_of_all_rows(spark):
    owners = spark.range(100).select(F.col("id").alias("own"), (F.col("id") + 1).alias("id"))
    posts = spark.range(60_000).select(F.col("id").alias("post"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 120).cast("long").alias("owner"))
    good, lost = migration.remap(posts, {"owner_id": ({"owner": "own"}, owners)})
    assert good.filter("owner_id <> owner + 1").count() == 0 and good.count() + lost.count() == 60_000 and lost.count() > 0


def test_differences_add_up(spark):
    before = spark.createDataFrame([(i, i * 10) for i in range(10)] + [(0, 0), (None, 5)], "k long, v long")
    after = spark.createDataFrame([(0, 0), (1, 11), (2, 20), (99, 1), (None, 5)], "k long, v long")
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    rule = migration.differences("r", before, after, ["k"], [("skipped", key(3, 4, 4, 1)), ("merged", key(4, 5, None))], ["v"])
    assert {r.cause: r.n for r in rule.collect()} == {"matched": 3, "changed": 1, "added": 1, "skipped": 2, "merged": 1, "unexplained": 4}
    clean = migration.differences("s", before, before.filter("k <> 3 OR k IS NULL"), ["k"], [("skipped", key(3))])
    whole = {(r.rule, r.cause): (r.difference, r.explained) for r in migration.report([rule, clean]).collect()}
    assert whole["r", "matched"] == (6, False) and whole["s", "skipped"] == (1, True)


def total(rows):
    return rows.groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def test_scores_follow_a_stream(spark, tmp_path):
    schema = "k string, id long, at timestamp, v long"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", 1, at(1), 5), ("b", 2, at(2), 7)], [("a", 3, at(3), 1)], [("c", 4, at(0), 2), ("a", 1, at(4), 50)], []]
    path = f"file://{tmp_path}/s"
    seen = []

    def score(rows):
        seen.append(sorted(r.k for r in rows.select("k").distinct().collect()))
        return total(rows)

    step = incremental.score_changed(path, "k", "id", "at", score, "night", buckets=4)
    for n, rows in enumerate(batches):
        for _ in range(2):  # each batch is tried again and changes nothing
            step(spark.createDataFrame(rows, schema), n)
            state = sorted((r.k, r.total, r.n) for r in incremental.scored(spark, path).collect())
    assert state == [("a", 51, 2), ("b", 7, 1), ("c", 2, 1)]
    assert seen == [["a", "b"]] * 2 + [["a"]] * 2 + [["a", "c"]] * 2  # only what has changed
    assert [(r.stream, r.mark, r.rows) for r in incremental.marked(spark, path).collect()] == [("night", at(4), 2)]
    whole = windows.upserted(spark, f"{path}/history")
    assert sorted((r.k, r.total, r.n) for r in total(whole).collect()) == state


def test_a_fault_between_the_tables_is_mended_by_the_next_try(spark, tmp_path):
    schema = "k string, id long, at timestamp, v long"
    path, at = f"file://{tmp_path}/s", dt.datetime(2024, 1, 1)
    broken = incremental.score_changed(path, "k", "id", "at", lambda rows: 1 / 0, "night", buckets=4)
    good = incremental.score_changed(path, "k", "id", "at", total, "night", buckets=4)
    good(spark.createDataFrame([("a", 1, at, 5)], schema), 0)
    try:
        broken(spark.createDataFrame([("a", 2, at, 6), ("b", 3, at, 1)], schema), 1)
    except ZeroDivisionError:
        pass
    assert {r.k: r.total for r in incremental.scored(spark, path).collect()} == {"a": 5}
    good(spark.createDataFrame([("a", 2, at, 6), ("b", 3, at, 1)], schema), 1)
    assert {r.k: r.total for r in incremental.scored(spark, path).collect()} == {"a": 11, "b": 1}
