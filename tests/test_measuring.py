"""The measurement queue: sweeps by hand, batch and stream, rows late, repeated and in any order; upserts over restarts."""

import datetime as dt
import random
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryline.operators import measuring
from quarryline.streaming import measuring as streaming
from quarryline.streaming import windows

T0 = dt.datetime(2024, 1, 1)
ROW = "content_id long, published_at timestamp, captured_at timestamp, bucket string, is_plan boolean"


def h(x):
    return T0 + dt.timedelta(hours=x)


def us(x):
    return round((x - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def by_hand(posts, rows, now, every=24, stale=96):
    """Sweep after sweep, as a queue is worked off."""
    out = {}
    hours = {"1h": 1, "6h": 6, "24h": 24, "72h": 72}
    window = {"1h": 12, "6h": 12, "24h": 12, "72h": 48}
    step = dt.timedelta(hours=every)
    for post, published in posts.items():
        own = [(c, b) for p, c, b in rows if p == post]
        for stage, n in hours.items():
            due = published + dt.timedelta(hours=n)
            at = dt.datetime(1970, 1, 1) + -((dt.datetime(1970, 1, 1) - due) // step) * step
            attempt, result = 0, ("pending", None, None, None)
            while at <= now and result[0] == "pending":
                attempt += 1
                near = [(abs(c - due), c, "bucket") for c, b in own if c <= at and b == stage and abs(c - due) <= dt.timedelta(hours=window[stage])]
                near = near or [(abs(c - due), c, "time") for c, b in own if c <= at and b is None and abs(c - due) <= dt.timedelta(hours=3)]
                if near:
                    gap, c, how = min(near)
                    result = ("measured" if gap <= dt.timedelta(hours=3) else "measured_late", None, how, us(c))
                elif attempt == 5 or at - due >= dt.timedelta(hours=stale):
                    reason = "no_snapshot_ever" if not any(c <= at for c, _ in own) else "grace_expired" if at - due >= dt.timedelta(hours=stale) else "attempts_exhausted"
                    result = ("closed_no_data", reason, None, us(at))
                at += step
            out[post, stage] = (attempt, *result)
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    posts = {i: h(rnd.choice([0, 3.5, 24, 47]) + rnd.random() * 20) for i in range(n)}
    rows = []
    for i, published in posts.items():
        for _ in range(rnd.choice([0, 1, 3, 8])):
            age = rnd.choice([0.5, 1, 2, 3.9, 6, 9, 17, 24, 30, 70, 72, 75, 100, 119, 150, 400]) + rnd.choice([0, rnd.random()])
            rows.append((i, published + dt.timedelta(hours=age), rnd.choice([None, "1h", "6h", "24h", "72h"])))
    return posts, rows


@pytest.mark.parametrize("every", [24, 36, 5])
def test_sweeps(spark, every):
    posts, rows = corpus(every)
    contents = spark.createDataFrame([*posts.items(), (900, None)], "content_id long, published_at timestamp")
    snapshots = spark.createDataFrame([*rows, (1, None, "1h"), (901, T0, None)], "content_id long, captured_at timestamp, bucket string")
    reasons = set()
    for now in (h(30), h(90), h(2000)):
        got = measuring.sweep(contents, snapshots, F.lit(now), every_hours=every).collect()
        want = by_hand(posts, rows, now, every)
        assert len(got) == len(want)
        for r in got:
            assert (r.attempt, r.status, r.close_reason, r.linked_by, r.done_us) == want[r.content_id, r.stage], (r, want[r.content_id, r.stage])
            reasons.add(r.close_reason)
    assert {"no_snapshot_ever", "attempts_exhausted" if every < 24 else "grace_expired"} <= reasons
    assert measuring.sweep(contents.limit(0), snapshots, F.lit(h(9))).count() == 0


def test_reconciling_is_idempotent(spark):
    contents = spark.createDataFrame([(1, T0), (2, T0)], "content_id long, published_at timestamp")
    before = spark.createDataFrame([(1, h(500), None)], "content_id long, captured_at timestamp, bucket string")
    queue = measuring.sweep(contents, before, F.lit(h(400)))
    later = before.union(spark.createDataFrame([(1, h(8), "6h"), (1, h(5), "6h"), (1, h(40), "24h")], before.schema))
    once = measuring.reconcile(queue, later)
    found = {(r.content_id, r.stage): r for r in once.collect()}
    assert found[1, "6h"].status == "measured" and found[1, "6h"].done_us == us(h(5)) and found[1, "6h"].close_reason is None
    assert found[1, "24h"].status == "closed_no_data" and found[2, "6h"].close_reason == "no_snapshot_ever"
    assert sorted(measuring.reconcile(once, later).collect()) == sorted(once.collect())
    assert tuple(measuring.status_counts(once, F.lit(h(400))).first()) == (0, 1, 0, 7, 0)


def streamed(spark, tmp_path, batches, build, schema=ROW):
    """Micro-batches as files in order; all rows that come out."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/b{i:03}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        out = build(stream)
        out.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(f"file://{tmp_path}/o").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(out.schema).parquet(f"file://{tmp_path}/o").collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_however_rows_are_dealt(spark, tmp_path, seed):
    posts, rows = corpus(seed, 25)
    rnd = random.Random(seed)
    events = [(i, p, p, None, True) for i, p in posts.items()] + [(i, posts[i], c, b, False) for i, c, b in rows]
    # In order of time, shaken by up to five hours; the watermark is six hours late.
    events.sort(key=lambda e: e[2] + dt.timedelta(hours=5 * rnd.random()))
    cuts = sorted(rnd.sample(range(1, len(events)), 4))
    end = [[(999, h(1000 + i), h(1000 + i), None, True)] for i in range(2)]
    batches = [events[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)])] + end
    got = streamed(spark, tmp_path, batches, streaming.measure)
    keys = [(r.content_id, r.stage) for r in got]
    assert len(keys) == len(set(keys)), "a stage was given out twice"
    want = by_hand(posts, rows, h(990))
    assert {(r.content_id, r.stage): (r.attempt, r.status, r.close_reason, r.linked_by, r.done_us) for r in got} == want


def test_rows_after_the_end_settle_nothing_again(spark, tmp_path):
    once = [[(1, T0, T0, None, True), (1, T0, h(1), "1h", False)], [(1, T0, h(6), "6h", False)], [(2, h(500), h(500), None, True)], [(2, h(500), h(501), "1h", False)]]
    after = [[(1, T0, h(520), "72h", False)], [(1, T0, h(540), None, False), (1, T0, h(541), None, True)], [(2, h(500), h(900), None, True)], [(2, h(500), h(901), None, True)]]
    got = streamed(spark, tmp_path, once + after, streaming.measure)
    assert sorted((r.content_id, r.stage, r.status) for r in got) == sorted(
        (i, s, "measured" if (s, i) in (("1h", 1), ("6h", 1), ("1h", 2)) else "closed_no_data") for i in (1, 2) for s in ("1h", "6h", "24h", "72h")
    )


class Handle:
    """State of one key and its timers as plain values; counts the calls, each of which is a message between a worker and Spark."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, key, value):
        return self

    def getValueState(self, name, value):
        return Value(self)

    def count(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self.count(bool(self.values))

    def getValue(self, key):
        return self.count(self.values.get(key))

    def updateValue(self, key, value):
        self.count(self.values.update({key: value}))

    def removeKey(self, key):
        self.count(self.values.pop(key))

    def iterator(self):
        return self.count(iter(list(self.values.items())))

    def clear(self):
        self.count(self.values.clear())

    def registerTimer(self, ms):
        self.count(self.timers.add(ms))

    def deleteTimer(self, ms):
        self.count(self.timers.remove(ms))


class Value:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def get(self):
        return self.handle.count(self.value)

    def update(self, value):
        self.value = self.handle.count(value)

    def clear(self):
        self.value = self.handle.count()


@pytest.mark.parametrize("held", [7, 20_000])
def test_posts_of_a_part_share_calls(monkeypatch, held):
    """All posts in one key: results as by hand, one timer, and a few calls per post, however many posts are held at once."""
    monkeypatch.setattr(streaming, "HELD", held)
    posts, rows = corpus(3, 400)
    events = [(i, us(p), us(p), None, True) for i, p in posts.items()] + [(i, us(posts[i]), us(c), b, False) for i, c, b in rows]
    random.Random(3).shuffle(events)
    frame = pd.DataFrame(events, columns=["content_id", "published_us", "captured_us", "bucket", "is_plan"])
    handle, queue, got = Handle(), streaming.MeasurementQueue(), []
    queue.init(handle)
    clock = lambda at: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    chunks = (frame[at : at + 50] for at in range(0, len(frame), 50))
    got += queue.handleInputRows((0,), chunks, clock(0))
    while handle.timers:
        assert len(handle.timers) == 1
        ms = min(handle.timers)
        got += queue.handleExpiredTimer((0,), clock(us(h(990)) // 1000), None)
        handle.timers.discard(ms)
    got = list(pd.concat(got).astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))
    assert len(got) == 4 * len(posts) and not handle.values
    assert {r[:2]: r[2:] for r in got} == by_hand(posts, rows, h(990))
    if held > len(posts):
        assert handle.calls < 2 * len(posts)


def test_stage_tracker_gives_no_stage_twice(spark, tmp_path):
    """All stages measured, then a snapshot long after the last one, before and after the state is gone."""
    first = [(1, T0, h(x)) for x in (1, 6, 24, 72)]
    batches = [[r] for r in first] + [[(2, h(90), h(91))], [(1, T0, h(95))], [(2, h(90), h(300))], [(1, T0, h(320))], [(1, T0, h(340))]]
    rows = streamed(spark, tmp_path, batches, windows.stage_tracker, "content_id long, published_at timestamp, captured_at timestamp")
    keys = [(r.content_id, r.stage) for r in rows]
    assert len(keys) == len(set(keys)) == 8
    assert [r.status for r in rows if r.content_id == 1] == ["measured"] * 4


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long")
    step = windows.upsert_into(path, ["k"], "v")
    step(frame([(i, 1) for i in range(200)]), 0)
    step(frame([(1, 2)]), 1)
    again = windows.upsert_into(path, ["k"], "v")  # a new checkpoint counts from 0
    for _ in range(2):  # tried again after a fault
        again(frame([(1, 3), (500, 1)]), 0)
    again(frame([(2, 9)]), 1)
    rows = dict(map(tuple, windows.upserted(spark, path).collect()))
    assert len(rows) == 201 and (rows[1], rows[2], rows[3], rows[500]) == (3, 9, 1, 1)
    named = windows.upsert_into(path, ["k"], "v", run="nightly")
    named(frame([(7, 70)]), 0)
    windows.upsert_into(path, ["k"], "v", run="nightly")(frame([(7, 70)]), 0)
    assert len({v for v, *_ in windows._versions(spark, path)}) <= 5


def test_upserts_keep_two_versions_of_a_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    step = windows.upsert_into(path, ["k"], "v", buckets=2)
    for n in range(6):
        step(spark.createDataFrame([(k, n) for k in range(9)], "k long, v long"), n)
    assert sorted(b for _, _, _, b, _ in windows._versions(spark, path)) == [0, 0, 1, 1]
    assert {r.v for r in windows.upserted(spark, path).collect()} == {5}
