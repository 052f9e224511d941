"""Rendezvous shards against a plain version, their files and what a change of shards moves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarryline.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot string, size int"


def plain(key, weights):
    def drawn(k):
        u = (int(hashlib.md5(f"{'' if key is None else key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -math.log(u) / weights[k]

    return min((k for k in range(len(weights)) if weights[k]), key=drawn)


def stored(spark, rows, weights, path, grown=None):
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA).repartition(3)
    sharding.write_shards(docs, path, weights)
    return sharding.digests(sharding.read_shards(spark, path, "doc_id long, text string"), weights, grown or [*weights, 1])


def rows_of(n):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, "", "a", "é" * 5, f"text {i}"])) for i in range(n)]
    return rows + [(None, None), (None, "x"), (None, "x"), (5, "again"), rows[7], rows[7], (n + 1, "long " * 200_000)]


def test_shards(spark, tmp_path):
    rows, weights = rows_of(700), [1.0] * 8
    got = stored(spark, rows, weights, f"{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == plain(r.doc_id, weights) and r.grown_shard == plain(r.doc_id, [*weights, 1]) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append((r.slot, r.doc_id if r.doc_id is not None else -1))
    for at in slots.values():
        at.sort()
        assert [s for s, _ in at] == list(range(len(at))) and [i for _, i in at] == sorted(i for _, i in at)
    assert len(slots) == 8 and 40 < sum(r.grown_shard == 8 for r in got) < 130


def test_one_key_in_a_third_of_all_rows_is_written_in_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ranges_for", lambda df: 12)
    rows = [(None, "copy")] * 1000 + [(i, f"t{i}") for i in range(2000)]
    got = stored(spark, rows, [1, 1], f"{tmp_path}/hot").collect()
    assert sorted((r.shard, r.slot) for r in got) == [(k, s) for k in (0, 1) for s in range(sum(r.shard == k for r in got))]
    hot = plain(None, [1, 1])
    files = [p for p in (tmp_path / "hot" / f"shard={hot}").iterdir() if p.suffix == ".parquet"]
    assert len(files) >= 6 and max(spark.read.parquet(str(p)).count() for p in files) < 700


def test_weights_and_changes(spark):
    docs = spark.range(20_000).selectExpr("id doc_id")
    at = dict(sharding.assign(docs, [1, 2, 5, 0]).groupBy("shard").count().collect())
    assert 3 not in at and all(abs(at[k] / 20_000 - w / 8) < 0.02 for k, w in enumerate([1, 2, 5]))
    for before, after, touched in (([1, 1, 1], [1, 1, 1, 1], 3), ([1, 2, 3], [1, 0, 3], 1), ([1, 1, 1], [1, 3, 1], 1)):
        changes = sharding.moved(docs, before, after).select("old_shard", "shard").distinct().collect()
        assert changes and all(touched in tuple(r) for r in changes)
    assert sharding.moved(docs, [1, 1], [1, 1]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(docs.doc_id, [0, 0])


def test_no_rows(spark, tmp_path):
    assert stored(spark, [], [1, 1], f"{tmp_path}/none").count() == 0


def test_reading_one_shard_reads_its_folder_only(spark, tmp_path):
    stored(spark, rows_of(50), [1] * 4, f"{tmp_path}/s")
    one = sharding.read_shards(spark, f"{tmp_path}/s", "doc_id long", shards=[2])
    assert re.search(r"PartitionFilters: \[[^\]]*\(shard#\d+ = 2\)", one._jdf.queryExecution().toString())
    assert [r.slot for r in one.orderBy("slot").collect()] == list(range(one.count()))


def test_texts_are_not_shuffled_to_get_their_slots(spark, tmp_path):
    """The first places of the runs go to the records."""
    path = f"file://{tmp_path}/shards"
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    sharding.write_shards(spark.createDataFrame([(i, "a b", "x", "y", 0) for i in range(40)], SCHEMA), path, [1.0] * 8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = sharding.read_shards(spark, path, "doc_id long, text string")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
