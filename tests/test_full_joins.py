"""Joins without SQL against plain versions over the whole of their tables."""

import datetime
import json
from collections import Counter, defaultdict
from itertools import combinations

import __spark_entry__
from quarryline.operators.stories import RARE_DF

QUERIES = __spark_entry__.queries()


def test_later_echoes_by_name(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "props").collect()
    naming = defaultdict(list)
    for _, user, ts, props in rows:
        naming[json.loads(props or "{}").get("k")].append((user, ts))
    want = {}
    for event, user, ts, _ in rows:
        want[event] = len({by for by, at in naming[user] if by != user and ts <= at <= ts + datetime.timedelta(hours=72)})
    assert sum(want.values()) > 0
    assert {r.snapshot_id: r.authors for r in QUERIES["later_echoes_by_name"](spark, sf_dir).collect()} == want


def test_pairs_by_rare_day(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = datetime.datetime(2030, 1, 1)
    crowd = [(10**6 + i, 10**6 + i, day) for i in range(RARE_DF + 1)] + [(2 * 10**6 + i, 10**6 + i, day + datetime.timedelta(1)) for i in range(RARE_DF)]
    more = spark.createDataFrame(crowd, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    orders.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/orders.parquet")
    by_day = defaultdict(set)
    for r in spark.read.parquet(f"{tmp_path}/orders.parquet").select("o_custkey", "o_orderdate").collect():
        by_day[r.o_orderdate.date()].add(r.o_custkey)
    want = Counter(p for s in by_day.values() if len(s) <= RARE_DF for p in combinations(sorted(s), 2))
    got = {(r.a, r.b): r.shared for r in QUERIES["pairs_by_rare_day"](spark, str(tmp_path)).collect()}
    assert got == want and got[10**6, 10**6 + 1] == 1 and (10**6, 10**6 + RARE_DF) not in got


def test_pairs_by_rare_value_reads_all_rows(spark, sf_dir):
    """Prices of every height and days of any number of sources."""
    by_day = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate").collect():
        by_day[r.o_orderdate.date()].add(r.o_custkey)
    want = Counter(p for s in by_day.values() for p in combinations(sorted(s), 2))
    got = {(r.a, r.b): r.shared for r in QUERIES["pairs_by_rare_value"](spark, sf_dir).collect()}
    assert got == want and len(got) > 300


def test_pairs_in_time_all_stages(spark, sf_dir):
    by_user = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type").collect():
        by_user[r.user_id].append((r.event_id, r.event_type, r.ts))
    near = datetime.timedelta(hours=30)
    want = sorted((a[0], b[0]) for s in by_user.values() for a, b in combinations(sorted(s), 2) if a[1] != b[1] and abs(a[2] - b[2]) <= near)
    got = sorted(map(tuple, QUERIES["pairs_in_time_all_stages"](spark, sf_dir).collect()))
    assert got == want and len(got) > QUERIES["pairs_in_time"](spark, sf_dir).count()
