"""Order statistics of large and small groups against sorted lists; many tasks for one group."""

import random
import statistics

from pyspark.sql import functions as F

from quarryline.functions import stats
from quarryline.operators import selection
from quarryline.operators.quantiles import p95_exclusive


def values(monkeypatch):
    rnd = random.Random(5)
    groups = {"even": [rnd.random() for _ in range(3000)], "odd": [rnd.randint(0, 40) / 4 for _ in range(2501)], "one": [7.0], "two": [1.0, 2.0], "same": [3.5] * 2000, "low": [1.0] * 1500 + [float(i) for i in range(900)], None: [5.0, 9.0, 6.0]}
    return [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)], groups


def test_medians_and_mad(spark, monkeypatch):
    rows, groups = values(monkeypatch)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    # Sketches with few points: bounds are far apart, and all groups over 100 values use them.
    for accuracy, small, in_task in ((10_000, 20_000, 10**6), (10_000, 20_000, 0), (100, 400, 0)):
        monkeypatch.setattr(selection, "ACCURACY", accuracy)
        monkeypatch.setattr(selection, "SMALL", small)
        monkeypatch.setattr(selection, "IN_TASK", in_task)
        got = {r.k: (r.n, r.med) for r in selection.medians(df, ["k"], "v").collect()}
        assert got == {k: (len(v), statistics.median(v)) for k, v in groups.items()}
        spread = {r.k: r.sigma for r in stats.mad_sigma(df, ["k"], "v").collect()}
        for k, vs in groups.items():
            m = statistics.median(vs)
            assert abs(spread[k] - (1.4826 * statistics.median(abs(v - m) for v in vs) if len(vs) > 1 else 0)) < 1e-12
    assert selection.medians(df.limit(0), ["k"], "v").count() == 0
    every = selection.medians(df, [], "v").first()
    known = [v for _, v in rows if v is not None]
    assert (every.n, every.med) == (len(known), statistics.median(known))


def test_exclusive_quantiles(spark, monkeypatch):
    rows, groups = values(monkeypatch)
    groups |= {str(n): [float((i * 37) % n) for i in range(n)] for n in (19, 20, 38, 39, 40, 59)}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    for accuracy, small, in_task in ((10_000, 20_000, 10**6), (10_000, 20_000, 0), (200, 400, 0)):
        monkeypatch.setattr(selection, "ACCURACY", accuracy)
        monkeypatch.setattr(selection, "IN_TASK", in_task)
        monkeypatch.setattr(selection, "SMALL", small)
        for r in p95_exclusive(df, ["k"], "v").collect():
            vs = groups[r.k]
            assert abs(r.p95 - (statistics.quantiles(vs, n=20)[18] if len(vs) >= 20 else max(vs))) < 1e-9, r.k


def test_a_class_of_all_rows_is_dealt_to_many_tasks(spark, monkeypatch):
    """Nothing but sketches and the middle values are shuffled."""
    n = 400_001
    df = spark.range(n).select(F.lit("all").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v")).repartition(8)
    seen = []
    kept = selection.running_totals
    monkeypatch.setattr(selection, "running_totals", lambda counts, *a: seen.append(counts.count()) or kept(counts, *a))
    assert selection.medians(df, ["k"], "v").first().med == (n - 1) / 2
    assert seen[0] < n / 500
    z = stats.robust_z(df, ["k"], "v")
    want = df.select(F.median("v")).first()[0]
    assert z.filter((F.col("v") == want) & (F.col("z") != 0)).count() == 0 and z.filter("z > 0").count() == n // 2
