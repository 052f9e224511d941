"""Operators on hand-made edge frames, against plain versions where there is one."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.operators import cosines, graph, influence, latest, neardup, quality, quantiles, ranking, snapshots, stories, trends, upsert
from quarryline.operators.components import connected_components
from quarryline.session import write_through

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, at(1), 1, None), (1, at(1), 2, "b"), (2, None, 3, "c")], "k long, ts timestamp, id long, v string")
    assert sorted((r.k, r.id) for r in latest.latest(df, ["k"], "ts", "id").collect()) == [(1, 2), (2, 3)]
    assert latest.latest(df.limit(0), ["k"], "ts", "id").count() == 0
    assert latest.latest_with_ties(df, ["k"], "ts").count() == 3


def test_nearest_within_tolerance(spark):
    wanted = spark.createDataFrame([(1, at(10)), (2, at(10))], "k long, at timestamp")
    rows = spark.createDataFrame([(1, at(8), 1, "x"), (1, at(12), 2, "x"), (1, at(12.5), 3, "y"), (2, at(14), 4, "x")], "k long, ts timestamp, id long, stage string")
    got = latest.nearest_within(wanted, rows, "k", "at", "ts", 3.0, "id").collect()
    assert [(r.k, r.id, r.gap_hours) for r in got] == [(1, 1, 2.0)]
    preferred = latest.nearest_within(wanted, rows, "k", "at", "ts", 3.0, "id", prefer=F.col("stage") == "y").collect()
    assert [r.id for r in preferred] == [3]


def test_as_of(spark):
    wanted = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 5, "c")], "k long, day long, name string")
    series = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 6, 60), (1, 4, None)], "k long, day long, v long")
    got = {r.name: r.v for r in latest.as_of(wanted.withColumnRenamed("day", "at"), series, "k", "at", "day", "v", "v").collect()}
    assert got == {"a": 50, "b": None, "c": None}


def test_values_scaled_to_an_age(spark):
    df = spark.createDataFrame([(1, 5.0, 10), (1, 20.0, 99), (2, 12.0, 10), (3, 0.0, 7), (4, None, 7)], "k long, age double, likes long")
    assert {r.k: (r.exact, r.likes) for r in latest.scaled_to_age(df, "k", "age", ["likes"]).collect()} == {1: (True, 10.0), 2: (False, 5.0)}


def test_later_echoes(spark):
    df = spark.createDataFrame([(1, "ann", at(0), []), (2, "bob", at(1), ["ann"]), (3, "cy", at(80), ["ann"]), (4, "ann", at(2), ["ann"])], "id long, author string, ts timestamp, names array<string>")
    assert {r.id: r.authors for r in influence.later_echoes(df, "names", "author", "id", "ts").collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_deltas_of_both_kinds(spark):
    rows = [(1, at(0), 10, 5), (1, at(599 / 3600), 12, 5), (1, at(1.2), 20, 4), (1, at(5.2), 15, None), (2, at(0), None, 1)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, views long, likes long")
    got = {(r.k, r.ts): r for r in snapshots.deltas(df, "k", "ts", ["views", "likes"]).collect()}
    a, b, c, d, e = (got[x[0], x[1]] for x in rows)
    assert [x.interval_quality for x in (a, b, c, d, e)] == ["first", "short", "ok", "ok", "first"]
    assert (b.delta_views, c.delta_views, c.delta_likes, c.is_anomaly) == (None, 8, None, True)
    assert (d.delta_views, d.per_hour, d.is_anomaly) == (None, None, True)
    kept = {r.ts: r for r in snapshots.deltas(df, "k", "ts", ["views", "likes"], keep_negative=True).filter("k = 1").collect()}
    assert (kept[rows[3][1]].delta_views, kept[rows[3][1]].per_hour, kept[rows[2][1]].is_anomaly) == (-5, -1.25, False)


def test_clamp_growth_and_neighbours(spark):
    df = spark.createDataFrame([(1, at(0), 5, 1), (1, at(1), 3, 2), (1, at(2), None, 3), (1, at(3), 9, 4)], "k long, ts timestamp, v long, id long")
    assert [r.v for r in snapshots.never_falling(df, "k", "ts", "v", "id").orderBy("id").collect()] == [5, 5, 5, 9]
    days = spark.createDataFrame([(1, dt.date(2024, 1, d), v) for d, v in ((1, 10), (3, 20), (10, 30))] + [(2, dt.date(2024, 1, 9), 4)], "k long, day date, subs long")
    got = {r.k: (r.growth, r.depth_days) for r in snapshots.growth(days, "k", "day", "subs", F.to_date(F.lit("2024-01-10"))).collect()}
    assert got == {1: (0.5, 9), 2: (None, 1)}
    near = spark.createDataFrame([(1, "a", at(0)), (1, "b", at(48)), (1, "b", at(97)), (2, "c", at(0))], "cluster long, channel string, ts timestamp")
    assert sorted(r.n_other for r in snapshots.duplicates_nearby(near, "cluster", "channel", "ts").collect()) == [0, 0, 1, 1]


def test_measurement_stages(spark):
    contents = spark.createDataFrame([(1, at(0)), (2, at(95)), (3, None)], "id long, published timestamp")
    taken = spark.createDataFrame([(1, at(1.5)), (1, at(13)), (2, at(96))], "id long, ts timestamp")
    plan = snapshots.stage_schedule(contents, "id", "published")
    got = {(r.id, r.stage): r.status for r in snapshots.stage_status(plan, taken, "id", "ts", F.lit(at(100))).collect()}
    assert got == {(1, "1h"): "measured", (1, "6h"): "measured_late", (1, "24h"): "closed_no_data", (1, "72h"): "closed_no_data", (2, "1h"): "measured", (2, "6h"): "pending", (2, "24h"): "pending", (2, "72h"): "pending"}


def test_exclusive_quantile(spark):
    import statistics

    rnd = random.Random(1)
    groups = {k: [rnd.choice([1.0, 2.0, 3.5, rnd.random()]) for _ in range(n)] for k, n in (("a", 19), ("b", 20), ("c", 57), ("d", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    got = {r.k: r.p95 for r in quantiles.p95_exclusive(df, ["k"], "v").collect()}
    want = {k: statistics.quantiles(vs, n=20)[18] if len(vs) >= 20 else max(vs) for k, vs in groups.items()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_ranked_selections(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", float(10 - i), "x" * i) for i in range(9)], "id long, key string, v double, text string")
    order = [F.desc("v"), F.col("id")]
    assert [r.id for r in ranking.cap_per_key(df, "key", order, 1, 2).collect()] == [0, 1]
    assert sorted(r.id for r in ranking.best_of_best(df, "key", "v", "id", 2, 2).collect()) == [0, 1, 3, 4]
    assert [r.id for r in ranking.rotation(df, [F.col("id")], 7, 4).orderBy("id").collect()] == [0, 1, 7, 8]
    assert ranking.rotation(df.limit(0), [F.col("id")], 7, 4).count() == 0
    assert sorted(r.id for r in ranking.within_budget(df, [], [F.col("id")], "text", 6).collect()) == [0, 1, 2, 3]
    shown = df.filter("id = 0").select("id")
    assert [r.id for r in ranking.interleave(df, df.filter("key = 'k1'"), order, "id", 4, shown).collect()] == [1, 4, 2, 7]
    reason = ranking.first_reason([("a", F.col("v") > 100), ("b", F.lit(None).cast("boolean")), ("c", F.col("v") > 5)])
    assert [r[0] for r in df.orderBy("id").select(reason).collect()] == ["c"] * 5 + [None] * 4


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", None), (None, "n", 1)], "id long, name string, n long")
    new = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, 2), (3, "c", 5, 1), (None, "m", 2, 1)], "id long, name string, n long, arrival long")
    rows = lambda df: sorted(((r.id, r.name, r.n) for r in df.collect()), key=str)
    assert rows(upsert.merge(old, new, ["id"], "arrival")) == sorted([(1, "y", None), (2, "b", None), (3, "c", 5), (None, "m", 2)], key=str)
    assert rows(upsert.merge(old, new, ["id"], "arrival", keep_known=True))[0] == (1, "y", 10)
    assert rows(upsert.merge(old, new, ["id"], "arrival", update=[]))[0] == (1, "a", 10)
    acc = upsert.accumulate(spark.createDataFrame([("k", 2, "a", 1)], "k string, n long, s string, t long"), spark.createDataFrame([("k", 3, None, 2)], "k string, n long, s string, t long"), ["k"], ["n"], ["s"], "t")
    assert [(r.n, r.s) for r in acc.collect()] == [(5, "a")]
    e = spark.createDataFrame([(1, "t", 0.5, None, at(1)), (1, "t", 0.9, "d", at(2))], "f long, target string, weight double, detail string, ts timestamp")
    once = upsert.merge_edges(None, e, ["f", "target"], "weight", "detail", "ts")
    twice = upsert.merge_edges(once, e.limit(1), ["f", "target"], "weight", "detail", "ts").first()
    assert (twice.seen_count, twice.weight, twice.detail, twice.first_seen) == (3, 0.9, "d", at(1))


def test_first_movers(spark):
    rows = [(1, "a", 1, at(0)), (1, "a", 2, at(0.1)), (1, "b", 3, at(0.5)), (2, "a", 4, at(0)), (2, "a", 5, at(1)), (3, "a", 6, at(0)), (3, "b", 7, at(0.1))]
    df = spark.createDataFrame(rows, "story long, author string, id long, ts timestamp")
    got = {r.id: (round(r.lead_minutes, 3), r.first_move) for r in graph.first_movers(df, "story", "author", "id", "ts").collect()}
    assert got == {1: (-30.0, True), 2: (-24.0, False), 3: (0.0, False), 6: (-6.0, False), 7: (0.0, False)}


def test_edge_groups(spark):
    rows = [(1, 9, "a", 1.0)] * 10 + [(2, 9, "b", 5.0)] + [(1, 8, "a", 1.0), (2, 8, "a", 2.0)]
    df = spark.createDataFrame(rows, "s long, t long, kind string, w double")
    got = {r.t: r for r in graph.consume(df, "s", "t", "kind", "w").collect()}
    assert (got[9].n_edges, got[9].n_sources, got[9].from_one, got[9].eligible, got[9].main_kind) == (11, 2, True, False, "a")
    assert (got[8].eligible, got[8].priority) == (True, 4.0)
    assert graph.consume(df, "s", "t", "kind", "w", known=df.filter("t = 9")).count() == 1


def test_trends(spark):
    posts = [(f"a{i}", at(i % 5), ["new", "old"]) for i in range(6)] + [(f"b{i}", at(-3), ["old"]) for i in range(3)] + [("c", at(-100), ["far"])]
    df = spark.createDataFrame(posts, "author string, ts timestamp, ents array<string>")
    got = {r.entity: r for r in trends.acceleration(df, "ents", "author", "ts", F.lit(at(6)), 6).collect()}
    assert (got["new"].state, got["old"].state, got["new"].accel) == ("new", "none", None)
    assert trends.novelties(df.withColumn("p", F.col("author") > "a2"), "ents", "author", "p", "ts", F.lit(at(-1))).first().entity == "new"


def plain_simhash(text):
    words = re.findall(r"\w+", text.lower())
    runs = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else set(words)
    hashes = [int(hashlib.md5(s.encode()).hexdigest()[:16], 16) for s in runs]
    return sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)


def test_near_duplicate_clusters(spark):
    rnd = random.Random(3)
    base = [rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randint(0, 50)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(base) for _ in range(rnd.randint(1, 40)))) for i in range(40)]
    for i in range(12):
        copy = list(base)
        copy[rnd.randrange(300)] = f"new{i}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200, ""), (201, None), (202, "..."), (203, rows[0][1])]
    prints = {i: plain_simhash(t) for i, t in rows if t and re.search(r"\w", t)}
    got = {r.id: r.fp % (1 << 64) for r in neardup.simhash(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == prints
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 6:
                    label[a] = min(label[a], label[b])
    clusters = neardup.clusters(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t")
    assert {r.id: r.cluster for r in clusters.collect()} == label
    assert len(set(label.values())) < len(label)


def test_links_of_large_buckets():
    """Masks over open bits compare a bit each and lose no pair."""
    from quarryline.operators import linking

    rnd = random.Random(2)
    for free in (-1, 0xFFFF_FFFF, 0b1011_0110_0111_0101_1100_1110):
        bits = [i for i in range(64) if free >> i & 1]
        masks = linking.covering_masks(6, free)
        assert all(m and not m & ~free for m in masks)
        for _ in range(300):
            diff = sum(1 << b for b in rnd.sample(bits, 6))
            assert any(not m & diff for m in masks)


def plain_pair_scores(posts):
    n = len(posts)
    df = [Counter(v for p in posts.values() for v in set(p[k])) for k in (1, 2)]
    idf = [{v: 1 + math.log((n + 1) / (1 + c)) for v, c in d.items()} for d in df]
    out = {}
    for a, b in itertools.combinations(sorted(posts), 2):
        (ta, wa, ea), (tb, wb, eb) = posts[a], posts[b]
        if abs((ta - tb).total_seconds()) > 30 * 3600:
            continue
        shared, rare = set(wa) & set(wb), [v for v in set(ea) & set(eb) if df[1][v] / n < 0.10]
        base = min(sum(idf[0][v] for v in set(w)) for w in (wa, wb))
        text = sum(idf[0][v] for v in shared) / base if base else 0.0
        if rare or (len(shared) >= 2 and text >= 0.15):
            out[a, b] = text + 0.10 * min(1.0, sum(idf[1][v] for v in rare) / 3.0)
    return out


def test_pair_scores_equal_all_pairs(spark):
    """Prefix filtering loses no pair: frequent words, light posts, equal weights, posts without words, entities alone."""
    rnd = random.Random(9)
    common, rest = [f"c{i}" for i in range(4)], [f"w{i}" for i in range(60)]
    posts = {}
    for i in range(90):
        words = [w for w in common if rnd.random() < 0.7] + rnd.sample(rest, rnd.choice([0, 0, 1, 2, 5, 9]))
        ents = [e for e in ("rare1", "rare2", "wide") if rnd.random() < (0.7 if e == "wide" else 0.04)]
        posts[i] = (dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 90)), words, ents)
    posts[90], posts[91] = (posts[0][0], [], []), (posts[0][0], list(posts[1][1]), [])
    df = spark.createDataFrame([(i, *p) for i, p in posts.items()], "id long, ts timestamp, tokens array<string>, ents array<string>")
    got = {(r.a, r.b): r.score for r in stories.pair_scores(df.repartition(3), "id", "ts", "tokens", "ents").collect()}
    want = plain_pair_scores(posts)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert 20 < len(want) < len(posts) * (len(posts) - 1) / 2


@pytest.mark.parametrize("cliques", [False, True])
def test_linkage_in_rounds_equals_one_merge_at_a_time(spark, cliques):
    rnd = random.Random(31)
    items = range(60)
    platform = {i: "xyz"[i % 3] for i in items}
    scores = {}
    for a, b in itertools.combinations(items, 2):
        near = a // 6 == b // 6
        if rnd.random() < (0.8 if near else 0.05) and (not cliques or platform[a] != platform[b]):
            scores[a, b] = rnd.random() * (1.0 if near else 0.4)
    want = stories.clique_linkage(platform, scores, 0.2) if cliques else plain_linkage(items, scores, 0.2)
    rows = [(a, b, platform[a], platform[b], s) for (a, b), s in scores.items()]
    pairs = spark.createDataFrame(rows, "a long, b long, pa string, pb string, score double").repartition(3)
    got = {r.id: r.story for r in stories.merge_in_rounds(pairs, 0.2, cliques).collect()}
    assert got == {i: min(g) for g in want for i in g if i in got} and len(set(got.values())) < len(got)


@pytest.mark.parametrize("cliques", [False, True])
def test_rounds_of_linkage_do_not_follow_the_length_of_chains(spark, monkeypatch, cliques):
    """Of a chain of rising scores only the last two are each other's best; blocks merge it in few rounds, and a hub with more edges than a block has is left to the others."""
    rnd = random.Random(3)
    scores = {(i, i + 1): 0.5 + i / 1000 for i in range(60)} | {(0, i): 0.2 + rnd.random() / 10 for i in range(61, 161, 2)} | {(a, b): rnd.random() for a in range(200, 212) for b in range(a + 1, 212) if (b - a) % 2}
    items = sorted({i for pair in scores for i in pair})
    platform = {i: "xy"[i % 2] for i in items}
    want = stories.clique_linkage(platform, scores, 0.2) if cliques else stories.average_linkage(items, scores, 0.2)
    pairs = spark.createDataFrame([(a, b, platform[a], platform[b], s) for (a, b), s in scores.items()], "a long, b long, pa string, pb string, score double")
    written = []
    monkeypatch.setattr(stories, "write_through", lambda df, path: written.append(path) or write_through(df, path))
    got = {r.id: r.story for r in stories.merge_in_rounds(pairs, 0.2, cliques, in_task=40).collect()}
    assert got == {i: min(g) for g in want for i in g}
    assert len(written) <= 60  # 90 and more by one merge of each group a round


@pytest.mark.parametrize("cliques", [False, True])
def test_hubs_merge_with_many_leaves_in_a_round(spark, monkeypatch, cliques):
    """Two linked hubs with more leaves than a block has, of smaller and larger ids and with equal scores, some linked to each other."""
    rnd = random.Random(9)
    score = lambda: 0.5 + rnd.randint(0, 30) / 100
    hubs = {40: [*range(0, 36, 4), *range(60, 82)], 141: [*range(1, 36, 6), *range(150, 161)]}
    platform = dict.fromkeys([*hubs], "x") | {i: "y" for own in hubs.values() for i in own}
    platform[141] = "z"
    scores = {(min(h, i), max(h, i)): score() for h, own in hubs.items() for i in own} | {(40, 141): 0.6, (40, 150): 0.55, (20, 141): 0.7}
    if not cliques:
        scores |= {(4, 8): 0.9, (60, 151): 0.65}
    want = stories.clique_linkage(platform, scores, 0.02) if cliques else stories.average_linkage([*platform], scores, 0.02)
    pairs = spark.createDataFrame([(a, b, platform[a], platform[b], s) for (a, b), s in scores.items()], "a long, b long, pa string, pb string, score double")
    written = []
    monkeypatch.setattr(stories, "write_through", lambda df, path: written.append(path) or write_through(df, path))
    got = {r.id: r.story for r in stories.merge_in_rounds(pairs, 0.02, cliques, in_task=10).collect()}
    assert got == {i: min(g) for g in want for i in g} and max(Counter(got.values()).values()) > 10
    assert len(written) <= 60 or not cliques  # elsewhere means fall with each leaf, and other edges come first


def test_running_totals_and_positions(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 9)) for i in rnd.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k long, w long").repartition(5)
    total, want = 0, {}
    for k, w in sorted(rows):
        total += w
        want[k] = total
    assert {r.k: r.upto for r in ranking.running_totals(df, [F.col("k")], "w").collect()} == want
    assert {r.k: r.position for r in ranking.positions(df, [F.col("k").desc()]).collect()} == {k: i for i, (k, _) in enumerate(sorted(rows, reverse=True))}
    assert ranking.rotation(df, [F.col("k")], 498, 5).count() == 5


def test_share_at_most_with_nulls_and_ties(spark):
    from quarryline.functions import stats

    rows = [("a", 1), ("a", 1), ("a", None), ("a", 3), ("b", 5), (None, 2), (None, 1)]
    got = sorted(map(str, stats.share_at_most(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", "pct").collect()))
    want = {("a", 1): 75.0, ("a", None): 25.0, ("a", 3): 100.0, ("b", 5): 100.0, (None, 2): 100.0, (None, 1): 50.0}
    assert got == sorted(f"Row(k={k!r}, v={v!r}, pct={want[k, v]})" for k, v in rows)


def test_stories_split_inside_a_component(spark):
    a, b = ["quake", "island", "harbour", "rescue"], ["merger", "bank", "shares", "board"]
    rows = [(1, at(0), a, ["@coast"]), (2, at(1), a[:3], ["@coast"]), (3, at(2), b, ["@stock"]), (4, at(3), b[1:], ["@stock"]), (5, at(4), ["lone"], []), (6, at(60), a, ["@coast"])]
    rows += [(10 + i, at(100 + 40 * i), [f"filler{i}", f"other{i}"], [f"@x{i}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, tokens array<string>, ents array<string>")
    got = {r.id: r.story for r in stories.stories(df, "id", "ts", "tokens", "ents").collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 3, 3, 5, 6]
    assert stories.average_linkage([1, 2, 3], {(1, 2): 0.9, (2, 3): 0.2}, 0.15) == [[1, 2], [3]]


def test_story_roles(spark):
    rows = [(1, 1, at(0), ["a"], None), (1, 2, at(1), ["a"], 1), (1, 3, at(2), ["a", "b"], None), (1, 4, at(3), ["b"], None), (2, 9, at(0), [], None)]
    df = spark.createDataFrame(rows, "story long, id long, ts timestamp, ents array<string>, points_to long")
    assert {r.id: r.role for r in stories.roles(df, "story", "id", "ts", "ents", "points_to").collect()} == {1: "primary", 2: "amplifier", 3: "extender", 4: "echo", 9: "primary"}


def test_roles_of_a_long_story(spark):
    """100,000 posts of one story, each with an entity of a few posts: linear, in many tasks."""
    n = 100_000
    rows = spark.range(n).select(F.lit("s").alias("story"), "id", F.timestamp_seconds("id").alias("ts"), F.array(F.floor(F.col("id") / 3).cast("string"), F.lit("all")).alias("ents"), F.when(F.col("id") % 7 == 1, F.lit(0)).alias("points_to"))
    got = stories.roles(rows.repartition(6), "story", "id", "ts", "ents", "points_to").groupBy("role").agg(F.count("*").alias("n"))
    amplifiers = sum(i % 7 == 1 for i in range(1, n))
    extenders = sum(i % 3 == 0 and i % 7 != 1 for i in range(1, n))
    assert dict(map(tuple, got.collect())) == {"primary": 1, "amplifier": amplifiers, "extender": extenders, "echo": n - 1 - amplifiers - extenders}


def test_candidates_are_bounded(spark):
    """Words in every eighth post bring posts together, but what they share of the rest decides which are scored."""
    rnd = random.Random(3)
    posts = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), [f"w{i}x{j}" for j in range(12)] + [f"c{j}" for j in range(24) if rnd.random() < 0.125] + [f"e{i // 2}a", f"e{i // 2}b", f"e{i // 2}c"], []) for i in range(600)]
    df = spark.createDataFrame(posts, "id long, ts timestamp, tokens array<string>, ents array<string>")
    pairs, _ = stories.candidates(df, "id", "ts", "tokens", "ents")
    scored = stories.pair_scores(df, "id", "ts", "tokens", "ents")
    met, kept = pairs.count(), scored.count()
    assert kept >= 300 and met <= 3 * kept


@pytest.mark.parametrize("kind", ["long", "string"])
def test_contraction_keeps_components(spark, monkeypatch, kind):
    from quarryline.operators import components

    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rnd.randint(400, 900), rnd.randint(400, 900)) for _ in range(400)] + [(1000, 1000), (None, 3), (7, 8), (8, 7)]
    cast = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"n{x:05}")
    df = spark.createDataFrame([(cast(a), cast(b)) for a, b in edges], f"src {kind}, dst {kind}")
    want = dict(map(tuple, connected_components(df).collect()))
    for size in (1_000_000, 7):  # workers take the chunk size from the function
        monkeypatch.setattr(components, "CHUNK_EDGES", size)
        stars = components.contracted(df.repartition(5))
        assert dict(map(tuple, connected_components(stars).collect())) == want
        assert stars.count() <= 2 * len(edges)
    assert components.contracted(df.limit(0)).count() == 0


def test_pair_quality(spark):
    clusters = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id long, c string")
    labels = spark.createDataFrame([(1, 2, True), (1, 3, True), (3, 4, False), (2, 4, False)], "a_id long, b_id long, same boolean")
    r = stories.pair_quality(clusters, labels, "id", "c").first()
    assert (r.hit, r.wrong, r.missed, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)


def test_entry_check_and_health(spark):
    df = spark.createDataFrame([(1, 20, 3, 1.0, 0.5, 0.1, 0.1, 0.1), (2, 20, 1, 1.0, 0.5, 0.1, 0.1, 0.1), (3, 20, 3, 1.0, None, 0.1, None, 0.1), (4, 3, 0, None, None, None, None, None)],
        "id long, n long, m long, posts_per_day double, cv_interval double, link_ratio double, dup_ratio double, rt_ratio double")
    reasons = lambda **o: {r.id: r.reason for r in quality.entry_check(df, "m", **o).collect()}
    assert reasons() == {1: None, 2: "cooccurrence_lt_2", 3: "dup_ratio_too_high", 4: "items_lt_15"}
    assert reasons(need_mentions=False)[2] is None
    rows = quality.health([("n", df, F.count("*"), 3.0), ("none", df.limit(0), F.max("n"), 1.0)]).collect()
    assert [(r.name, r.value, r.alert) for r in rows] == [("n", 4.0, True), ("none", None, True)]


def test_components_of_nothing_and_of_a_chain(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert connected_components(empty).count() == 0
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100)], "src long, dst long")
    assert {r.component for r in connected_components(chain).collect()} == {0, 100}


def test_cross_platform_stories_need_every_link(spark):
    quake = ["quake", "island", "harbour", "rescue", "night"]
    rows = [(1, "x", at(0), quake, ["@coast", "@sea"]), (2, "y", at(1), quake, ["@coast"]), (3, "z", at(2), quake[:1] + ["merger", "bank", "share"], ["@sea"]), (4, "x", at(1), quake, ["@coast"]), (5, "y", at(60), quake, ["@coast"])]
    df = spark.createDataFrame(rows, "id long, p string, ts timestamp, words array<string>, ents array<string>")
    got = {r.id: r.story for r in stories.cross_stories(df, "id", "ts", "p", "words", "ents").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert stories.clique_linkage({1: "x", 2: "y", 3: "z"}, {(1, 2): 0.9, (2, 3): 0.8}, 0.1) == [[1, 2], [3]]


def test_cross_platform_stories_make_words_once(spark):
    """The expression of the words stands in one plan only: that of the table which the rest reads."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def spied(text):
        made.add(1)
        return text.split()

    rows = [(i, "xy"[i % 2], at(i), f"quake island harbour{i // 2}") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, p string, ts timestamp, text string").select("id", "p", "ts", spied("text").alias("words"), F.split("text", " ").alias("ents"))
    got = {r.id: r.story for r in stories.cross_stories(df, "id", "ts", "p", "words", "ents").collect()}
    assert set(got) == set(range(6)) and made.value == 6


def plain_cosines(rows, gate, most, giant):
    n = len(rows)
    df, de = Counter(w for r in rows for w in {*r[3]} - {None}), Counter(e for r in rows for e in {*(r[4] or [])} - {None})
    vectors = [{w: (1 + math.log(k)) * (1 + math.log((n + 1) / (1 + df[w]))) for w, k in Counter(x for x in r[3] if x is not None).items()} for r in rows]
    norm = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    out = {}
    for (i, x), (j, y) in itertools.permutations(enumerate(rows), 2):
        if None in (x[0], y[0], x[1], y[1], x[2], y[2]) or x[0] >= y[0] or x[1] == y[1] or abs((x[2] - y[2]).total_seconds()) > gate * 3600:
            continue
        shared = [e for e in {*(x[4] or [])} & {*(y[4] or [])} - {None} if de[e] <= most and de[e] < n]
        dot = sum(w * vectors[j].get(v, 0.0) for v, w in vectors[i].items())
        if shared and dot:
            out[x[0], y[0]] = (x[1], y[1], sum(de[e] / n < giant for e in shared), dot / norm[i] / norm[j])
    return out


@pytest.mark.parametrize("sizes", [(5 << 20, 2 << 20, 2 << 20), (40, 60, 1), (1, 1, 7)])
def test_cosines_equal_the_plain_ones_in_slices_and_blocks_of_any_size(spark, monkeypatch, sizes):
    """Posts at one moment that stand on several borders, values without posts, and posts without id, platform, time, words or entities."""
    for name, size in zip(("SLICE_VALUES", "BLOCK_VALUES", "PAIRS_AT_ONCE"), sizes, strict=True):
        monkeypatch.setattr(cosines, name, size)
    rnd = random.Random(17)
    some = lambda k, m, c: [f"{c}{int(rnd.random() ** 2 * m)}" for _ in range(rnd.randint(0, k))]
    rows = [(i * 3 - 20, rnd.choice("xyz"), at(rnd.choice([5, 5, rnd.randint(0, 200)])), some(9, 30, "w"), some(4, 25, "w") + some(3, 30, "@")) for i in range(90)]
    rows += [(None, "x", at(5), ["w1", "w2"], ["@1"]), (900, None, at(5), ["w1"], ["@1", "w20"]), (901, "y", None, ["w1", "w3"], ["@2"]), (902, "y", at(5), ["w1", None, "w1"], None), (903, "z", at(5), [], ["@1", None])]
    df = spark.createDataFrame(rows, "id long, p string, ts timestamp, words array<string>, ents array<string>").repartition(3)
    found = cosines.cosines(cosines.encode(df, "id", "ts", "p", "words", "ents"), 30.0, 12, 0.10).collect()
    want = plain_cosines(rows, 30.0, 12, 0.10)
    got = {(r.a, r.b): (r.pa, r.pb, r.rare, r.score) for r in found}
    assert len(found) == len(got) > 60 and got.keys() == want.keys()
    assert all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-9 for k in want) and {v[2] > 0 for v in want.values()} == {True, False}


def test_cross_platform_stories_shuffle_no_row_for_a_word_of_a_post(spark):
    """400 posts have 40,000 words; what is exchanged is a row per value of a slice."""
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(i, "xy"[i % 2], at(i / 100), text.split(), [f"@{i // 2}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p string, ts timestamp, words array<string>, ents array<string>").coalesce(1)
    pairs = stories.cross_pairs(df, "id", "ts", "p", "words", "ents")
    assert "Generate" not in pairs._jdf.queryExecution().toString()
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, i + 1) for i in range(0, 400, 2)}
    assert cosines.encode(df, "id", "ts", "p", "words", "ents").groupBy("kind").count().orderBy("kind").collect() == [(cosines.POST, 400), (cosines.VALUE, 300), (cosines.SLICE, 1)]


def test_story_build_and_migration(spark):
    rows = [(1, 1, "Ann", at(0), ["a"]), (1, 2, "ann", at(1), ["b"]), (2, 3, "bob", at(2), ["a"]), (2, 4, "cy", at(3), [])]
    df = spark.createDataFrame(rows, "story long, id long, author string, ts timestamp, ents array<string>")
    older = df.filter("id = 1")
    got = {r.story: (r.posts, r.authors, r.first_id, r.is_single, r.is_new) for r in stories.build(df, older, "story", "id", "author", "ts", "ents").collect()}
    assert got == {1: (2, 1, 1, True, True), 2: (2, 2, 3, False, False)}
    known, unknown = upsert.migrate(df, spark.createDataFrame([(1, 100)], "story long, new long"), "story", "new")
    assert (known.count(), unknown.count()) == (2, 2)


def plain_linkage(items, scores, threshold):
    groups = [[i] for i in sorted(items)]
    while True:
        best, pick = threshold, None
        for x in range(len(groups)):
            for y in range(x + 1, len(groups)):
                mean = sum(scores.get((min(i, j), max(i, j)), 0) for i in groups[x] for j in groups[y]) / (len(groups[x]) * len(groups[y]))
                if mean > best or (pick is None and mean == best):
                    best, pick = mean, (x, y)
        if pick is None:
            return groups
        groups[pick[0]] += groups.pop(pick[1])


def test_average_linkage_equals_the_plain_one():
    rnd = random.Random(5)
    for _ in range(40):
        n = rnd.randint(2, 14)
        scores = {(i, j): rnd.random() for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4}
        got = stories.average_linkage(list(range(n)), scores, 0.15)
        assert sorted(map(sorted, got)) == sorted(map(sorted, plain_linkage(range(n), scores, 0.15)))
    chain = {(i, i + 1): 0.5 + i / 1e6 for i in range(20_000)}
    assert len(stories.average_linkage(list(range(20_001)), chain, 0.3)) < 20_001


def test_covering_masks_compare_many_bits_in_every_table():
    """A table that compares a bit or two holds all hashes in a few buckets, each of which is dealt to every table again."""
    from quarryline.operators import linking

    for radius in (4, 6):
        for free in (-1, (1 << 32) - 1):
            bits = (free & (1 << 64) - 1).bit_count()
            assert min((m & (1 << 64) - 1).bit_count() for m in linking.covering_masks(radius, free)) >= bits // 3


def test_pairs_of_a_shared_day_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from quarryline.plans import clusters

    monkeypatch.setattr(clusters, "PAIRS_IN_TASK", 50)
    monkeypatch.setattr(clusters, "SOURCES_AT_ONCE", 7)
    days = {0: range(40), 1: range(30, 60), 2: [5], 3: [1, 2]}
    rare = spark.createDataFrame([(s, d) for d, own in days.items() for s in own], "source_id long, day long").coalesce(1)
    found = clusters._shared(rare)
    want = {}
    for own in days.values():
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.shared for r in found.collect()} == want
    assert found.rdd.getNumPartitions() == (40 * 39 // 2 + 30 * 29 // 2 + 1) // 50 + 1


def test_phrases_make_only_pairs_that_can_be_among_the_first(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [[f"w{int(rnd.random() ** 3 * 30)}" for _ in range(rnd.randint(0, 12))] for _ in range(60)]
    counted = Counter(p for w in texts for p in {*w, *(f"{a} {b}" for a, b in itertools.pairwise(w))})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, w array<string>")
    for known, limit in ((5000, 12), (5000, 1000), (3, 12)):
        monkeypatch.setattr(trends, "KNOWN_WORDS", known)
        want = sorted(((p, n) for p, n in counted.items() if n >= 3), key=lambda x: (-x[1], x[0]))[:limit]
        assert [tuple(r) for r in trends.phrases(df, "id", "w", 3, limit).collect()] == want
