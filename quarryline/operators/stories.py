"""Stories: posts about one event, by TF-IDF overlap and shared rare entities, and the roles of their members."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import times
from quarryline.operators.components import connected_components, contracted
from quarryline.operators.cosines import POST, cosines, encode
from quarryline.operators.ranking import null_safe
from quarryline.session import shared_dir, write_through

#: Fixed values.
TIME_GATE_HOURS, GIANT_SHARE, MATCH_MIN = 30.0, 0.10, 0.10
#: Share of the weight that a pair has to have in common which the commonest words of a post hold that bring it together with none.
REST = 0.3
#: Pairs of a component that one task links; larger components are linked in rounds, with the same result.
PAIRS_IN_TASK = 200_000
ENTITY_WEIGHT, ENTITY_NORM, TEXT_STRONG, MIN_SHARED = 0.10, 3.0, 0.15, 2


def weights(posts: DataFrame, column: str) -> DataFrame:
    """Per value of an array column: ``df``, the posts that have it, and ``idf`` = 1 + ln((n + 1) / (1 + df))."""
    total = posts.agg(F.count("*").alias("__n"))
    counted = posts.select(F.explode(F.array_distinct(column)).alias("v")).groupBy("v").agg(F.count("*").alias("df"))
    return counted.crossJoin(F.broadcast(total)).select("v", "df", (1 + F.ln((F.col("__n") + 1) / (1 + F.col("df")))).alias("idf"), (F.col("df") / F.col("__n")).alias("share"))


def candidates(posts: DataFrame, id_: str, ts: str, tokens: str, entities: str, gate_hours: float = TIME_GATE_HOURS) -> tuple[DataFrame, DataFrame]:
    """Pairs that may be one event, and the weighted words of all posts (written to the shared folder).

    Posts meet on a shared value and a time bucket of the gate's width, this one or the next; the post with less weight is ``x``, its lead words are all but the commonest, which
    hold ``REST`` of the weight that a pair has to share. What a pair shares among the lead words (``t``, ``n``) is summed where it meets; if this and
    all of the rest stay below the limit, the pair is dropped, however common the word it met on. Pairs with a rare entity in common (``e``) stay.
    """
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (gate_hours * 3600))
    exploded = lambda c: posts.select(F.col(id_).alias("id"), F.col(ts).alias("ts"), bucket.alias("k"), F.explode(F.array_distinct(c)).alias("v"))
    words = exploded(tokens).join(weights(posts, tokens).select("v", "idf"), "v")
    light = Window.partitionBy("id").orderBy("idf", "v").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumns({"mass": F.sum("idf").over(Window.partitionBy("id")), "lighter": F.sum("idf").over(light)})
    words = write_through(words.withColumn("leads", F.col("lighter") >= REST * TEXT_STRONG * F.col("mass") * (1 - 1e-9)).drop("lighter"), shared_dir(posts.sparkSession))
    masses = words.groupBy("id").agg(F.max("mass").alias("mass"), F.sum(F.when(~F.col("leads"), F.col("idf")).otherwise(0.0)).alias("rest"))
    rare = weights(posts, entities).filter(F.col("share") < GIANT_SHARE).select("v", "idf")
    named = exploded(entities).join(rare, "v").join(masses.drop("rest"), "id", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    nearby = F.explode(F.array("k", F.col("k") + 1, F.col("k") - 1)).alias("k")
    near = F.abs(times.hours_between(F.col("tx"), F.col("ty"))) <= gate_hours
    lighter = (F.col("mx") < F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("x") < F.col("y")))

    def met(lead: DataFrame, every: DataFrame) -> DataFrame:
        left = lead.select("v", F.col("id").alias("x"), F.col("ts").alias("tx"), F.col("mass").alias("mx"), "idf", nearby)
        right = every.select("v", "k", F.col("id").alias("y"), F.col("ts").alias("ty"), F.col("mass").alias("my"))
        return left.join(right, ["v", "k"]).filter((F.col("x") != F.col("y")) & near & lighter)

    base = F.least("mx", "my").alias("base")
    by_word = met(words.filter("leads"), words).select("x", "y", base, F.col("idf").alias("t"), F.lit(1).alias("n"), F.lit(None).cast("double").alias("e"))
    by_name = met(named, named).select("x", "y", base, F.lit(0.0).alias("t"), F.lit(0).alias("n"), F.col("idf").alias("e"))
    sums = by_word.unionByName(by_name).groupBy("x", "y").agg(F.max("base").alias("base"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    joined = sums.join(masses.select(F.col("id").alias("x"), "rest"), "x", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    able = F.col("e").isNotNull() | (F.col("t") + F.col("rest") >= TEXT_STRONG * F.col("base") * (1 - 1e-9))
    return write_through(joined.filter(able).drop("rest"), shared_dir(posts.sparkSession)), words


def pair_scores(posts: DataFrame, id_: str, ts: str, tokens: str, entities: str, gate_hours: float = TIME_GATE_HOURS) -> DataFrame:
    """``a`` < ``b`` and ``score`` of posts within the time gate that share a rare entity, or two tokens and enough of the lighter post's weight.

    To what the candidates share among lead words comes what they share of the lighter post's few other words.
    """
    pairs, words = candidates(posts, id_, ts, tokens, entities, gate_hours)
    others = words.filter("NOT leads").select(F.col("id").alias("x"), "v", "idf")
    common = pairs.select("x", "y").join(others, "x").join(words.select(F.col("id").alias("y"), "v"), ["y", "v"])
    more = common.groupBy("x", "y").agg(F.sum("idf").alias("more_t"), F.count("*").alias("more_n"))
    joined = pairs.join(more, ["x", "y"], "left")
    t, n = F.col("t") + F.coalesce("more_t", F.lit(0.0)), F.col("n") + F.coalesce("more_n", F.lit(0))
    text = F.when(F.col("base") > 0, t / F.col("base")).otherwise(0.0)
    strong = F.col("e").isNotNull() | ((n >= MIN_SHARED) & (text >= TEXT_STRONG))
    score = text + ENTITY_WEIGHT * F.least(F.lit(1.0), F.coalesce("e", F.lit(0.0)) / ENTITY_NORM)
    return joined.filter(strong).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), score.alias("score"))


def average_linkage(items: list[int], scores: dict[tuple[int, int], float], threshold: float) -> list[list[int]]:
    """Merge the two groups with the highest mean score while it reaches the threshold; the smallest ids of equal ones.

    Only linked groups are ever compared, best first from a heap, so the work grows with the links.
    """
    return _linkage({i: "" for i in items}, scores, threshold, lambda a, b, linked: len(a) * len(b))


def _linkage(platforms: dict[int, str], scores: dict[tuple[int, int], float], threshold: float, pairs_of) -> list[list[int]]:
    """``pairs_of`` (group, group, linked pairs) is the number that a mean is taken over, or None where the groups may not merge."""
    groups = {i: [i] for i in platforms}
    links: dict[int, dict[int, tuple[float, int]]] = {i: {} for i in platforms}
    for (a, b), s in scores.items():
        links[a][b] = links[b][a] = (s, 1)
    age = dict.fromkeys(platforms, 0)
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        total, linked = links[a][b]
        n = pairs_of(groups[a], groups[b], linked)
        if n and total / n >= threshold:
            a, b = min(a, b), max(a, b)
            heappush(heap, (-total / n, a, b, age[a], age[b]))

    for a, b in scores:
        offer(a, b)
    while heap:
        _, a, b, age_a, age_b = heappop(heap)
        if age.get(a) != age_a or age.get(b) != age_b:
            continue  # one of them has changed since
        groups[a] += groups.pop(b)
        age[a] += 1
        del age[b], links[a][b]
        for c, (total, linked) in links.pop(b).items():
            if c != a:
                had = links[a].get(c, (0.0, 0))
                links[a][c] = links[c][a] = (had[0] + total, had[1] + linked)
                del links[c][b]
        for c in links[a]:
            offer(a, c)
    return [groups[i] for i in sorted(groups)]


def _between(here: dict[str, int], there: dict[str, int], cliques: bool) -> int:
    """Pairs of two groups, given their members per platform; with ``cliques`` those across platforms."""
    same = sum(k * there.get(p, 0) for p, k in here.items()) if cliques else 0
    return sum(here.values()) * sum(there.values()) - same


def _merged_inside(pdf: pd.DataFrame, threshold: float, cliques: bool) -> pd.DataFrame:
    """``was`` and ``now`` of the groups of a block that merge, whatever comes of the groups outside; ``inx`` and ``iny`` tell whose links are all here.

    Links are taken best first. One to a group that may still merge elsewhere holds up the group on this side, and so on from there; any other is
    the best of both of its groups, and they merge.
    """
    links: dict[int, dict[int, tuple[float, int]]] = {}
    held: dict[int, Counter] = {}
    waiting = set()
    for x, y, s, n, hx, hy, inx, iny in pdf[["x", "y", "s", "n", "hx", "hy", "inx", "iny"]].itertuples(index=False, name=None):
        links.setdefault(x, {})[y] = links.setdefault(y, {})[x] = (s, n)
        for g, h, inside in ((x, hx, inx), (y, hy, iny)):
            if g not in held:
                held[g] = Counter(dict(h))
                if not inside:
                    waiting.add(g)
    groups = {g: [g] for g in links}
    age = dict.fromkeys(links, 0)
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        total, linked = links[a][b]
        n = _between(held[a], held[b], cliques)
        if n and total / n >= threshold and (n == linked or not cliques):
            a, b = min(a, b), max(a, b)
            heappush(heap, (-total / n, a, b, age[a], age[b]))

    for a in links:
        for b in links[a]:
            if a < b:
                offer(a, b)
    while heap:
        _, a, b, age_a, age_b = heappop(heap)
        if age.get(a) != age_a or age.get(b) != age_b:
            continue  # one of them has changed since
        if a in waiting or b in waiting:
            waiting |= {a, b}
            continue
        groups[a] += groups.pop(b)
        held[a].update(held.pop(b))
        age[a] += 1
        del age[b], links[a][b]
        for c, (total, linked) in links.pop(b).items():
            if c != a:
                had = links[a].get(c, (0.0, 0))
                links[a][c] = links[c][a] = (had[0] + total, had[1] + linked)
                del links[c][b]
        for c in links[a]:
            offer(a, c)
    return pd.DataFrame([(i, g) for g, own in groups.items() for i in own if i != g], columns=["was", "now"])


def _merged_to_hub(pdf: pd.DataFrame, threshold: float, cliques: bool) -> pd.DataFrame:
    """``was`` and ``now`` of a hub and of those leaves (groups with no edge but that to the hub) that merge with it before anything else does, best first.

    Means only fall as the hub grows, so a leaf is rated again when its turn comes. Other edges of the hub have a mean of ``bound`` at most, then as now.
    """
    hub, bound = int(pdf["hub"].iloc[0]), pdf["bound"].iloc[0]
    held = Counter(dict(pdf["hh"].iloc[0]))
    leaves = {leaf: (s, n, dict(h)) for leaf, s, n, h in pdf[["leaf", "s", "n", "hl"]].itertuples(index=False, name=None)}
    heap = [(-s / _between(held, own, cliques), leaf) for leaf, (s, n, own) in leaves.items()]
    heapify(heap)
    merged = [hub]
    while heap:
        rated, leaf = heappop(heap)
        total, linked, own = leaves[leaf]
        n = _between(held, own, cliques)
        if total / n < threshold or (cliques and n != linked):
            continue  # now and later
        if -total / n != rated:
            heappush(heap, (-total / n, leaf))
            continue
        if total / n <= bound:
            break
        held.update(own)
        merged.append(leaf)
    now = min(merged)
    return pd.DataFrame([(i, now) for i in merged if i != now], columns=["was", "now"])


def _merges_in_blocks(edges: DataFrame, n: int, threshold: float, cliques: bool, in_task: int, shifted: bool) -> DataFrame:
    """Merges inside blocks of neighbouring ids with ``in_task`` ends of edges or so; ``shifted`` moves the borders by half a block.

    A group is inside the block of its id, and its edges come there too; one with more edges than ``in_task`` is inside none. Such a hub meets the best ``in_task`` of its leaves elsewhere.
    """
    ends = edges.select(F.explode(F.array("x", "y")).alias("g"))
    degrees = ends.groupBy("g").agg(F.count("*").alias("k"))
    huge = degrees.filter(F.col("k") > in_task).select("g")
    blocks = 2 * n // in_task + 1
    shares = [(i + (0.5 if shifted else 0.0)) / blocks for i in range(0 if shifted else 1, blocks)]
    borders = sorted(set(ends.agg(F.percentile_approx("g", shares, 100 * blocks)).first()[0]))  # one number per block

    @F.pandas_udf("int")
    def block(g: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, g, "right").astype("int32"))

    known = edges.withColumns({"bx": block("x"), "by": block("y")})
    for side in ("x", "y"):
        known = known.join(huge.select(F.col("g").alias(side), F.lit(-1).alias("none")), side, "left").withColumn(f"b{side}", F.coalesce("none", f"b{side}")).drop("none")
    dealt = known.withColumn("block", F.explode(F.array_distinct(F.array("bx", "by")))).filter("block >= 0")
    inside = dealt.select("block", "x", "y", "s", "n", "hx", "hy", (F.col("bx") == F.col("block")).alias("inx"), (F.col("by") == F.col("block")).alias("iny"))
    merges = inside.groupBy("block").applyInPandas(lambda pdf: _merged_inside(pdf, threshold, cliques), "was long, now long")
    if huge.isEmpty():
        return merges
    sides = [edges.filter("able").select(F.col(a).alias("hub"), F.col(b).alias("leaf"), "s", "n", F.col(f"h{a}").alias("hh"), F.col(f"h{b}").alias("hl"), "mean") for a, b in ("xy", "yx")]
    stars = sides[0].union(sides[1]).join(huge.withColumnRenamed("g", "hub"), "hub", "left_semi").join(degrees.withColumnRenamed("g", "leaf"), "leaf")
    ranked = stars.withColumn("place", F.row_number().over(Window.partitionBy("hub", F.col("k") == 1).orderBy(F.desc("mean"), "leaf"))).withColumn("near", (F.col("k") == 1) & (F.col("place") <= in_task))
    rest = ranked.groupBy("hub").agg(F.coalesce(F.max(F.when(~F.col("near"), F.col("mean"))), F.lit(-math.inf)).alias("bound"))
    near = ranked.filter("near").join(rest, "hub").select("hub", "leaf", "s", "n", "hh", "hl", "bound")
    return merges.union(near.groupBy("hub").applyInPandas(lambda pdf: _merged_to_hub(pdf, threshold, cliques), "was long, now long"))


def merge_in_rounds(pairs: DataFrame, threshold: float, cliques: bool = False, in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """``id`` and ``story`` of all items of scored pairs, for components of any size: groups that are each other's best partner merge, round by round.

    A merge never brings a third group nearer than the nearer of the two was, so merging all mutual best pairs at once gives what one merge at a time gives; of
    equal means the smaller ids come first. With ``cliques`` groups merge only if all of their pairs across platforms are linked, and only these count in the mean.
    For the same reason a round merges whole blocks of groups as far as these do not depend on others, with other borders each time, and edges of groups that no
    edge can merge any more are left out. So rounds are few however long the chains are; where blocks give nothing, one merge of each group is done.
    Every round is written to the shared folder; sums of scores per pair of groups shuffle, members do not meet.
    """
    spark = pairs.sparkSession
    sides = [pairs.select(F.col(i).alias("id"), (F.col(p) if cliques else F.lit("")).alias("p")) for i, p in (("a", "pa"), ("b", "pb"))]
    groups = write_through(sides[0].union(sides[1]).distinct().withColumn("g", F.col("id")), shared_dir(spark))
    edges = pairs.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    in_blocks, number = True, 0
    while True:
        held = groups.groupBy("g", "p").agg(F.count("*").alias("k")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("p", "k"))).alias("held"))  # an entry per platform
        known = edges.join(held.withColumnsRenamed({"g": "x", "held": "hx"}), "x").join(held.withColumnsRenamed({"g": "y", "held": "hy"}), "y")
        size = lambda h: F.aggregate(F.map_values(h), F.lit(0).cast("long"), lambda t, k: t + k)
        same = F.aggregate(F.map_keys("hx"), F.lit(0).cast("long"), lambda t, k: t + F.col("hx")[k] * F.coalesce(F.try_element_at(F.col("hy"), k), F.lit(0)))
        between = size(F.col("hx")) * size(F.col("hy")) - (same if cliques else F.lit(0))
        rated = write_through(known.withColumns({"mean": F.col("s") / between, "able": (F.col("s") / between >= threshold) & ((between == F.col("n")) | F.lit(not cliques))}), shared_dir(spark))
        able = rated.filter("able")
        alive = able.select(F.explode(F.array("x", "y")).alias("g")).distinct()
        live = write_through(rated.join(alive.select(F.col("g").alias("x")), "x", "left_semi").join(alive.select(F.col("g").alias("y")), "y", "left_semi"), shared_dir(spark))
        n = live.count()
        if not n:
            return groups.select("id", F.col("g").alias("story"))
        if in_blocks:
            found = _merges_in_blocks(live, n, threshold, cliques, in_task, number % 2 == 1) if n > in_task else live.withColumns({"inx": F.lit(True), "iny": F.lit(True)}).groupBy().applyInPandas(
                lambda pdf: _merged_inside(pdf, threshold, cliques), "was long, now long"
            )
        else:
            rank = F.struct("mean", -F.col("x"), -F.col("y"))
            ranked = able.select("x", "y", rank.alias("r"))
            best = ranked.select(F.explode(F.array("x", "y")).alias("g"), "r").groupBy("g").agg(F.max("r").alias("r"))
            found = best.groupBy("r").agg(F.count("*").alias("k")).filter("k = 2").select((-F.col("r.col3")).alias("was"), (-F.col("r.col2")).alias("now"))
        merges = write_through(found, shared_dir(spark))
        none = merges.isEmpty()
        if none and (not in_blocks or n <= in_task):
            return groups.select("id", F.col("g").alias("story"))
        in_blocks, number = not none, number + 1
        moved = lambda df, c: df.join(merges.select(F.col("was").alias(c), F.col("now").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        groups = write_through(moved(groups, "g"), shared_dir(spark))
        if n <= in_task:  # nothing was outside
            return groups.select("id", F.col("g").alias("story"))
        joined = moved(moved(live.select("x", "y", "s", "n"), "x"), "y").filter("x <> y")
        edges = joined.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _grouped(pairs: DataFrame, threshold: float, link: Callable[[pd.DataFrame], pd.DataFrame], cliques: bool, in_task: int) -> DataFrame:
    """Linkage inside each connected component of the pairs: by ``link`` in one task for up to ``in_task`` pairs, in rounds for larger ones."""
    spark = pairs.sparkSession
    pairs = write_through(pairs, shared_dir(spark))
    labels = connected_components(contracted(pairs, "a", "b")).withColumnRenamed("node", "a")
    sizes = pairs.join(labels, "a").groupBy("component").agg(F.count("*").alias("n"))
    large = write_through(sizes.filter(F.col("n") > in_task).select("component"), shared_dir(spark))
    labelled = pairs.join(labels, "a")
    small = labelled.join(large, "component", "left_anti").groupBy("component").applyInPandas(link, "id long, story long")
    if large.isEmpty():
        return small
    return small.union(merge_in_rounds(labelled.join(large, "component", "left_semi").drop("component"), threshold, cliques, max(in_task, 1)))


def stories(posts: DataFrame, id_: str, ts: str, tokens: str, entities: str, threshold: float = MATCH_MIN, gate_hours: float = TIME_GATE_HOURS, in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """``id_`` and ``story``, the smallest id of its group.

    Groups never leave a connected component of scores, so components are found first and average linkage runs inside each.
    """
    posts = write_through(posts.select(id_, ts, tokens, entities), shared_dir(posts.sparkSession))  # words are made once
    pairs = pair_scores(posts, id_, ts, tokens, entities, gate_hours)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = {(int(a), int(b)): float(s) for a, b, s in zip(pdf.a, pdf.b, pdf.score, strict=True)}
        groups = average_linkage(sorted({*pdf.a.astype(int), *pdf.b.astype(int)}), scores, threshold)
        return pd.DataFrame([(i, min(g)) for g in groups for i in g], columns=["id", "story"])

    grouped = _grouped(pairs, threshold, link, False, in_task)
    return posts.select(id_).join(grouped.withColumnRenamed("id", id_), id_, "left").select(id_, F.coalesce("story", F.col(id_).cast("long")).alias("story"))


def roles(members: DataFrame, story: str, id_: str, ts: str, entities: str, points_to: str) -> DataFrame:
    """primary for the first post, amplifier where ``points_to`` names it, extender for a post with a new entity, echo for the others.

    A post extends its story if it is the first with one of its entities. First posts are aggregates over (story) and (story, entity), joined back: no row
    holds what came before it, and a story of any length is spread by its posts. Posts are told apart by ``ts`` and ``id_``.
    """
    order = F.struct(F.col(ts).alias("ts"), F.col(id_).alias("id"))
    firsts = members.groupBy(story).agg(F.min(order).alias("__first"))
    each = members.select(*dict.fromkeys([story, id_, ts]), F.explode(entities).alias("__e"))
    keys = list(dict.fromkeys([story, ts, id_]))
    told = {ts: F.col("__o.ts").alias(ts), id_: F.col("__o.id").alias(id_)}
    new = each.groupBy(story, "__e").agg(F.min(order).alias("__o")).select(story, *(told[k] for k in keys[1:])).distinct()
    joined = null_safe(null_safe(members, firsts, [story]), new.withColumn("__new", F.lit(True)), keys, "left")
    role = (
        F.when(order == F.col("__first"), "primary")
        .when(F.coalesce(F.col(points_to) == F.col("__first.id"), F.lit(False)), "amplifier")
        .when(F.col("__new"), "extender")
        .otherwise("echo")
    )
    return joined.withColumn("role", role).select(*members.columns, "role")


def pair_quality(clusters: DataFrame, labels: DataFrame, id_: str, cluster: str) -> DataFrame:
    """Precision, recall and F1 of a clustering over labelled pairs (``a_id``, ``b_id``, ``same``)."""
    of = lambda side: clusters.select(F.col(id_).alias(f"{side}_id"), F.col(cluster).alias(f"{side}_c"))
    joined = labels.join(of("a"), "a_id").join(of("b"), "b_id").withColumn("said", F.col("a_c") == F.col("b_c"))
    n = joined.agg(F.count_if(F.expr("said and same")).alias("hit"), F.count_if(F.expr("said and not same")).alias("wrong"), F.count_if(F.expr("same and not said")).alias("missed"))
    p, r = F.try_divide(F.col("hit"), F.col("hit") + F.col("wrong")), F.try_divide(F.col("hit"), F.col("hit") + F.col("missed"))
    return n.select("hit", "wrong", "missed", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


#: Limits between platforms. Fixed values.
RARE_DF, COSINE_MIN, COSINE_SUPPORT, SHARED_ENTITIES = 50, 0.30, 0.10, 2


def cross_pairs(posts: DataFrame, id_: str, ts: str, platform: str, words: str, entities: str, gate_hours: float = TIME_GATE_HOURS) -> DataFrame:
    """``a`` < ``b``, their platforms ``pa`` and ``pb``, and ``score``, the TF-IDF cosine of pairs across platforms that may be one event.

    Candidates share an entity of at most ``RARE_DF`` posts, so no value brings together more. A cosine of 0.30 is enough, or 0.10 with two such
    entities that are not everywhere. ``words`` keeps repeats.
    """
    return _linked(encode(posts, id_, ts, platform, words, entities), gate_hours)


def _linked(encoded: DataFrame, gate_hours: float) -> DataFrame:
    ok = (F.col("score") >= COSINE_MIN) | ((F.col("score") >= COSINE_SUPPORT) & (F.col("rare") >= SHARED_ENTITIES))
    return cosines(encoded, gate_hours, RARE_DF, GIANT_SHARE).filter(ok).select("a", "b", "pa", "pb", "score")


def clique_linkage(platforms: dict[int, str], scores: dict[tuple[int, int], float], threshold: float) -> list[list[int]]:
    """Merge the groups with the highest mean score while every pair of them across platforms is linked."""

    def across(a: list[int], b: list[int], linked: int) -> int | None:
        here, there = Counter(platforms[i] for i in a), Counter(platforms[i] for i in b)
        n = len(a) * len(b) - sum(k * there[p] for p, k in here.items())
        return n if n == linked else None

    return _linkage(platforms, scores, threshold, across)


def cross_stories(posts: DataFrame, id_: str, ts: str, platform: str, words: str, entities: str, threshold: float = COSINE_SUPPORT, in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """``id_`` and ``story``, the smallest id of its group across platforms, which stays the same from run to run."""
    encoded = encode(posts, id_, ts, platform, words, entities)  # words are made once
    pairs = _linked(encoded, TIME_GATE_HOURS)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        platforms = {**dict(zip(pdf.a.astype(int), pdf.pa, strict=True)), **dict(zip(pdf.b.astype(int), pdf.pb, strict=True))}
        scores = {(int(a), int(b)): float(s) for a, b, s in zip(pdf.a, pdf.b, pdf.score, strict=True)}
        return pd.DataFrame([(i, min(g)) for g in clique_linkage(platforms, scores, threshold) for i in g], columns=["id", "story"])

    grouped = _grouped(pairs, threshold, link, True, in_task)
    return encoded.filter(F.col("kind") == POST).select(F.col("id").alias(id_)).join(grouped.withColumnRenamed("id", id_), id_, "left").select(id_, F.coalesce("story", F.col(id_).cast("long")).alias("story"))


def build(members: DataFrame, older: DataFrame, story: str, id_: str, author: str, ts: str, entities: str) -> DataFrame:
    """Per story the posts, the distinct authors, its first post, and whether it is of one author or has an entity that ``older`` posts lack."""
    first = F.min_by(F.struct(F.col(id_).alias("id"), F.col(author).alias("author"), F.col(ts).alias("ts")), F.struct(ts, id_))
    base = members.groupBy(story).agg(F.count("*").alias("posts"), F.countDistinct(F.lower(author)).alias("authors"), first.alias("f"))
    each = members.select(story, F.explode(F.array_distinct(entities)).alias("e")).distinct()
    new = each.join(older.select(F.explode(entities).alias("e")).distinct(), "e", "left_anti").select(story).distinct().withColumn("is_new", F.lit(True))
    joined = base.join(new, story, "left")
    return joined.select(
        story,
        "posts",
        "authors",
        F.col("f.id").alias("first_id"),
        F.col("f.author").alias("first_author"),
        F.col("f.ts").alias("first_at"),
        (F.col("authors") == 1).alias("is_single"),
        F.coalesce("is_new", F.lit(False)).alias("is_new"),
    )
