"""The link graph: in-degree from trusted sources, groups of edges, first movers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import stats

MIN_SOURCES, SPAM_SHARE = 2, 0.9


def trusted_in_degree(edges: DataFrame, sources: DataFrame, source: str, target: str, platform: str, size: str, fraction: float = 0.10) -> DataFrame:
    """Distinct sources per target, only those of the largest ``fraction`` of their platform."""
    trusted = stats.top_fraction(sources, [platform], size, source, fraction).select(source)
    return edges.join(trusted, source, "left_semi").groupBy(target).agg(F.countDistinct(source).alias("in_degree"))


def consume(edges: DataFrame, source: str, target: str, kind: str, weight: str, known: DataFrame | None = None, least_sources: int = MIN_SOURCES) -> DataFrame:
    """Per target ``n_edges``, ``n_sources``, ``max_weight``, the ``main_kind`` by weight, ``from_one`` (one source gives nearly all), ``eligible``, ``priority``.

    Edges are summed by target, source and kind first, so a target with very many edges is a few rows per task.
    """
    pre = edges.groupBy(target, source, kind).agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.max(weight).alias("mw"))
    by_source = pre.groupBy(target, source).agg(F.sum("n").alias("n"))
    sources = by_source.groupBy(target).agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_sources"), F.max("n").alias("most"))
    by_kind = pre.groupBy(target, kind).agg(F.sum("w").alias("w"), F.max("mw").alias("mw"))
    kinds = by_kind.groupBy(target).agg(F.max("mw").alias("max_weight"), F.min_by(kind, F.struct(-F.col("w"), kind)).alias("main_kind"))
    out = sources.join(kinds, target)
    if known is not None:
        out = out.join(known.select(target), target, "left_anti")
    one = F.col("most") >= SPAM_SHARE * F.col("n_edges")
    return out.select(
        target, "n_edges", "n_sources", "max_weight", "main_kind", one.alias("from_one"),
        ((F.col("n_sources") >= least_sources) & ~one).alias("eligible"), (F.col("n_sources") * F.col("max_weight")).alias("priority"),
    )


def first_movers(members: DataFrame, story: str, author: str, id_: str, ts: str, least_lead: float = 10.0) -> DataFrame:
    """Per member of a story with two authors or more: ``lead_minutes`` relative to the second author's first post, and ``first_move``.

    The first author is that of the earliest post; the second the earliest other one. Each author's first post is enough to
    find both, so stories are aggregated by author before any order is needed.
    """
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    first = members.groupBy(story, author).agg(F.min(F.struct(seconds.alias("s"), F.col(id_).alias("i"))).alias("at"))
    order = Window.partitionBy(story).orderBy("at", author)
    pairs = first.withColumn("k", F.row_number().over(order)).filter("k <= 2").groupBy(story).agg(
        F.max(F.when(F.col("k") == 1, F.struct(F.col("at.s").alias("t1"), F.col("at.i").alias("first_id")))).alias("f"), F.max(F.when(F.col("k") == 2, F.col("at.s"))).alias("t2")
    ).filter("t2 is not null").select(story, "f.t1", "f.first_id", "t2")
    joined = members.join(pairs, story)
    ahead = (F.col("t2") - F.col("t1")) / 60
    lead = (seconds - F.col("t2")) / 60
    return joined.select(story, author, id_, lead.alias("lead_minutes"), ((F.col(id_) == F.col("first_id")) & (ahead >= least_lead)).alias("first_move"))


def first_mover_ledger(moves: DataFrame, story: str, author: str) -> DataFrame:
    """Per author the stories, the first moves and their share, and the median lead."""
    found = moves.groupBy(author).agg(
        F.countDistinct(story).alias("stories"), F.count_if("first_move").alias("first_moves"), F.median("lead_minutes").alias("median_lead")
    )
    return found.withColumn("share", F.col("first_moves") / F.col("stories"))
