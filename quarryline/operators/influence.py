"""Who takes up an author or a post within a window of time, without meeting posts and namings one by one.

A post at t counts an author with a naming in [t, t + W]. Of the namings of one author, the one at s answers for the posts in (previous naming, s] that are
no older than W; these intervals do not overlap, so the number of authors of a post is the number of intervals over it: a running sum over
interval ends and posts in the order of name and time. It takes as long for a name that everybody uses as for as many names of one use each, and a name is
dealt to as many tasks as it needs, since sums and predecessors come from ranges of the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ranking import positions, running_totals

HOUR = 3_600_000_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def reaches(namings: DataFrame, hours: float) -> DataFrame:
    """Disjoint intervals (``name``, ``by``, ``start``, ``stop``) in which a post of ``name`` is taken up by ``by``, from namings (``name``, ``by``, ``at`` in microseconds)."""
    width = round(hours * HOUR)
    once = namings.filter("name IS NOT NULL AND by IS NOT NULL AND at IS NOT NULL").select("name", "by", "at").distinct()
    placed = positions(once, [F.col("name"), F.col("by"), F.col("at")], "__place")
    before = placed.select((F.col("__place") + 1).alias("__place"), F.col("name").alias("__name"), F.col("by").alias("__by"), F.col("at").alias("__at"))
    joined = placed.join(before, "__place", "left")
    previous = F.when((F.col("__name") == F.col("name")) & (F.col("__by") == F.col("by")), F.col("__at") + 1)
    return joined.select("name", "by", F.greatest(F.col("at") - width, previous).alias("start"), F.col("at").alias("stop"))


def weighed(posts: DataFrame, intervals: DataFrame, weight: str) -> DataFrame:
    """``id`` and ``total``: the sum of ``weight`` (a whole number) of the intervals over each post (``id``, ``name``, ``at``)."""
    asked = posts.filter("name IS NOT NULL AND at IS NOT NULL").select("name", "at", F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__w"), "id")
    none = F.lit(None).cast(posts.schema["id"].dataType).alias("id")
    opened = intervals.select("name", F.col("start").alias("at"), F.lit(0).alias("__kind"), F.col(weight).cast("long").alias("__w"), none)
    closed = intervals.select("name", F.col("stop").alias("at"), F.lit(2).alias("__kind"), (-F.col(weight)).cast("long").alias("__w"), none)
    ends = opened.unionByName(closed).groupBy("name", "at", "__kind").agg(F.sum("__w").alias("__w"), F.first("id").alias("id"))
    # Intervals of a name open and close in it, so what earlier names leave is nothing.
    order = [F.col(c) for c in ("name", "at", "__kind", "id")]
    return running_totals(ends.unionByName(asked), order, "__w", "total").filter("__kind = 1").select("id", "total")


def later_echoes(posts: DataFrame, keys_of: str, author: str, id_: str, ts: str, hours: float = 72.0) -> DataFrame:
    """Per post the number of other authors whose posts name its author within ``hours`` after it; ``keys_of`` is an array of the names in a post."""
    named = posts.select(F.explode(keys_of).alias("name"), F.col(author).alias("by"), _micros(ts).alias("at")).filter("name <> by")
    intervals = reaches(named, hours).withColumn("n", F.lit(1))
    counted = weighed(posts.select(F.col(id_).alias("id"), F.col(author).alias("name"), _micros(ts).alias("at")), intervals, "n")
    joined = posts.select(id_).join(counted.withColumnRenamed("id", id_), id_, "left")
    return joined.select(id_, F.coalesce("total", F.lit(0)).alias("authors"))


def _signals(posts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts by author; namings and repetitions by name; links by the id that ends them."""
    counted = posts.filter("counts AND author IS NOT NULL AND at IS NOT NULL")
    names = F.array_compact(F.array_append(F.transform("mentions", F.lower), F.lower("origin")))
    named = counted.select(F.explode(names).alias("name"), F.lower("author").alias("by"), _micros("at").alias("at")).filter("name <> by")
    linked = counted.select(F.explode("links").alias("link"), F.lower("author").alias("by"), _micros("at").alias("__at"), F.col("id").alias("__other"))
    linked = linked.select(F.regexp_extract("link", "([0-9]+)(?:[^0-9]*)$", 1).alias("id"), "by", "__at", "__other")
    own = posts.filter("author IS NOT NULL AND at IS NOT NULL").select("id", F.lower("author").alias("name"), _micros("at").alias("at"))
    return own, named, linked


def _spans(named: DataFrame, width: int) -> DataFrame:
    """First and last naming by every author in every stretch of ``width``: all that a window of that width has to know of one."""
    return named.groupBy("name", "by", F.floor(F.col("at") / width).alias("__cell")).agg(F.min("at").alias("__first"), F.max("at").alias("__last"))


def _linkers(own: DataFrame, linked: DataFrame, width: int) -> DataFrame:
    """(``id``, ``by``) of posts linked by others in the window; a link has one target, so these are no more than links."""
    hits = own.join(linked, "id").filter((F.col("by") != F.col("name")) & (F.col("__other") != F.col("id")) & (F.col("__at") - F.col("at")).between(0, width))
    return hits.select("id", "name", "at", "by").distinct()


def spread(posts: DataFrame, verified: DataFrame, hours: float = 72.0, weight: float = 1.5, bonus: float = 0.10) -> DataFrame:
    """Independent authors who took a post up: ``post``, ``author``, ``weight``, a little more for verified ones; a row for each.

    An author does so by naming, repeating or linking the post within the time. ``posts`` has ``id``, ``author``, ``at``, ``mentions``, ``origin``, ``links``, ``counts``.
    Posts meet the authors of two stretches as long as the window, each once a stretch however often they name.
    """
    width = round(hours * HOUR)
    own, named, linked = _signals(posts)
    cells = F.explode(F.array(F.lit(0), F.lit(1))).alias("__next")
    asked = own.select("id", "name", "at", cells).withColumn("__cell", F.floor(F.col("at") / width) + F.col("__next"))
    met = asked.join(_spans(named, width), ["name", "__cell"])
    hit = F.when(F.col("__next") == 0, F.col("__last") >= F.col("at")).otherwise(F.col("__first") <= F.col("at") + width)
    found = met.filter(hit).select("id", "by").union(_linkers(own, linked, width).select("id", "by")).distinct()
    marked = found.join(verified.select(F.lower("author").alias("by"), F.lit(True).alias("__v")).distinct(), "by", "left")
    return marked.select(F.col("id").alias("post"), F.col("by").alias("author"), F.round(weight * F.when(F.col("__v"), 1 + bonus).otherwise(1.0), 6).alias("weight"))


def spread_scores(posts: DataFrame, verified: DataFrame, hours: float = 72.0, weight: float = 1.5, bonus: float = 0.10) -> DataFrame:
    """``id`` and ``score`` of every post that has a time and an author: the sum of the weights of :func:`spread`, without its rows.

    Namings are summed as intervals; links are added for authors who do not name the post's author in the window.
    """
    width = round(hours * HOUR)
    own, named, linked = _signals(posts)
    known = verified.select(F.lower("author").alias("by"), F.lit(True).alias("__v")).distinct()
    units = F.round(weight * F.when(F.col("__v"), 1 + bonus).otherwise(1.0) * 1_000_000).cast("long").alias("w")
    intervals = reaches(named, hours).join(known, "by", "left").select("name", "start", "stop", units)
    by_name = weighed(own, intervals, "w")
    spans = _spans(named, width)
    asked = _linkers(own, linked, width).withColumn("__next", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = asked.withColumn("__cell", F.floor(F.col("at") / width) + F.col("__next")).join(spans, ["name", "by", "__cell"], "left")
    hit = F.when(F.col("__next") == 0, F.col("__last") >= F.col("at")).otherwise(F.col("__first") <= F.col("at") + width)
    only = asked.groupBy("id", "by").agg(F.max(F.coalesce(hit, F.lit(False))).alias("__named")).filter("NOT __named").join(known, "by", "left").select("id", units)
    by_link = only.groupBy("id").agg(F.sum("w").alias("__linked"))
    both = own.select("id").distinct().join(by_name.groupBy("id").agg(F.max("total").alias("total")), "id", "left").join(by_link, "id", "left")
    return both.select("id", F.round((F.coalesce("total", F.lit(0)) + F.coalesce("__linked", F.lit(0))) / 1_000_000, 6).alias("score"))
