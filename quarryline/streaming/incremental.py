"""Scores kept up with a stream: each micro-batch recomputes the keys that it has rows of, from their whole history, and nothing else.

Three tables below one folder, all written by ``windows.upsert_into`` and so safe to try again: ``history`` has the rows, in buckets of the scored key, so that a batch
reads the buckets of its keys only; ``scores`` has a row per key; ``marks`` has how far each stream has come, written last: what stands there is in the scores.
A batch that is tried again, before or after its mark, leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.streaming import windows


def score_changed(path: str, key: str, row_id: str, ts: str, score: Callable[[DataFrame], DataFrame], run: str, buckets: int = 64):
    """A foreachBatch step. ``score`` makes a row per ``key`` from rows of the history; ``row_id`` names a row, of which the last by ``ts`` counts."""
    history = windows.upsert_into(f"{path}/history", [key, row_id], ts, buckets, run, bucket_by=[key])
    scores = windows.upsert_into(f"{path}/scores", [key], "scored_at", buckets, run)
    marks = windows.upsert_into(f"{path}/marks", ["stream"], "mark", 1, run)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        history(batch, number)
        changed = batch.select(key).filter(F.col(key).isNotNull()).distinct()
        touched = [r.b for r in changed.select(windows.bucket_of([key], buckets).alias("b")).distinct().collect()]  # numbers below ``buckets``
        if not touched:
            return
        own = windows.upserted(spark, f"{path}/history", touched).join(changed, key, "left_semi")
        last = own.groupBy(key).agg(F.max(ts).alias("scored_at"))
        scores(score(own).join(last, key), number)
        marks(batch.agg(F.max(ts).alias("mark"), F.count("*").alias("rows")).select(F.lit(run).alias("stream"), "mark", "rows"), number)

    return step


def scored(spark: SparkSession, path: str) -> DataFrame:
    return windows.upserted(spark, f"{path}/scores")


def marked(spark: SparkSession, path: str) -> DataFrame:
    """How far each stream has come: ``stream``, ``mark``, ``rows`` of the last batch."""
    return windows.upserted(spark, f"{path}/marks")
