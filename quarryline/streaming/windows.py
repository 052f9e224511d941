"""Streaming forms: windowed counts with late data, dedup on ingest, incremental upserts, measurement stages as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.functions import times
from quarryline.operators import upsert
from quarryline.session import exists, remove


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; tables without one load as timestamp_ntz."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per window and key; rows later than the watermark are left out by it."""
    own = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = event_time(stream, ts).withWatermark(ts, late).groupBy(own.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Rows per session of each key: a gap of that length ends it."""
    grouped = event_time(stream, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def once_per_key(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return event_time(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, int, int, str]]:
    """(version, run, batch, bucket, folder) of all that is stored whole; a folder for each bucket and version, of which two at most stay."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = lambda pattern: [str(f.getPath()) for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")) or []]
    whole = {p.removesuffix("/_SUCCESS").rpartition("version=")[2] for p in listed("version=*/_SUCCESS")}
    found = []
    for folder in listed("version=*/run=*/batch=*/bucket=*"):
        version, run, batch, bucket = (x.partition("=")[2] for x in folder.split("/")[-4:])
        if version in whole:
            found.append((int(version), run, int(batch), int(bucket), folder))
    return found


def _last(versions: list[tuple[int, str, int, int, str]]) -> dict[int, tuple[int, str]]:
    """Bucket: its last version and folder."""
    return {bucket: (version, folder) for version, _, _, bucket, folder in sorted(versions)}


def _rows_of(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*folders).drop("version", "run", "batch", "bucket")


def upserted(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The table that ``upsert_into`` keeps: of every bucket of keys (or of those named) the rows of its last version."""
    last = _last(_versions(spark, path))
    return _rows_of(spark, path, [folder for bucket, (_, folder) in last.items() if buckets is None or bucket in buckets])


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def upsert_into(path: str, keys: list[str], arrival: str, buckets: int = 64, run: str | None = None, bucket_by: list[str] | None = None):
    """A foreachBatch step that merges each micro-batch into a Parquet table of ``buckets`` hash ranges of its keys, or of ``bucket_by``, some of these.

    Only buckets that the batch has keys of are written again, as a version one higher than any there is. ``run`` (by default the id that
    the query has from its checkpoint, else one of this step) and the number of the batch are stored with it: the last batch tried again replaces its own version, and a
    query that begins anew, with numbers from 0, adds to what is there. Versions that two later ones of their bucket have taken the place of are removed.
    """
    from uuid import uuid4

    own = run or uuid4().hex

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = run or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or own
        bucket = bucket_of(bucket_by or keys, buckets)
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # numbers below ``buckets``
        if not touched:
            return
        versions = _versions(spark, path) if exists(spark, path) else []
        highest = max((v for v, *_ in versions), default=0)
        again = {(r, b) for v, r, b, *_ in versions if v == highest} == {(name, number)}
        version = highest if again else highest + 1
        before = _last([v for v in versions if v[0] < version])
        folders = [before[b][1] for b in touched if b in before]
        old = _rows_of(spark, path, folders) if folders else batch.limit(0)
        merged = upsert.merge(old, batch, keys, arrival).withColumns({"run": F.lit(name), "batch": F.lit(number), "bucket": bucket})
        merged.repartition("bucket").write.mode("overwrite").partitionBy("run", "batch", "bucket").parquet(f"{path}/version={version}")
        for v, _, _, b, folder in versions:
            if b in touched and b in before and v < before[b][0]:
                remove(spark, folder)

    return step


STAGE_ROWS = "content_id long, stage string, status string, at timestamp"
STAGE_STATE = "published long, done string"
HOUR = 3_600_000_000


def _micros(column: pd.Series) -> np.ndarray:
    """As an array: a key has few rows, and each operation on a Series takes many times as long as these."""
    return column.to_numpy("datetime64[us]").astype(np.int64)


def stage_tracker(stream: DataFrame, late: str = "6 hours", tolerance_hours: float = 3.0, grace_hours: float = 6.0) -> DataFrame:
    """``content_id``, ``stage``, ``status``, ``at`` from rows (``content_id``, ``published_at``, ``captured_at``).

    State per content is its publication time in microseconds and the stages that are settled. A snapshot within the tolerance measures a stage, one
    in the grace measures it late; of several in one micro-batch the earliest counts. A timer closes stages whose grace is over without data.
    The state stays until the last grace is over by the watermark; rows of an older content measure nothing and open no state, so a stage is
    given out once. ``streaming/measuring.py`` has the queue with attempts and reasons.
    """
    offsets = {s: round(h * HOUR) for s, h in times.STAGE_HOURS.items()}
    tolerance, grace = round(tolerance_hours * HOUR), round((tolerance_hours + grace_hours) * HOUR)
    horizon = max(offsets.values()) + grace

    def track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        published, done = state.get if state.exists else (None, "")
        settled = set(filter(None, done.split(",")))
        first: dict[str, int] = {}
        for pdf in frames:
            captured = _micros(pdf["captured_at"])
            if published is None:
                born = int(_micros(pdf["published_at"]).min())
                if born + horizon <= max(state.getCurrentWatermarkMs() * 1000, int(captured.min()) - 1):
                    continue  # its stages were settled long ago
                published = born
            for stage in offsets.keys() - settled:
                gap = captured - published - offsets[stage]
                near = captured[(gap >= -tolerance) & (gap <= grace)]
                if len(near):
                    first[stage] = min(int(near.min()), first.get(stage, int(near.min())))
        if published is None:
            yield pd.DataFrame([], columns=["content_id", "stage", "status", "at"])
            return
        out = [(s, "measured" if at - published - offsets[s] <= tolerance else "measured_late", at) for s, at in first.items()]
        now = state.getCurrentWatermarkMs() * 1000
        ends = {s: published + x + grace for s, x in offsets.items() if s not in settled and s not in first}
        out += [(s, "closed_no_data", end) for s, end in ends.items() if end <= now]
        left = [end for end in (*ends.values(), published + horizon) if end > now]
        if left:
            state.update((published, ",".join(sorted({*settled, *(s for s, _, _ in out)}))))
            state.setTimeoutTimestamp(min(left) // 1000 + 1)
        elif state.exists:
            state.remove()
        rows = [(key[0], s, status, pd.Timestamp(at, unit="us")) for s, status, at in sorted(out, key=lambda row: offsets[row[0]])]
        yield pd.DataFrame(rows, columns=["content_id", "stage", "status", "at"])

    rows = event_time(event_time(stream, "captured_at"), "published_at").withWatermark("captured_at", late)
    return rows.groupBy("content_id").applyInPandasWithState(track, STAGE_ROWS, STAGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
