"""The measurement queue over a stream: a map of posts per part of them, and timers at the sweeps that settle stages.

A stage is settled by the first sweep that sees a snapshot which fits, or by the one that closes it; it is given out once the watermark has passed that sweep, as
all that the sweep can see has come by then. So results do not depend on how rows are dealt to micro-batches, and equal those of
``operators/measuring.py`` for rows that are not late. Settled stages stay in the state until nothing that is still on time
can touch the post; a later row of it finds no state, is older than the post's last sweep, and is left out. So no stage is given out twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarryline.functions import times
from quarryline.operators.measuring import EVERY_HOURS, HOUR, LINK_HOURS, MAX_ATTEMPTS, STALE_HOURS, WINDOW_HOURS

ROWS = "content_id long, stage string, attempt int, status string, close_reason string, linked_by string, done_us long"
COLUMNS = ["content_id", "stage", "attempt", "status", "close_reason", "linked_by", "done_us"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of each stage, in their order, the best snapshot so far: the attempt that sees it (0: none), link by time, distance, capture time; and whether the stage is settled.
POST_STATE = "published long, seen long, stages array<struct<attempt: int, by_time: boolean, gap: long, captured: long, settled: boolean>>"
#: Keys that posts are dealt to, as a call for a key costs more than a post does; posts of a key that are held at once, and rows given out at once.
PARTS, HELD, OUT_ROWS = 1024, 20_000, 10_000
UNSEEN = (0, False, 0, 0, False)


class MeasurementQueue(StatefulProcessor):
    """A key is a part of the posts. Sweeps are on a grid that all posts share, so a part has one timer, at its next sweep that can settle something."""

    def __init__(self, every_hours: int = EVERY_HOURS, stale_hours: int = STALE_HOURS) -> None:
        self.every, self.stale = every_hours * HOUR, stale_hours * HOUR
        self.offsets = {s: h * HOUR for s, h in times.STAGE_HOURS.items()}
        self.windows = {s: h * HOUR for s, h in WINDOW_HOURS.items()}
        #: Age after which no row can matter: every sweep that could settle a stage is over.
        self.horizon = max(self.offsets.values()) + self.stale + self.every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.posts = handle.getMapState("posts", "content_id long", POST_STATE)
        self.timer = handle.getValueState("timer", "ms long")

    def _first(self, due: int) -> int:
        return -(-due // self.every) * self.every

    def _closing(self, due: int) -> int:
        return min(MAX_ATTEMPTS, max(1, -(-(due + self.stale - self._first(due)) // self.every) + 1))

    def _decision(self, due: int, attempt: int) -> int:
        """The attempt that settles a stage."""
        closing = self._closing(due)
        return min(attempt, closing) if attempt else closing

    def _fit(self, stage: str, due: int, captured: int, bucket: str | None) -> tuple | None:
        gap = abs(captured - due)
        by_bucket = bucket == stage and gap <= self.windows[stage]
        if not by_bucket and not (bucket is None and gap <= LINK_HOURS * HOUR):
            return None
        return (max(1, -(-(captured - self._first(due)) // self.every) + 1), not by_bucket, gap, captured)

    def _settle(self, content: int, post: tuple, watermark_us: int) -> tuple[list[tuple], tuple | None, int]:
        """Rows of the stages that the watermark has passed; the post after that (none: it is over); the sweep to look at it again."""
        published, seen, stages = post
        out, waiting, after = [], [], []
        for (stage, offset), (attempt, by_time, gap, captured, settled) in zip(self.offsets.items(), stages, strict=True):
            due = published + offset
            n = self._decision(due, attempt)
            at = self._first(due) + (n - 1) * self.every
            if not settled and at >= watermark_us:
                waiting.append(at)
            elif not settled:
                if attempt and attempt <= self._closing(due):
                    status = "measured" if gap <= LINK_HOURS * HOUR else "measured_late"
                    out.append((content, stage, n, status, None, "time" if by_time else "bucket", captured))
                else:
                    reason = "no_snapshot_ever" if seen is None or seen > at else "grace_expired" if at - due >= self.stale else "attempts_exhausted"
                    out.append((content, stage, n, "closed_no_data", reason, None, at))
                settled = True
            after.append((attempt, by_time, gap, captured, settled))
        end = self._first(published + self.horizon)
        return out, (published, seen, after) if waiting or end >= watermark_us else None, min(waiting, default=end)

    def _wake(self, at: int) -> None:
        """The part's timer is at this sweep, or at an earlier one."""
        ms, known = at // 1000 + 1, self.timer.get()
        if known is None or ms < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _put(self, posts: dict[int, tuple], watermark_us: int) -> Iterator[pd.DataFrame]:
        out, again = [], []
        for content, post in posts.items():
            rows, after, at = self._settle(content, post, watermark_us)
            out += rows
            if after is None:
                self.posts.removeKey((content,))
            else:
                self.posts.updateValue((content,), after)
                again.append(at)
        if again:
            self._wake(min(again))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        stored = self.posts.exists()
        held: dict[int, tuple] = {}
        for pdf in rows:
            for content, born, captured, bucket, plan in zip(*(pdf[c].tolist() for c in ("content_id", "published_us", "captured_us", "bucket", "is_plan")), strict=True):
                post = held.get(content) or (self.posts.getValue((content,)) if stored else None)
                if post is None:
                    if captured - born > self.horizon or born + self.horizon < watermark:
                        continue  # its stages were settled long ago
                    post = (born, None, [UNSEEN] * len(self.offsets))
                published, seen, stages = post
                if not plan:
                    seen, stages = captured if seen is None else min(seen, captured), list(stages)
                    for k, (stage, offset) in enumerate(self.offsets.items()):
                        attempt, *rest, settled = stages[k]
                        fit = None if settled else self._fit(stage, published + offset, captured, bucket)
                        if fit and (not attempt or fit < (attempt, *rest)):
                            stages[k] = (*fit, False)
                held[content] = (published, seen, stages)
                if len(held) >= HELD:
                    yield from self._put(held, watermark)
                    held, stored = {}, True
        yield from self._put(held, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The sweep over all posts of the part."""
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        out, changed, over, again = [], [], [], []
        for (content,), post in self.posts.iterator():
            rows, after, at = self._settle(content, post, watermark)
            if after is None:
                over.append(content)
            else:
                again.append(at)
                if rows:
                    changed.append((content, after))
            out += rows
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        for content, after in changed:
            self.posts.updateValue((content,), after)
        self.timer.clear()
        if again:
            for content in over:
                self.posts.removeKey((content,))
            self._wake(min(again))
        else:
            self.posts.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def measure(stream: DataFrame, late: str = "6 hours", every_hours: int = EVERY_HOURS, stale_hours: int = STALE_HOURS, parts: int = PARTS) -> DataFrame:
    """Settled stages of the posts of a stream, once each; the columns of ``COLUMNS``.

    The stream has ``content_id``, ``published_at``, ``captured_at`` and ``bucket``; rows with ``is_plan`` put a post into the queue (``captured_at`` is then its time of publication) and
    measure nothing. Rows without ``content_id`` take no part. The state is kept by RocksDB (the session's ``spark.sql.streaming.stateStore.providerClass``); a post is in one of ``parts``
    keys, a number that a checkpoint is bound to.
    """
    micros = lambda c: F.unix_micros(c).alias(f"{c.removesuffix('_at')}_us")
    rows = stream.withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "captured_at")}).filter("content_id IS NOT NULL AND published_at IS NOT NULL AND captured_at IS NOT NULL")
    part = F.pmod(F.xxhash64("content_id"), F.lit(parts)).cast("int").alias("part")
    rows = rows.withWatermark("captured_at", late).select(part, F.col("content_id").cast("long").alias("content_id"), micros("published_at"), micros("captured_at"), "bucket", "is_plan", "captured_at")
    return rows.groupBy("part").transformWithStateInPandas(MeasurementQueue(every_hours, stale_hours), ROWS, "Append", "EventTime")
