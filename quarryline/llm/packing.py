"""Packing of token streams into sequences by order-preserving dynamic programming.

Documents keep their order of id. Within a partition the stream may be cut at document ends (free), sentence ends
(a small penalty) or, where a sentence is long, between any two tokens of a fixed grid (a larger one). The program
chooses the cuts that minimise padding plus penalties: best(j) = min over i of best(i) + padding(p_j - p_i) + penalty(j) with
p_j - p_i at most the sequence length. Padding falls linearly in p_i, so a monotone queue over the sliding window of starts
gives each minimum in constant time; lengths that are a power of two need no padding and are tried one by one.

Null and empty texts are one end id. Repeated ids stay documents of their own. An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.batches import slices
from quarryline.llm.orc_tokens import in_order, with_end
from quarryline.llm.tokens import DEFAULT_VOCABULARY, PieceEncoder, vocabulary_path
from quarryline.session import shared_dir, write_through

END_ID = 1
LENGTH = 2048
#: Padding tokens that one cut is worth, by place: document end, sentence end, inside a sentence.
PENALTIES = (0.0, 2.0, 12.0)
GRID = 64
#: Tokens that the program plans at once; the tail of a plan is planned again with what follows.
PLAN_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, part_sequence long, offset long"
PIECES = [f.split()[0] for f in SCHEMA.split(", ")]


def plan_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into ``places`` (ascending, first 0, no gap over ``length``) of the cuts that cost least.

    The first and the last place are always cut.
    """
    p, pen = places.tolist(), penalties.tolist()
    n = len(p)
    exact, edge = _exact_starts(places, length)
    best = [0.0] * n
    came = [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # best(i) + p_i, ascending; i ascending
    for j in range(1, n):
        pj = p[j]
        low = pj - length
        while p[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        cost = value + length - pj
        for k in exact[edge[j] : edge[j + 1]]:
            if best[k] < cost:
                cost, i = best[k], k
        cost += pen[j]
        best[j], came[j] = cost, i
        value = cost + pj
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def _exact_starts(places: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """For every place the earlier ones at a distance that is a power of two under ``length``, nearest first, and where each place's begin."""
    ends, starts = [], []
    index = np.full(int(places[-1]) + 1, -1, np.int32)  # of a place, by its position
    index[places] = np.arange(len(places), dtype=np.int32)
    for power in (1 << k for k in range(length.bit_length()) if 1 << k < length):
        far = int(np.searchsorted(places, power))
        at = index[places[far:] - power]
        hit = np.flatnonzero(at >= 0)
        ends.append(hit + far)
        starts.append(at[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    return starts[order].tolist(), np.searchsorted(ends[order], np.arange(len(places) + 1)).tolist()


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut is allowed, with penalties: document ends, sentence ends, and a grid where both are far apart."""
    kind = np.zeros(len(ids) + 1, np.uint8)  # 0: no place; else the index of its penalty, from the last
    np.take(sentence_end, ids, out=kind[1:].view(bool))
    kind[1:] *= 2
    kind[doc_ends] = 3
    natural = np.flatnonzero(kind)
    natural = natural if kind[0] else np.concatenate([[0], natural])
    gaps = np.diff(natural)
    long = np.flatnonzero(gaps > grid)
    counts = (gaps[long] - 1) // grid
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    kind[np.repeat(natural[long], counts) + step * grid] = 1
    kind[0] = 3
    places = np.flatnonzero(kind)
    penalties = np.array([0.0, *PENALTIES[::-1]])[kind[places]]
    penalties[0] = 0.0
    return places, penalties


@lru_cache(maxsize=1)
def _sentence_ends(encoder: PieceEncoder) -> np.ndarray:
    """Whether an id ends a sentence; made once a worker, as reading the vocabulary takes as long as packing some hundred thousand ids."""
    size = encoder.tokenizer.get_vocab_size()
    newline = encoder.byte_chars[10]
    flags = np.zeros(size + 1, bool)
    for token, i in encoder.tokenizer.get_vocab().items():
        flags[i] = token[-1:] in (".", "!", "?", newline)
    return flags


class _Stream:
    """The pending tokens of a partition, and the pieces cut from them."""

    def __init__(self, sentence_end: np.ndarray, length: int) -> None:
        self.flags, self.length, self.sequence = sentence_end, length, 0
        self.ids = np.empty(0, np.uint32)
        #: Per pending document: id, ids of it before this stream's first, its ids in all, and its end in the stream.
        self.docs: list[tuple[int | None, int, int, int]] = []

    def add(self, ids: np.ndarray, offsets: np.ndarray, doc_ids: list) -> None:
        held = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        for doc, a, b in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            self.docs.append((doc, 0, b - a, held + b))

    def cut(self, last: bool) -> pa.RecordBatch | None:
        if not len(self.ids):
            return None
        ends = np.array([d[3] for d in self.docs], np.int64)
        places, penalties = candidates(self.ids, ends, self.flags)
        chosen = places[plan_cuts(places, penalties, self.length)]
        if not last:  # the last sequences depend on what follows
            chosen = chosen[: np.searchsorted(chosen, chosen[-1] - 8 * self.length, "right")]
            if len(chosen) < 2:
                return None
        upto = int(chosen[-1])
        edges = np.union1d(chosen, ends[ends < upto])
        starts, stops = edges[:-1], edges[1:]
        seq = np.searchsorted(chosen, starts, "right") - 1
        doc = np.searchsorted(ends, starts, "right")
        total = np.array([d[2] for d in self.docs], np.int64)
        before = np.array([d[1] for d in self.docs], np.int64)
        doc_start = np.concatenate([[0], ends[:-1]])
        view = memoryview(np.ascontiguousarray(self.ids.astype("<u4"))).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
                pa.array(before[doc] + starts - doc_start[doc]),
                pa.array(stops - starts),
                pa.array(crc, pa.int64()),
                pa.array(total[doc]),
                pa.array(np.full(len(seq), TaskContext.get().partitionId(), np.int32)),
                pa.array(self.sequence + seq),
                pa.array(starts - chosen[seq]),
            ],
            names=PIECES,
        )
        self.sequence += len(chosen) - 1
        kept = []
        for i, (name, had, size, end) in enumerate(self.docs):
            if end > upto:
                begun = max(0, upto - int(doc_start[i]))
                kept.append((name, had + begun, size, end - upto))
        self.docs, self.ids = kept, self.ids[upto:].copy()
        return out


def pack(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = END_ID, length: int = LENGTH, plan_tokens: int = PLAN_TOKENS) -> DataFrame:
    """Pieces of documents with their sequence inside the partition (``part``, ``part_sequence``)."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        stream = _Stream(_sentence_ends(encoder), length)
        for batch in slices(batches, limit=4 << 20):
            stream.add(*with_end(*encoder.encode(batch.column("text")), end_id), batch.column("doc_id").to_pylist())
            if len(stream.ids) >= plan_tokens and (out := stream.cut(last=False)) is not None:
                yield out
        if (out := stream.cut(last=True)) is not None:
            yield out

    return in_order(docs).mapInArrow(run, SCHEMA)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id`` over all partitions; the sums behind it are one row per partition."""
    sums = pieces.groupBy("part").agg((F.max("part_sequence") + 1).alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    return pieces.join(F.broadcast(starts), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("part_sequence")).alias("sequence_id"), "offset"
    )


def pack_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Pack and number; the pieces are written to the shared folder once, as both the sums and the result read them."""
    return number_sequences(write_through(pack(docs, **options), shared_dir(spark)))
