"""Questions from slices of the corpus to parts of a key space, and the answers back.

A slice is one row with some MB of whole documents. A task counts the keys of a slice and sends every part of the key space its share as one
compressed row; the task of a part adds up the shares of all slices and answers each in the order of its keys. So the shuffle moves
bytes per distinct key of a slice instead of a row per key, a frequent key is one entry per slice, and no task holds more than
one slice and the answers to it, or one part.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.batches import slices, text_rows
from quarryline.session import write_through

#: ``part`` is the part that a row is sent to, or the part that has sent it.
SCHEMA = "part int, slice long, kind int, data binary"
NAMES = ["part", "slice", "kind", "data"]
#: Keys are hashes of so many bits; parts are ranges of them.
KEY_BITS = 48
#: Slices that a task gathers answers for.
SLICES_PER_TASK = 4

Row = tuple[int, int, int, bytes]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: the bytes of equal weight stand together, so that small numbers take little room."""
    heads, bodies = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        heads.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        bodies.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.compress(b"".join(heads + bodies), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    shapes = [struct.unpack_from("<2sQ", raw, 1 + 10 * i) for i in range(raw[0])]
    at, out = 1 + 10 * len(shapes), []
    for kind, n in shapes:
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned keys; ``np.cumsum`` undoes it."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range begins in ascending keys; ``parts`` + 1 numbers."""
    edges = np.array([(i << KEY_BITS) // parts for i in range(parts + 1)], np.uint64)
    return np.searchsorted(keys, edges)


def make_slices(docs: DataFrame, path: str, slice_bytes: int) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` as bytes) as rows of about ``slice_bytes``, written to ``path`` and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        count = 0
        for batch in _regrouped(slices(batches, limit=slice_bytes), slice_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            data = zstandard.compress(sink.getvalue(), 3)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([first + count]), pa.array([-1], pa.int32()), pa.array([data], pa.binary())], names=NAMES)
            count += 1

    return write_through(text_rows(docs).mapInArrow(run, SCHEMA), path)


def _regrouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches together, up to ``limit`` bytes of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def open_slice(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.decompress(data)) as stream:
        return stream.read_next_batch()


def part_count(spark: SparkSession, slices_: DataFrame, slices_per_part: int) -> int:
    """Parts grow with the slices, so that what one holds does not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices_.count() // slices_per_part, 1)


def batch_of(rows: list[Row]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """Rows with the same ``key``, one group at a time; the input is sorted by it."""
    held: list[Row] = []
    at = NAMES.index(key)
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in NAMES), strict=True):
            if held and held[0][at] != row[at]:
                yield held[0][at], held
                held = []
            held.append(row)
    if held:
        yield held[0][at], held


def ask(slices_: DataFrame, questions: Callable[[int, pa.RecordBatch], Iterator[Row]]) -> DataFrame:
    """Rows that ``questions`` (slice, its documents) makes of every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "slice"):
            if out := [*questions(number, open_slice(rows[0][3]))]:
                yield batch_of(out)

    return slices_.mapInArrow(run, SCHEMA)


def answer(rows: DataFrame, parts: int, answers: Callable[[int, list[Row]], Iterator[Row]]) -> DataFrame:
    """What ``answers`` (part, its rows by slice and kind) makes of the rows sent to every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _groups(batches, "part"):
            if out := [*answers(part, group)]:
                yield batch_of(out)

    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "slice", "kind").mapInArrow(run, SCHEMA)


def gather(
    slices_: DataFrame, answered: DataFrame, finish: Callable[[int, pa.RecordBatch, list[Row]], Iterator[pa.RecordBatch]], schema: str, per_task: int = SLICES_PER_TASK
) -> DataFrame:
    """What ``finish`` (slice, its documents, the answers by kind and part) makes of every slice; tasks grow in number with the slices, which are dealt to them in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _groups(batches, "slice"):
            yield from finish(number, open_slice(group[0][3]), group[1:])

    n, last = slices_.agg(F.count("*"), F.max("slice")).first()
    tasks = max(1, n // per_task)
    # Slices are numbered by the partition that made them, then in it; counted across the partitions, they are nearly without gaps.
    turn = F.col("slice").bitwiseAND((1 << 32) - 1) * (((last or 0) >> 32) + 1) + F.shiftright("slice", 32)
    both = slices_.union(answered).repartitionById(tasks, F.pmod(turn, F.lit(tasks)).cast("int")).sortWithinPartitions("slice", "kind", "part")
    return both.mapInArrow(run, schema)
