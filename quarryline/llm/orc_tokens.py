"""Token-ID files in ORC: one row per document, ids in integer run-length encoding.

Files are written in ascending order of document id, so that stripe and row-group statistics are narrow; Bloom filters on
the document id and the row index let a reader skip stripes and row groups, and every stripe is a split of its own.

Null texts are empty documents (only the end id). Rows whose id is null come first, repeated ids keep one row each, in the
order of their text. An empty table gives files without rows. Further columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.batches import flat_bytes, slices, text_rows
from quarryline.llm.sharding import ranges_for
from quarryline.llm.tokens import DEFAULT_VOCABULARY, PieceEncoder, vocabulary_path

END_ID = 2
#: Name of the table of starts; readers of the files pass over names that begin like this.
STARTS = "_starts"
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def in_order(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Texts range-partitioned by document id and sorted: partition i holds smaller ids than partition i + 1. All rows of one id are in one range."""
    rows = text_rows(docs)
    ranged = rows.repartitionByRange(ranges, "doc_id") if ranges else rows.repartitionByRange("doc_id")
    return ranged.sortWithinPartitions("doc_id", "text")


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document's, and the new offsets."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Ids of every document in ascending order; ``part_start`` counts the ids before it in its partition."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = PieceEncoder.of(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, offsets = with_end(*encoder.encode(batch.column("text")), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(offsets[:-1] + done), pa.array(np.diff(offsets)), lists],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            done += len(ids)

    return in_order(docs, ranges_for(docs)).mapInArrow(run, SCHEMA)


def write_orc(encoded: DataFrame, path: str, stripe_bytes: int = 16 << 20, index_stride: int = 1000, false_positives: float = 0.01) -> None:
    """Write encoded documents with row indexes and Bloom filters on ``doc_id``, and beside them where each partition's ids begin, a row per partition."""
    (
        encoded.write.mode("overwrite")
        .option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(false_positives))
        .orc(path)
    )
    sums = encoded.sparkSession.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    starts.coalesce(1).write.mode("overwrite").parquet(f"{path}/{STARTS}")


def read_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents with ``start``, the ids of all documents before them. ``doc_ids`` is pushed down to the stripes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    starts = spark.read.schema("part int, before long").parquet(f"{path}/{STARTS}")  # stored when the files were: a lookup reads no other file's numbers
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """Count and CRC-32 of each document's ids, as unsigned 32-bit little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column("raw"))
            view = memoryview(np.ascontiguousarray(data))
            crc = [zlib.crc32(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends) // 4), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy().astype(np.int64)
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4"))
            raw = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(values)])
            yield from run(iter([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), raw], names=["doc_id", "start", "raw"])]))

    return rows.select("doc_id", "start", "ids").mapInArrow(lists, "doc_id long, start long, n_tokens long, ids_crc32 long")
