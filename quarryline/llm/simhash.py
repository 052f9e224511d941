"""SimHash near-duplicates with covering locality-sensitive hashing.

Structured masks (``operators.linking``) make 2^(r+1) - 1 tables of the fingerprints; each pair within the radius r meets in a table, without exception. Equal
fingerprints are one node, large buckets are dealt to finer masks over the bits that their table left open, and inside a bucket nodes are linked breadth first, with one
edge per node and component. Components come from star contraction over those edges.

Null and blank texts have fingerprint zero and are linked like any other. A row without id links others but names none: its component is the
smallest id that its fingerprint reaches, or null. Rows with the same id stay rows and may be in different components. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.batches import slices, text_rows
from quarryline.operators.components import connected_components
from quarryline.operators.linking import links
from quarryline.session import shared_dir, write_through

WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The bits that are set in over half of the hashes of the text's word shingles, repeats included."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) + 1 <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = [0, *(gaps[: len(gaps) - words + 1] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.array([digest(view[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fp``, the fingerprint's bits as a signed long, and ``md5`` of the text, which tells rows with the same id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64)), batch.column("md5")], names=["doc_id", "fp", "md5"])

    return text_rows(docs, _text_md5()).mapInArrow(run, "doc_id long, fp long, md5 string")


def _text_md5():
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("md5")


def _groups(spark: SparkSession, docs: DataFrame, words: int, radius: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fingerprints``, and per distinct ``fp`` its smallest id ``rep`` and ``group``, the smallest fingerprint that it reaches."""
    rows = write_through(fingerprints(docs, words, seed), shared_dir(spark))
    nodes = write_through(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), shared_dir(spark))
    labels = connected_components(links(nodes, radius))
    return rows, nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest id among all documents reachable over links."""
    rows, nodes = _groups(spark, docs, words, radius, seed)
    smallest = nodes.groupBy("group").agg(F.min("rep").alias("component_id"))
    return rows.join(nodes.join(smallest, "group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of equal ids that of the smallest MD5 of the text, then of the other columns as JSON.

    Rows with the same id whose texts are in different groups all stay. Rows without id cannot be named and stay. No column names are reserved.
    """
    rows, nodes = _groups(spark, docs, words, radius, seed)
    copies = rows.filter("doc_id is not null").groupBy("doc_id", "md5", "fp").agg(F.count("*").alias("n"))
    best = copies.join(nodes, "fp").groupBy("group").agg(F.min(F.struct("doc_id", "md5", "n")).alias("best"))
    chosen = best.select(F.col("best.doc_id").alias("id"), F.col("best.md5").alias("md5"), F.col("best.n").alias("n"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), _text_md5(), F.struct(*docs.columns).alias("row"))
    kept = write_through(own.join(chosen, ["id", "md5"]), shared_dir(spark))
    repeated = kept.filter("n > 1").groupBy("id", "md5").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.filter("n = 1").select("row.*").union(repeated.select("row.*")).union(docs.filter(F.col("doc_id").cast("long").isNull()))


def hex_fingerprint(column: str = "fp"):
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
