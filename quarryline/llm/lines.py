"""Line deduplication: two Bloom filters find suspects, only these are shuffled for exact counts.

Hashes of long lines, once per slice of whole documents, go to ranges of the hash space. Each range has a filter of lines seen once and, where
they were seen before, a filter of lines seen twice, ``BITS_PER_LINE`` bits for every hash that it was sent; ranges grow in number with the corpus. So
the share of false suspects is the same at every size, and no filter is sent to all tasks: a range looks up the hashes that it was sent in its second filter and
answers each slice with one bit per hash. Slices then emit (document, 128-bit line hash) for suspects; their documents are counted exactly.

A null text is one empty line; a row without id counts as one document below all others; rows with the same id are one document.
Lines that tie in every way are the same line. An empty table stays empty. Columns ``n_lines`` and ``n_dropped`` of the
input are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.batches import slices
from quarryline.llm.exchange import KEY_BITS, Row, answer, ask, bounds, deltas, gather, make_slices, pack, part_count, unpack
from quarryline.session import shared_dir, write_through

MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_LINE = 16.0
PROBES = 3
SLICE_BYTES = 4 << 20
SLICES_PER_PART = 16
BLANKS = b" \t\n\x0b\x0c\r"
ASKED, SUSPECT = range(2)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line without blanks at its ends and with A-Z lower-cased, or None where that is too short."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _long_keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k is not None}


class Bloom:
    """A filter of 64-bit hashes with ``PROBES`` bits each."""

    def __init__(self, bits: int) -> None:
        self.bits = max(64, bits)
        self.data = np.zeros(self.bits // 8 + 1, np.uint8)

    def probes(self, hashes: np.ndarray) -> np.ndarray:
        """Bit numbers of each hash, one column per probe; ranges share their upper bits, so these are mixed first."""
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
        return np.stack([(low + np.uint64(i) * high) % np.uint64(self.bits) for i in range(PROBES)], axis=1).astype(np.int64)

    def has(self, probes: np.ndarray) -> np.ndarray:
        return (self.data[probes >> 3] >> (probes & 7).astype(np.uint8) & 1).all(axis=1)

    def add(self, probes: np.ndarray) -> None:
        flat = probes.ravel()
        np.bitwise_or.at(self.data, flat >> 3, np.left_shift(np.uint8(1), (flat & 7).astype(np.uint8)))


def seen_twice(shares: list[tuple[np.ndarray, np.ndarray]], bits_per_line: float = BITS_PER_LINE) -> list[np.ndarray]:
    """For each share (distinct hashes, whether two documents of it have them) which hashes the filter of lines seen twice contains."""
    bits = int(bits_per_line * sum(len(hashes) for hashes, _ in shares))
    once, twice = Bloom(bits), Bloom(bits)
    for hashes, many in shares:
        probes = once.probes(hashes)
        twice.add(probes[many | once.has(probes)])
        once.add(probes)
    return [twice.has(twice.probes(hashes)) for hashes, _ in shares]


class Lines:
    """The long lines of a slice: per document and distinct line the row and key; the distinct hashes ascending and which each line has."""

    def __init__(self, batch: pa.RecordBatch, min_chars: int) -> None:
        self.keys: list[bytes] = []
        rows: list[int] = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = _long_keys(text, min_chars)
            self.keys += own
            rows += [i] * len(own)
        self.rows = np.array(rows, np.int64)
        self.hashes, self.which = np.unique(np.array([xxhash.xxh3_64_intdigest(k) for k in self.keys], np.uint64), return_inverse=True)


def suspects(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, bits_per_line: float = BITS_PER_LINE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(document, 128-bit line hash) of the lines that may be in two documents or more."""
    root = shared_dir(spark)
    whole = make_slices(docs, f"{root}/slices", slice_bytes)
    parts = part_count(spark, whole, SLICES_PER_PART)

    def questions(number: int, batch: pa.RecordBatch) -> Iterator[Row]:
        own = Lines(batch, min_chars)
        many = np.bincount(own.which, minlength=len(own.hashes)) > 1
        edge = bounds(own.hashes >> np.uint64(64 - KEY_BITS), parts)
        for part in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[part], edge[part + 1])
            yield part, number, ASKED, pack(deltas(own.hashes[s]), many[s].astype(np.uint8))

    def judge(part: int, rows: list[Row]) -> Iterator[Row]:
        shares = [(np.cumsum(h), m.astype(bool)) for h, m in (unpack(row[3]) for row in rows)]
        for row, found in zip(rows, seen_twice(shares, bits_per_line), strict=True):
            yield part, row[1], SUSPECT, pack(found.astype(np.uint8))

    def emit(number: int, batch: pa.RecordBatch, answers: list[Row]) -> Iterator[pa.RecordBatch]:
        own = Lines(batch, min_chars)
        flags = np.concatenate([np.empty(0, np.uint8), *(unpack(row[3])[0] for row in answers)])
        found = np.flatnonzero(flags[own.which])
        pairs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(own.keys[i]) for i in found.tolist()]), "<i8").reshape(-1, 2)
        ids = batch.column("doc_id").take(pa.array(own.rows[found]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["doc_id", "k1", "k2"])

    marked = gather(whole, answer(ask(whole, questions), parts, judge), emit, "doc_id long, k1 long, k2 long")
    return marked.withColumn("doc_id", _order_id("doc_id"))


def _order_id(name: str):
    """Rows without id count as one document below all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63)))


def dedup_lines(
    spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits_per_line: float = BITS_PER_LINE, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The rows of ``docs`` with repeated lines gone from ``text``, and ``n_lines`` (before), ``n_dropped``."""
    found = write_through(suspects(spark, docs, min_chars, bits_per_line, slice_bytes), shared_dir(spark)).distinct()
    frequent = found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    # A line in very many documents is a hot key on the left only; adaptive execution splits that side.
    drops = found.join(frequent, ["k1", "k2"]).filter("doc_id <> last").groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    texts = docs.select(F.struct(*rest).alias("row"), text, _order_id("doc_id").alias("doc"))
    joined = texts.join(drops, "doc", "left").select("row", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, lines, dropped = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                gone = 0
                n = text.count(b"\n") + 1
                if drop:
                    bad = {(d["k1"], d["k2"]) for d in drop}
                    kept = [x for x in text.split(b"\n") if (k := line_key(x, min_chars)) is None or _pair(k) not in bad]
                    gone, text = n - len(kept), b"\n".join(kept)
                out.append(text)
                lines.append(n)
                dropped.append(gone)
            columns = [batch.column("row"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_dropped"])

    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    own = {c: F.col(c) if c in ("text", "n_lines", "n_dropped") else F.col("row").getField(c).alias(c) for c in [*docs.columns, "n_lines", "n_dropped"]}
    return joined.mapInArrow(run, schema).select(*own.values())


def _pair(key: bytes) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(key)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
