"""Links between 64-bit hashes within a radius of differing bits, without pairs of all members of a bucket.

The i-th of the bits to be covered gets a code c(i) in {1, ..., 2^(r+1) - 1}, read as a vector of r + 1 bits. Table v, for each of
the 2^(r+1) - 1 non-zero vectors v, compares the bits whose code has an odd product with v. The codes of r differing bits span at most
r dimensions, so some v is orthogonal to all of them and its table ignores every differing bit: each pair within the radius
meets in a table, without exception.

A bucket of more than ``BUCKET`` hashes is not searched as it is: the bits that its table did not compare are covered in turn, so its hashes are dealt to
finer buckets in which each of their pairs within the radius meets again, and so on. Inside a bucket hashes are linked breadth first, one edge per hash and component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import shared_dir, write_through

BITS = 64
#: Hashes of a bucket that one task searches; more are dealt to finer buckets.
BUCKET = 1 << 13
#: Rows of all tables that one task deals out.
ROWS_IN_TASK = 1_000_000


@lru_cache
def balanced_codes(radius: int, n: int) -> tuple[int, ...]:
    """Codes of ``n`` bits. Powers of two come first, so that from ``radius`` + 1 bits on every table compares a bit at least; each further
    code is the one that helps the tables with the fewest bits most, so that all tables compare about half of the bits."""
    tables = (1 << radius + 1) - 1
    vectors = np.arange(1, tables + 1)
    odd = np.bitwise_count(vectors[:, None] & vectors[None, :]) % 2  # table, code
    codes = [1 << i for i in range(min(n, radius + 1))]
    held = odd[:, np.array(codes, np.int64) - 1].sum(axis=1, dtype=np.int64)
    while len(codes) < n:
        lack = 0.5 ** held.astype(float)
        best = int(np.argmax(lack @ odd))
        codes.append(best + 1)
        held += odd[:, best]
    return tuple(codes)


@lru_cache(1 << 12)
def covering_masks(radius: int, free: int = -1) -> list[int]:
    """One mask per table over the bits set in ``free``, as signed longs; see the module's text."""
    tables = (1 << radius + 1) - 1
    bits = [i for i in range(BITS) if free >> i & 1]
    codes = balanced_codes(radius, len(bits))
    masks = []
    for v in range(1, tables + 1):
        mask = sum(1 << bit for bit, code in zip(bits, codes, strict=True) if (v & code).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def link_bucket(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the components of one bucket: a root's index and the index of each other member."""
    roots, members = [], []
    left = np.arange(len(values))
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(values[left] ^ values[frontier.pop()]) <= radius
            hits, left = left[near], left[~near]
            frontier += hits.tolist()
            roots += [root] * len(hits)
            members.append(hits)
    return np.array(roots, np.int64), np.concatenate(members) if members else np.empty(0, np.int64)


def _dealt(rows: DataFrame, radius: int) -> DataFrame:
    """Hashes (``mask``, ``fp``) under every finer mask that covers the bits which ``mask`` does not compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer: dict[int, np.ndarray] = {}
        for batch in batches:
            masks, prints = (batch.column(c).to_numpy() for c in ("mask", "fp"))
            for mask in np.unique(masks).tolist():
                if mask not in finer:
                    finer[mask] = np.array([mask | m for m in covering_masks(radius, ~mask)], np.int64)
                own = prints[masks == mask]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(finer[mask], len(own))), pa.array(np.repeat(own, len(finer[mask])))], names=["mask", "fp"])

    return rows.mapInArrow(run, "mask long, fp long").withColumn("bucket", F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))))


def links(nodes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (``src``, ``dst``) between distinct hashes (``fp``) that join all pairs within the radius.

    Buckets are counted with partial sums before they meet; the loop ends as distinct hashes have no more than ``bucket`` values in so few open bits.
    """
    if bucket < 1 << radius + 1:
        raise ValueError("too small a bucket for the radius")
    spark, found = nodes.sparkSession, None
    tasks = nodes.count() * ((1 << radius + 1) - 1) // ROWS_IN_TASK + 1  # a hash becomes a row per table, so few bytes are much work
    rows = nodes.select(F.lit(0).cast("long").alias("mask"), "fp").repartition(tasks, "fp")
    while True:
        dealt = _dealt(rows, radius)
        large = dealt.groupBy("bucket").count().filter(F.col("count") > bucket).select("bucket")
        large = write_through(large, shared_dir(spark))
        some = not large.isEmpty()
        edges = _linked(dealt.join(large, "bucket", "left_anti") if some else dealt, radius)
        found = edges if found is None else found.union(edges)
        if not some:
            return found
        rows = write_through(dealt.join(large, "bucket", "left_semi").select("mask", "fp"), shared_dir(spark))


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges inside buckets, each of a bounded size."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 2

        def joined(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(columns[0])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(columns[0])]])
            src, dst = [], []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                roots, members = link_bucket(columns[1][a:b].view(np.uint64), radius)
                src.append(columns[1][a:b][roots])
                dst.append(columns[1][a:b][members])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                at = int(np.searchsorted(held[0], held[0][-1]))
                yield from joined([h[:at] for h in held])
                held = [h[at:].copy() for h in held]
        if len(held[0]):
            yield from joined(held)

    return buckets.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(edges, "src long, dst long")
