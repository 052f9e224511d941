"""Connected components of an edge list, without the driver: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import remove, shared_dir, write_through


CHUNK_EDGES = 1_000_000


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Fewer edges with the same components and nodes, as stars: chains inside a chunk of a partition's edges are followed where they lie.

    A small graph comes as one chunk and is done; of a large one each chunk, of bounded size, leaves at most one edge a node, and paths get shorter.
    """
    kind = edges.schema[src].dataType.simpleString()

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = flat[: len(a)], flat[len(a) :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[u], label[v])
            before = label.copy()
            for ends in (label[u], label[v], u, v):
                np.minimum.at(label, ends, low)
            label = label[label]
            if np.array_equal(label, before):
                break
        moved = label != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_EDGES:
                yield stars(*_ends(held))
                held, n = [], 0
        if n:
            yield stars(*_ends(held))

    known = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return known.distinct().mapInArrow(run, f"src {kind}, dst {kind}")


def _ends(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in (0, 1))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component``: the smallest node that each node reaches; only nodes that have an edge to another node.

    Every round links each node to the smallest neighbour it knows and is written to the shared folder, so lineage stays one
    round long. The number of rounds grows with the logarithm of the longest chain; it ends when all edges form stars.
    """
    spark = edges.sparkSession
    root = shared_dir(spark)
    pairs = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    pairs = write_through(pairs, f"{root}/0")
    step = 0
    while not _all_stars(pairs):
        step += 1
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = write_through(moved.union(lowest).distinct(), f"{root}/{step}")
        remove(spark, f"{root}/{step - 1}")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _all_stars(pairs: DataFrame) -> bool:
    """Each upper node has one lower node, and no lower node is an upper one."""
    if not pairs.groupBy("u").count().filter("count > 1").limit(1).isEmpty():
        return False
    return pairs.select(F.col("v").alias("u")).distinct().join(pairs.select("u"), "u", "left_semi").limit(1).isEmpty()
