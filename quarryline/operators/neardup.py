"""Near-duplicate texts by blocks of a 64-bit hash of word runs, and text clusters by shared rare words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarryline.functions import text as T
from quarryline.operators.components import connected_components
from quarryline.operators.linking import links
from quarryline.session import shared_dir, write_through

RADIUS = 6


def simhash(df: DataFrame, id_: str, text: str) -> DataFrame:
    """``id_`` and ``fp``: bit i is set where more of the text's word runs have it in the first half of their MD5 than not. Texts without words have none.

    Words come from the JVM; a text's runs are hashed and counted in its batch, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            ends, flat = lists.offsets.to_pylist(), lists.values.to_pylist()
            ids, prints = [], []
            for i, key in enumerate(batch.column(id_).to_pylist()):
                words = flat[ends[i] : ends[i + 1]]
                if words:
                    ids.append(key)
                    prints.append(_print(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(id_).type), pa.array(np.array(prints, np.uint64).view(np.int64))], names=[id_, "fp"])

    rows = df.select(id_, T.words(text).alias("w"))
    return rows.mapInArrow(run, StructType([rows.schema[id_], StructField("fp", LongType())]))


def _print(words: list[str], k: int = 3, block: int = 1 << 15) -> int:
    runs = [*({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or set(words))]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(runs), block):  # long texts in pieces, so that their bits take little room
        part = b"".join(md5(r.encode()).digest()[:8] for r in runs[at : at + block])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(runs)).view(">u8")[0])


def clusters(df: DataFrame, id_: str, text: str, radius: int = RADIUS) -> DataFrame:
    """``id_`` and ``cluster``, the smallest id of its chain of near texts; texts without words stand alone.

    Equal hashes are one node; nodes are linked in buckets of a bounded size, so the work does not grow with the square of a group.
    """
    spark = df.sparkSession
    prints = write_through(simhash(df, id_, text), shared_dir(spark))
    nodes = write_through(prints.groupBy("fp").agg(F.min(id_).alias("rep")), shared_dir(spark))
    labels = connected_components(links(nodes, radius)).withColumnRenamed("node", "fp")
    grouped = nodes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("rep").alias("cluster"))
    found = prints.join(grouped.join(smallest, "group").select("fp", "cluster"), "fp").select(id_, "cluster")
    return df.select(id_).join(found, id_, "left").select(id_, F.coalesce("cluster", id_).alias("cluster"))
