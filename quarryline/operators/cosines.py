"""TF-IDF cosines of posts that share a rare entity, are near in time and of different platforms.

Posts are encoded in slices: each value of a slice is one row with its counts, and the posts are numbers of these values, as compressed arrays. A slice learns what its values
count in all posts, and sends its posts to blocks of neighbouring times. Two blocks meet in one place, where all of their pairs are found and scored. So neither a word
of a post nor a pair is a row that shuffles, and memory follows the size of a slice or of two blocks.
"""

from __future__ import annotations

import ctypes
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import shared_dir, write_through

#: Words and entities that a slice holds, distinct ones that a block of times holds on average, and pairs that are scored at once.
SLICE_VALUES, BLOCK_VALUES, PAIRS_AT_ONCE = 3 << 20, 2 << 20, 2 << 20
#: Kinds of encoded rows: a post, a value of a slice, a slice.
POST, VALUE, SLICE = 0, 1, 2
#: Bits of a value's number in its slice, and of a slice's number in its partition.
CODE_BITS, COUNT_BITS = 26, 16


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: the bytes of equal weight stand together, so that small numbers take little room."""
    arrays = tuple(np.ascontiguousarray(a) for a in arrays)
    heads = [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays]
    bodies = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    raw = b"".join([struct.pack("<B", len(arrays)), *heads, *bodies])
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], struct.unpack_from("<Q", data)[0], asbytes=True)
    heads = [struct.unpack_from("<2sQ", raw, 1 + 10 * i) for i in range(raw[0])]
    at, out = 1 + 10 * len(heads), []
    for kind, n in heads:
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def _counted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands there; sorts in place, as numpy's own way by hashes takes many times as long."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


def _counted(lists: pa.Array, codes: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_counted_keys` of row times ``size`` plus code, for the values of ``lists`` that are not null."""
    keys = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keys *= size
    keys += codes.fill_null(0).to_numpy(zero_copy_only=False)
    return _counted_keys(keys[codes.is_valid().to_numpy(zero_copy_only=False)] if codes.null_count else keys)


def _split(codes: pa.Array, lists: list[pa.Array]) -> list[pa.Array]:
    n = len(codes) - len(lists[1].flatten())
    return [codes[:n], codes[n:]]


def _release() -> None:
    """Give unused memory back to the system: the next stage shares this worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _texts(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names as numbers: their bytes, and how many each has."""
    raw = [name.encode() for name in names]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def _names(raw: np.ndarray, sizes: np.ndarray) -> list[str]:
    ends = np.cumsum(sizes)
    return [raw[e - n : e].tobytes().decode() for e, n in zip(ends, sizes, strict=True)]


def _steps(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys; ``np.cumsum`` undoes it."""
    return np.diff(keys, prepend=0).astype(np.uint64)


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows with about ``limit`` values together; one with more stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(sum(pc.list_value_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("words", "ents")))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + limit - size, "right"))
            if stop <= start and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def _slice(number: int, rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The encoded rows of a slice."""
    rows = rows.combine_chunks()
    flat = [rows.column(c).combine_chunks() for c in ("words", "ents")]
    coded = pa.concat_arrays([a.flatten() for a in flat]).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    (of_words, tf), (of_ents, _) = (_counted(a, codes, size) for a, codes in zip(flat, _split(coded.indices, flat), strict=True))
    keys = _counted_keys(np.concatenate([of_words, of_ents]))[0]
    times, named = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint8)
    times[np.searchsorted(keys, of_words)] = tf
    named[np.searchsorted(keys, of_ents)] = 1

    whole = pc.and_(pc.and_(rows.column("key").is_valid(), rows.column("ts").is_valid()), rows.column("p").is_valid())
    usable = whole.to_numpy(zero_copy_only=False).astype(bool)  # others are near no post
    platforms = rows.column("p").filter(whole).combine_chunks().dictionary_encode()
    row, value = np.divmod(keys, size)
    own = usable[row]
    data = packed(
        rows.column("key").filter(whole).to_numpy().astype(np.int64), rows.column("ts").filter(whole).to_numpy().astype(np.int64), platforms.indices.to_numpy(zero_copy_only=False).astype(np.int32),
        np.array([size]), _steps((np.cumsum(usable) - 1)[row[own]] * size + value[own]), times[own], named[own], *_texts(platforms.dictionary.to_pylist()),
    )

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    n, count = rows.num_rows, lambda k: np.bincount(k % size, minlength=size)
    yield batch(n, kind=np.full(n, POST), id=rows.column("id").combine_chunks(), ts=rows.column("ts").combine_chunks(), nw=np.bincount(row, minlength=n))
    if len(coded.dictionary):
        yield batch(size, kind=np.full(size, VALUE), slice=np.full(size, number), v=coded.dictionary, code=np.arange(size), nw=count(of_words), ne=count(of_ents))
    yield batch(1, kind=[SLICE], slice=[number], data=[data])


def encode(posts: DataFrame, id_: str, ts: str, platform: str, words: str, entities: str) -> DataFrame:
    """Posts in slices, written to the shared folder: rows of posts (``id``, ``ts`` in microseconds, and ``nw``, their distinct values), of the values of a slice, and of slices. ``words`` keeps repeats."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = posts.schema[id_].dataType.simpleString()
    schema = f"kind int, slice long, id {kind}, ts long, v string, code int, nw long, ne long, data binary"
    arrow, limit = to_arrow_schema(StructType.fromDDL(schema)), SLICE_VALUES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << COUNT_BITS
        for number, rows in enumerate(_cut(batches, limit)):
            yield from _slice(first + number, rows, arrow)
            _release()

    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("ts")
    rows = posts.select(F.col(id_).alias("id"), F.col(id_).cast("long").alias("key"), at, F.col(platform).cast("string").alias("p"), F.col(words).alias("words"), F.col(entities).alias("ents"))
    return write_through(rows.mapInArrow(run, schema), shared_dir(posts.sparkSession))


def _blocks(ts: np.ndarray, ids: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The block of a post; posts on a border that stands several times are dealt to the blocks that it parts."""
    first, last = np.searchsorted(borders, ts, "left"), np.searchsorted(borders, ts, "right")
    dealt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return first + (dealt % (last - first + 1).astype(np.uint64)).astype(np.int64)


def _of_posts(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all values of ``rows``, and how many each has."""
    n = starts[rows + 1] - starts[rows]
    return np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log((n + 1) / (1 + df))


def _placed(rows: pa.Table, n: int, borders: np.ndarray, gate: float) -> Iterator[tuple[int, int, bytes]]:
    """``x``, ``y`` and data of the posts of a slice for all pairs of blocks that they have to be in; ``rows`` are the slice and what its values count."""
    slice_ = rows.filter(rows.column("data").is_valid())
    ids, ts, p, (size,), steps, tf, named, *names = unpacked(slice_.column("data")[0].as_py())
    row, code = np.divmod(np.cumsum(steps).astype(np.int64), size)
    known = rows.filter(rows.column("code").is_valid())
    number, gid, df, rare = (known.column(c).to_numpy().astype(np.int64) for c in ("code", "gid", "df", "rare"))
    gids, dfs, rares = np.full(size, -1), np.ones(size, np.int64), np.zeros(size, np.uint8)
    gids[number], dfs[number], rares[number] = gid, df, rare
    w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0.0) * _idf(dfs[code], n)
    norm = np.sqrt(np.bincount(row, w * w, len(ids)))
    named = named * (rares[code] > 0)
    able = np.bincount(row, named, len(ids)) > 0  # others share no rare entity
    kept = able[row] & (named | ((tf > 0) & (dfs[code] > 1))).astype(bool)
    row, code, tf, named = row[kept], code[kept], tf[kept], named[kept].astype(np.uint8)
    starts = np.searchsorted(row, np.arange(len(ids) + 1))

    home = _blocks(ts, ids, borders)
    posts = np.flatnonzero(able)
    reach = int(gate * 3.6e9) + 1
    low, high = np.searchsorted(borders, ts[posts] - reach, "left"), np.searchsorted(borders, ts[posts] + reach, "right")
    places = high - low + 1
    post, other = np.repeat(posts, places), np.repeat(low - np.cumsum(places) + places, places) + np.arange(places.sum())
    x, y = np.minimum(home[post], other), np.maximum(home[post], other)
    order = np.lexsort((post, y, x))
    post, x, y = post[order], x[order], y[order]
    cuts = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
    for first, stop in itertools.pairwise([*cuts, len(post)]):
        own = post[first:stop]
        at, counts = _of_posts(starts, own)
        present = np.bincount(code[at], minlength=size) > 0
        values, inner = np.flatnonzero(present), (np.cumsum(present) - 1)[code[at]]
        keys = np.repeat(np.arange(len(own)), counts) * len(values) + inner
        data = packed(ids[own], ts[own], p[own], home[own].astype(np.int32), norm[own], gids[values], dfs[values], rares[values], _steps(keys), tf[at], named[at], *names)
        yield int(x[first]), int(y[first]), data


def _met(records: Iterator[bytes], same: bool, n: int, gate: float, at_once: int) -> Iterator[pa.RecordBatch]:
    """Scored pairs of the posts of two blocks, or of one (``same``)."""
    platforms: dict[str, int] = {}
    parts: list[tuple[np.ndarray, ...]] = []
    posts = 0
    for data in records:
        ids, ts, p, home, norm, gids, dfs, rares, steps, tf, named, *names = unpacked(data)
        row, value = np.divmod(np.cumsum(steps).astype(np.int64), max(len(gids), 1))
        w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0.0) * _idf(dfs[value], n)
        own = np.array([platforms.setdefault(name, len(platforms)) for name in _names(*names)], np.int64)
        parts.append((ids, ts, own[p], home, norm, (row + posts).astype(np.int32), gids[value], w, named * rares[value]))
        posts += len(ids)
    ids, ts, p, home, norm, row, gid, w, rare = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    starts = np.searchsorted(row, np.arange(posts + 1))
    code = np.unique(gid, return_inverse=True)[1]
    lent = np.zeros(code.max() + 1)

    named = np.flatnonzero(rare)
    named = named[np.lexsort((ts[row[named]], code[named]))]
    of, by, giant = code[named], row[named], rare[named] < 2
    follow = np.searchsorted(of, of, "right") - np.arange(len(of)) - 1
    limits = np.cumsum(np.bincount(by, follow, posts))  # of the pairs that posts begin, by entities
    first = 0
    while first < posts:
        stop = max(first + 1, int(np.searchsorted(limits, (limits[first - 1] if first else 0) + at_once, "right")))
        at = np.flatnonzero((by >= first) & (by < stop) & (follow > 0))
        found, step = [], 1
        while len(at):
            at = at[follow[at] >= step]
            at = at[(ts[by[at + step]] - ts[by[at]]) / 3.6e9 <= gate]
            l, r = by[at], by[at + step]
            ok = (p[l] != p[r]) & (ids[l] != ids[r]) & ((home[l] != home[r]) | same)
            found.append((l[ok], r[ok], giant[at[ok]]))
            step += 1
        first = stop
        if not found:
            continue
        l, r, common = (np.concatenate(c) for c in zip(*found, strict=True))
        l, r = np.where(ids[l] < ids[r], l, r), np.where(ids[l] < ids[r], r, l)
        pairs, which = np.unique(l * posts + r, return_inverse=True)
        few = np.bincount(which, ~common, len(pairs)).astype(np.int64)
        l, r = np.divmod(pairs, posts)
        dots = np.zeros(len(pairs))
        cuts = np.flatnonzero(np.diff(l, prepend=-1))
        for start, end in itertools.pairwise([*cuts, len(pairs)]):
            own = slice(starts[l[start]], starts[l[start] + 1])
            lent[code[own]] = w[own]
            at, counts = _of_posts(starts, r[start:end])
            dots[start:end] = np.add.reduceat(lent[code[at]] * w[at], np.cumsum(counts) - counts)
            lent[code[own]] = 0.0
        l, r, few, dots = (a[dots > 0] for a in (l, r, few, dots))
        names = np.array([*platforms, None], object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[l]), pa.array(ids[r]), pa.array(names[p[l]], pa.string()), pa.array(names[p[r]], pa.string()), pa.array(few), pa.array(dots / (norm[l] * norm[r]))],
            names=["a", "b", "pa", "pb", "rare", "score"],
        )


def cosines(encoded: DataFrame, gate_hours: float, most: int, giant_share: float) -> DataFrame:
    """``a`` < ``b``, their platforms ``pa`` and ``pb``, the entities ``rare`` that both have and that less than ``giant_share`` of all posts have, and ``score``, the cosine of their words.

    Pairs are of different platforms, at most ``gate_hours`` apart, and share an entity of at most ``most`` posts that not all posts have, and a word.
    """
    posts = encoded.filter(F.col("kind") == POST)
    n, values = posts.agg(F.count("*"), F.coalesce(F.sum("nw"), F.lit(0))).first()
    blocks = values // BLOCK_VALUES + 1
    shares = [i / blocks for i in range(1, blocks)]
    borders = np.array(sorted(posts.agg(F.percentile_approx("ts", shares, 100 * blocks)).first()[0] or []) if shares else [], np.int64)  # one number per block
    of = Window.partitionBy("v")
    gid = F.min(F.shiftleft("slice", CODE_BITS).bitwiseOR(F.col("code"))).over(of).alias("gid")
    counted = encoded.filter(F.col("kind") == VALUE).select("slice", "code", gid, F.sum("nw").over(of).alias("df"), F.sum("ne").over(of).alias("de"))  # a row per slice
    rare = F.when(F.col("de").between(2, most) & (F.col("de") < n), F.when(F.col("de") / n < giant_share, 2).otherwise(1)).otherwise(0)
    known = counted.select("slice", "code", "gid", "df", rare.alias("rare")).filter((F.col("df") > 1) | (F.col("rare") > 0))
    slices = encoded.filter(F.col("kind") == SLICE).select("slice", "data")
    at_once = PAIRS_AT_ONCE

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, data in _placed(pa.Table.from_batches(batches), n, borders, gate_hours):
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([y]), pa.array([data], pa.binary())], names=["x", "y", "data"])
        _release()

    def met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (data for b in batches for data in b.column("data").to_pylist())
        yield from _met(records, key[0].as_py() == key[1].as_py(), n, gate_hours, at_once)
        _release()

    dealt = known.unionByName(slices, allowMissingColumns=True).groupBy("slice").applyInArrow(placed, "x long, y long, data binary")
    return dealt.groupBy("x", "y").applyInArrow(met, "a long, b long, pa string, pb string, rare long, score double")
