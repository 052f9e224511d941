"""Removal of repeated substrings by prefix-free parsing.

Which suffixes agree in their first ``length`` bytes is read off the corpus order, which the suffix arrays of a dictionary and a parse give (``parsing``).
To sort in many tasks, windows are dealt by content first. In each window of ``length`` bytes the smallest of the rolling hashes of
``TRIGGER`` bytes, the leftmost of equal ones, is the window's trigger, so equal windows have it at the same place. Windows with the same trigger and
nearly the same place of it make a family: the bytes that they share are its core, the bytes that they cover together its span. Equal
windows are in families of equal cores.

First round: slices of the corpus send 48-bit hashes of cores and 128-bit hashes of spans, which are counted. A core that occurs once repeats none of its
windows; a span that occurs twice repeats all of its windows, so copies need no more than that. Where a core has a span that occurs once, which is so at the
edges of repeated passages and of changes in near copies, windows have to be told apart: each distinct span is sent, as bytes and with its frequency, by
the first slice that has it.
Second round: every part of the core hashes is parsed prefix-free, about ``PARSED_BYTES`` of whole core groups at a time; the suffix arrays of its phrases and of
their sequence put its windows in order, neighbours with ``length`` bytes or more in common are equal, and a window whose frequencies add up to two is a repeat.

A core with more than ``CROWD`` distinct spans, as a common passage of nearly ``length`` bytes in ever other surroundings has, is not sorted in one place:
its windows are dealt by 128-bit hashes of their own, one entry per slice and window.

Null and empty texts have no bytes. Matches never cross documents. Rows without id or with the same id are rows of their own; all copies lose what
they share. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.batches import flat_bytes
from quarryline.llm.exchange import KEY_BITS, SCHEMA, Row, answer, ask, batch_of, bounds, deltas, gather, make_slices, pack, part_count, unpack
from quarryline.llm.parsing import repeated_windows
from quarryline.session import shared_dir, write_through

LENGTH = 200
TRIGGER = 24
#: Places of the trigger in a window that make one family.
PLACES = 100
SLICE_BYTES = 2 << 20
SLICES_PER_PART = 16
#: Distinct spans of a core that are sorted together.
CROWD = 1000
#: Bytes that are parsed at a time.
PARSED_BYTES = 1 << 20
SPANS, FOUND, TEXTS, WINDOWS, ORDERED, REPEATED = range(6)
#: What is known of a slice's span: no window repeats; all do, and nothing is sent; it is sent to be sorted, as the corpus's only
#: occurrence or for all of them; it is in a crowd, as one or for all.
NONE, ALL, ONE, MANY, CROWD_ONE, CROWD_MANY = range(6)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of any range of bytes in constant time: sums of byte codes times powers, modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if len(_powers[0]) <= n:
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(n + n // 4 + 1, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
        self.inverse = _powers[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def rolling(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def triggers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the smallest, the leftmost of equal ones."""
    n = len(hashes) - width + 1
    bits = np.uint64(max(24, len(hashes).bit_length()))
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.uint64((1 << 64) - 1))
    padded[: len(keys)] = keys
    ahead = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128-bit hashes of ranges of bytes, two columns."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before, in any key."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Families:
    """The window families of a slice: first and last window start, and the distinct spans, ascending by core."""

    data: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: Of each family its distinct span; of each distinct span its core, hash, frequency and one family that has it.
    which: np.ndarray
    core: np.ndarray
    span: np.ndarray
    count: np.ndarray
    sample: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, length: int) -> Families:
        data, ends = flat_bytes(batch.column("text"))
        trigger = min(TRIGGER, length)
        change = np.zeros(len(data) + 1, np.int8)
        long = np.flatnonzero(np.diff(ends) >= length)
        np.add.at(change, ends[:-1][long], 1)
        np.add.at(change, ends[1:][long] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
        empty = np.empty(0, np.int64)
        if not len(starts):
            return cls(data, ends, empty, empty, empty, empty.astype(np.uint64), np.empty((0, 2), np.uint64), empty, empty)
        hashes = RollingHash(data)
        at = triggers(hashes.rolling(trigger), length - trigger + 1)[starts]
        block = (at - starts) // PLACES
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(at) != 0) | (np.diff(block) != 0)]))
        first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
        at, block = at[heads], block[heads]
        begin = at - block * PLACES
        stop = np.maximum(begin - PLACES + 1 + length, at + trigger)
        core = _mix(hashes.of(begin, stop) + block.astype(np.uint64)) >> np.uint64(64 - KEY_BITS)
        span = digests(data, first, last + length)
        order = np.lexsort((span[:, 1], span[:, 0], core))
        new = _runs(core[order], span[order, 0], span[order, 1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        sample = order[new]
        return cls(data, ends, first, last, which, core[sample], span[sample], np.bincount(which), sample)

    def texts(self, status: np.ndarray) -> np.ndarray:
        """The distinct spans that this slice sends."""
        return np.flatnonzero((status == ONE) | (status == MANY))

    def crowded(self, status: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window starts of crowded spans, the distinct hashes ascending, which of these each start has, and the frequency that each start stands for."""
        spans = np.flatnonzero((status == CROWD_ONE) | (status == CROWD_MANY))
        families = self.sample[spans]
        sizes = self.last[families] - self.first[families] + 1
        starts = _ranges(self.first[families], sizes)
        hashes = digests(self.data, starts, starts + length)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        new = _runs(hashes[order, 0], hashes[order, 1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        return starts, hashes[order][new], index, np.repeat(np.where(status[spans] == CROWD_MANY, 2, 1), sizes)


def _ask_spans(parts: int, length: int):
    def questions(number: int, batch: pa.RecordBatch) -> Iterator[Row]:
        own = Families.of(batch, length)
        edge = bounds(own.core, parts)
        for part in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[part], edge[part + 1])
            yield part, number, SPANS, pack(deltas(own.core[s]), own.span[s, 0], own.span[s, 1], own.count[s].astype(np.uint32))

    return questions


def _answer_spans(crowd: int):
    def judge(part: int, rows: list[Row]) -> Iterator[Row]:
        """What follows from the frequencies of one part's cores and spans, for the spans of each slice."""
        columns = [unpack(row[3]) for row in rows]
        core = np.concatenate([np.cumsum(c[0]) for c in columns])
        high, low, count = (np.concatenate([c[i] for c in columns]) for i in (1, 2, 3))
        order = np.lexsort((low, high, core))  # stable: the first slice that has a span comes first
        core, high, low, count = core[order], high[order], low[order], count[order].astype(np.int64)
        heads = np.flatnonzero(_runs(core, high, low))
        of_span = np.add.reduceat(count, heads)
        in_core = np.cumsum(_runs(core)[heads]) - 1
        of_core, distinct = np.bincount(in_core, of_span)[in_core], np.bincount(in_core)[in_core]
        crowded = distinct > crowd
        single = (np.bincount(in_core, of_span == 1) > 0)[in_core]
        sent = np.where(of_span > 1, np.where(crowded, CROWD_MANY, MANY), np.where(crowded, CROWD_ONE, ONE))
        sizes = np.diff(np.append(heads, len(order)))
        status = np.full(len(order), ALL, np.uint8)
        status[heads] = np.where(single, sent, ALL)
        status[np.repeat(of_core == 1, sizes)] = NONE
        out = np.empty(len(order), np.uint8)
        out[order] = status
        edge = np.concatenate([[0], np.cumsum([len(c[0]) for c in columns])])
        for i, row in enumerate(rows):
            yield part, row[1], FOUND, pack(out[edge[i] : edge[i + 1]])

    return judge


def _joined(answers: list[Row], kind: int) -> np.ndarray:
    """The answers of all parts of a kind, one after another: in the order of the questions' keys."""
    return np.concatenate([np.empty(0, np.uint8), *(unpack(row[3])[0] for row in answers if row[2] == kind)])


def _ask_windows(parts: int, length: int):
    def questions(number: int, batch: pa.RecordBatch, answers: list[Row]) -> Iterator[pa.RecordBatch]:
        own = Families.of(batch, length)
        status = _joined(answers, FOUND)
        rows: list[Row] = []
        spans = own.texts(status)
        families = own.sample[spans]
        sizes = own.last[families] - own.first[families] + length
        stops = np.cumsum(sizes)
        flat = own.data[_ranges(own.first[families], sizes)]
        core, weight = own.core[spans], np.where(status[spans] == MANY, 2, 1).astype(np.uint8)
        edge = bounds(core, parts)
        for part in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[part], edge[part + 1])
            own_bytes = flat[stops[s.start] - sizes[s.start] : stops[s.stop - 1]]
            rows.append((part, number, TEXTS, pack(deltas(core[s]), weight[s], sizes[s].astype(np.uint32), own_bytes)))
        _, hashes, index, weights = own.crowded(status, length)
        twice = (np.bincount(index, weights, len(hashes)) > 1).astype(np.uint8)
        edge = bounds(hashes[:, 0] >> np.uint64(64 - KEY_BITS), parts)
        for part in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[part], edge[part + 1])
            rows.append((part, number, WINDOWS, pack(deltas(hashes[s, 0]), hashes[s, 1], twice[s])))
        if rows:
            yield batch_of(rows)

    return questions


def _answer_windows(length: int):
    def judge(part: int, rows: list[Row]) -> Iterator[Row]:
        for kind, reply, judged in ((TEXTS, ORDERED, _sorted), (WINDOWS, REPEATED, _counted)):
            asked = [row for row in rows if row[2] == kind]
            if asked:
                for row, flags in zip(asked, judged([unpack(row[3]) for row in asked], length), strict=True):
                    yield part, row[1], reply, pack(flags.astype(np.uint8))

    return judge


def _sorted(columns: list[list[np.ndarray]], length: int) -> list[np.ndarray]:
    """Per slice and window of the spans that it sent, whether it repeats: by the order of all windows of the part."""
    core = np.concatenate([np.cumsum(c[0]) for c in columns])
    weight, sizes, data = (np.concatenate([c[i] for c in columns]) for i in (1, 2, 3))
    sizes = sizes.astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    at = np.cumsum(windows) - windows
    out = np.empty(windows.sum(), bool)
    order = np.argsort(core, kind="stable")
    filled = np.cumsum(sizes[order])
    tops = np.append(np.flatnonzero(_runs(core[order])), len(order))
    done = 0
    while done < len(order):
        limit = (filled[done - 1] if done else 0) + PARSED_BYTES
        fits = tops[np.searchsorted(tops, np.searchsorted(filled, limit, "right"), "right") - 1]
        stop = int(max(fits, tops[np.searchsorted(tops, done, "right")]))  # a whole core group at least
        own = order[done:stop]
        ends = np.concatenate([[0], np.cumsum(sizes[own])])
        out[_ranges(at[own], windows[own])] = repeated_windows(data[_ranges(begins[own], sizes[own])], ends, weight[own], length)
        done = stop
    edge = np.concatenate([[0], np.cumsum([len(c[0]) for c in columns])])
    bound = np.append(at, len(out))[edge]
    return [out[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]


def _counted(columns: list[list[np.ndarray]], length: int) -> list[np.ndarray]:
    """Per slice and window hash that it sent, whether it occurs twice."""
    high = np.concatenate([np.cumsum(c[0]) for c in columns])
    low, twice = (np.concatenate([c[i] for c in columns]) for i in (1, 2))
    order = np.lexsort((low, high))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(_runs(high[order], low[order])) - 1
    repeated = (np.bincount(which, 1 + twice) > 1)[which]
    edge = np.concatenate([[0], np.cumsum([len(c[0]) for c in columns])])
    return [repeated[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _remove(length: int):
    def finish(number: int, batch: pa.RecordBatch, answers: list[Row]) -> Iterator[pa.RecordBatch]:
        own = Families.of(batch, length)
        status = _joined(answers, FOUND)
        whole = np.isin(status[own.which], (ALL, MANY, CROWD_MANY)) if len(own.which) else np.empty(0, bool)
        families = own.sample[own.texts(status)]
        starts = _ranges(own.first[families], own.last[families] - own.first[families] + 1)
        crowded, _, index, _ = own.crowded(status, length)
        repeated = np.concatenate([starts[_joined(answers, ORDERED) == 1], crowded[_joined(answers, REPEATED)[index] == 1]])
        n = len(own.data)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.concatenate([own.first[whole], repeated]), 1)
        np.add.at(change, np.concatenate([own.last[whole], repeated]) + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        # A run that ends with its document is not joined to one that begins the next.
        begins = gone & ~np.concatenate([[False], gone[:-1]])[:n]
        firsts = own.ends[:-1][np.diff(own.ends) > 0]
        begins[firsts] = gone[firsts]
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[own.ends])
        removed = total(gone)
        kept = own.data[~gone].tobytes()
        at = np.concatenate([[0], np.cumsum(np.diff(own.ends) - removed)]).tolist()
        texts = [kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        columns = [batch.column("doc_id"), pa.array(np.diff(own.ends)), pa.array(removed), pa.array(total(begins)), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return finish


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, slice_bytes: int = SLICE_BYTES, crowd: int = CROWD) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that are in no repeated string of ``length`` bytes."""
    root = shared_dir(spark)
    slices = make_slices(docs, f"{root}/slices", slice_bytes)
    parts = part_count(spark, slices, SLICES_PER_PART)
    found = write_through(answer(ask(slices, _ask_spans(parts, length)), parts, _answer_spans(crowd)), f"{root}/spans")
    windows = gather(slices, found, _ask_windows(parts, length), SCHEMA)
    ordered = answer(windows, parts, _answer_windows(length))
    return gather(slices, found.union(ordered), _remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
