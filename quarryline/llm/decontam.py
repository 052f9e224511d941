"""Benchmark decontamination with suffix arrays of the training shards.

Every task turns slices of whole documents into arrays of word ids and sorts their suffixes by prefix doubling: the suffix array of
a shard. Suffixes whose first word no test item has cannot match and are left out. All suffixes of the test items are then
binary-searched in it, word by word, which gives the places of every window; from each of these the longest verbatim match is searched in the suffix array
of the items (``matches``). Documents stay whole in one slice, so nothing is shuffled. Test items are sent to the tasks in blocks of at most ``BLOCK_BYTES``; more items mean more
blocks, each searched against all rows. The driver holds one block and the next: a block's result is written through before another is fetched.

Null and empty texts have no words and are never hit; items without words are skipped. Item ids that occur twice are one item with several texts;
texts without an item id are one item without a name, which counts in hits and ``n_items`` and is not in ``items``. Documents keep their rows: repeated ids give repeated results. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.batches import slices, text_rows
from quarryline.session import remove, shared_dir, write_through

WINDOW = 13
#: A document is contaminated from one hit word in so many.
SHARE = 20
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 6 << 20

_WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


class TestSet:
    """Items as one array of word ids, with separators that match nothing."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.items: list[np.ndarray] = []
        for _, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            self.items.append(np.array(ids, np.int64))
        self.depth = max([len(x) for x in self.items], default=0)
        #: Start, item and length of every window, and the words of all items padded by zeros.
        self.flat = np.concatenate([*self.items, np.zeros(self.depth + 1, np.int64)])
        starts, owner, left = [], [], []
        at = 0
        for k, x in enumerate(self.items):
            starts.append(np.arange(at, at + len(x)))
            owner.append(np.full(len(x), k))
            left.append(np.arange(len(x), 0, -1))
            at += len(x)
        empty = [np.empty(0, np.int64)]
        self.starts, self.owner, self.left = (np.concatenate(x or empty) for x in (starts, owner, left))
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.need = np.minimum(window, self.sizes[self.owner]) if len(self.owner) else self.owner


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes that begin with a known word (id over 0), ordered by their first ``depth`` words or more.

    Unknown words are 0 and end a comparison. Prefix doubling: ranks of k words give ranks of 2k; suffixes that are alone with
    their rank are settled and no longer sorted.
    """
    n = len(words)
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = words
    order = np.flatnonzero(words)
    order = order[np.argsort(words[order], kind="stable")]
    span = 1

    def groups(keys: np.ndarray) -> np.ndarray:
        """Index of the first place of each place's group."""
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
        return np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))

    first = groups(words[order])
    rank[:] = 0
    rank[order] = first + 1
    open_ = np.arange(len(order))
    while span < depth and len(open_):
        heads = rank[order[open_]] - 1
        counts = np.bincount(heads, minlength=len(order))
        open_ = open_[counts[heads] > 1]
        if not len(open_):
            break
        at = order[open_]
        head = rank[at] - 1
        nxt = np.where(at + span < n, rank[np.minimum(at + span, n)], 0)
        by = np.lexsort((nxt, head))
        at, head, nxt = at[by], head[by], nxt[by]
        order[open_] = at
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (nxt[1:] != nxt[:-1])])
        place = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = open_[place] + 1
        open_ = open_[nxt != 0]  # nothing known follows the others
        span *= 2
    return order


def longest_matches(words: np.ndarray, order: np.ndarray, flat: np.ndarray, starts: np.ndarray, left: np.ndarray, need: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Suffixes of ``flat`` at ``starts`` (``left`` words each) searched in the suffix array ``order`` of ``words``, up to ``depth`` words.

    Per suffix the words of its longest match, the first suffix of ``words`` that has it, and the range of the suffix array that matches its first ``need`` words (or is empty).
    """
    n, q = len(words), len(starts)
    padded = np.append(words, 0)
    low, high = np.zeros(q, np.int64), np.full(q, len(order), np.int64)
    longest = np.zeros(q, np.int64)
    win_low, win_high = np.zeros(q, np.int64), np.zeros(q, np.int64)
    alive = np.arange(q) if len(order) else np.empty(0, np.int64)

    def bound(live: np.ndarray, at: int, want: np.ndarray, upper: bool) -> np.ndarray:
        a, b = low[live].copy(), high[live].copy()
        while True:
            todo = np.flatnonzero(a < b)
            if not len(todo):
                return a
            mid = (a[todo] + b[todo]) // 2
            seen = padded[np.minimum(order[mid] + at, n)]
            right = seen <= want[todo] if upper else seen < want[todo]
            a[todo] = np.where(right, mid + 1, a[todo])
            b[todo] = np.where(right, b[todo], mid)

    for at in range(depth):
        alive = alive[left[alive] > at]
        want = flat[starts[alive] + at]
        alive, want = alive[want > 0], want[want > 0]
        if not len(alive):
            break
        a, b = bound(alive, at, want, False), bound(alive, at, want, True)
        found = a < b
        alive = alive[found]
        low[alive], high[alive] = a[found], b[found]
        longest[alive] = at + 1
        full = alive[need[alive] == at + 1]
        win_low[full], win_high[full] = low[full], high[full]
    return longest, order[np.minimum(low, max(len(order) - 1, 0))] if len(order) else low, win_low, win_high


class Prefixes:
    """Classes of equal runs of 1, 2, 4 ... words of an array, up to ``depth``; other words get the same classes, where they have a run that the array has."""

    def __init__(self, words: np.ndarray, depth: int) -> None:
        self.levels, self.keys = [np.append(words, 0)], []
        while 2 << len(self.keys) <= depth:
            pairs, known, base = self._pairs(self.levels[-1], 1 << len(self.keys), len(words) + 2)
            keys = np.unique(pairs[known])
            self.keys.append((base, keys))
            self.levels.append(np.where(known, np.searchsorted(keys, pairs) + 1, 0))

    @staticmethod
    def _pairs(level: np.ndarray, half: int, base: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Both halves of each run as one number, and whether all of its words are known."""
        after = np.zeros_like(level)
        after[:-half] = level[half:]
        return level * base + after, (level > 0) & (after > 0), base

    def of(self, words: np.ndarray) -> list[np.ndarray]:
        """Levels of other words, 0 where the array has no such run."""
        levels = [np.append(words, 0)]
        for k, (base, keys) in enumerate(self.keys):
            pairs, known, _ = self._pairs(levels[-1], 1 << k, base)
            place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            found = known & (keys[place] == pairs) if len(keys) else np.zeros(len(pairs), bool)
            levels.append(np.where(found, place + 1, 0))
        return levels

    def common(self, at: np.ndarray, others: list[np.ndarray], to: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``at`` of the array and at ``to`` of the others have in common."""
        size = np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            here, there = self.levels[k], others[k]
            a, b = here[np.minimum(at + size, len(here) - 1)], there[np.minimum(to + size, len(there) - 1)]
            size += ((a == b) & (a > 0)).astype(np.int64) << k
        return size


def longest_in(prefixes: Prefixes, order: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest match of each suffix of ``words`` in a suffix array, and the first suffix in its order that has it.

    Binary search by the words in common, which come from classes of runs: log(suffixes) times log(depth) steps, however long the match.
    """
    if not len(order) or not len(starts):
        return np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    others, own = prefixes.of(words), prefixes.levels[0]
    padded = np.append(words, 0)
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while len(todo := np.flatnonzero(low < high)):
        mid = (low[todo] + high[todo]) // 2
        same = prefixes.common(order[mid], others, starts[todo])
        less = own[np.minimum(order[mid] + same, len(own) - 1)] < padded[np.minimum(starts[todo] + same, len(words))]
        low[todo], high[todo] = np.where(less, mid + 1, low[todo]), np.where(less, high[todo], mid)
    before, after = np.maximum(low - 1, 0), np.minimum(low, len(order) - 1)
    sizes = [prefixes.common(order[at], others, starts) for at in (before, after)]
    longest = np.maximum(*sizes)
    # Towards the place of the suffix the words in common never get fewer.
    a, b = np.zeros(len(starts), np.int64), np.where(sizes[0] == longest, before, after)
    while len(todo := np.flatnonzero(a < b)):
        mid = (a[todo] + b[todo]) // 2
        there = prefixes.common(order[mid], others, starts[todo]) >= longest[todo]
        a[todo], b[todo] = np.where(there, a[todo], mid + 1), np.where(there, mid, b[todo])
    return longest, order[a]


def _shard(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of the slice with a 0 after each document, and the end of each document's words."""
    get = vocabulary.get
    ids: list[int] = []
    ends = []
    for text in batch.column("text").to_pylist():
        ids += [get(w, 0) for w in words_of(text)]
        ends.append(len(ids))
        ids.append(0)
    return np.array(ids, np.int64), np.array(ends, np.int64)


class Hits:
    """The windows of test items in a slice of documents.

    Windows that are equal have one range of the suffix array; it is followed to its places once, whatever the number of windows. Ranges of one length are
    disjoint, so a word begins at most one place for each length of a window.
    """

    def __init__(self, batch: pa.RecordBatch, tests: TestSet, window: int) -> None:
        self.words, self.ends = _shard(batch, tests.vocabulary)
        self.begins = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        order = suffix_array(self.words, window)
        _, _, low, high = longest_matches(self.words, order, tests.flat, tests.starts, tests.left, tests.need, window)
        hit = np.flatnonzero(high > low)
        ranges, which = np.unique(np.stack([low[hit], high[hit], tests.need[hit]]), axis=1, return_inverse=True)
        low, high, need = ranges
        sizes = high - low
        of = np.repeat(np.arange(len(sizes)), sizes)
        #: Where a window begins, and its length.
        self.at = order[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] if len(order) else of
        self.length = need[of]
        self.doc = np.searchsorted(self.ends, self.at, "left")
        # Distinct (range, document) and (range, item): their pairs by range are what documents have of items.
        documents = np.unique(np.stack([of, self.doc]), axis=1)
        items = np.unique(np.stack([which.ravel(), tests.owner[hit]]), axis=1)
        first = np.searchsorted(items[0], np.arange(len(low) + 1))
        many = np.diff(first)[documents[0]]
        index = np.repeat(first[documents[0]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        #: Distinct pairs of documents and items, by document.
        self.pairs = np.unique(np.stack([np.repeat(documents[1], many), items[1][index]]), axis=1)


def _runs(found: Hits, at: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that matches from ``at`` on can have, runs apart by a 0, and where each match begins in them.

    All windows of a match longer than a window are found too, so that a match ends a window after the last word of its run.
    """
    if not len(at):
        return np.empty(0, np.int64), at
    change = np.zeros(len(found.words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + window, found.ends[doc]), -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    run = np.cumsum(np.concatenate([[0], np.diff(kept) > 1]))
    place = np.arange(len(kept)) + run
    words = np.zeros(place[-1] + 2, np.int64)
    words[place] = found.words[kept]
    return words, place[np.searchsorted(kept, at)]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of a bounded size, fetched one partition of about that size at a time."""
    block: list[tuple[str | None, bytes]] = []
    held = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for row in (items.repartition(ceil(total / block_bytes)) if total > block_bytes else items).toLocalIterator():
        if block and held + len(row.text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item, bytes(row.text)))
        held += len(row.text)
    if block:
        yield block


def _with_last(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block and whether it is the last; one without items where there is none."""
    block = next(blocks, [])
    while (following := next(blocks, None)) is not None:
        yield block, False
        block = following
    yield block, True


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches of documents with items, each once: of the words at which a window of an item begins, those whose longest match is more than the rest of the one before.

    ``doc_id``, ``word`` (offset), ``length`` (words), and the item that has it: ``item_id``, ``item_word`` (offset), the first in the order of the test suffixes. The
    runs of such words, and no others, are searched in the suffix array of the items. A match of any length is one row per block of items that has it.
    """

    def make(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = TestSet(shared.value, window)
            # Items stand apart, so that a match ends with its item.
            apart = np.zeros(len(tests.flat) + len(tests.items), np.int64)
            own = np.arange(len(tests.starts)) + tests.owner
            apart[own] = tests.flat[: len(own)]
            order = suffix_array(apart, tests.depth)
            prefixes = Prefixes(apart, tests.depth)
            base = np.cumsum(tests.sizes) - tests.sizes
            for batch in slices(batches, limit=SHARD_BYTES):
                found = Hits(batch, tests, window)
                at = np.unique(found.at)
                doc = np.searchsorted(found.ends, at, "left")
                longest, where = longest_in(prefixes, order, *_runs(found, at, doc, window))
                fresh = np.ones(len(at), bool)
                fresh[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (longest[1:] >= longest[:-1])
                at, doc, longest, where = at[fresh], doc[fresh], longest[fresh], where[fresh]
                query = np.searchsorted(own, where)
                item = tests.owner[query]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        pa.array(at - found.begins[doc] if len(at) else at),
                        pa.array(longest),
                        pa.array([tests.names[i] for i in item.tolist()], pa.string()),
                        pa.array(query - base[item] if len(at) else at),
                    ],
                    names=["doc_id", "word", "length", "item_id", "item_word"],
                )

        return run

    spark, schema = docs.sparkSession, "doc_id long, word long, length long, item_id string, item_word long"
    found = []
    for block, last in _with_last(_blocks(benchmark, block_bytes)):
        shared = spark.sparkContext.broadcast(block)
        found.append(text_rows(docs).mapInArrow(make(shared), schema))
        if not last:
            found[-1] = write_through(found[-1], shared_dir(spark))
            shared.destroy()
    return reduce(DataFrame.union, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES, rows: bool = False) -> DataFrame:
    """Per document ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted names) and ``contaminated``; with ``rows`` also ``__row``, its columns as a struct.

    Blocks after the first add to the runs of hit words and the items that the earlier ones found.
    """
    carried = ["__row"] * rows
    row = f"__row {docs.select(F.struct(*docs.columns).alias('r')).schema[0].dataType.simpleString()}, " if rows else ""

    def make(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = TestSet(shared.value, window)
            for batch in slices(batches, limit=SHARD_BYTES):
                hits = Hits(batch, tests, window)
                words, ends, begin = hits.words, hits.ends, hits.begins
                before = batch.column("runs")
                edges = before.flatten().to_numpy(zero_copy_only=False) + np.repeat(begin, np.asarray(before.value_lengths()))
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, np.concatenate([hits.at, edges[::2]]), 1)
                np.add.at(change, np.concatenate([hits.at + hits.length, edges[1::2]]), -1)
                covered = np.cumsum(change[:-1]) > 0
                edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                per_doc = np.searchsorted(starts, [*begin, len(words)])
                shift = np.repeat(begin, np.diff(per_doc))
                flat = np.stack([starts - shift, stops - shift], axis=1).ravel()
                runs = pa.ListArray.from_arrays(pa.array((per_doc * 2).astype(np.int32)), pa.array(flat))
                item_bounds = np.searchsorted(hits.pairs[0], np.arange(len(ends) + 1))
                items = [
                    sorted({*had, *(tests.names[k] for k in hits.pairs[1, i:j].tolist())}, key=lambda x: (x is None, x))
                    for had, i, j in zip(batch.column("items").to_pylist(), item_bounds[:-1], item_bounds[1:], strict=True)
                ]
                text = [] if last else [batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *map(batch.column, carried), *text, pa.array(ends - begin), runs, pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", *carried, *(["text"] * (not last)), "n_words", "runs", "items"],
                )

        return run

    extra = [F.struct(*docs.columns).alias("__row")] if rows else []
    found = text_rows(docs, *extra, F.array().cast("array<bigint>").alias("runs"), F.array().cast("array<string>").alias("items"))
    spark, stored = docs.sparkSession, None
    for block, last in _with_last(_blocks(benchmark, block_bytes)):
        shared = spark.sparkContext.broadcast(block)
        text = "" if last else "text binary, "
        found = found.mapInArrow(make(shared, last), f"doc_id long, {row}{text}n_words long, runs array<bigint>, items array<string>")
        if not last:
            before, stored = stored, shared_dir(spark)
            found = write_through(found, stored)
            shared.destroy()
            if before:
                remove(spark, before)
    ends, starts = F.filter("runs", lambda _, i: i % 2 == 1), F.filter("runs", lambda _, i: i % 2 == 0)
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_compact("items").alias("items")  # a null stands for the item without a name
    counted = found.select("doc_id", "n_words", (total(ends) - total(starts)).alias("n_hit"), F.size("items").cast("long").alias("n_items"), names, *carried)
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they were."""
    return contamination(docs, benchmark, rows=True, **options).filter(~F.col("contaminated")).select("__row.*")


def item_hash(column: str = "items"):
    return F.sha2(F.array_join(column, ","), 256)
