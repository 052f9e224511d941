"""A Katz backoff bigram model of the corpus, and the score of every text under it.

Tokens are words, then one end; the first word follows a start. Counts of 1 to ``K`` are discounted by Good and Turing's estimate, larger ones by the small
constant ``DELTA``, so that every context leaves mass for words that never followed it. A word w after a context v has
d(c(v w)) * c(v w) / c(v) where that was seen, and alpha(v) * P(w) else, with P(w) = d(c(w)) * c(w) / N, or the mass left for one unknown word;
alpha(v) is the mass that v leaves, divided by the P of all words never seen after v, so the probabilities after each context add up to one.

Words are 48-bit hashes. Counts live in tables partitioned by ranges of the following word, contexts in tables partitioned by ranges of the
context; all n-grams of the training texts are counted, whatever their frequency. Words that follow very many others, the end of a text before all,
would make one part grow with the corpus: the ``HOT`` words with the most contexts in ``HOT_SLICES`` slices have their bigrams dealt by context instead. This
choice only says where counts are added up. The counts of these few words themselves are sums over all parts, known to every task afterwards. Class counts of a context (its n-grams and their
followers by frequency) are added up before any discount is known, so one pass over the counts is enough.

Null and empty texts are one end token. A null id is not held out. Repeated ids stay rows of their own. Without training texts, every token has
probability one of the single unknown word. An empty table has no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.exchange import SCHEMA, Row, answer, ask, bounds, deltas, gather, make_slices, open_slice, pack, part_count, unpack
from quarryline.session import shared_dir, write_through

K = 5
DELTA = 0.01
FOLDS = 10
START, END = np.uint64(0), np.uint64(1)
SLICE_BYTES = 8 << 20
SLICES_PER_PART = 2
BASE_ADD = 0.1
HOT, HOT_SLICES = 63, 8
#: Kinds of rows: questions, context statistics, answers, sums over a part, and a part's table of bigrams.
COUNTS, WANTED, CONTEXTS, COUNTED, ALPHAS, SUMS, TABLE, HOT_COUNTS, HOT_COUNTED, HOT_CONTEXTS, HOT_TABLE = range(11)


def word_hashes(texts: list[bytes], chunk: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of all words with A-Z lower-cased, and the number of words of each text."""
    sizes, hashes, held = [], [np.empty(0, np.uint64)], []

    def flush() -> None:
        coded = pa.array(held, pa.binary()).dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        values = np.array([digest(w) for w in coded.dictionary.to_pylist()], np.uint64) >> np.uint64(16)
        hashes.append(np.maximum(values, np.uint64(2))[coded.indices.to_numpy()])
        held.clear()

    for text in texts:
        words = text.lower().split()
        sizes.append(len(words))
        held += words
        if len(held) >= chunk:
            flush()
    if held:
        flush()
    return np.concatenate(hashes), np.array(sizes, np.int64)


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


@dataclass
class Bigrams:
    """The bigrams of a slice: ``words`` ascending; per distinct bigram its place in words as follower and context; per token its bigram and text.

    With no ``folds`` all texts are held out and nothing is learnt from them.
    """

    words: np.ndarray
    follower: np.ndarray
    context: np.ndarray
    of_token: np.ndarray
    text: np.ndarray
    held_out: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, folds: int) -> Bigrams:
        hashes, sizes = word_hashes(batch.column("text").to_pylist())
        held = np.array([not folds or is_held_out(i, folds) for i in batch.column("doc_id").to_pylist()], bool)
        ends = np.cumsum(sizes)
        after = np.insert(hashes, ends, END)
        before = np.insert(hashes, ends - sizes, START)
        words, index = np.unique(np.concatenate([after, before]), return_inverse=True)
        n = len(after)
        pairs, of_token = np.unique(index[:n].astype(np.int64) * len(words) + index[n:], return_inverse=True)
        return cls(words, pairs // len(words), pairs % len(words), of_token, np.repeat(np.arange(len(sizes)), sizes + 1), held)

    def cold(self, hot: np.ndarray) -> np.ndarray:
        """Bigrams whose follower is none of the hot words, ascending by follower."""
        return np.flatnonzero(~np.isin(self.words, hot)[self.follower])

    def hot(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other bigrams, ascending by context, and which hot word follows."""
        place = np.searchsorted(hot, self.words)
        place = np.where(np.isin(self.words, hot), place, -1)[self.follower]
        own = np.flatnonzero(place >= 0)
        own = own[np.lexsort((place[own], self.context[own]))]
        return own, place[own]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def hot_words(slices: DataFrame, n: int = HOT, sample: int = HOT_SLICES) -> np.ndarray:
    """The words with the most distinct contexts in some slices of the whole corpus, and the end of a text; ascending.

    Slices are taken by the hash of their number, so that no language or source at the head of the input decides alone: ``sample`` of them, or a
    thousandth, up to a thousand. The choice changes how the work is dealt and no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                grams = Bigrams.of(open_slice(data), 0)
                contexts = np.bincount(grams.follower, minlength=len(grams.words))
                best = np.argsort(-contexts, kind="stable")[: 2 * n]
                yield pa.RecordBatch.from_arrays([pa.array(grams.words[best].view(np.int64)), pa.array(contexts[best])], names=["word", "n"])

    numbers = slices.select("slice").distinct()
    wanted = min(1000, max(sample, numbers.count() // 1000))
    some = [r.slice for r in numbers.orderBy(F.xxhash64("slice"), "slice").limit(wanted).collect()]  # a filter reads them where they are
    found = slices.filter(F.col("slice").isin(some)).select("data").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = [r.word for r in found.orderBy(F.desc("n"), "word").limit(n).collect()]
    return np.unique(np.array([int(END), *best], np.uint64))


def _questions(parts: int, folds: int, hot: np.ndarray):
    def ask_for(number: int, batch: pa.RecordBatch) -> Iterator[Row]:
        grams = Bigrams.of(batch, folds)
        counts = np.bincount(grams.of_token, ~grams.held_out[grams.text], len(grams.follower)).astype(np.uint32)
        own = grams.cold(hot)
        starts = _starts(grams.follower[own])
        keys = grams.words[grams.follower[own[starts]]]
        starts = np.append(starts, len(own))
        contexts = grams.words[grams.context[own]]
        edge = bounds(keys, parts)
        for part in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[part], edge[part + 1]
            s = slice(starts[a], starts[b])
            yield part, number, COUNTS, pack(deltas(keys[a:b]), np.diff(starts[a : b + 1]).astype(np.uint32), contexts[s], counts[own[s]])
        own, place = grams.hot(hot)
        contexts = grams.words[grams.context[own]]
        edge = bounds(contexts, parts)
        for part in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[part], edge[part + 1])
            yield part, number, HOT_COUNTS, pack(deltas(contexts[s]), place[s].astype(np.uint16), counts[own[s]])
        wanted = grams.words[_wanted(grams)]
        edge = bounds(wanted, parts)
        for part in np.flatnonzero(np.diff(edge)).tolist():
            yield part, number, WANTED, pack(deltas(wanted[edge[part] : edge[part + 1]]))

    return ask_for


def _wanted(grams: Bigrams) -> np.ndarray:
    """Contexts that may need their backoff weight: those of held-out texts, as all bigrams of the others are counted."""
    return np.unique(grams.context[grams.of_token[grams.held_out[grams.text]]])


def _add_up(parts: int, n_hot: int):
    """Counts of one part's bigrams over all slices: answers to each, and where no table is among the rows the part's tables, its sums and what its contexts need."""

    def add(part: int, rows: list[Row]) -> Iterator[Row]:
        yield from (row for row in rows if row[2] == WANTED)
        known = any(row[2] in (TABLE, HOT_TABLE) for row in rows)
        sums = np.zeros(4 + 2 * K + n_hot, np.int64)
        yield from _add_cold(part, parts, rows, known, sums)
        yield from _add_hot(part, parts, rows, known, sums)
        if not known:
            yield part, -1, SUMS, sums.astype("<i8").tobytes()

    return add


_CLASSES = np.arange(1, K + 2)[:, None]


def _add_cold(part: int, parts: int, rows: list[Row], known: bool, sums: np.ndarray) -> Iterator[Row]:
    asked = [(row[1], unpack(row[3])) for row in rows if row[2] == COUNTS]
    shares = [x for _, x in asked] + [[x[0], x[2], x[3], x[4]] for x in (unpack(row[3]) for row in rows if row[2] == TABLE)]
    if not shares:
        return
    keys, sizes, contexts, counts = zip(*shares, strict=True)
    words, which = np.unique(np.concatenate([np.cumsum(k) for k in keys]), return_inverse=True)
    lengths = np.concatenate(sizes).astype(np.int64)
    word = np.repeat(which, lengths)
    context, count = np.concatenate(contexts), np.concatenate(counts).astype(np.int64)
    mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31)) ^ context) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed)
    starts = _starts(mixed[order])
    totals = np.add.reduceat(count[order], starts)
    of_entry = np.empty(len(count), np.int64)
    of_entry[order] = np.repeat(totals, np.diff(np.append(starts, len(order))))
    of_word = np.bincount(word, count, len(words)).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    inside = np.concatenate([[0], np.cumsum(lengths)])
    for i, (number, _) in enumerate(asked):
        a, b = edge[i], edge[i + 1]
        yield part, number, COUNTED, pack(of_word[which[a:b]].astype(np.uint64), of_entry[inside[a] : inside[b]].astype(np.uint64))
    if known:
        return
    sums[: 4 + 2 * K] += [of_word.sum(), (of_word > 0).sum(), *(of_word == _CLASSES).sum(axis=1), *(totals == _CLASSES).sum(axis=1)]
    first, seen = order[starts][totals > 0], totals[totals > 0]
    yield from _context_rows(part, parts, context[first], seen, of_word[word[first]])
    by = np.argsort(word[first], kind="stable")
    runs = np.bincount(word[first], minlength=len(words)).astype(np.uint32)
    yield part, -1, TABLE, pack(deltas(words), of_word.astype(np.uint64), runs, context[first][by], seen[by].astype(np.uint32))


def _add_hot(part: int, parts: int, rows: list[Row], known: bool, sums: np.ndarray) -> Iterator[Row]:
    """Bigrams of hot words, which are dealt by context; what their followers count in all is not known here, so contexts name them."""
    asked = [(row[1], unpack(row[3])) for row in rows if row[2] == HOT_COUNTS]
    shares = [x for _, x in asked] + [unpack(row[3]) for row in rows if row[2] == HOT_TABLE]
    if not shares:
        return
    context = np.concatenate([np.cumsum(x[0]) for x in shares])
    place, count = (np.concatenate([x[i] for x in shares]).astype(np.int64) for i in (1, 2))
    order = np.lexsort((place, context))
    new = np.concatenate([[True], (np.diff(context[order]) != 0) | (np.diff(place[order]) != 0)])
    starts = np.flatnonzero(new)
    totals = np.add.reduceat(count[order], starts)
    of_entry = np.empty(len(count), np.int64)
    of_entry[order] = totals[np.cumsum(new) - 1]
    edge = np.concatenate([[0], np.cumsum([len(x[0]) for x in shares])])
    for i, (number, _) in enumerate(asked):
        yield part, number, HOT_COUNTED, pack(of_entry[edge[i] : edge[i + 1]].astype(np.uint64))
    if known:
        return
    sums[3 + K : 4 + 2 * K] += (totals == _CLASSES).sum(axis=1)
    sums[4 + 2 * K :] += np.bincount(place, count, len(sums) - 4 - 2 * K).astype(np.int64)
    first, seen = order[starts][totals > 0], totals[totals > 0]
    yield from _context_rows(part, parts, context[first], seen, np.zeros(len(first), np.int64))
    yield part, part, HOT_CONTEXTS, pack(deltas(context[first]), place[first].astype(np.uint16))
    yield part, -1, HOT_TABLE, pack(deltas(context[first]), place[first].astype(np.uint16), seen.astype(np.uint32))


def _context_rows(part: int, parts: int, context: np.ndarray, pair: np.ndarray, follower: np.ndarray) -> Iterator[Row]:
    """Per context: its count, its bigrams by class, and its followers by class; classes above ``K`` are one, with the sum of the followers' counts."""
    order = np.argsort(context)
    context, pair, follower = context[order], pair[order], follower[order]
    starts = _starts(context)
    keys = context[starts]
    columns = [pair, *(np.minimum(pair, K + 1) == r for r in range(1, K + 2)), *(np.minimum(follower, K + 1) == r for r in range(1, K + 2)), np.where(follower > K, follower, 0)]
    sums = [np.add.reduceat(c.astype(np.uint64), starts) if len(starts) else starts.astype(np.uint64) for c in columns]
    edge = bounds(keys, parts)
    for to in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[to], edge[to + 1])
        yield to, part, CONTEXTS, pack(deltas(keys[own]), *(s[own] for s in sums))


@dataclass
class Discounts:
    """What the corpus as a whole says: tokens, distinct tokens, and factors of the counts 1 to ``K`` per order."""

    tokens: int
    distinct: int
    unigram: np.ndarray
    bigram: np.ndarray
    delta: float
    unknown: float
    #: The hot words' counts.
    hot: np.ndarray

    @classmethod
    def of(cls, sums: list[int]) -> Discounts:
        hot = np.array(sums[4 + 2 * K :], np.int64)
        tokens, distinct = sums[0] + int(hot.sum()), sums[1] + int((hot > 0).sum())
        of_class = [n + int((hot == r).sum()) for r, n in enumerate(sums[2 : 3 + K], 1)]
        classes = np.array(of_class[:K])
        unigram, bigram = good_turing(of_class), good_turing(sums[3 + K : 4 + 2 * K])
        left = ((1 - unigram[1:]) * np.arange(1, K + 1)) @ classes + DELTA * (distinct - classes.sum())
        return cls(tokens, distinct, unigram, bigram, DELTA, float(left / tokens) if tokens else 1.0, hot)

    def kept(self, counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        small = np.where(counts <= K, factors[np.minimum(counts, K)], 1.0) * counts
        return np.where(counts > K, counts - self.delta, small)

    def unigrams(self, counts: np.ndarray) -> np.ndarray:
        """P(w), for a count of 0 that of the unknown word."""
        return np.where(counts > 0, self.kept(counts, self.unigram) / max(self.tokens, 1), self.unknown)


def good_turing(of_class: list[int]) -> np.ndarray:
    """Factors at 0 to ``K`` (0 unused) from the number of n-grams with counts 1 to K + 1.

    Where the estimate is not between 0 and 1, as the classes of a small corpus are uneven, the absolute discount n1 / (n1 + 2 n2) takes its place;
    where there is none of that either, one half.
    """
    n = [0, *of_class]
    out = np.ones(K + 1)
    top = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    absolute = min(max(absolute, 0.05), 0.95)
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else 0.0
        out[r] = d if 0.05 < d < 1 else (r - absolute) / r
    return out


def _alphas(discounts: Discounts):
    """Backoff weights of one part's contexts, for each slice that wants some."""

    def weigh(part: int, rows: list[Row]) -> Iterator[Row]:
        keys, values = context_weights(*_context_tables(rows), discounts)
        for row in rows:
            if row[2] == WANTED:
                wanted = np.cumsum(unpack(row[3])[0])
                at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
                yield part, row[1], ALPHAS, pack(np.where(found, values[at], 1.0) if len(keys) else np.ones(len(wanted)))

    return weigh


def _context_tables(rows: list[Row]) -> tuple[list[list[np.ndarray]], list[list[np.ndarray]]]:
    return tuple([unpack(row[3]) for row in rows if row[2] == kind] for kind in (CONTEXTS, HOT_CONTEXTS))


def context_weights(tables: list[list[np.ndarray]], hot: list[list[np.ndarray]], discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """The contexts (ascending) of tables from ``_context_rows`` and their backoff weights; ``hot`` names the hot words after each context."""
    if not tables:
        return np.empty(0, np.uint64), np.empty(0)
    keys, which = np.unique(np.concatenate([np.cumsum(t[0]) for t in tables]), return_inverse=True)
    sums = [np.bincount(which, np.concatenate([t[i] for t in tables]), len(keys)) for i in range(1, 2 * K + 5)]
    total, pairs, followers, large = sums[0], np.array(sums[1 : K + 2]), np.array(sums[K + 2 : 2 * K + 3]), sums[-1]
    r = np.arange(1, K + 1)
    left = ((1 - discounts.bigram[1:]) * r) @ pairs[:K] + discounts.delta * pairs[K]
    lower = (discounts.unigram[1:] * r) @ followers[:K] + large - discounts.delta * followers[K]
    kept = discounts.kept(discounts.hot, discounts.unigram)
    for context, place in hot:
        lower += np.bincount(np.searchsorted(keys, np.cumsum(context)), kept[place], len(keys))
    return keys, (left / total) / (1 - lower / discounts.tokens)


def _scores(discounts: Discounts, folds: int, hot: np.ndarray):
    def finish(number: int, batch: pa.RecordBatch, answers: list[Row]) -> Iterator[pa.RecordBatch]:
        grams = Bigrams.of(batch, folds)
        answered = lambda kind, i: np.concatenate([np.empty(0, np.uint64), *(unpack(row[3])[i] for row in answers if row[2] == kind)]).astype(np.int64)
        of_word, pair = np.zeros(len(grams.words), np.int64), np.zeros(len(grams.follower), np.int64)
        cold = grams.cold(hot)  # parts ascending, so followers ascending
        of_word[grams.follower[cold[_starts(grams.follower[cold])]]] = answered(COUNTED, 0)
        pair[cold] = answered(COUNTED, 1)
        pair[grams.hot(hot)[0]] = answered(HOT_COUNTED, 0)
        here = np.isin(grams.words, hot)
        of_word[here] = discounts.hot[np.searchsorted(hot, grams.words[here])]
        starters = of_word[np.searchsorted(grams.words, END)]  # a start precedes as many tokens as there are ends
        of_context = np.where(grams.words == START, starters, of_word)
        alpha = np.ones(len(grams.words))
        weights = [unpack(row[3])[0] for row in answers if row[2] == ALPHAS]
        if weights:
            alpha[_wanted(grams)] = np.concatenate(weights)
        seen = discounts.kept(pair, discounts.bigram) / np.maximum(of_context[grams.context], 1)
        unseen = alpha[grams.context] * discounts.unigrams(of_word[grams.follower])
        logs = np.log10(np.where(pair > 0, seen, unseen))
        base = np.log10((of_word + BASE_ADD) / (discounts.tokens + BASE_ADD * (discounts.distinct + 1)))
        n = len(grams.held_out)
        word = grams.follower[grams.of_token]
        sums = [
            np.bincount(grams.text, minlength=n),
            np.bincount(grams.text, of_word[word] > 0, n).astype(np.int64),
            np.full(n, discounts.tokens),
            np.bincount(grams.text, base[word], n),
            np.bincount(grams.text, logs[grams.of_token], n),
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(grams.held_out), *map(pa.array, sums)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return finish


def _corpus_sums(counted: DataFrame, n_hot: int) -> list[int]:
    """The sums of all parts added up: a few numbers."""
    size = 4 + 2 * K + n_hot

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("data").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)) % size), pa.array(values)], names=["i", "n"])

    rows = counted.filter(F.col("kind") == SUMS).select("data").mapInArrow(decode, "i long, n long")
    found = {r.i: r.n for r in rows.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return [found.get(i, 0) for i in range(size)]


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Tables:
    """A trained model: tables at ``path``, partitioned by ranges of the following word and of the context."""

    path: str
    parts: int
    discounts: Discounts
    hot: np.ndarray

    def rows(self, spark: SparkSession, *kinds: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("kind").isin(*kinds))

    def bigrams(self, spark: SparkSession) -> DataFrame:
        """``context``, ``word`` (hashes; 0 begins and 1 ends a text), ``count`` and ``word_count``, one row per bigram."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    words, totals, runs, contexts, counts = unpack(data)
                    columns = [contexts, np.repeat(np.cumsum(words), runs), counts, np.repeat(totals, runs)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["context", "word", "count", "word_count"])

        hot, totals = self.hot, self.discounts.hot

        def spread_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    contexts, place, counts = unpack(data)
                    columns = [np.cumsum(contexts), hot[place], counts, totals[place]]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["context", "word", "count", "word_count"])

        schema = "context long, word long, count long, word_count long"
        return self.rows(spark, TABLE).select("data").mapInArrow(spread, schema).union(self.rows(spark, HOT_TABLE).select("data").mapInArrow(spread_hot, schema))

    def contexts(self, spark: SparkSession) -> DataFrame:
        """``context`` and its backoff weight ``alpha``."""
        discounts = self.discounts

        def weigh(part: int, rows: list[Row]) -> Iterator[Row]:
            yield part, -1, ALPHAS, pack(*context_weights(*_context_tables(rows), discounts))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    keys, values = unpack(data)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(values)], names=["context", "alpha"])

        return answer(self.rows(spark, CONTEXTS, HOT_CONTEXTS), self.parts, weigh).select("data").mapInArrow(spread, "context long, alpha double")


def train(spark: SparkSession, slices: DataFrame, path: str, folds: int = FOLDS) -> Tables:
    """Count all texts but those of fold 0 and write the tables, with the answers to the slices."""
    parts = part_count(spark, slices, SLICES_PER_PART)
    hot = hot_words(slices)
    counted = write_through(answer(ask(slices, _questions(parts, folds, hot)), parts, _add_up(parts, len(hot))), path)
    return Tables(path, parts, Discounts.of(_corpus_sums(counted, len(hot))), hot)


def score_texts(spark: SparkSession, docs: DataFrame, folds: int = FOLDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Train on all texts but fold 0 and score all texts."""
    root = shared_dir(spark)
    slices = make_slices(docs, f"{root}/slices", slice_bytes)
    model = train(spark, slices, f"{root}/tables", folds)
    weights = answer(model.rows(spark, WANTED, CONTEXTS, HOT_CONTEXTS), model.parts, _alphas(model.discounts))
    return gather(slices, model.rows(spark, COUNTED, HOT_COUNTED).union(weights), _scores(model.discounts, folds, model.hot), RESULT, per_task=2)


def score_others(spark: SparkSession, model: Tables, docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Score texts that the model was not trained on; all of them are held out."""
    slices = make_slices(docs, f"{shared_dir(spark)}/slices", slice_bytes)
    asked = write_through(ask(slices, _questions(model.parts, 0, model.hot)), f"{shared_dir(spark)}/questions")
    counts = asked.filter(F.col("kind").isin(COUNTS, HOT_COUNTS)).union(model.rows(spark, TABLE, HOT_TABLE))
    counted = answer(counts, model.parts, _add_up(model.parts, len(model.hot)))
    weights = answer(asked.filter(F.col("kind") == WANTED).union(model.rows(spark, CONTEXTS, HOT_CONTEXTS)), model.parts, _alphas(model.discounts))
    return gather(slices, counted.union(weights), _scores(model.discounts, 0, model.hot), RESULT, per_task=2)
