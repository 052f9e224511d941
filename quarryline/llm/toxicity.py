"""Toxicity by a convolutional text classifier, trained in numpy.

Words and their stems are hashed into buckets with embeddings, a word is the sum of its buckets; filters of several widths run over the whole text, each keeps its maximum, and a logistic
layer weighs the maxima. Training uses at most ``MAX_ROWS`` labelled ids (those with the smallest hash), one text of each, ``MAX_BYTES`` in all and none over ``MAX_TEXT``;
buckets that fewer than ``MIN_DOCS`` of these hold have no embedding and no effect. A threshold per language, with the language guessed from the
text's function words, is calibrated on training rows set aside; scores are shifted so that it lies at 0.5. Scores depend on the text alone.

Null and empty texts get the score of a text without known words. Labels are joined by id; a null id has no label and is not held out; the largest of
several labels of an id counts. With labels of one class only, or none, every score is a small constant or the class.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm import tokens
from quarryline.llm.batches import release, slices, text_rows

BUCKETS = 1 << 20
MAX_ROWS = 6000
#: Bytes of the training texts in all, and of the longest that is taken.
MAX_BYTES, MAX_TEXT = 64 << 20, 1 << 20
MIN_DOCS = 3
DIMS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
LEAST_STEPS = 900
BATCH = 32
RATE = 0.01
#: Rows behind each text: one that windows may begin at, as every text has one then, and others that they only end on; so no window reaches the next text.
PAD = max(WIDTHS)
#: Evidence of a bucket, as a root of a likelihood ratio, from which on it counts at the start of training.
SURE = 3.5
STEMS = (0, 4, 5, 6)
#: Text that is split into words at once, and embeddings that meet the filters at once.
SLICE_BYTES, TABLE_ROWS = 2 << 20, 1 << 14

_WORD_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

#: Function words that give away a language. Fixed values.
MARKERS = {
    "en": "the and of to is that it was for with as on be this are by at from or have not",
    "de": "der die das und ist nicht ein eine zu den mit von dem des auf im sich auch es an",
    "fr": "le la les et des est une dans pour qui que du pas sur avec il au ce par sont",
    "es": "el los las y un una por con para es del se no lo como pero su más al está",
}
LANGUAGES = ["?", *MARKERS]
_LANGUAGE_OF: dict[bytes, int] = {}
for _k, _name in enumerate(LANGUAGES[1:], 1):
    for _w in MARKERS[_name].split():
        _LANGUAGE_OF.setdefault(_w.encode(), _k)


def features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word: itself and its beginnings of 4, 5 and 6 letters, so that unseen forms of a known stem are near it."""
    text = word.decode("utf-8", "replace")
    return tuple(xxhash.xxh32_intdigest(f"{k}:{text[:k] if k else text}") % BUCKETS for k in STEMS)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each distinct word (one row per word, then two of -1); the row of every word, with the row before the last and then only the last
    behind each text, ``PAD`` in all; the start of each text; the guessed language of each."""
    words = [t.translate(_WORD_BYTES).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = len(words)
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    del words  # an object per word
    distinct = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy().astype(np.int64)
    buckets = np.array([*map(features, distinct), *[(-1,) * len(STEMS)] * 2], np.int64)
    marks = np.fromiter((_LANGUAGE_OF.get(w, 0) for w in distinct), np.int64, len(distinct))
    starts = np.cumsum(sizes + PAD) - (sizes + PAD)
    flat = np.full(int((sizes + PAD).sum()), len(distinct) + 1, np.int64)
    flat[starts + sizes] = len(distinct)
    doc = np.repeat(np.arange(n), sizes)
    flat[np.arange(len(index)) + PAD * doc] = index
    votes = np.bincount(doc * len(LANGUAGES) + marks[index], minlength=n * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    votes[:, 0] = 0
    return buckets, flat, starts, votes.argmax(axis=1)


@dataclass
class Model:
    """``known``: buckets with an embedding, ascending; row 0 of ``embedding`` is the zero of all others."""

    known: np.ndarray
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    shift: np.ndarray

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, buckets)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == buckets, at + 1, 0) if len(self.known) else np.zeros(len(buckets), np.int64)

    def responses(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """One column per filter: the response of the window that begins at each place."""
        part, out, slot = table[rows], np.zeros((len(rows), len(WIDTHS) * FILTERS), np.float32), 0
        for k, width in enumerate(WIDTHS):
            into = out[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                source = part[:, slot * FILTERS : (slot + 1) * FILTERS]
                into[: len(rows) - j] += source[j:]
                slot += 1
        return out

    def table(self) -> np.ndarray:
        """Every embedding times every place of every filter, so that scoring only looks up and adds; by blocks of rows, as the product is in doubles."""
        out = np.empty((len(self.embedding), self.filters.shape[1]), np.float32)
        for at in range(0, len(out), TABLE_ROWS):
            out[at : at + TABLE_ROWS] = self.embedding[at : at + TABLE_ROWS] @ self.filters
        return out

    def logits(self, buckets: np.ndarray, rows: np.ndarray, starts: np.ndarray, languages: np.ndarray, table: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        first, *others = buckets.T
        words = table[self.rows(first)]
        for column in others:
            words += table[self.rows(column)]
        table = words
        out = np.empty(len(starts))
        ends = np.append(starts[1:], len(rows))
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
            best = np.full((stop - at, len(self.bias)), -np.inf, np.float32)
            for a in range(int(starts[at]), int(ends[stop - 1]), block):  # a longer text comes in overlapping parts
                b = min(a + block, int(ends[stop - 1]))
                got = self.responses(rows[a : min(b + PAD, int(ends[stop - 1]))], table)[: b - a]
                got[rows[a:b] == len(table) - 1] = -np.inf
                first = np.maximum(starts[at:stop], a) - a
                inside = (starts[at:stop] < b) & (ends[at:stop] > a)
                best[inside] = np.maximum(best[inside], np.maximum.reduceat(got, first[inside], axis=0))
            out[at:stop] = np.maximum(best + self.bias, 0) @ self.weights + self.offset
            at = stop
        return out - self.shift[languages]


def constant(logit: float) -> Model:
    n = len(WIDTHS) * FILTERS
    return Model(np.empty(0, np.int64), np.zeros((1, DIMS)), np.zeros((DIMS, sum(WIDTHS) * FILTERS)), np.zeros(n), np.zeros(n), logit, np.zeros(len(LANGUAGES)))


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors; in the middle of the best gap."""
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(1 - y)])[::-1][0] - np.concatenate([[0], np.cumsum(1 - y)])
    edges = np.concatenate([[x[0] - 2], (x[1:] + x[:-1]) / 2, [x[-1] + 2]])
    usable = np.concatenate([[True], x[1:] > x[:-1], [True]])
    errors = np.where(usable, errors, len(y) + 1)
    best = np.flatnonzero(errors == errors.min())
    gaps = np.concatenate([[0], x[1:] - x[:-1], [0]])
    return float(edges[best[np.argmax(gaps[best])]])


def evidence(positives: np.ndarray, counts: np.ndarray, rate: float) -> np.ndarray:
    """Signed root of the likelihood ratio: how far the share of positive texts among those with a bucket is from the overall rate."""
    negatives = counts - positives
    part = lambda n, expected: n * np.log(np.maximum(n, 1) / expected)
    ratio = 2 * (part(positives, counts * rate) + part(negatives, counts * (1 - rate)))
    return np.sign(positives - counts * rate) * np.sqrt(np.maximum(ratio, 0))


@dataclass
class Sample:
    """Labelled texts: ``words`` has the buckets of each distinct word, ``texts`` the words of each text as rows of it."""

    words: np.ndarray
    texts: list[np.ndarray]
    labels: np.ndarray
    languages: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> Sample:
        """From rows of ``doc_id``, ``toxic`` and ``text``, in ascending order of id."""
        parts, texts, base = [np.empty((0, len(STEMS)), np.int64)], [], 0
        for batch in slices(batches, limit=SLICE_BYTES):
            buckets, flat, starts, languages = hashed_words(batch.column("text").to_pylist())
            ends = np.append(starts[1:], len(flat)) - PAD
            ids, toxic = (batch.column(c).to_pylist() for c in ("doc_id", "toxic"))
            texts += [(i, y, k, (flat[a:b] + base).astype(np.int32)) for i, y, k, a, b in zip(ids, toxic, languages.tolist(), starts, ends, strict=True)]
            parts.append(buckets[:-2])
            base += len(buckets) - 2
        texts.sort(key=lambda t: (t[0], len(t[3])))
        every = np.ascontiguousarray(np.concatenate(parts).astype(np.int32)).view(f"V{4 * len(STEMS)}").ravel()
        words, place = np.unique(every, return_inverse=True)
        words = words.view(np.int32).reshape(-1, len(STEMS)).astype(np.int64)
        return cls(words, [place[t[3]].astype(np.int32) for t in texts], np.array([t[1] for t in texts], np.int64), np.array([t[2] for t in texts], np.int64))


def gradients(model: Model, parts: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weighted mean logistic loss of some texts, which are rows of ``parts`` (embedding rows of each word) with padding behind.

    The gradient of the embedding has the rows that the second result names; the others are zero. Only the window with the largest response of a filter counts.
    """
    slots, n_filters = np.concatenate([[0], np.cumsum(WIDTHS)]), len(WIDTHS) * FILTERS
    rows = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    seen, local = np.unique(rows, return_inverse=True)
    vectors = model.embedding[parts[seen]].sum(axis=1)
    got = model.responses(local, (vectors @ model.filters).astype(np.float32))
    got[rows == len(parts) - 1] = -np.inf
    top = np.stack([a + got[a : a + n].argmax(axis=0) for a, n in zip(starts, sizes, strict=True)])
    peak = got[top, np.arange(n_filters)] + model.bias
    active = np.maximum(peak, 0)
    p = 1 / (1 + np.exp(-(active @ model.weights + model.offset)))
    delta = (p - labels) * weight / len(texts)
    grad_peak = np.where(peak > 0, delta[:, None] * model.weights, 0)
    grad = {"offset": delta.sum(), "weights": active.T @ delta, "bias": grad_peak.sum(axis=0), "filters": np.zeros_like(model.filters), "embedding": np.zeros((len(seen), DIMS))}
    touched = [np.empty(0, np.int64)]
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        for j in range(width):
            where = np.minimum(top[:, own] + j, len(rows) - 1)
            columns = (slots[k] + j) * FILTERS + np.arange(FILTERS)
            g = grad_peak[:, own]
            grad["filters"][:, columns] += np.einsum("bfd,bf->df", vectors[local[where]], g)
            touched.append(local[where].ravel())
            np.add.at(grad["embedding"], local[where].ravel(), (g[:, :, None] * model.filters[:, columns].T[None]).reshape(-1, DIMS))
    mine = np.unique(np.concatenate(touched))
    at, where = np.unique(parts[seen[mine]].ravel(), return_inverse=True)
    summed = np.zeros((len(at), DIMS))
    np.add.at(summed, where, np.repeat(grad["embedding"][mine], len(STEMS), axis=0))
    grad["embedding"] = summed
    return grad, at


def fit(sample: Sample, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Train by Adam; every fifth row is set aside for the thresholds."""
    words, texts, labels, languages = sample.words, sample.texts, sample.labels, sample.languages
    positive = int(labels.sum())
    if positive == 0 or positive == len(labels):
        return constant(float(np.log((positive + 1) / (len(labels) - positive + 20))))
    rnd = np.random.default_rng(seed)
    every = np.arange(len(labels))
    aside = every % 5 == 4
    if len(labels) < 200 or not 0 < labels[~aside].sum() < (~aside).sum():
        aside[:] = False
    use = every[~aside]
    counts, positives = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for i in use:  # text by text: the buckets of all texts together would be the most that training holds
        own = np.unique(words[np.unique(texts[i])])
        counts[own] += 1
        positives[own] += labels[i]
    buckets = np.flatnonzero(counts)
    counts, positives = counts[buckets], positives[buckets]
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(use)))
    known = buckets[counts >= min(MIN_DOCS, len(use))]
    n_filters = len(WIDTHS) * FILTERS
    signs = evidence(positives, counts, float(labels[use].mean()))[np.isin(buckets, known)]
    model = Model(
        known,
        np.vstack([np.zeros(DIMS), rnd.normal(0, 0.03, (len(known), DIMS))]),
        rnd.normal(0, 0.3, (DIMS, sum(WIDTHS) * FILTERS)),
        np.zeros(n_filters),
        rnd.normal(0, 0.3, n_filters),
        float(np.log(labels[use].mean() / (1 - labels[use].mean()))),
        np.zeros(len(LANGUAGES)),
    )
    # The first dimension and the first filter begin with what single words say, so that few labels are enough to start from.
    model.embedding[1:, 0] = np.clip((signs - SURE) / SURE, -0.5, 1.5)
    model.filters[:, 0] = 0
    model.filters[0, 0] = 2.0
    model.weights[0] = 1.0
    parts = np.vstack([model.rows(words.ravel()).reshape(words.shape), np.zeros((2, len(STEMS)), np.int64)])  # embedding rows of each word
    pad = np.array([len(words), *[len(words) + 1] * (PAD - 1)], np.int32)
    padded = [np.concatenate([t, pad]) for t in texts]
    state = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in ("embedding", "filters", "bias", "weights")}
    weight = np.where(labels == 1, 0.5 / labels[use].mean(), 0.5 / (1 - labels[use].mean()))
    step = 0
    for _ in range(epochs):
        for chosen in np.array_split(rnd.permutation(use), max(1, len(use) // BATCH)):
            step += 1
            grad, at = gradients(model, parts, [padded[i] for i in chosen], labels[chosen], weight[chosen])
            model.offset -= RATE * float(grad.pop("offset"))
            for name, g in grad.items():
                first, second = state[name]
                part = at if name == "embedding" else slice(None)
                first[part] = 0.9 * first[part] + 0.1 * g
                second[part] = 0.999 * second[part] + 0.001 * g * g
                move = RATE * (first[part] / (1 - 0.9**step)) / (np.sqrt(second[part] / (1 - 0.999**step)) + 1e-8)
                getattr(model, name)[part] -= move
            model.embedding[0] = 0
    table = model.table()
    judge = every[aside] if aside.any() else use
    flat = np.concatenate([padded[i] for i in judge])
    sizes = np.array([len(padded[i]) for i in judge])
    seen, flat = np.unique(flat, return_inverse=True)  # padding stands last in both
    logits = model.logits(np.vstack([words, np.full((2, len(STEMS)), -1)])[seen], flat, np.cumsum(sizes) - sizes, languages[judge], table)
    overall = _threshold(logits, labels[judge])
    model.shift[:] = overall
    for k in range(len(LANGUAGES)):
        own = languages[judge] == k
        if labels[judge][own].sum() >= 10 and (1 - labels[judge][own]).sum() >= 10:
            model.shift[k] = _threshold(logits[own], labels[judge][own])
    model.known, model.embedding = model.known.astype(np.int32), model.embedding.astype(np.float32)
    return model


def id_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_ROWS, seed: int = 7, max_bytes: int = MAX_BYTES, max_text: int = MAX_TEXT) -> Model:
    """Fit on at most ``max_rows`` labelled ids outside fold 0, one text of each, of ``max_bytes`` in all; texts over ``max_text`` bytes are not taken.

    The bounded sample meets in one task, which trains; only the model comes to the driver. Of several texts of an id the one with the smallest MD5 is taken.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    usable = known.filter(id_fold("doc_id", folds) != 0).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    sample = usable.orderBy(*order).limit(max_rows)
    keyed = text_rows(docs).withColumn("md5", F.md5("text"))
    sized = keyed.join(F.broadcast(sample), "doc_id").filter(F.octet_length("text") <= max_text).select("doc_id", "toxic", F.struct("md5", F.octet_length("text").alias("bytes")).alias("t"))
    one = sized.groupBy("doc_id").agg(F.min("t").alias("t"), F.max("toxic").alias("toxic"))
    so_far = F.sum("t.bytes").over(Window.orderBy(*order))  # over max_rows rows of numbers at most
    chosen = one.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).select("doc_id", "toxic", F.col("t.md5").alias("md5"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        sample = Sample.of(batches)
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample, seed))], pa.binary())], names=["model"])

    rows = keyed.join(F.broadcast(chosen), ["doc_id", "md5"]).dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else constant(float(np.log(1 / 20)))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row``, the columns of ``docs`` as a struct, whatever their names, and ``score``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    inside = isinstance(docs.schema[at].dataType, T.StringType)  # then a text is sent once, in its row
    texts = docs.select(F.struct(*docs.columns).alias("row"), *([] if inside else [F.col("text").cast("string").alias("text")]))

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.struct_field(batch.column("row"), [at]) if inside else batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pc.fill_null(own, "").cast(pa.binary())], names=["row", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        table = shared.value.table()
        for batch in slices(with_text(batches), limit=SLICE_BYTES):
            logits = shared.value.logits(*hashed_words(batch.column("text").to_pylist()), table)
            values = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values)], names=["row", "score"])

    return texts.mapInArrow(run, T.StructType([texts.schema["row"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with their score in column ``into``; an input column of that name is replaced."""
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != into]
    return _scored(docs, model).select(*kept, F.col("score").alias(into))


def reject(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't call toxic, with their columns as they were."""
    return _scored(docs, train(docs, labels, folds, max_rows)).filter("score < 0.5").select("row.*")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id``, ``held_out`` (the fold that training never saw), ``score`` and ``predicted``."""
    model = train(docs, labels, folds, max_rows)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held = F.coalesce(id_fold("doc_id", folds) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
