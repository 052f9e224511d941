"""The convolutional classifier in plain Python: its forward pass, its gradients by finite differences, and what its wider filters add."""

import math
import random

import numpy as np
import pytest

from quarryline.llm import toxicity

from .test_text_operators import frame


@pytest.fixture(scope="module")
def model():
    rnd = np.random.default_rng(4)
    known = np.unique(np.concatenate([np.array(toxicity.features(w)) for w in (b"alpha", b"beta", b"gamma", b"delta", b"rain")]))
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    embedding = np.vstack([np.zeros(toxicity.DIMS), rnd.normal(0, 0.5, (len(known), toxicity.DIMS))])
    filters = rnd.normal(0, 0.5, (toxicity.DIMS, sum(toxicity.WIDTHS) * toxicity.FILTERS))
    return toxicity.Model(known, embedding, filters, rnd.normal(0, 0.3, n), rnd.normal(0, 0.5, n), 0.2, np.zeros(len(toxicity.LANGUAGES)))


def vector(model, word):
    out = np.zeros(toxicity.DIMS)
    for bucket in toxicity.features(word):
        at = np.flatnonzero(model.known == bucket)
        if len(at):
            out += model.embedding[at[0] + 1]
    return out


def plain_logit(model, text):
    """A loop over words, places and filters; windows at the end of a text go on with zeros, and the last one is zeros only."""
    words = text.lower().encode().split()
    vectors = [vector(model, w) for w in words] + [np.zeros(toxicity.DIMS)] * max(toxicity.WIDTHS)
    total, slot = model.offset, 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -math.inf
            for at in range(len(words) + 1):
                window = vectors[at : at + width]
                best = max(best, sum(float(v @ model.filters[:, (slot + j) * toxicity.FILTERS + f]) for j, v in enumerate(window)))
            total += max(best + model.bias[k * toxicity.FILTERS + f], 0) * model.weights[k * toxicity.FILTERS + f]
        slot += width
    return total


def texts():
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "rain", "unknown", "Alphabet"]
    return ["", "alpha", "beta gamma", *(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(30))]


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_forward_pass(model, block):
    """Scores of whole texts, in one piece or in overlapping ones."""
    got = model.logits(*toxicity.hashed_words([t.encode() for t in texts()]), model.table(), block)
    assert got == pytest.approx([plain_logit(model, t) for t in texts()], abs=1e-4)


def test_scores_do_not_depend_on_neighbours(model):
    alone = [float(model.logits(*toxicity.hashed_words([t.encode()]), model.table())[0]) for t in texts()]
    assert model.logits(*toxicity.hashed_words([t.encode() for t in texts()][::-1]), model.table())[::-1] == pytest.approx(alone, abs=1e-5)


def test_gradients_by_finite_differences(model):
    words = [b"alpha", b"beta", b"gamma", b"delta", b"rain"]
    buckets = np.array([toxicity.features(w) for w in words])
    parts = np.vstack([model.rows(buckets.ravel()).reshape(buckets.shape), np.zeros((2, len(toxicity.STEMS)), np.int64)])
    pad = [len(words), *[len(words) + 1] * (toxicity.PAD - 1)]
    rows = [np.array([0, 1, 2, 0, *pad]), np.array([3, 4, *pad]), np.array([2, 1, *pad])]
    labels, weight = np.array([1, 0, 1]), np.array([1.0, 0.5, 2.0])
    named = [" ".join(words[i].decode() for i in r[: -toxicity.PAD]) for r in rows]

    def loss():
        p = [1 / (1 + math.exp(-plain_logit(model, t))) for t in named]
        return sum(-w * (y * math.log(q) + (1 - y) * math.log(1 - q)) for q, y, w in zip(p, labels, weight)) / len(rows)

    grad, at = toxicity.gradients(model, parts, rows, labels, weight)
    rnd = np.random.default_rng(2)

    def slope(array, place, step=1e-5):
        kept = array[place]
        array[place] = kept + step
        high = loss()
        array[place] = kept - step
        low = loss()
        array[place] = kept
        return (high - low) / (2 * step)

    for name in ("weights", "bias", "filters"):
        array = getattr(model, name)
        for _ in range(12):
            place = tuple(int(rnd.integers(n)) for n in array.shape)
            assert grad[name][place] == pytest.approx(slope(array, place), abs=1e-4)
    for i in rnd.choice(len(at), 10):
        if at[i]:  # row 0 stays zero
            j = int(rnd.integers(toxicity.DIMS))
            assert grad["embedding"][i, j] == pytest.approx(slope(model.embedding, (at[i], j)), abs=1e-4)


def test_wider_filters_see_what_single_words_do_not(spark):
    """Every text has both words; only side by side they count. Without evidence of single words the wider filters have to learn it."""
    rnd = random.Random(5)
    filler = [f"w{i}" for i in range(40)]

    def text(toxic):
        words = [rnd.choice(filler) for _ in range(20)]
        at = rnd.randrange(1, 9)
        return " ".join([*words[:at], *(["bad", "dog"] if toxic else ["dog"]), *words[at:], *([] if toxic else ["bad"]), rnd.choice(filler)])

    rows = [(i, text(i % 2)) for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    got = [r for r in toxicity.classify(frame(spark, rows), labels).collect() if r.held_out]
    assert len(got) > 100 and sum(r.predicted == r.doc_id % 2 for r in got) >= 0.9 * len(got)


def test_training_sample_is_bounded(spark, monkeypatch):
    """One text of an id, however often it occurs, none that is too long, and no more bytes than allowed."""
    rows = [(i, "calm " + "abcdefghij"[i % 10] * 5) for i in range(50)] * 3 + [(60, "long " * 1000), (61, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, toxic int")
    sizes = {}
    for limit in (1 << 20, 120):
        model = toxicity.train(frame(spark, rows).repartition(4), labels, max_bytes=limit, max_text=1000)
        sizes[limit] = len(model.known)
    assert 4 < sizes[120] < sizes[1 << 20]
