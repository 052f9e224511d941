"""The Katz model against a plain version with dictionaries, and its probabilities against one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarryline.llm import exchange, katz
from quarryline.session import shared_dir

from .test_text_operators import frame


def words(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)}).split(None) if (t or "").isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Plain:
    def __init__(self, rows):
        self.uni, self.bi = Counter(), Counter()
        for i, t in rows:
            if not held_out(i):
                seq = ["<s>", *words(t), "</s>"]
                self.uni.update(seq[1:])
                self.bi.update(zip(seq, seq[1:]))
        self.n = sum(self.uni.values())
        classes = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
        self.d1, self.d2 = katz.good_turing(classes(self.uni)), katz.good_turing(classes(self.bi))
        self.after = defaultdict(list)
        for v, w in self.bi:
            self.after[v].append(w)
        self.unknown = 1 - sum(self.p1(w) for w in self.uni)

    def cut(self, c, d):
        return d[c] * c if c <= katz.K else c - katz.DELTA

    def p1(self, w):
        return self.cut(self.uni[w], self.d1) / self.n if self.uni[w] else self.unknown

    def p2(self, w, v):
        total = sum(self.bi[v, x] for x in self.after[v])
        if c := self.bi[v, w]:
            return self.cut(c, self.d2) / total
        if not total:
            return self.p1(w)
        left = 1 - sum(self.cut(self.bi[v, x], self.d2) for x in self.after[v]) / total
        return left / (1 - sum(self.p1(x) for x in self.after[v])) * self.p1(w)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.randint(3, 60)]) for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    texts += ["hot pair " * 400, "only here now " * 30]
    return [*enumerate(texts), (900, None), (901, " \t\n"), (None, "w1 w2 nowhere"), (5, "a repeated id"), (5, "a repeated id")]


def test_scores_and_sums(spark, rows):
    rnd = random.Random(4)
    new = [(i, " ".join(rnd.choice(["w1", "never", "w5", "hot", "other"]) for _ in range(12))) for i in range(1000, 1200) if held_out(i)]
    all_rows = rows + new
    model = Plain(all_rows)
    want = []
    for i, t in all_rows:
        seq = ["<s>", *words(t), "</s>"]
        base = sum(math.log10((model.uni[w] + 0.1) / (model.n + 0.1 * (len(model.uni) + 1))) for w in seq[1:])
        score = sum(math.log10(model.p2(w, v)) for v, w in zip(seq, seq[1:]))
        want.append((str(i), held_out(i), len(seq) - 1, sum(model.uni[w] > 0 for w in seq[1:]), model.n, base, score))
    for size in (1 << 20, 700):
        got = [(str(r[0]), *r[1:]) for r in katz.score_texts(spark, frame(spark, all_rows).repartition(4), slice_bytes=size).collect()]
        assert len(got) == len(want)
        for a, b in zip(sorted(got), sorted(want)):
            assert a[:5] == b[:5]
            assert a[5:] == pytest.approx(b[5:], abs=1e-7)
    assert katz.score_texts(spark, frame(spark, [])).count() == 0
    alone = [i for i in range(100) if held_out(i)][0]
    assert [r.score for r in katz.score_texts(spark, frame(spark, [(alone, "nothing learnt")])).collect()] == [0.0]


def test_tables_and_other_texts(spark, rows):
    model = Plain(rows)
    root = shared_dir(spark)
    slices = exchange.make_slices(frame(spark, rows).repartition(3), f"{root}/slices", 900)
    tables = katz.train(spark, slices, f"{root}/tables")
    code = lambda w: {"<s>": 0, "</s>": 1}.get(w) if w in ("<s>", "</s>") else int(katz.word_hashes([w.encode()])[0][0])
    got = {(r.context, r.word): (r["count"], r.word_count) for r in tables.bigrams(spark).collect()}
    assert got == {(code(v), code(w)): (n, model.uni[w]) for (v, w), n in model.bi.items()}
    alphas = {r.context: r.alpha for r in tables.contexts(spark).collect()}
    assert set(alphas) == {code(v) for v in model.after}
    for v in ["<s>", "w1", "hot"]:
        assert alphas[code(v)] * model.unknown == pytest.approx(model.p2("never", v), rel=1e-9)
    new = [(1, "w1 w5 never hot pair"), (None, "only here"), (2, None)]
    seqs = {str(i): ["<s>", *words(t), "</s>"] for i, t in new}
    scored = {str(r.doc_id): r for r in katz.score_others(spark, tables, frame(spark, new)).collect()}
    for i, seq in seqs.items():
        assert scored[i].score == pytest.approx(sum(math.log10(model.p2(w, v)) for v, w in zip(seq, seq[1:])), abs=1e-7)
        assert (scored[i].n_tokens, scored[i].held_out, scored[i].train_tokens) == (len(seq) - 1, True, model.n)


@pytest.mark.parametrize("n", [0, 3, 1000])
def test_scores_do_not_depend_on_the_hot_words(spark, rows, monkeypatch, n):
    """No hot word but the end, a few, or all words: the same scores."""
    want = {(str(r.doc_id), r.n_tokens): tuple(r)[1:] for r in katz.score_texts(spark, frame(spark, rows)).collect()}
    chosen = katz.hot_words
    monkeypatch.setattr(katz, "hot_words", lambda slices: chosen(slices, n))
    got = {(str(r.doc_id), r.n_tokens): tuple(r)[1:] for r in katz.score_texts(spark, frame(spark, rows).repartition(5), slice_bytes=900).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:4] == v[:4] and got[k][4:] == pytest.approx(v[4:], abs=1e-9)


def test_probabilities_add_up_to_one(rows):
    model = Plain(rows)
    for v in ["<s>", "w1", "hot", "pair", "only", "never"]:
        assert sum(model.p2(w, v) for w in model.uni) + model.p2("never", v) == pytest.approx(1, abs=1e-12)


def test_packed_arrays_come_back():
    rnd = np.random.default_rng(1)
    arrays = [rnd.integers(0, 1 << 48, 1000).astype(np.uint64), np.empty(0, np.uint32), rnd.normal(size=7), np.array([True, False])]
    for a, b in zip(arrays, exchange.unpack(exchange.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
    keys = np.unique(arrays[0])
    assert (np.cumsum(exchange.deltas(keys)) == keys).all()
    edge = exchange.bounds(keys, 7)
    assert edge[0] == 0 and edge[-1] == len(keys)


def test_good_turing_falls_back_where_classes_are_uneven():
    assert all(0 < d < 1 for n in ([0] * 6, [5, 0, 0, 0, 0, 9], [9, 4, 2, 1, 1, 1], [1, 9, 0, 0, 3, 0]) for d in katz.good_turing(n)[1:])
