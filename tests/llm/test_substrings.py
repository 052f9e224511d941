"""Removal of repeated substrings against counts of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import parsing, substrings
from quarryline.llm.queries import op2_repeated_substrings

from .test_text_operators import frame, sha


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((str(i), len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def text(rnd, n, alphabet="abcdefghij klmnop\u00e9"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    passages = [text(rnd, n) for n in (199, 200, 201, 260, 500, 1200)]
    rows = []
    for i in range(60):
        parts = [text(rnd, rnd.randint(0, 400)) for _ in range(3)]
        for p in passages:
            if rnd.random() < 0.25:
                at = rnd.randint(0, len(p) // 2)
                parts.append(rnd.choice([p, p[at:], p[:-at] if at else p, p[:100] + "#" + p[100:]]))
        rnd.shuffle(parts)
        rows.append((i, "".join(parts)))
    base = text(rnd, 3000)
    for i in range(8):  # near copies
        copy = list(base)
        for _ in range(i):
            copy[rnd.randrange(3000)] = "#"
        rows.append((200 + i, "".join(copy)))
    rows += [(300, "ab" * 700), (301, "x" * 205), (302, "x" * 199), (303, "y" * 200), (304, text(rnd, 40_000) + passages[5]), (305, text(rnd, 199))]
    return [*rows, (400, None), (401, ""), (None, passages[3]), (304, "twice"), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize(("length", "size", "crowd"), [(200, 1 << 20, 1000), (200, 9000, 1000), (60, 20_000, 3), (200, 9000, 2)])
def test_removed_bytes(spark, rows, length, size, crowd):
    got = substrings.remove_repeats(spark, frame(spark, rows).repartition(5), length, size, crowd).collect()
    want = plain(rows, length)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark, frame(spark, [])).count() == 0


def test_query_on_a_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {str(r.doc_id): tuple(r)[1:] for r in op2_repeated_substrings(spark, sf_dir).collect()}
    assert got == {r[0]: (*r[1:4], sha(r[4])) for r in plain(docs, 200)}


def test_triggers_are_the_leftmost_smallest():
    rnd = np.random.default_rng(2)
    values = rnd.integers(0, 12, 400).astype(np.uint64) << np.uint64(40)
    got = substrings.triggers(values, 37)
    assert got.tolist() == [i + int(values[i : i + 37].argmin()) for i in range(len(values) - 36)]


@pytest.mark.parametrize("seed", range(12))
def test_corpus_order_is_that_of_a_plain_sort(seed):
    """The order from dictionary and parse, and the bytes that neighbours share, on repetitive texts."""
    rnd = random.Random(seed)
    alphabet = rnd.choice(["ab", "abc\0", "abcdefgh ", "\u00ff\0a"])
    base = text(rnd, rnd.randint(1, 400), alphabet)
    texts = []
    for _ in range(rnd.randint(0, 9)):
        a, b = sorted(rnd.choices(range(len(base) + 1), k=2))
        texts.append((base[a:b] + text(rnd, rnd.randint(0, 20), alphabet)).encode())
    texts += [b"", b"a" * rnd.randint(0, 300), *texts[:1]]
    want = sorted((t[o:], i, o) for i, t in enumerate(texts) for o in range(len(t)))
    got = parsing.corpus_order(texts)
    assert [x[:2] for x in got] == [x[1:] for x in want]
    for (one, _, _), (two, _, _), (_, _, common) in zip(want, want[1:], got[1:]):
        assert common == next((k for k, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))


def test_repetitive_text_has_a_small_dictionary():
    """A passage in a thousand texts is one entry per phrase; windows are the same as those of brute force."""
    rnd = random.Random(8)
    passage = text(rnd, 2000)
    texts = [(text(rnd, 30) + passage).encode() for _ in range(1000)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    parsed = parsing.Parsing.of(np.frombuffer(b"".join(texts), np.uint8), ends)
    assert len(parsed.keys) < 100_000 < ends[-1]


def test_chunks_of_core_groups(spark, rows, monkeypatch):
    """Parts that are parsed piece by piece give the same windows."""
    monkeypatch.setattr(substrings, "PARSED_BYTES", 1)
    rnd = np.random.default_rng(3)
    texts = [rnd.integers(97, 99, n).astype(np.uint8) for n in rnd.integers(20, 30, 60)]
    core = np.sort(rnd.integers(0, 9, 60).astype(np.uint64))
    columns = [[substrings.deltas(core[a:b]), np.ones(b - a, np.uint8), np.array([len(t) for t in texts[a:b]], np.uint32), np.concatenate(texts[a:b])] for a, b in ((0, 25), (25, 60))]
    got = np.concatenate(substrings._sorted(columns, 8))
    want = []
    for t, c in zip(texts, core):
        for i in range(len(t) - 7):
            same = sum(bytes(t[i : i + 8]) == bytes(u[j : j + 8]) for u, d in zip(texts, core) if c == d for j in range(len(u) - 7))
            want.append(same > 1)
    assert got.tolist() == want
