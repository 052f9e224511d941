"""Operators against plain brute-force versions of their contracts."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from quarryline.llm import decontam, lines, pii, quality, queries, simhash
from quarryline.operators import linking

BL = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def frame(spark, rows):
    """Documents with nulls everywhere and extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, None, "x", 7) for i, t in rows], "doc_id long, text string, lang string, source string, spans string, n_words int")


def corpus():
    rnd = random.Random(11)
    shared = ["this line is shared by several documents of the corpus %d" % i for i in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(rnd.choice(["ab", "cd", "ef", "Gh", "éé", "x1"]) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(0, 6))]
        parts += [("  " + s.upper() + "\t") if rnd.random() < 0.3 else s for s in shared if rnd.random() < 0.12 + 0.1 * (s[-1] == "1")]
        rnd.shuffle(parts)
        rows.append((i * 2, "\n".join(parts)))
    return [*rows, (201, None), (203, ""), (205, "\n\n"), (207, "é" * 39 + "\n" + "é" * 40), (209, "same same same same " * 3000), (None, "no id")]


def test_line_dedup(spark):
    rows = corpus() + [(300 + i, "é" * 40) for i in range(5)]
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BL))
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(fold(x)) >= 40:
                where[fold(x)].add(-1 if i is None else i)
    want = {}
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(w := where.get(fold(x), ())) >= 5 and max(w) != i)]
        want[i] = (len(ls), len(ls) - len(keep), "\n".join(keep))
    assert sum(v[1] for v in want.values()) > 10
    for bits, size in ((16.0, 4 << 20), (0.5, 500)):  # filters that are far too small, and many slices, give the same
        got = lines.dedup_lines(spark, frame(spark, rows).repartition(5), bits_per_line=bits, slice_bytes=size)
        assert got.columns[:6] == ["doc_id", "text", "lang", "source", "spans", "n_words"]
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == want
    assert lines.dedup_lines(spark, frame(spark, [])).count() == 0


def base_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_pii(spark):
    rnd = random.Random(2)
    bits = ["a.b@c.de", "@", "x@y", "x@y.z@q.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4012888888881881", "1234567 ", "+1 (017) 555-7713", "+12", "é", " ", " ", "\n", "-", ".", "word", "++1 234 567 8901"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    texts += ["call 98079157628 +1 (974) 555-3436 and IBAN GB82 WEST 1234 5698 7654 32 now", "12345678 4111111111111111 12345678", None, "", "1" * 50_000, "a" * 50_000 + "@"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(frame(spark, rows))).collect()}
    for i, t in rows:
        want = base_pii(t or "") if len(t or "") < 40_000 else []
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (got[i].base_sha256, [got[i][f"n_{k}"] for k in pii.BASE_KINDS]) == (sha(written), [sum(s[0] == k for s in want) for k in pii.BASE_KINDS])
        assert set(filter(None, written.split(","))) <= set(got[i].spans.split(","))
    kinds = {s.split(":")[0] for s in got[300].spans.split(",")}
    assert "iban" in kinds and "card" in {s.split(":")[0] for s in got[301].spans.split(",")}
    assert pii.redact(frame(spark, [(1, "mail a@b.cd now")])).first().text == "mail [email] now"
    assert pii.find_pii(frame(spark, [])).count() == 0


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def added_pii(text):
    """The spans that the method adds, from its rules: candidates in their order, each kept if no character of it is taken and its score is enough."""
    taken = {i for _, a, b in base_pii(text) for i in range(a, b)}
    context = {"card": ("card", "credit", "visa"), "phone": ("call", "phone"), "iban": ("iban", "bank", "account"), "ssn": ("ssn",)}
    score = {"card": 20, "phone": 30, "iban": 10, "ssn": 20}
    out = []

    def offer(kind, a, b, checked):
        sides = (text[max(0, a - 40) : a].lower(), text[b : b + 40].lower())
        points = score[kind] + 50 * checked + 30 * any(w in side for w in context[kind] for side in sides)
        if points >= 50 and not taken & set(range(a, b)):
            out.append((kind, a, b))
            taken.update(range(a, b))

    failed = [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)] + [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)]
    for kind, m in failed:
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "card" and len(digits) > 14 and not (len(digits) <= 19 and plain_luhn(digits)):
            groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
            i = 0
            while i < len(groups):
                whole = [(j, re.sub("[^0-9]", "", text[groups[i][0] : groups[j][1]])) for j in range(i, len(groups))]
                good = next((j for j, d in whole if 14 <= len(d) <= 19 and plain_luhn(d)), None)
                if good is not None:
                    offer("card", groups[i][0], groups[good][1], True)
                i = i + 1 if good is None else good + 1
        if kind == "phone" and len(digits) > 15:
            first = re.match(r"\+[0-9]{1,3}[ .-]?(\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", m[0])
            if first:
                offer("phone", m.start(), m.start() + first.end(), 10 <= len(re.sub("[^0-9]", "", first[0])) <= 15)
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        code = m[0].replace(" ", "")
        moved = code[4:] + code[:4]
        number = "".join(c if c.isdigit() else str("ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c) + 10) for c in moved)
        if 15 <= len(code) <= 34 and int(number) % 97 == 1:
            offer("iban", m.start(), m.end(), True)
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        offer("ssn", m.start(), m.end(), False)
    for m in re.finditer(r"(?<![0-9+])(\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            offer("phone", m.start(), m.end(), False)
    return out


def test_added_spans_equal_plain_rules(spark):
    """Every added kind with and without its context, next to base spans and inside longer runs."""
    rnd = random.Random(11)
    bits = ["4111 1111 1111 1111", "12345678 4111111111111111 12345678", "4111 1111 1111 1112 9", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 33", "123-45-6789", "030-1234-5678", "(030) 123 4567",
            "+1 212 555 0100 212 555 0100", "+49 30 123456 7890 1234 99", "card", "Call me", "IBAN", "ssn:", "bank account", "a@b.cd", "10.0.0.1", "word", "plain words that go on for more than forty characters in all", ",", " ", "\n"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))) for _ in range(500)]
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans if not s["base"]] for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        want = added_pii(t)
        assert sorted(got[i]) == sorted(want), t
        kinds |= {k for k, _, _ in want}
    assert kinds == {"card", "phone", "iban", "ssn"}


def brute_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(hit)


def test_quality_counts_and_verdicts(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    rows = corpus()
    clean = [(1000 + i, "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 12))) for _ in range(rnd.randint(8, 30)))) for i in range(200)]
    junk = [(5000, " ".join("abc***" for _ in vocabulary[:30]) + " " + " ".join(f"{w}&&&" for w in vocabulary[:300]))]
    got = {r.doc_id: r for r in quality.judge(spark, frame(spark, rows + clean + junk).repartition(3)).collect()}
    for i, t in rows + clean + junk:
        r = got[i]
        n, chars, symbols, dup, rep = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
    assert all(got[i].kept for i, _ in clean) and not got[5000].kept and not got[5000].base_failed
    assert quality.judge(spark, frame(spark, [])).count() == 0
    assert [r.kept for r in quality.judge(spark, frame(spark, [(1, None), (1, None)])).collect()] == [False, False]


def test_one_moderate_outlier_per_statistic(spark):
    rnd = random.Random(12)
    word = lambda least, most: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(least, most)))
    vocabulary = [word(2, 8) for _ in range(5000)]
    line = lambda n=0: " ".join(rnd.choice(vocabulary) for _ in range(n or rnd.randint(5, 12)))
    text = lambda n: "\n".join(line() for _ in range(n))
    clean = [(i, text(rnd.randint(8, 30))) for i in range(400)]
    marked = lambda c, share: " ".join(w + c * (rnd.random() < share) for w in text(20).split(" "))
    phrases = [line(4) for _ in range(9)]
    outliers = {
        "log_words": text(220),
        "word_length": "\n".join(" ".join(word(5, 8) for _ in range(8)) for _ in range(20)),
        "symbols": marked("#", 0.12),
        "dup_lines": "\n".join(x for i in range(16) for x in (line(), phrases[i % 2][:3] + " x")),
        "repeats": "\n".join(f"{line(7)} {phrases[i % 9]} {line(1)}" for i in range(18)),
        "upper": "".join(c.upper() if rnd.random() < 0.12 else c for c in text(20)),
        "marks": marked("!", 0.35),
    }
    assert list(outliers) == list(quality.FLOORS)
    rows = clean + [(1000 + k, t) for k, t in enumerate(outliers.values())]
    got = {r.doc_id: r for r in quality.judge(spark, frame(spark, rows).repartition(3)).collect()}
    assert not any(got[1000 + k].base_failed for k in range(len(outliers)))
    assert [name for k, name in enumerate(outliers) if got[1000 + k].kept] == []
    assert sum(got[i].kept for i, _ in clean) >= 0.98 * len(clean)


def brute_decontamination(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(k))
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if names := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= names
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "b", "Cc", "dé"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([0, 3, 12, 13, 14, 20, 40])))) for k in range(14)] + [(99, None), (7, "b b b b b b b b b b b b b b b b b"), (3, "...")]
    docs = [(i, ", ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    docs += [(100 + k, f"x y z {t} w\n{t}") for k, (_, t) in enumerate(items)] + [(200, None), (201, "b " * 3000), (200, "a")]
    d = frame(spark, docs).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(d, b, block_bytes=block)
    rows = found.select("doc_id", "n_words", "n_hit", decontam.F.size("items").alias("n"), decontam.item_hash().alias("h"), "contaminated").collect()
    want = brute_decontamination(docs[:-3] + [docs[-2]], items)
    assert {r[0]: tuple(r)[1:] for r in rows if r[0] != 200} == {k: v for k, v in want.items()}
    assert sorted(r.n_words for r in rows if r.doc_id == 200) == [0, 1]
    assert decontam.contamination(frame(spark, []), b).count() == 0
    assert decontam.contamination(d, b.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_repeated_words_stay_linear():
    """An item of a word a thousand times and a document of it 200,000 times: places grow with the document, not with the product."""
    import tracemalloc

    import pyarrow as pa

    tests = decontam.TestSet([("5", b"same " * 1000), ("6", b"same " * 13)])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"same " * 200_000], pa.binary())], names=["doc_id", "text"])
    tracemalloc.start()
    hits = decontam.Hits(batch, tests, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hits.at) == 200_000 - 12 and set(hits.length.tolist()) == {13} and peak < 200 << 20
    assert hits.pairs.tolist() == [[0, 0], [0, 1]]


@pytest.mark.parametrize("block", [1 << 20, 90])
def test_matches_equal_brute_force(spark, block):
    """The longest match with any item's text from every word where a window of an item begins, unless it is the rest of the match from the word before; per block."""
    rnd = random.Random(21)
    word = lambda: rnd.choice("abc")
    items = [(k, [word() for _ in range(rnd.choice([2, 4, 13, 30]))]) for k in range(9)]
    docs = [(i, [word() for _ in range(rnd.randint(0, 12))] + items[i % 9][1][rnd.randint(0, 3) :] + ["c", "zz"] * (i % 2) + items[(i * 5) % 9][1]) for i in range(12)]
    docs.append((50, ["a"] * 40))
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    rows = decontam.matches(frame(spark, [(i, " ".join(t)) for i, t in docs]).repartition(3), b, block_bytes=block).collect()
    text, item = dict(docs), {str(k): t for k, t in items}
    got = {}
    for r in rows:
        a, t = text[r.doc_id][r.word :], item[r.item_id][r.item_word :]
        assert a[: r.length] == t[: r.length] and (a[r.length : r.length + 1] or [0]) != (t[r.length : r.length + 1] or [1])
        got[r.doc_id, r.word] = max(r.length, got.get((r.doc_id, r.word), 0))
    want, windows = {}, {}
    for i, t in docs:
        for at in range(len(t)):
            lengths = []
            for _, u in items:
                n = min(13, len(u))
                for k in range(len(u)):
                    size = next((x for x, (p, q) in enumerate(zip(t[at:], u[k:])) if p != q), min(len(t) - at, len(u) - k))
                    lengths.append((size, size >= n and k <= len(u) - n))
                    windows[i, at] = max(windows.get((i, at), 0), n * lengths[-1][1])
            if any(full for _, full in lengths):
                want[i, at] = max(size for size, _ in lengths)
    fresh = {(i, at): size for (i, at), size in want.items() if want.get((i, at - 1), 0) <= size}
    assert len(fresh) < len(want)
    if block > 90:
        assert got == fresh
    else:  # each block tells of its own items; together every window lies in a match
        assert got.keys() <= want.keys() and all(got[k] <= want[k] for k in got)
        assert all(any(j == i and word <= at and word + size >= at + n for (j, word), size in got.items()) for (i, at), n in windows.items() if n)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_items_without_id_equal_sql(spark, tmp_path, block):
    passages = [" ".join(f"{c}{i}" for i in range(15)) for c in "pqrs"]
    items = [(1, passages[0]), (None, passages[1]), (None, passages[2]), (4, passages[3]), (None, None)]
    docs = [(k, f"so {p} it is") for k, p in enumerate(passages)] + [(10, " ".join(passages)), (11, f"{passages[1]} {passages[2]}"), (12, "none of them")]
    d, b = frame(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    cur = con.execute(queries.ORACLE_SQL["op6_benchmark_decontamination"])
    columns = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, queries.op6_benchmark_decontamination(spark, str(tmp_path)).select(*columns).collect())) == want
    found = decontam.contamination(d, b, block_bytes=block)
    rows = {r.doc_id: r for r in found.collect()}
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows.values()) == sorted((*x[:4], x[5]) for x in want)
    assert (rows[11].n_hit, rows[11].n_items, rows[11]["items"]) == (30, 1, []) and rows[10]["items"] == ["1", "4"]
    assert decontam.decontaminate(d, b, block_bytes=block).select("doc_id").collect() == [(12,)]
    places = decontam.matches(d, b, block_bytes=block).filter("doc_id = 11").select("word", "item_id").collect()
    assert sorted(r.word for r in places) == [0, 15] and {r.item_id for r in places} == {None}


def test_longest_matches_and_places(spark):
    docs = frame(spark, [(1, "p q one two three four five six seven eight nine ten eleven twelve thirteen fourteen z")])
    items = spark.createDataFrame([(5, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen")], "item_id long, text string")
    rows = decontam.matches(docs, items).orderBy("word").collect()
    assert [(r.word, r.item_word, r.length) for r in rows] == [(2, 1, 14)]


def test_a_copy_of_a_very_long_item_is_one_row_and_soon_found(spark):
    """200,000 words in common: the search takes steps in proportion to the logarithm of the match."""
    rnd = random.Random(1)
    words = [f"w{rnd.randint(0, 5000)}" for _ in range(200_000)]
    docs = frame(spark, [(1, "before " + " ".join(words) + " after"), (2, "nothing of it"), (3, " ".join(words[70_000:70_020]))])
    items = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(words[100:140]))], "item_id long, text string")
    decontam.matches(docs.limit(0), items).count()
    began = time.perf_counter()
    rows = sorted((r.doc_id, r.word, r.length, r.item_id, r.item_word) for r in decontam.matches(docs, items).collect())
    assert time.perf_counter() - began < 60  # a linear walk from every word takes half an hour
    assert rows == [(1, 1, 200_000, "5", 0), (3, 0, 20, "5", 70_000)]


@pytest.mark.parametrize(("bits", "least", "most"), [(20.0, 0, 0.01), (16.0, 0, 0.02), (2.0, 0.02, 1), (0.5, 0.5, 1)])
@pytest.mark.parametrize("lines_", [2_000, 200_000])
def test_false_suspects_do_not_grow_with_the_corpus(bits, least, most, lines_):
    """Every line unique: the share that the second filter passes depends on bits per line only. Real repeats are always passed."""
    rnd = np.random.default_rng(5)
    hashes = rnd.integers(0, 1 << 45, lines_).astype(np.uint64)  # the upper bits of a range are equal
    shares = [(np.unique(x), np.zeros(len(np.unique(x)), bool)) for x in np.array_split(hashes, 10)]
    share = np.concatenate(lines.seen_twice(shares, bits)).mean()
    assert least <= share <= most
    repeated = [(np.unique(np.append(x, hashes[:50])), many) for x, many in shares[:3]]
    repeated = [(x, np.zeros(len(x), bool)) for x, _ in repeated]
    for (x, _), found in zip(repeated, lines.seen_twice(repeated, bits), strict=True):
        assert found[np.isin(x, hashes[:50])].all()


def test_line_dedup_with_clashing_columns(spark):
    line = "a line of forty characters or more, in all documents"
    rows = [(i, line, f"doc{i}", i, "d", "x", True) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, k1 long, drop string, row string, __doc boolean")
    got = lines.dedup_lines(spark, docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(tuple(r)[:7] for r in got.collect()) == [(*r[:1], line if r[0] == 5 else "", *r[2:]) for r in rows]


@pytest.mark.parametrize("part", [0, 255, 256, 10**5])
def test_ip_parts_of_any_length(part):
    """Parts with thousands of leading zeros are judged by their value."""
    text = "0" * 5000 + f"{part}.1.2.3 and 9.9.9.{'0' * 6000}{part}"
    ends = [(0, 5000 + len(f"{part}.1.2.3")), (len(text) - 6006 - len(str(part)), len(text))]
    assert [s[1:3] for s in pii.find_spans(text) if s[0] == "ip"] == (ends if part <= 255 else [])


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """Fingerprints, and the smallest id that each id reaches, by all pairs."""
    prints = {i: plain_fingerprint(t) for i, t in rows}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a], changed = label[b], True
    return prints, label


def test_simhash(spark):
    rnd = random.Random(9)
    base = [rnd.choice(["alpha", "Beta", "gamma", "delta", "eps"]) + str(rnd.randint(0, 99)) for _ in range(400)]
    rows = [(i, t) for i, t in corpus() if i is not None]
    for i in range(40):
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = "changed%d" % rnd.randint(0, 999)
        rows.append((1000 - i, "  ".join(copy)))
    rows += [(2000, " \t "), (2001, "one two"), (2002, "ONE two"), (2003, "a b c d")]

    prints, label = plain_components(rows)
    got = queries.simhash.near_duplicates(spark, frame(spark, rows).repartition(6)).select("doc_id", simhash.hex_fingerprint().alias("h"), "component_id").collect()
    assert {r.doc_id: (r.h, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", label[i]) for i in prints}
    assert len(set(label.values())) < len(label) - 20
    assert simhash.near_duplicates(spark, frame(spark, [])).count() == 0
    lonely = simhash.near_duplicates(spark, frame(spark, [(None, "q r s t"), (5, "q r s t"), (None, "u v w x y z")])).collect()
    assert sorted(str(r.component_id) for r in lonely) == ["5", "5", "None"]


def test_covering_masks_meet_every_pair_within_the_radius():
    rnd = np.random.default_rng(1)
    masks = np.array(linking.covering_masks(4), np.int64).view(np.uint64)
    assert len(masks) == 31
    for _ in range(2000):
        bits = rnd.choice(64, 4, replace=False)
        diff = np.uint64(sum(1 << int(b) for b in bits))
        assert ((masks & diff) == 0).any()


@pytest.mark.parametrize("free", [-1, 0xFFFFFFFF, 0b1011_0110_0111_0101_1100])
def test_finer_masks_cover_the_open_bits(free):
    """Under any mask the finer ones cover what it does not compare, and every one of them compares a bit at least."""
    bits = [i for i in range(64) if free >> i & 1]
    masks = linking.covering_masks(4, free)
    assert all(m and not m & ~free for m in masks)
    rnd = random.Random(3)
    for _ in range(500):
        diff = sum(1 << b for b in rnd.sample(bits, 4))
        assert any(not m & diff for m in masks)


def test_large_buckets_are_dealt_to_finer_ones(spark):
    """Links of a crowd of near fingerprints, in buckets of 32 at most, join what brute force joins."""
    rnd = random.Random(12)
    centre = rnd.getrandbits(63)
    prints = {centre ^ sum(1 << b for b in rnd.sample(range(20), rnd.randint(0, 8))) for _ in range(700)} | {rnd.getrandbits(63) for _ in range(50)}
    label = {p: p for p in prints}
    for p in prints:
        group = {label[q] for q in prints if (p ^ q).bit_count() <= 4}
        label = {q: min(group) if x in group else x for q, x in label.items()}
    from quarryline.operators.components import connected_components

    nodes = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    found = {r.node: r.component for r in connected_components(linking.links(nodes, 4, 32)).collect()}
    assert {p: found.get(p, p) for p in prints} == label


def test_chain_of_links_is_one_component(spark):
    from quarryline.operators.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (None, 3)], "src long, dst long")
    assert {r.component for r in connected_components(edges).collect()} == {0}
