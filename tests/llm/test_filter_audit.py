"""Filter interactions against a plain walk through every order."""

import random
import re
from itertools import permutations

from quarryline.llm import audit

SCHEMA = "doc_id long, text string, lang string, mask int, n int"


def plain(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    failed = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            f.add("E")
        good, toxic = (any(j == i and row[k] == 1 for j, *row in labels) for k in (0, 1))
        failed.append((lang or "", f, i is not None and good, i is not None and toxic))
    out = {}
    for part in {x[0] for x in failed}:
        own = [x for x in failed if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                fails = sum(letter in x[1] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(x[1] == {letter} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def corpus():
    rnd = random.Random(4)
    texts = [None, "", "  \n", "A" * 30, "é" * 9 + "X", "é" * 8 + "X", "same " * 200, " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(99)), " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)), "Word word", "a b　c"]
    for _ in range(40):
        words = [rnd.choice(["Ab", "cd", "EF", "g#", "h", "é"]) + str(rnd.randint(0, 150)) for _ in range(rnd.choice([5, 99, 100, 180]))]
        texts.append(rnd.choice([" ", "\t", "\x0b"]).join(words))
    rows = [(i, t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, rnd.choice(texts), rnd.choice(["en", "fr"])) for i in range(40)] + [(None, texts[6], "en"), (None, None, None)] + [(3, "A" * 30, "en"), (3, "other", "en"), rows[5]]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 3, 4) for r in rows], SCHEMA).repartition(3)
    marks = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, part int")
    got = audit.audit(spark, docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): list(r[3:]) for r in got.collect()}
    assert got.count() == len(found) == 600 * 4
    assert found == plain(rows, labels)
    assert sum(r[4] for r in found.values()) and sum(r[5] for r in found.values())


def test_one_text_in_most_rows_and_no_rows(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) text", "'x' lang")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    first = {(r.filter_order, r.step): r for r in audit.audit(spark, docs, marks).collect()}
    assert (first["EABCD", 1].removed, first["EABCD", 1].kept, first["EABCD", 2].removed) == (999, 2001, 2001)
    assert first["AEBCD", 2].redundant == 999 and first["AEBCD", 5].kept == 0
    assert audit.audit(spark, docs.limit(0), marks).count() == 0


def test_long_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300_000)), "x"), (2, "a" * 2_000_000, "x")], "doc_id int, text string, lang string")
    rows = {r.filter_order: r for r in audit.audit(spark, docs, spark.createDataFrame([], "doc_id int, quality int, toxic int")).filter("step = 5").collect()}
    assert all(r.kept == 1 for r in rows.values()) and rows["ABCDE"].shapley == 0
