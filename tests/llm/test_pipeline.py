"""Toxicity and the pipeline: held-out accuracy, and each stage against a plain version of its rule."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quarryline.llm import decontam, simhash, toxicity  # noqa: E402
from quarryline.llm.queries import op9_toxicity  # noqa: E402

from .test_text_operators import BL, brute_decontamination, frame, plain_components  # noqa: E402


def test_toxicity_held_out_accuracy(spark):
    """Accuracy over fold 0 only, of which training saw no row."""
    sf_dir = "/root/testdata/sf0.01"
    rows = op9_toxicity(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    unseen = [r for r in rows if r.doc_id in label and r.held_out]
    assert len(unseen) > 50 and {label[r.doc_id] for r in unseen} == {0, 1}
    assert sum(r.predicted == label[r.doc_id] for r in unseen) >= 0.9 * len(unseen)


def test_rejected_rows_have_any_columns(spark):
    rnd = random.Random(2)
    rows = [(i, "calm " * 9 + ("vile" if i % 4 == 0 else "word"), "a", i, "b", "c") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __toxicity string, score long, row string, md5 string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] % 4]
    assert rnd


def test_toxicity_edges(spark):
    rnd = random.Random(1)
    calm = [" ".join(rnd.choice("rain tree lake stone road".split()) for _ in range(30)) for _ in range(120)]
    rows = [(i, t if i % 4 else t + " vile") for i, t in enumerate(calm)] + [(500, None), (501, ""), (None, "vile " * 20), (3, calm[3])]
    labels = spark.createDataFrame([(i, None, int(i % 4 == 0)) for i in range(120)] + [(7, 1, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 120) >= 118
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.classify(frame(spark, []), labels).count() == 0
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}


def test_keep_one_of_each_group(spark):
    rows = [(5, "a b c d e"), (3, "A b  c d e"), (3, "a b c d e"), (9, "q w e r t y"), (None, "a b c d e"), (None, None), (11, None), (12, "")]
    kept = simhash.keep_one(spark, frame(spark, rows).repartition(3))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "3", "9", "None", "None"]
    assert simhash.keep_one(spark, frame(spark, [])).count() == 0


def test_keep_one_keeps_different_texts_of_one_id(spark):
    """Rows with one id in different groups all stay; of rows alike in id and text the choice does not depend on partitions."""
    rows = [(5, "a b c d e f", "x"), (5, "totally other words here now yes", "y"), (5, "a b c d e f", "b"), (7, "a b c d e f", "a"), (8, "totally other words here now yes", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    for parts in (1, 4):
        assert sorted(map(tuple, simhash.keep_one(spark, docs.repartition(parts)).collect())) == [rows[2], rows[1]]


def test_decontaminated_rows_keep_their_columns(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(15)))], "item_id long, text string")
    docs = frame(spark, [(1, "x " + " ".join(f"W{i}" for i in range(15))), (2, "clean text"), (None, None)])
    for size in (1 << 20, 10):
        kept = decontam.decontaminate(docs, items, block_bytes=size)
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.filter("doc_id = 2 or doc_id is null").collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("spans", F.lit("x"))
    names = docs.columns
    judged = {r.doc_id: r.predicted for r in op9_toxicity(spark, sf_dir).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert docs.columns == names
        after = {r.doc_id: r.text or "" for r in rows}
        assert len(after) == len(rows)
        if name == "toxicity":
            assert set(after) == {i for i in before if not judged[i]}
        elif name == "line_dedup":
            where = defaultdict(set)
            key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BL))
            for i, t in before.items():
                for x in t.split("\n"):
                    if len(key(x)) >= 40:
                        where[key(x)].add(i)
            assert after == {i: "\n".join(x for x in t.split("\n") if not (len(w := where.get(key(x), ())) >= 5 and max(w) != i)) for i, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            assert set(after) == set(plain_components([*before.items()])[1].values()) and len(after) < len(before)
        elif name == "decontamination":
            bad = brute_decontamination([*before.items()], items)
            assert set(after) == {i for i in before if not bad[i][4]} and len(after) < len(before)
