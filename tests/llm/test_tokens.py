import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import orc_tokens, packing
from quarryline.llm.tokens import PieceEncoder, vocabulary_path
from quarryline.session import shared_dir

ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n", "a\t b ", "it's we're", "é à  ü", "x" * 500, "漢字 テスト 123", "a b  c", "<|endoftext|> a", "12 34,56.", "ͅab ẞ"]


def reference(texts):
    t = PieceEncoder.of(vocabulary_path("byte_bpe_50k.json")).tokenizer
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_piecewise_ids_equal_whole_text_ids():
    rnd = random.Random(5)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "1", " ", "漢", "😀", "-"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)]
    encoder = PieceEncoder.of(vocabulary_path("byte_bpe_50k.json"))
    ids, ends = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == reference(texts)


def fresh(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_marks_and_newlines_between_words():
    """Words with runs of marks behind them, newlines between words and inside runs of blanks: ids of a fresh tokenizer, when seen first and when looked up."""
    rnd = random.Random(7)
    alphabet = ["word", "Stem", "über", "a1", "don't", *"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\", "***", "'s", "\n", "\n", "\n\n", " ", " ", " ", "\r\n", "…", "—"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(1500)] + ["\na", "a\n", "\n", "a \nb", "a\n b", " \n", "x\n\ny"]
    encoder = PieceEncoder(vocabulary_path("byte_bpe_50k.json"))
    want = fresh(texts)
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_added_tokens_in_texts_are_one_id():
    rnd = random.Random(6)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", ".", "'s", "é", "<|endoftext|>", "<|endoftext|>", "<|", "|>"]
    texts = ["a <|endoftext|> b", "x\n <|endoftext|>  b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n", " <|endoftext|> ", "<|EndOfText|>"]
    texts += ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(400)]
    encoder = PieceEncoder.of(vocabulary_path("byte_bpe_50k.json"))
    ids, ends = encoder.encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert got == fresh(texts) and got[0] == [64, 220, 50256, 275]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, part int")


def test_orc_round_trip(spark):
    texts = [*ODD, None, "same", "same"]
    docs = frame(spark, [(i * 3 if i < len(texts) - 1 else (i - 1) * 3, t, None, "clash", 1) for i, t in enumerate(texts)])
    path = shared_dir(spark)
    orc_tokens.write_orc(orc_tokens.encode_documents(docs.repartition(3)), path)
    rows = sorted(orc_tokens.digests(orc_tokens.read_orc(spark, path)).collect())
    want, start = [], 0
    for i, t in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0], r[1] or "")):
        ids = [*reference([t or ""])[0], 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == sorted(want)
    assert [r.doc_id for r in orc_tokens.read_orc(spark, path, doc_ids=[3]).collect()] == [3]


def test_orc_files_have_indexes_bloom_filters_and_run_lengths(spark):
    """What the footers say: several stripes, a row index and a Bloom filter on doc_id in each, ids in run-length encoding; a wanted id reads few row groups."""
    docs = spark.range(0, 20_000).selectExpr("id * 2 as doc_id", "concat_ws(' ', sha2(string(id), 256), sha2(string(id + 7), 512)) as text")
    path = shared_dir(spark)
    orc_tokens.write_orc(orc_tokens.encode_documents(docs.repartition(1)), path, stripe_bytes=1 << 18)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [f for f in spark.read.orc(path).inputFiles()]
    stripes, kinds, encodings, strides = 0, set(), set(), set()
    for f in files:
        place = jvm.org.apache.hadoop.fs.Path(f)
        reader = jvm.org.apache.orc.OrcFile.createReader(place, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        strides.add(reader.getRowIndexStride())
        rows = reader.rows()
        doc_column = reader.getSchema().findSubtype("doc_id").getId()
        for i in range(reader.getStripes().size()):
            footer = rows.readStripeFooter(reader.getStripes().get(i))
            stripes += 1
            own = [footer.getStreams(k) for k in range(footer.getStreamsCount())]
            kinds |= {str(x.getKind()) for x in own if x.getColumn() == doc_column}
            encodings |= {str(footer.getColumns(k).getKind()) for k in range(footer.getColumnsCount())}
        rows.close()
        reader.close()
    assert stripes > 1 and strides == {1000}
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds) and "DIRECT_V2" in encodings
    total = spark.read.schema(orc_tokens.SCHEMA).orc(path).selectExpr("sum(n_tokens) * 4").first()[0]
    stored = sum(jvm.org.apache.hadoop.fs.Path(f).getFileSystem(conf).getFileStatus(jvm.org.apache.hadoop.fs.Path(f)).getLen() for f in files)
    assert stored < 0.6 * total
    # Rows that leave the scan: pushed filters drop row groups by statistics, and, for an odd id between them, by the Bloom filter.
    def scanned(ids):
        plan = orc_tokens.read_orc(spark, path, doc_ids=ids).select("doc_id")
        plan.collect()
        metrics = plan._jdf.queryExecution().executedPlan()
        found = []

        def walk(node):
            if node.nodeName().startswith("Scan orc") or "Scan" in node.nodeName():
                text = str(node.metadata().get("PushedFilters").getOrElse(None)) if node.metadata().contains("PushedFilters") else ""
                found.append((node.metrics().apply("numOutputRows").value(), text))
            kids = node.children()
            for k in range(kids.size()):
                walk(kids.apply(k))
            if node.nodeName() == "AdaptiveSparkPlan":
                walk(node.executedPlan())
            if "QueryStage" in node.nodeName():
                walk(node.plan())

        walk(metrics)
        return found

    one = [n for n, text in scanned([8000]) if "doc_id" in text]
    none = [n for n, text in scanned([8001]) if "doc_id" in text]
    assert one and max(one) <= 2000
    assert none and max(none) == 0


def test_a_lookup_reads_the_stripes_of_its_ids_only(spark):
    """No sums over all files; of 40,000 rows in many files the scan gives a few row groups."""
    docs = spark.range(0, 40_000).selectExpr("id as doc_id", "concat('t ', sha2(string(id), 256)) as text")
    path = shared_dir(spark)
    orc_tokens.write_orc(orc_tokens.encode_documents(docs.repartition(4)), path)
    one = orc_tokens.read_orc(spark, path, doc_ids=[31_234])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan
    everything = {r.doc_id: r.start for r in orc_tokens.read_orc(spark, path).select("doc_id", "start").collect()}
    assert [(r.doc_id, r.start) for r in one.collect()] == [(31_234, everything[31_234])]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "one id")
    one.select("ids").collect()
    store, read = spark.sparkContext._jsc.sc().statusStore(), 0
    for job in tracker.getJobIdsForGroup("lookup"):
        for stage in tracker.getJobInfo(job).stageIds:
            read += store.lastStageAttempt(stage).inputRecords()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert read <= 3_000


def test_orc_with_very_long_and_clashing_rows(spark):
    """Long texts, null and repeated ids, and columns named like the operator's own."""
    long = "word " * 400_000
    rows = [(None, "a", "x", 1, 2), (3, long, "x", 1, 2), (3, "b", "x", 1, 2), (3, "b", "x", 1, 2), (None, None, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int, n_tokens long")
    path = shared_dir(spark)
    orc_tokens.write_orc(orc_tokens.encode_documents(docs.repartition(2)), path)
    got = sorted(orc_tokens.digests(orc_tokens.read_orc(spark, path)).select("start", "doc_id", "n_tokens").collect())
    sizes = {t: len(fresh([t or ""])[0]) + 1 for _, t, *_ in rows}
    want, start = [], 0
    for i, t in [(None, None), (None, "a"), (3, "b"), (3, "b"), (3, long)]:
        want.append((start, i, sizes[t]))
        start += sizes[t]
    assert [tuple(r) for r in got] == want


def test_orc_empty_table_and_null_id(spark):
    path = shared_dir(spark)
    orc_tokens.write_orc(orc_tokens.encode_documents(frame(spark, [])), path)
    assert orc_tokens.digests(orc_tokens.read_orc(spark, path)).count() == 0
    path = shared_dir(spark)
    orc_tokens.write_orc(orc_tokens.encode_documents(frame(spark, [(None, "a", None, None, None), (1, None, None, None, None)])), path)
    assert [(r.doc_id, r.start) for r in orc_tokens.read_orc(spark, path).orderBy(F.col("start")).collect()] == [(None, 0), (1, 2)]


def check_pieces(rows, texts, length=2048):
    """Every id in exactly one piece, sequences gapless and within the length; returns the padding."""
    ids = {i: np.array([*reference([t or ""])[0], 1], "<u4") for i, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return padding


def test_packing_pieces(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "word " * 9000)], "doc_id long, text string"))
    rows = packing.pack_documents(spark, docs, plan_tokens=20_000).collect()
    padding = check_pieces(rows, docs.collect())
    assert padding < 0.01 * sum(r.length for r in rows)
    assert packing.pack_documents(spark, docs.limit(0)).count() == 0


def test_packing_of_null_and_repeated_ids_and_clashing_columns(spark):
    """Rows keep their id; repeated ids give pieces per row, which the lengths of the rows tell apart."""
    rows = [(None, "no id here", 1, 2, "p"), (5, "first text of five", 1, 2, "p"), (5, "second and longer text of five", 1, 2, "p"), (7, None, 1, 2, "p"), (None, None, 1, 2, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, part int, ids_crc32 string")
    got = packing.pack_documents(spark, docs.repartition(2)).collect()
    want = sorted((str(i), len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for (i, t, *_), x in zip(rows, fresh([r[1] or "" for r in rows])))
    assert sorted((str(r.doc_id), r.doc_tokens, r.ids_crc32) for r in got) == want
    assert all(r.start == 0 and r.length == r.doc_tokens for r in got)


def test_plan_is_optimal():
    rnd = random.Random(3)
    for _ in range(60):
        length = 16
        places = [0]
        while len(places) < 30:
            places.append(places[-1] + rnd.randint(1, 9))
        pen = [0.0] + [rnd.choice([0.0, 1.0, 3.0]) for _ in places[1:]]
        cost = lambda a, b: 0 if (b - a) & (b - a - 1) == 0 else length - (b - a)
        best = [0.0] + [float("inf")] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + cost(places[i], places[j]) + pen[j] for i in range(j) if places[j] - places[i] <= length)
        cuts = packing.plan_cuts(np.array(places), np.array(pen), length)
        got = sum(cost(places[a], places[b]) + pen[b] for a, b in zip(cuts, cuts[1:]))
        assert got == pytest.approx(best[-1])


def test_sentence_ends_are_made_once_a_worker():
    encoder = PieceEncoder.of(vocabulary_path())
    assert packing._sentence_ends(encoder) is packing._sentence_ends(encoder)
