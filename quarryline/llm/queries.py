"""One query per operator over the whole of its table; results are the contract's digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import audit, decontam, katz, lines, orc_tokens, packing, pii, quality, sharding, simhash, sql, substrings, toxicity, turns
from quarryline.session import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(spark, table(spark, sf_dir, "documents")).select(*columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.item_hash().alias("items_sha256"), "contaminated")


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places and longest verbatim matches behind op6's digests."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(spark, table(spark, sf_dir, "documents"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    orc_tokens.write_orc(orc_tokens.encode_documents(table(spark, sf_dir, "documents")), path)
    return orc_tokens.digests(orc_tokens.read_orc(spark, path))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turns.Repair(spark, turns.damage(rows), conversations=rows).digest()


def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, weights = shared_dir(spark), [1.0] * 8
    sharding.write_shards(table(spark, sf_dir, "documents"), path, weights)
    return sharding.digests(sharding.read_shards(spark, path, "doc_id long, text string"), weights, [*weights, 1.0])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_repeated_substrings,
        op3_pack_sequences,
        op4_pii_spans,
        op5_quality_outliers,
        op6_benchmark_decontamination,
        benchmark_matches,
        op7_katz_scores,
        op8_token_orc,
        op9_toxicity,
        op10_simhash_components,
        op11_conversation_repair,
        op12_rendezvous_shards,
        op13_filter_audit,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": sql.LINE_DEDUP,
    "op6_benchmark_decontamination": sql.DECONTAMINATION,
    "op11_conversation_repair": sql.REPAIR,
    "op12_rendezvous_shards": sql.RENDEZVOUS,
    "op13_filter_audit": sql.FILTER_AUDIT,
}
