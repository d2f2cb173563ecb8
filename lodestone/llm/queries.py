"""The queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, conversations, decontaminate, language, merkle, packing, quality, simhash, sql, substring, suffixes, token_counts, token_store, warc
from lodestone.sources.tables import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = substring.dedup(docs.select("doc_id", "text"))  # the other columns stay behind: the result is the digest
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256", (F.col("n_repeated") > 0).alias("has_repeats"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in with provisional counts, then are revised; a base takes both in, and both are sent again."""
    docs, root, version = table(spark, sf_dir, "documents"), shared_path(spark, "token-counts"), "byte_bpe_50k"
    exact = token_counts.count_tokens(docs, version)
    rough = docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    rough = rough.withColumn("n_tokens", F.expr("n_bytes div 4"))
    for _ in range(2):
        token_counts.commit(token_counts.inserts(rough), root, "provisional")
        token_counts.commit(token_counts.revisions(rough, exact), root, "exact")
        token_counts.compact(spark, root)
    return token_counts.totals(spark, root)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), archive)
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.clean(table(spark, sf_dir, "documents")))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), store, end=0)
    return token_store.read_checksums(spark, store)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end=2)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared_path(spark, "manifest")
    merkle.write(docs, path, carry={"tampered": merkle.tampered(docs)})
    return merkle.digest(merkle.proofs(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_store": op8_token_store,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash": op10_simhash,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op3_decontamination": sql.DECONTAMINATION,
    "op5_warc": sql.WARC,
    "op7_quality_rules": sql.QUALITY,
    "op12_conversation_repair": sql.REPAIR,
    "op13_merkle_manifest": sql.MANIFEST,
}
