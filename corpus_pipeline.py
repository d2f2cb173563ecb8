"""A cleaning pipeline over ``documents``: each stage applies one operator and takes effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near, packing, quality, substring
from lodestone.llm.spans import NO_ID
from lodestone.sources.tables import remove, shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that are rejected go.

    Null and empty texts have no words and are rejected; a null id is like any other; repeated rows
    are judged alike, each for itself. An empty table stays empty. Columns stay, n_chars follows the text.
    """
    return quality.filtered(docs, quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 of their five-word shingles the row with the smallest id stays.

    Each row has its own decision: rows without an id come after all others, and of rows that share id and
    text the one with the smallest hash of the whole row stays. Null, empty and blank texts are alike, so one
    of them stays. An empty table stays empty.
    """
    return near.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the first document only (by id, null first, then by hash); documents that lose everything go.

    Null and empty texts have nothing to lose and stay, a null text as an empty one. Repeated rows of one
    id and text are one document: they lose nothing to each other. An empty table stays empty.
    """
    return substring.deduped(docs, substring.dedup(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; each row has its own decision, with or without an id.

    Null and empty texts hold none and stay, and so does everything where there are no items.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)).cast("long"), F.coalesce("text", F.lit("")))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hit = decontaminate.find_contamination(docs.select(key.alias("doc_id"), "text"), items).where(F.col("n_hit") > 0).select(F.col("doc_id").alias("key"))
    return rows.join(hit, "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its place in a training sequence.

    Null text is empty: one piece with the end id. Null and repeated ids and repeated rows are
    documents each; pieces of equal length, id and number take slots in any order. An empty table gives no rows.
    """
    return packing.pack(docs, capacity=1024, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", pack),
]
#: Hash functions, tokenizing and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
