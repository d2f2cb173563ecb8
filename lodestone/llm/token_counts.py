"""Delta-maintained token counts.

Changes to documents become signed rows: an insert adds, a delete subtracts, a revision
subtracts the old count under its old keys and adds the new one. A batch's rows are summed by
(source, lang, tokenizer_version) and committed as one small delta of a batch log; totals are the
log's base and the deltas since. Of two writers of one batch id one commits, and a batch that is
sent again after any failure changes nothing. Compaction sums old deltas into a new base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import Encoder, vocabulary_path
from lodestone.llm.common import plain, slices
from lodestone.sources.tables import BatchLog

GROUP = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"


def count_tokens(docs: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens, n_bytes of whole texts (null and empty: 0).

    A row for each row; nulls in other columns stay; an empty table gives an empty result. Columns
    besides doc_id, source, lang and text are ignored.
    """
    path = vocabulary_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, at = Encoder.of(path).encode_column(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "source", "lang", "n_bytes")] + [pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "source", "lang", "n_bytes", "n_tokens"])

    rows = plain(docs, "doc_id", "source", "lang", "text").select("doc_id", "source", "lang", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_bytes long, n_tokens long").withColumn("tokenizer_version", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows for new documents."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_bytes").cast("long").alias("n_bytes"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows for documents that go, with the counts they had."""
    return inserts(counts).select(*GROUP, *[(-F.col(c)).alias(c) for c in SUMS])


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows for documents whose counts or keys change from ``old`` to ``new``."""
    return deletes(old).union(inserts(new))


def delta(changes: DataFrame) -> DataFrame:
    """Sums by group, without groups in which nothing is left; null keys are groups of their own.

    Rows are summed within tasks before the shuffle, so a hot source sends one row a task.
    """
    return changes.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).where(" or ".join(f"{c} <> 0" for c in SUMS))


def log_of(spark: SparkSession, root: str) -> BatchLog:
    return BatchLog(spark, root, DELTA)


def commit(changes: DataFrame, root: str, batch: str) -> bool:
    """Commit a batch of signed rows; False if a batch with this id was committed before or meanwhile.

    Null sources and languages are groups of their own, repeated rows count each, and a batch without
    rows is committed like any other. Only sums are written: one row a group.
    """
    return log_of(changes.sparkSession, root).commit(lambda: delta(changes).coalesce(1), batch)


def compact(spark: SparkSession, root: str) -> bool:
    """Sum all committed batches into a new base; False if there are none or another compaction was first."""
    return log_of(spark, root).compact(lambda rows: delta(rows).coalesce(1))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals over all committed batches; groups in which nothing is left are left out.

    Reads the base and the deltas that it hasn't taken in. A folder without batches has no totals.
    """
    return delta(log_of(spark, root).read())
