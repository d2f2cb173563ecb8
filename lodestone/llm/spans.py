"""Byte spans of documents: keys for rows, and cutting spans out of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lodestone.llm.common import slices

#: Stands for a null doc_id in keys.
NO_ID = -(1 << 63)
KEY = ["doc", "h"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the id), h (a hash of the text) and text: together they name a row; null text is empty.

    Rows that repeat an id with the same text have one key and get the same result.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def doc_id() -> F.Column:
    """The doc_id of a key."""
    return F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans, sorted; touching spans join."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:] - 1, [len(e) - 1]])] if len(first) else e[:0]


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with the bytes of their spans taken out.

    ``spans``: doc, h, spans array<struct<start, end>> (disjoint, sorted), n_repeated, at most one
    row a key. Returns doc_id, n_bytes, n_removed, n_spans, n_repeated (0 for a key without a row),
    spans, kept (binary), kept_sha256, rest (a struct of the other columns, null if there are none).
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"), rest.alias("rest"))
    joined = rows.join(spans, KEY, "left").select(doc_id(), "text", "spans", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"), "rest")
    kind = "array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, removed, count, kept, names = [], [], [], [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw, at, parts, gone = text.encode(), 0, [], 0
                for x in own or ():
                    parts.append(raw[at : x["start"]])
                    gone, at = gone + x["end"] - x["start"], x["end"]
                left = b"".join([*parts, raw[at:]]) if own else raw
                size.append(len(raw))
                removed.append(gone)
                count.append(len(own or ()))
                kept.append(left)
                names.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), b.column("n_repeated"), b.column("spans"), pa.array(kept, pa.binary()), pa.array(names, pa.string()), b.column("rest")],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "spans", "kept", "kept_sha256", "rest"],
            )

    schema = StructType([*_parse_datatype_string(f"doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, spans {kind}, kept binary, kept_sha256 string").fields, StructField("rest", joined.schema["rest"].dataType)])
    return joined.mapInArrow(run, schema)
