"""Best-fit packing planned over a histogram of lengths.

Best-fit decreasing runs over (length, count) pairs on the driver: at most ``capacity``
counts go in, and the plan that comes out is bounded by the capacity too, not by the
documents: each length splits at most two groups of equal bins, so there are no more than
four groups a length, and a bin holds at most sqrt(2 * capacity) different lengths.
Documents then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import Encoder, vocabulary_path
from lodestone.llm.common import plain, scan, slices, with_column
from lodestone.sources.tables import cut

CAPACITY = 1024


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts.

    Returns parallel arrays, sorted by (length, rank): items of ``length`` with a rank in
    [rank, rank + n) within that length go to bin ``bin`` + (their rank - rank) // ``per``,
    at offset ``offset`` + ((their rank - rank) % per) * length.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first bin, bins)
    bins, plan = 0, []
    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = counts[length], 0

        def place(first: int, n: int, room: int) -> int:
            """Fill as many of the n bins from ``first`` as there are items; returns bins used."""
            nonlocal left, rank
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, capacity - room))
                free[room - per * length].append((first, full))
                left, rank = left - full * per, rank + full * per
            if left and left < per and full < n:
                plan.append((length, rank, left, first + full, left, capacity - room))
                free[room - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            return full

        for room in range(length, capacity):
            waiting, free[room] = free[room], []
            while waiting:
                first, n = waiting.pop()
                used = place(first, n, room) if left else 0
                if used < n:
                    free[room].append((first + used, n - used))
            if not left:
                break
        if left:
            bins += place(bins, left, capacity)
    names = ("length", "rank", "n", "bin", "per", "offset")
    rows = np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)
    return {k: rows[:, i] for i, k in enumerate(names)} | {"bins": np.int64(bins)}


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document.

    Null text is empty: one piece with the end id alone. A document of more than ``capacity``
    ids is cut; only its first piece may be shorter.
    """
    path = vocabulary_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, at = Encoder.of(path).encode_column(b.column("text"), end)
            ids = ids.astype("<u4")
            doc, piece, start, length, crc = [], [], [], [], []
            for i, k in enumerate(b.column("doc_id").to_pylist()):
                n = int(at[i + 1] - at[i])
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for j, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    doc.append(k)
                    piece.append(j)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(memoryview(ids[at[i] + x : at[i] + y])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` and columns doc_id, piece.

    Ties (equal length, doc_id and piece) take slots in any order, each its own. No rows in,
    no rows out.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    lengths = np.array(sorted(counts), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum([counts[int(x)] for x in lengths])]).astype(np.int64)
    # rank in the order (length, doc_id, piece), so one sorted array finds each item's slots
    begin = before[np.searchsorted(lengths, plan["length"])] + plan["rank"]

    def step(b: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        rank = state["base"] + np.arange(b.num_rows)
        k = np.searchsorted(begin, rank, side="right") - 1
        nth = rank - begin[k]
        return with_column(b, sequence_id=plan["bin"][k] + nth // plan["per"][k], offset=plan["offset"][k] + nth % plan["per"][k] * plan["length"][k])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return scan(pieces, step, ["length", "doc_id", "piece"], None, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = 2, path: str | None = None) -> DataFrame:
    """Encode, cut and pack (doc_id, text) rows; one row a piece.

    Repeated doc_ids and rows count each; other columns are ignored; an empty table gives an
    empty result. Ids move nowhere: only the narrow rows of pieces are sorted.
    """
    return assign(cut(encode_pieces(docs, capacity, end, path)), capacity)


def materialize(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, end: int = 2, path: str | None = None) -> DataFrame:
    """sequence_id, input_ids array<int>: the packed sequences. doc_ids must be unique."""
    path = vocabulary_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, at = Encoder.of(path).encode_column(b.column("text"), end)
            for i, k in enumerate(b.column("doc_id").to_pylist()):
                n = int(at[i + 1] - at[i])
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                cuts = [ids[at[i] + x : at[i] + y].astype(np.int32) for x, y in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array(cuts, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    cuts = plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, ids array<int>")
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(cuts, ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("input_ids"))
