"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

Cuts depend on the last 32 bytes only (apart from the length bounds), so an insertion shifts
cuts near it and no others. Of equal chunks the one first in (doc_id, position) order stays. A
run of neighbouring later chunks is taken out of a document if it has at least ``least_run``
bytes; shorter runs are chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import plain, slices, utf8
from lodestone.llm.spans import KEY, keyed, without_spans

#: Bytes of a chunk: at least, at most, and the mean of what a cut lies beyond the least.
LEAST, MOST, BEYOND = 24, 256, 24
LEAST_RUN = 64
REACH = 32
GEAR = np.random.default_rng(32).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def candidates(data: np.ndarray) -> np.ndarray:
    """Places (ends of chunks) where the gear hash of the last ``REACH`` bytes is small."""
    h = GEAR[data]
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    return np.flatnonzero(h < np.uint64((1 << 64) // BEYOND)) + 1


def cut_points(data: np.ndarray, found: np.ndarray) -> list[int]:
    """Ends of a document's chunks; a cut within a UTF-8 character moves behind it."""
    n, ends, at = len(data), [], 0
    inside = (data & 0xC0) == 0x80

    def cut(c: int) -> None:
        nonlocal at
        while c < n and inside[c]:
            c += 1
        at = c
        ends.append(c)

    for c in found[np.searchsorted(found, REACH) :].tolist():  # earlier hashes would reach before the text
        while c - at > MOST:
            cut(at + MOST)
        if c - at >= LEAST:
            cut(c)
    while n - at > MOST:
        cut(at + MOST)
    if at < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by digest; of equal ones in a batch, all but the first are surely later ones (kind 1)."""
    for b in slices(batches):
        data, offsets = utf8(b.column("text"))
        doc, h = b.column("doc").to_numpy(), b.column("h").to_numpy()
        found = candidates(data) if len(data) else np.zeros(0, np.int64)
        edges = np.searchsorted(found, offsets, side="right")
        names, row, pos, size = [], [], [], []
        view = memoryview(np.ascontiguousarray(data))
        for i in range(len(doc)):
            a, z = int(offsets[i]), int(offsets[i + 1])
            x = 0
            for y in cut_points(data[a:z], found[edges[i] : edges[i + 1]] - a):
                names.append(hashlib.blake2b(view[a + x : a + y], digest_size=16).digest())
                row.append(i)
                pos.append(x)
                size.append(y - x)
                x = y
        if not names:
            continue
        d = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        row, pos, size = np.array(row), np.array(pos, np.int64), np.array(size, np.int64)
        order = np.lexsort((pos, h[row], doc[row], d[:, 1], d[:, 0]))
        d, row, pos, size = d[order], row[order], pos[order], size[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        own = first[of]
        later = (doc[row] != doc[row[own]]) | (h[row] != h[row[own]]) | (pos != pos[own])
        keep = new | later
        many = np.maximum.reduceat(later.astype(np.int8), first)[of]
        kind = np.where(new, 2 * many, 1).astype(np.int32)
        to = np.where(new, d[:, 0], h[row] ^ doc[row])
        columns = [to, kind, d[:, 0], d[:, 1], doc[row], h[row], pos, size]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["to", "kind", "d1", "d2", "doc", "h", "pos", "size"])


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (digest, doc, h, pos): later chunks, and the first ones that have later ones.

    Only the last row of a batch waits for the next, so memory doesn't grow with a group.
    """
    names = ["doc", "h", "pos", "size", "first"]
    last = None  # (digest, key) of the current group's first chunk, its row, whether it was sent
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.column("kind").to_numpy()
        d1, d2, doc, h, pos, size = (b.column(c).to_numpy() for c in ("d1", "d2", "doc", "h", "pos", "size"))
        known = kind == 1
        out = [(doc[known], h[known], pos[known], size[known], np.zeros(int(known.sum()), bool))]
        i = np.flatnonzero(~known)
        if len(i):
            d1, d2, doc, h, pos, size, many = d1[i], d2[i], doc[i], h[i], pos[i], size[i], kind[i] == 2
            new = np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
            if last and last[:2] == (d1[0], d2[0]):  # goes on from the last batch
                d1, d2, doc, h, pos, size, many, new = (np.concatenate([[x], y]) for x, y in zip((*last[:6], False, True), (d1, d2, doc, h, pos, size, many, new), strict=True))
                new[1] = False
                sent = last[6]
            else:
                sent = False
            first = np.flatnonzero(new)
            own = first[np.cumsum(new) - 1]
            later = ~new & ((doc != doc[own]) | (h != h[own]) | (pos != pos[own]))
            has = np.maximum.reduceat((later | many).astype(np.int8), first).astype(bool)
            send = first[has]
            if sent:
                send = send[send != 0]
            out.append((doc[later], h[later], pos[later], size[later], np.zeros(int(later.sum()), bool)))
            out.append((doc[send], h[send], pos[send], size[send], np.ones(len(send), bool)))
            k = first[-1]
            last = (d1[k], d2[k], doc[k], h[k], pos[k], size[k], bool(has[-1]) or (sent and k == 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)


def _runs(pos: np.ndarray, size: np.ndarray, least: int) -> list[dict[str, int]]:
    """Spans of neighbouring chunks with at least ``least`` bytes."""
    if not len(pos):
        return []
    order = np.argsort(pos)
    s, e = pos[order], pos[order] + size[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != e[:-1]]))
    s, e = s[first], e[np.concatenate([first[1:] - 1, [len(e) - 1]])]
    return [{"start": a, "end": z} for a, z in zip(s.tolist(), e.tolist(), strict=True) if z - a >= least]


def repeated_spans(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """doc, h, spans (to take out), n_repeated (bytes in runs that repeat, first ones included)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = keyed(docs).mapInArrow(_chunks, "to long, kind int, d1 long, d2 long, doc long, h long, pos long, size long")
    sorted_chunks = chunks.repartition(n, "to").sortWithinPartitions("d1", "d2", "doc", "h", "pos")
    repeats = sorted_chunks.mapInArrow(_owners, "doc long, h long, pos long, size long, first boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans, repeated = [], []
            for parts in b.column("parts"):
                rows = parts.values
                pos, size, first = rows.field("pos").to_numpy(), rows.field("size").to_numpy(), rows.field("first").to_numpy(zero_copy_only=False)
                _, once = np.unique(pos, return_index=True)  # repeated rows share a key
                pos, size, first = pos[once], size[once], first[once]
                spans.append(_runs(pos[~first], size[~first], least_run))
                repeated.append(sum(x["end"] - x["start"] for x in _runs(pos, size, least_run)))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), pa.array(spans, span), pa.array(repeated, pa.int64())], names=["doc", "h", "spans", "n_repeated"])

    parts = repeats.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "size", "first")).alias("parts"))
    return parts.mapInArrow(run, "doc long, h long, spans array<struct<start:long,end:long>>, n_repeated long")


def dedup(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, n_repeated, spans, kept (binary),
    kept_sha256, rest. ``n_repeated`` counts the bytes of runs that occur elsewhere too, where they
    stay as well as where they go. ``rest`` is a struct of the other columns. Null and empty texts have no chunks; rows that
    repeat an id with the same text count as one document and lose nothing to each other; null ids
    come first in order. An empty table gives an empty result.
    """
    return without_spans(docs, repeated_spans(plain(docs, "doc_id", "text"), least_run))


def deduped(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those that lost all are gone.

    A column n_chars is brought up to date.
    """
    text = F.col("kept").cast("string")
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    left = found.where("n_removed = 0 or n_removed < n_bytes")
    return left.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])
