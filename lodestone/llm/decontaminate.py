"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item becomes windows of consecutive words. A window is a set of (shingle,
position) pairs; a document holds the window only if it holds all of them, so by the prefix
filter it is enough to join one: the window's rarest shingle in the corpus. Every match of
that shingle in a document proposes one place for the window; the place must lie within the
document (length and position bounds), and then all words are compared.

Rarity is counted over all documents. The index of windows is broadcast in blocks of a fixed
size, so it never outgrows an executor: larger benchmarks take more passes over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import plain, slices
from lodestone.sources.tables import cut

#: Words of the decontamination contract, after lower-casing A-Z only.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WINDOW = 10
SHINGLE = 2
#: Places of windows that are compared at once in a document, about (those of one shingle aren't divided).
PROPOSED = 1 << 18
#: Characters of item texts that go into one broadcast block (about ten times that in memory).
BLOCK_CHARS = 8_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower()) if text else []


#: Words of UTF-8 bytes without a regular expression: what parts them becomes a space.
_PARTED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or WORD.match(chr(c)) else 32 for c in range(256))


def raw_words(raw: bytes | None) -> list[bytes]:
    """The same words as UTF-8."""
    return raw.translate(_PARTED).split() if raw else []


class Index:
    """Windows of a block of items, with words as small integers."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.window, self.vocabulary, seen = window, {}, {}
        number = self.vocabulary.setdefault
        for item, text in items:
            w = [number(x, len(self.vocabulary)) for x in raw_words(text.encode())]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                seen.setdefault(tuple(w[i : i + window]), set()).add(str(item))
        self.names = sorted({x for s in seen.values() for x in s})
        at = {x: i for i, x in enumerate(self.names)}
        self.windows = [np.array(w, np.int64) for w in seen]
        self.items = [sorted(at[x] for x in s) for s in seen.values()]
        # shingles of `shingle` words; a shorter window is one shingle
        self.n = len(self.vocabulary) + 1
        self.width = np.array([min(shingle, len(w)) for w in self.windows], np.int64)
        self.shingle = shingle
        self.all = {k: np.unique(np.concatenate([self.keys(w, k) for w in self._of(k)] or [np.zeros(0, np.int64)])) for k in range(1, shingle + 1)}
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def _of(self, k: int) -> list[np.ndarray]:
        return [w for w, x in zip(self.windows, self.width, strict=True) if x == k]

    def keys(self, ids: np.ndarray, k: int) -> np.ndarray:
        """A number for the shingle of k words at each position; negative where a word is unknown."""
        out = ids[: len(ids) - k + 1].copy()
        bad = out < 0
        for j in range(1, k):
            more = ids[j : len(ids) - k + 1 + j]
            bad |= more < 0
            out = out * self.n + more
        out[bad] = -1
        return out

    def ids(self, raw: bytes | None) -> np.ndarray:
        """Number of each word of a UTF-8 text, -1 for words of no window."""
        w = raw_words(raw)
        return np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))

    def counts(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(k, position of each known shingle of k words in self.all[k])."""
        for k, known in self.all.items():
            if len(known) and len(ids) >= k:
                keys = self.keys(ids, k)
                keys = keys[keys >= 0]
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                yield k, at[known[at] == keys]

    def order(self, rarity: dict[int, np.ndarray]) -> None:
        """Choose each window's prefix token: its rarest shingle, the first of equals."""
        for k in self.all:
            rows = []
            for j, (w, x) in enumerate(zip(self.windows, self.width, strict=True)):
                if x == k:
                    keys = self.keys(w, k)
                    o = int(np.argmin(rarity[k][np.searchsorted(self.all[k], keys)]))
                    rows.append((int(keys[o]), o, j))
            rows.sort()
            self.prefix[k] = tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else ()
        self.flat = np.concatenate(self.windows or [np.zeros(0, np.int64)])
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """(hit by word, numbers of items) of one document."""
        hit, found = np.zeros(len(ids) + 1, np.int64), set()
        for k, prefix in self.prefix.items():
            if not prefix or len(ids) < k:
                continue
            token, offset, window = prefix
            keys = self.keys(ids, k)
            place = np.flatnonzero(keys >= 0)
            low, high = np.searchsorted(token, keys[place], "left"), np.searchsorted(token, keys[place], "right")
            some = np.flatnonzero(high > low)
            place, low, n = place[some], low[some], (high - low)[some]
            edges = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // PROPOSED)) + 1).tolist(), len(n)]
            for x, y in zip(edges, edges[1:], strict=False):
                if x < y:
                    found |= self._verify(ids, hit, place[x:y], low[x:y], n[x:y], offset, window)
        return np.cumsum(hit[:-1]) > 0, found

    def _verify(self, ids: np.ndarray, hit: np.ndarray, place: np.ndarray, low: np.ndarray, n: np.ndarray, offset: np.ndarray, window: np.ndarray) -> set[int]:
        """Compare the n windows from ``low`` on at each place; marks the words of those that are there, returns their items."""
        row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        begin, w = np.repeat(place, n) - offset[row], window[row]
        fits = (begin >= 0) & (begin + self.length[w] <= len(ids))
        begin, w = begin[fits], w[fits]
        j = 0
        while len(w) and j < self.window:  # compare word by word, keeping the places that still agree
            more = self.length[w] > j
            same = ~more
            same[more] = ids[begin[more] + j] == self.flat[self.start[w[more]] + j]
            begin, w, j = begin[same], w[same], j + 1
        np.add.at(hit, begin, 1)
        np.add.at(hit, begin + self.length[w], -1)
        return {i for x in np.unique(w).tolist() for i in self.items[x]}


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """Items with an id and words, a bounded number of characters at a time.

    An item is never divided, so a block is at most ``most`` characters and one item long.
    """
    held, n = [], 0
    for r in plain(items, "item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        if held and n + len(r["text"]) > most:
            yield held
            held, n = [], 0
        held.append((r["item_id"], r["text"]))
        n += len(r["text"])
    if held:
        yield held


def _rarity(docs: DataFrame, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sums = {k: np.zeros(len(a), np.int64) for k, a in index.all.items()}
        for b in slices(batches):
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                for k, at in index.counts(index.ids(raw)):
                    np.add.at(sums[k], at, 1)
        for k, s in sums.items():
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int64()), pa.array(s[some], pa.int64())], names=["k", "at", "n"])

    out = {k: np.zeros(len(a), np.int64) for k, a in shared.value.all.items()}
    for r in plain(docs, "text").mapInArrow(run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():  # at most the block's shingles
        out[r["k"]][r["at"]] = r["n"]
    return out


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items array<string>, spans array<struct<start, end>>.

    ``spans`` are maximal runs of hit words, [start, end) in words; ``items`` the sorted ids (as
    strings) of items with a window in the document. Null and empty texts have no words; items
    without id or words are ignored; repeated items count once, repeated documents each; a table
    without items hits nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = "doc_id long, text string, n_words long, items array<string>, spans array<struct<start:long,end:long>>"

    def found_in(rows: DataFrame, shared, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches):
                n, found, spans = [], [], []
                for raw, names, old in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("items").to_pylist(), b.column("spans").to_pylist(), strict=True):
                    ids = index.ids(raw)
                    hit, numbers = index.find(ids)
                    for x in old:
                        hit[x["start"] : x["end"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
                    n.append(len(ids))
                    found.append(sorted({*names, *(index.names[i] for i in numbers)}))
                    spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                text = pa.nulls(b.num_rows, pa.string()) if last else b.column("text")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, span)], names=["doc_id", "text", "n_words", "items", "spans"])

        return rows.mapInArrow(run, schema)

    docs = plain(docs, "doc_id", "text")
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    blocks = _blocks(items, block_chars)
    block = next(blocks, [])
    while True:
        later = next(blocks, None)
        index = Index(block, window)
        counted = spark.sparkContext.broadcast(index)
        index.order(_rarity(docs, counted) if block else {k: np.zeros(0, np.int64) for k in index.all})
        counted.unpersist()
        rows = found_in(rows, spark.sparkContext.broadcast(index), later is None)
        if later is None:
            break
        rows, block = cut(rows), later  # one block in memory at a time
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the decontamination contract."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
