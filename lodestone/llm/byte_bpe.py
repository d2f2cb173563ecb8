"""Byte-level BPE by ranks: encoding and decoding with DuckDB queries inside Spark's tasks.

Nothing is shuffled. A task cuts its texts into words, asks DuckDB for the ids of words it hasn't met,
and places them. In DuckDB a word is a set of rows (position, token). A recursive query joins
neighbouring rows with the table of merges and contracts each word's leftmost pair of least rank
until no pair is left. Decoding joins ids with the vocabulary and aggregates the bytes in order.

The table of merges has every pair of tokens whose bytes together are a token, so any split counts,
and a word that is a token itself is that token: both as the tiktoken library has it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, plain, slices, utf8

#: Name of the file of ranks used unless a path is given.
RANKS = "byte_bpe_50k.tiktoken"
#: Words that a worker knows before it forgets them all, and ids that are decoded at once.
MOST, AT_ONCE = 300_000, 1 << 18
#: Rows of all rounds that one recursive query may hold; it stops there and the next one goes on.
ROWS = 4_000_000
#: Bytes from which a word contracts all occurrences of its least pair in a round.
LONG = 256
#: Apostrophe endings that are words of their own.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

_PAIRS = """
WITH RECURSIVE step(round, word, pos, after, tok) AS (
  SELECT 0, word, pos, after, tok FROM start
  UNION ALL (
    WITH least_pair AS (
      SELECT a.word, min((m::BIGINT << 40) + a.pos) AS x, arg_min(b.pos, (m::BIGINT << 40) + a.pos) AS second, arg_min(b.after, (m::BIGINT << 40) + a.pos) AS after
      FROM step a JOIN step b ON a.word = b.word AND a.after = b.pos JOIN merges ON a.tok = l AND b.tok = r GROUP BY a.word
    )
    SELECT round + 1, word, pos, CASE WHEN pos = x & 1099511627775 THEN p.after ELSE s.after END, CASE WHEN pos = x & 1099511627775 THEN (x >> 40)::INTEGER ELSE tok END
    FROM step s JOIN least_pair p USING (word) WHERE pos <> second AND round < $rounds
  )
)
"""
# In a round a long word contracts occurrences of its least pair from the left, until one makes a pair of lower rank.
_RUNS = """
WITH RECURSIVE step(round, word, pos, after, tok) AS (
  SELECT 0, word, pos, after, tok FROM start
  UNION ALL (
    WITH near AS (
      SELECT *, lead(tok) OVER w AS next, lead(after) OVER w AS next_after, lag(tok) OVER w AS prev, lead(tok, 2) OVER w AS later, row_number() OVER w AS i FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
      SELECT near.*, m, min(m) OVER (PARTITION BY word) AS best FROM near LEFT JOIN merges ON tok = l AND next = r
    ), runs AS (
      SELECT *, m = best AS same, i - row_number() OVER (PARTITION BY word, m IS NOT DISTINCT FROM best ORDER BY i) AS run FROM ranked WHERE best IS NOT NULL
    ), taken AS (
      SELECT *, coalesce(same, false) AND row_number() OVER (PARTITION BY word, same, run ORDER BY i) % 2 = 1 AS odd FROM runs
    ), judged AS (
      SELECT t.*, min(pos) FILTER (odd AND (a.m < best OR b.m < best OR c.m < best)) OVER (PARTITION BY word) AS stop
      FROM taken t LEFT JOIN merges a ON odd AND a.l = prev AND a.r = best LEFT JOIN merges b ON odd AND b.l = best AND b.r = later LEFT JOIN merges c ON odd AND c.l = best AND c.r = best
    ), hits AS (SELECT *, odd AND pos <= coalesce(stop, pos) AS hit FROM judged)
    SELECT round + 1, word, pos, CASE WHEN hit THEN next_after ELSE after END, CASE WHEN hit THEN best ELSE tok END
    FROM (SELECT *, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone FROM hits) WHERE NOT gone AND round < $rounds
  )
)
"""
_LAST = "SELECT word, pos, after, tok, round FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) ORDER BY word, pos"


def ranks_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(RANKS)


class Vocabulary:
    """Ranks, merges and known words of one Python worker."""

    _held: dict[str, Vocabulary] = {}

    @classmethod
    def of(cls, path: str | None = None) -> Vocabulary:
        path = ranks_path(path)
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        import duckdb
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        get = self.ranks.get
        merges = [(get(t[:i]), get(t[i:]), rank) for t, rank in self.ranks.items() for i in range(1, len(t))]
        merges = np.array([m for m in merges if m[0] is not None and m[1] is not None], np.int32).reshape(-1, 3)
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._table("merges", l=merges[:, 0], r=merges[:, 1], m=merges[:, 2])
        self._table("vocabulary", id=np.fromiter(self.ranks.values(), np.int32, len(self.ranks)), token=[t.hex() for t in self.ranks])
        self.kind = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
        self.kind[[9, 10, 11, 12, 13, 32]] = 0
        self.kind[[*range(65, 91), *range(97, 123), *range(0xC0, 0xF8), *range(0x80, 0xC0)]] = 1  # letters of U+00C0 to U+00FF are two bytes each
        self.kind[48:58] = 2
        self.clear()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.filled = 0

    # words

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where words start, as the pattern finds them in each text."""
        n, size = len(data), np.diff(offsets)
        kind, start = self.kind[data], np.zeros(n, bool)
        first = np.zeros(n + 1, bool)
        first[offsets[:-1][size > 0]] = True
        first[n] = True
        start[1:] = kind[1:] != kind[:-1]
        start |= first[:-1]
        last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:-1])  # of white space that a word follows
        start[last] = True
        start[last + 1] = data[last] != 32
        start |= first[:-1]
        mark = np.flatnonzero((data == 39) & start)
        for ending in ENDINGS:
            at, ok = mark[mark + len(ending) < n], slice(None)
            for k, letter in enumerate(ending.encode(), 1):
                ok = (data[at + k] == letter) & ~first[at + k]
                at = at[ok]
            start[at + 1] = False
            start[(at + 1 + len(ending))[at + 1 + len(ending) < n]] = True
        odd = np.flatnonzero((data >= 0x80) & ~self._latin(data))
        for r in np.unique(np.searchsorted(offsets, odd, side="right") - 1):  # texts with other characters
            a, b = int(offsets[r]), int(offsets[r + 1])
            sizes = [len(w.encode()) for w in self.words.findall(data[a:b].tobytes().decode())]
            start[a:b] = False
            start[a + np.cumsum([0, *sizes[:-1]])] = True
        return np.flatnonzero(start)

    @staticmethod
    def _latin(data: np.ndarray) -> np.ndarray:
        """Bytes of the letters U+00C0 to U+00FF; its two signs are none."""
        lead = np.zeros(len(data), bool)
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        both = lead.copy()
        both[1:] |= lead[:-1]
        return both

    # encoding

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a column of texts; null is empty."""
        data, offsets = utf8(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start = self.starts(data, offsets)
        ends = np.append(start, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        entry = self._entries(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        length = self.size[entry].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.at[entry] - before[:-1], length) + np.arange(before[-1])]
        return ids, before[np.searchsorted(start, offsets)]

    def _entries(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of these different words are."""
        if len(self.known) > MOST:
            self.clear()
        new = [w for w in words if w not in self.known]
        single = [w for w in new if w in self.ranks]
        longer = [w for w in new if w not in self.ranks]
        self._learn(single, np.fromiter(map(self.ranks.__getitem__, single), np.int32, len(single)), np.ones(len(single), np.int32))
        for some, query in (([w for w in longer if len(w) < LONG], _PAIRS), ([w for w in longer if len(w) >= LONG], _RUNS)):
            if some:
                self._learn(some, *self._contract(some, query))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _contract(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words, by rounds of contraction until no pair is left."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        rows, done = {"word": word, "pos": pos, "after": pos + 1, "tok": self.byte[data]}, []
        while len(rows["word"]):
            self._table("start", **rows)
            rounds = int(np.clip(ROWS // len(rows["word"]), 1, 64))
            out = self.db.execute(query.replace("$rounds", str(rounds)) + _LAST).fetchnumpy()
            on = out["round"] == rounds
            done.append((out["word"][~on], out["tok"][~on]))
            rows = {c: out[c][on] for c in rows}
        word, tok = (np.concatenate([d[k] for d in done]) for k in range(2))
        return tok[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _learn(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while n + len(words) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.at[n : n + len(words)], self.size[n : n + len(words)] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    # decoding

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The bytes of each row's ids; ids that aren't in the vocabulary are an error."""
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        parts: list[list[bytes]] = [[] for _ in range(len(offsets) - 1)]
        for at in range(0, len(ids), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            self._table("given_ids", row=row[some], pos=np.arange(len(row[some])), id=ids[some].astype(np.int64))
            out = self.db.execute("SELECT row, string_agg(token, '' ORDER BY pos) AS hex, count(*) = count(token) AS whole FROM given_ids LEFT JOIN vocabulary USING (id) GROUP BY row").fetchnumpy()
            if not out["whole"].all():
                raise ValueError("ids that the vocabulary doesn't have")
            for r, text in zip(out["row"], out["hex"], strict=True):
                parts[r].append(bytes.fromhex(text))
        return (b"".join(p) for p in parts)


def _passed(b: pa.RecordBatch, column: str, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [c for c in b.schema.names if c != column]
    return pa.RecordBatch.from_arrays([b.column(c) for c in names] + [values], names=[*names, name])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of each row, its whole text encoded without special tokens.

    Null and empty texts have no ids (an empty array, never null). Null, equal and repeated keys are
    rows like others, an empty table gives no rows and other columns stay behind, so names can't clash.
    A task holds about 1 MB of text at a time, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.of(path)
        for b in slices(batches, text):
            ids, offsets = own.encode_column(b.column(text))
            yield _passed(b, text, "ids", pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())))

    rows = plain(docs, key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, ids, decoded) of each row: the bytes of its ids, which need not be UTF-8.

    Null and empty arrays give no bytes; an id that the vocabulary doesn't have, or a null in an array,
    is an error. Null and repeated keys are rows like others; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.of(path)
        for b in batches:
            column = b.column(ids)
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(sizes)
            start = 0
            while start < len(ends):
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
                part, n = b.slice(start, stop - start), sizes[start:stop]
                flat = part.column(ids).flatten()
                if flat.null_count:
                    raise ValueError("a null among ids")
                found = list(own.decode_rows(flat.to_numpy(), np.concatenate([[0], np.cumsum(n)])))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column(ids), pa.array(found, pa.binary())], names=[key, ids, "decoded"])
                start = stop
            give_back()

    rows = plain(encoded, key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{ids}` array<int>, decoded binary")


def digest(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
