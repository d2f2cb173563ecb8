"""Byte-level BPE encoding of Arrow text columns with the ``tokenizers`` library.

The library encodes each different word piece once; a vectorised lookup by two 64-bit
hashes places its ids wherever the piece occurs again, if its bytes are those of the piece that was
encoded (structured words can share both hashes; each of these is encoded by itself). Pieces are cut at white space only
where the tokenizer's own pre-tokenizer cuts too, so ids equal those of whole-text encoding:
before a run of ASCII white space and before the last character of a run that a word follows,
after that character if it isn't a space, and between a Latin letter or digit and ASCII
punctuation (not after an apostrophe). Texts with other white space, or with the string of an
added token, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from lodestone.llm.common import utf8

#: Name of the vocabulary file used unless a path is given.
VOCABULARY = "byte_bpe_50k.json"
#: White space outside ASCII: fixed values of the Unicode White_Space property.
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A piece that the pre-tokenizer surely keeps whole.
ONE_WORD = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Places of the table of known pieces, and pieces after which it starts anew: about 90 MB a worker.
SLOTS = 1 << 21
MOST = 1 << 20
#: Bytes of text that are encoded at once: the arrays beside them take about a hundred times that.
AT_ONCE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)


#: Bytes of a piece that are compared in words of eight; by how many bits the bytes behind a piece's end are shifted out.
LONG = 64
LOST = np.array([0, *range(56, -1, -8)], np.uint64)


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _words(data: np.ndarray) -> np.ndarray:
    """The little-endian number of the eight bytes from each place on (the last eight places have none)."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class Encoder:
    """Encodes batches; one lives in each Python worker."""

    _held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str | None = None) -> Encoder:
        path = vocabulary_path(path)
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = self.tokenizer.model.tokenize
        # whole-text normalizing isn't piecewise, nor are pre-tokenizers that look back
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.piecewise = self.tokenizer.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        rng = np.random.default_rng(20)
        self.table, self.table2 = (rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.odd = np.zeros(256, bool)
        self.odd[[0xC2, 0xE1, 0xE2, 0xE3]] = True
        word = np.zeros(256, bool)
        word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        mark = np.zeros(256, bool)
        mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
        self.word, self.mark = word, mark
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves, others from U+0100 on
        self.shown = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in kept)}
        self.room = 0
        self.clear()

    def clear(self) -> None:
        self.key, self.check, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.at, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.raw, self.raw_at, self.raw_size = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.n = self.filled = self.raw_filled = 0

    def _powered(self, n: int) -> None:
        if n > self.room:
            self.room = max(n, AT_ONCE + 1)
            self.up, self.up2 = _powers(BASE, self.room), _powers(BASE2, self.room)
            self.down, self.down2 = (_powers(np.uint64(pow(int(b), -1, 1 << 64)), self.room) for b in (BASE, BASE2))

    def _ids(self, piece: str) -> list[int]:
        if ONE_WORD.fullmatch(piece):
            word = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            return [t.id for t in self.merge(word)]
        return [t.id for word, _ in self.split(piece) for t in self.merge(word)]

    def _find(self, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Entry of each (h, h2), -1 where there is none."""
        found, todo = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        while len(todo):
            e = self.entry[slot]
            hit = (e >= 0) & (self.key[slot] == h[todo]) & (self.check[slot] == h2[todo])
            found[todo[hit]] = e[hit]
            on = (e >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return found

    def _keep(self, pieces: list[bytes]) -> np.ndarray:
        """New entries for these pieces: their bytes and ids, outside the table yet."""
        ids = [self._ids(p.decode()) for p in pieces]
        n, size = len(ids), np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        while self.n + n > len(self.at):
            self.at, self.size, self.raw_at, self.raw_size = (np.resize(x, 2 * len(x)) for x in (self.at, self.size, self.raw_at, self.raw_size))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        new = np.arange(self.n, self.n + n, dtype=np.int32)
        self.at[new], self.size[new] = self.filled + np.cumsum(size) - size, size
        self.pool[self.filled : self.filled + len(flat)] = flat
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, n)
        while self.raw_filled + len(data) + 8 > len(self.raw):
            self.raw = np.resize(self.raw, 2 * len(self.raw))
        self.raw_at[new], self.raw_size[new] = self.raw_filled + np.cumsum(size) - size, size
        self.raw[self.raw_filled : self.raw_filled + len(data)] = data
        self.n += n
        self.filled += len(flat)
        self.raw_filled += len(data)
        return new

    def _add(self, h: np.ndarray, h2: np.ndarray, pieces: list[bytes]) -> None:
        """New entries in the table; the pairs (h, h2) are different from each other and from all held."""
        new, n = self._keep(pieces), len(pieces)
        todo, slot = np.arange(n), (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        while len(todo):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = new[todo[free]]  # the last of those that want a slot has it
            got = free & (self.entry[slot] == new[todo])
            self.key[slot[got]], self.check[slot[got]] = h[todo[got]], h2[todo[got]]
            todo, slot = todo[~got], (slot[~got] + 1) & (SLOTS - 1)

    def _other(self, entry: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Indexes of pieces data[s:e] whose bytes aren't those of their entry. Eight bytes are compared at once, and byte by byte in long pieces."""
        size, at = e - s, self.raw_at[entry]
        other = size != self.raw_size[entry]
        here, there = _words(np.concatenate([data, np.zeros(8, np.uint8)])), _words(self.raw)
        todo = np.flatnonzero(~other)
        for k in range(0, LONG, 8):
            left = size[todo] - k
            todo, left = todo[left > 0], left[left > 0]
            if not len(todo):
                break
            differ = here[s[todo] + k] ^ there[at[todo] + k]
            other[todo] |= differ << LOST[np.minimum(left, 8)] != 0
        for i in np.flatnonzero(~other & (size > LONG)).tolist():
            other[i] = not np.array_equal(data[s[i] : e[i]], self.raw[at[i] : at[i] + size[i]])
        return np.flatnonzero(other)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_column(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string column; null is empty; ``end`` follows each text."""
        data, offsets = utf8(column)
        rows = len(offsets) - 1
        whole = np.zeros(rows, bool)
        if not self.piecewise:
            whole[:] = True
        elif len(data):
            hit = np.flatnonzero(self.odd[data])
            for r in np.unique(np.searchsorted(offsets, hit, side="right") - 1):
                whole[r] = OTHER_SPACE.search(data[offsets[r] : offsets[r + 1]].tobytes().decode()) is not None
            raw = data.tobytes()
            for token in self.added:
                at = raw.find(token)
                while at >= 0:  # a match across two texts only costs speed
                    whole[np.searchsorted(offsets, at, side="right") - 1] = True
                    at = raw.find(token, at + 1)
        parts, counts = self._pieces(data, offsets, whole)
        if end is None and not whole.any():
            return parts, np.concatenate([[0], np.cumsum(counts)])
        # put whole-text rows and the end id in
        extra = {int(r): self.encode(data[offsets[r] : offsets[r + 1]].tobytes().decode()) for r in np.flatnonzero(whole)}
        total = counts + (end is not None)
        for r, ids in extra.items():
            total[r] += len(ids)
        out_at = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(out_at[-1], np.uint32)
        in_at = np.concatenate([[0], np.cumsum(counts)])
        out[np.repeat(out_at[:-1] - in_at[:-1], counts) + np.arange(len(parts))] = parts
        for r, ids in extra.items():
            out[out_at[r] : out_at[r] + len(ids)] = ids
        if end is not None:
            out[out_at[1:] - 1] = end
        return out, out_at

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, n = len(offsets) - 1, len(data)
        size = np.diff(offsets)
        if not n or skip.all():
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        if self.n > MOST:
            self.clear()
        self._powered(n + 1)
        space = self.space[data]
        start = np.zeros(n, bool)
        first = np.zeros(n, bool)
        first[offsets[:-1][size > 0]] = True
        start[1:] = space[1:] & ~space[:-1]
        after = np.flatnonzero(~space[1:] & space[:-1] & ~first[1:]) + 1  # behind a run: the run's last character stands alone or goes with the next word
        start[after] = data[after - 1] != 32
        longer = after[(after > 1) & ~first[after - 1]]
        start[longer - 1] |= space[longer - 2]
        word, mark = self.word[data], self.mark[data]
        latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # letters of Latin-1, without its two signs
        word[:-1] |= latin
        word[1:] |= latin
        start[1:] |= (word[:-1] & mark[1:]) | (mark[:-1] & (data[:-1] != 39) & word[1:])
        start |= first
        if skip.any():
            start &= ~np.repeat(skip, size)
        s = np.flatnonzero(start)
        row = np.searchsorted(offsets, s, side="right") - 1
        e = np.empty_like(s)
        e[:-1] = s[1:]
        e[-1:] = n
        e = np.minimum(e, offsets[row + 1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        h = (sums[e] - sums[s]) * self.down[s]
        np.cumsum(self.table2[data] * self.up2[:n], out=sums[1:])
        h2 = (sums[e] - sums[s]) * self.down2[s] + (e - s).astype(np.uint64)
        h ^= h >> np.uint64(29)
        entry = self._find(h, h2)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            raw = data.tobytes()
            while len(miss):  # more than once if two pieces of a batch have an equal first hash
                new = miss[np.unique(h[miss], return_index=True)[1]]
                self._add(h[new], h2[new], [raw[a:b] for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)])
                entry[miss] = self._find(h[miss], h2[miss])
                miss = miss[entry[miss] < 0]
        other = self._other(entry, data, s, e)
        if len(other):
            entry[other] = self._keep([data[a:b].tobytes() for a, b in zip(s[other].tolist(), e[other].tolist(), strict=True)])
        length = self.size[entry].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.at[entry] - before[:-1], length) + np.arange(before[-1])]
        return ids, np.bincount(row, weights=length, minlength=rows).astype(np.int64)
