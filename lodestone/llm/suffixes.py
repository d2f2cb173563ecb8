"""Exact substring dedup with suffix arrays built by two-stage sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else.

1. Anchors. Every window of LENGTH bytes has an anchor: the leftmost of its grams (GRAM bytes)
   with the least hash. Equal windows have equal anchors at equal places, so windows of
   different grams need no comparison. Neighbouring windows with the same anchor make a row: a
   context, named by the BLAKE2b digest (128 bits) of its bytes. Copies of a context collapse
   (within batches before the shuffle, then by group): all their windows repeat.
2. Contexts that share a gram but differ are the candidates. Only they are fetched as bytes, split
   by where the anchor lies into classes whose windows have all but CLASS bytes in common, and
   grouped by a hash of those common bytes. Equal candidates meet by their digest before, and one of them
   stands for all. A gram in more than HOT differing contexts gets classes
   of HOT_CLASS places, so that its surroundings part its candidates into many groups.
3. Groups of at least two are concatenated and their suffix array is built by two-stage
   sorting: suffixes smaller than their successors are sorted directly, all others are induced
   by one scan over the buckets of first bytes. Windows repeat where the common prefix of
   neighbours in the array has LENGTH bytes or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import partitions_for, plain, slices, utf8
from lodestone.llm.spans import KEY, keyed, merged, without_spans
from lodestone.sources.tables import cut, shared_path

LENGTH, GRAM = 200, 48
#: Anchor places in a window, in four classes.
REACH = LENGTH - GRAM + 1
CLASS = -(-REACH // 4)
#: Differing contexts of a gram beyond which its candidates are split by their surroundings, and the places of such a class.
HOT, HOT_CLASS = 2048, 3
#: Bytes of candidates that are sorted at once (a group isn't divided).
SORT_BYTES = 1 << 20
BLOCK = 1 << 20
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
T1, T2 = (np.random.default_rng(k).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (61, 62))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Polynomial hashes of substrings of a byte array, modulo 2^64; both bases are odd."""

    _up: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: np.uint64, table: np.ndarray):
        n = len(data)
        held = self._up.get(int(base))
        if held is None or len(held[0]) <= n:
            size = max(n + 1, 2 * BLOCK)
            held = self._up[int(base)] = (_powers(base, size), _powers(np.uint64(pow(int(base), -1, 1 << 64)), size))
        up, self.down = held
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=self.sums[1:])

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (self.sums[z] - self.sums[a]) * self.down[a]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value (by its upper 43 bits) in each full window; len(v) < 2^21."""
    n = len(v) - width + 1
    mask = np.uint64((1 << 21) - 1)
    key = (v & ~mask) | np.arange(len(v), dtype=np.uint64)
    rows = -(-len(v) // width)
    grid = np.full(rows * width, ~np.uint64(0))
    grid[: len(v)] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & mask).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, place of the anchor in the first window, gram, x1, x2) of each context.

    gram hashes the anchor's gram; (x1, x2) is a digest of all bytes of the context's windows, which
    decide the place of the anchor too.
    """
    out = []
    n = len(data)
    if n >= LENGTH:
        ends = np.repeat(offsets[1:], np.diff(offsets))
    for a in range(0, n - LENGTH + 1, BLOCK):
        part = data[a : a + BLOCK + LENGTH - 1]
        s = np.arange(len(part) - LENGTH + 1)
        g = np.arange(len(part) - GRAM + 1)
        v = mixed(Hashes(part, B1, T1).of(g, g + GRAM))
        anchor = window_minima(v, REACH)
        ok = ends[a + s] - (a + s) >= LENGTH
        row = np.searchsorted(offsets, a + s, side="right") - 1
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(s)]]))
        keep = ok[first]
        first, count = first[keep], count[keep]
        place = anchor[first] - first
        z = first + count - 1 + LENGTH
        raw, name = part.tobytes(), hashlib.blake2b
        names = np.frombuffer(b"".join([name(raw[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), z.tolist(), strict=True)]), np.int64).reshape(-1, 2)
        out.append((row[first], a + first - offsets[row[first]], count, place, v[anchor[first]].view(np.int64), names[:, 0], names[:, 1]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: kind 0: a context to compare, 1: windows known to repeat. many: copies of it are known.
CONTEXT = "to long, kind int, gram long, x1 long, x2 long, doc long, h long, first long, windows int, place int, many boolean"
NAMES = ["to", "kind", "gram", "x1", "x2", "doc", "h", "first", "windows", "place", "many"]
OUT = ["gram", *NAMES[5:]]
FOUND = "kind int, gram long, doc long, h long, first long, windows int, place int, many boolean"


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group, group of each row) of sorted rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _find_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data, offsets = utf8(b.column("text"))
        row, first, windows, place, gram, x1, x2 = contexts(data, offsets)
        if not len(row):
            continue
        doc, h = b.column("doc").to_numpy()[row], b.column("h").to_numpy()[row]
        order = np.lexsort((x2, x1))
        doc, h, first, windows, place, gram, x1, x2 = (c[order] for c in (doc, h, first, windows, place, gram, x1, x2))
        start, of = _groups(x1, x2)
        many = np.diff(np.concatenate([start, [len(of)]])) > 1
        lead = np.zeros(len(of), bool)
        lead[start] = True
        send = [(gram, 0, lead, many[of]), (h ^ doc, 1, many[of], many[of])]  # copies: each one's windows, and the first to stand for all
        for to, kind, keep, flag in send:
            k = np.flatnonzero(keep)
            if len(k):
                columns = [to[k], np.full(len(k), kind, np.int32), gram[k], x1[k], x2[k], doc[k], h[k], first[k], windows[k].astype(np.int32), place[k].astype(np.int32), flag[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=NAMES)


def _compare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, gram, x1, x2). Out: windows that repeat (kind 1), candidates (kind 0).

    Copies of a context are neighbours, and so are the contexts of a gram: only the last context waits
    for the next batch, so memory doesn't grow with a gram.
    """
    last: dict[str, np.ndarray] | None = None  # the last context, one row
    shared = False  # whether its gram had another context before

    def batch(rows: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
        n = len(rows["doc"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(rows[c]) for c in OUT)], names=["kind", *OUT])

    for b in batches:
        if not b.num_rows:
            continue
        rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in NAMES[1:]}
        known = rows["kind"] == 1
        if known.any():
            yield batch({k: c[known] for k, c in rows.items()}, 1)
        rows = {k: c[~known] for k, c in rows.items()}
        if not len(rows["doc"]):
            continue
        if last is not None:
            rows = {k: np.concatenate([last[k], c]) for k, c in rows.items()}
        start, of = _groups(rows["gram"], rows["x1"], rows["x2"])
        size = np.diff(np.concatenate([start, [len(of)]]))
        repeat = (size > 1)[of] & ~rows["many"]
        if repeat.any():
            yield batch({k: c[repeat] for k, c in rows.items()}, 1)
        many = np.maximum.reduceat(rows["many"].astype(np.int8), start).astype(bool) | (size > 1)
        one = {k: c[start] for k, c in rows.items()} | {"many": many}
        first, gram = _groups(one["gram"])
        differ = np.diff(np.concatenate([first, [len(gram)]])) > 1
        differ[0] |= shared
        keep = differ[gram]
        shared, keep[-1] = bool(differ[-1]), False
        if keep.any():
            yield batch({k: c[keep] for k, c in one.items()}, 0)
        last = {k: c[-1:] for k, c in one.items()}
    if last is not None and shared:
        yield batch(last, 0)


CANDIDATE = "k1 long, k2 long, d1 long, d2 long, doc long, h long, first long, windows int, many boolean, data binary"
_CANDIDATE = pa.schema([*[(c, pa.int64()) for c in ("k1", "k2", "d1", "d2", "doc", "h", "first")], ("windows", pa.int32()), ("many", pa.bool_()), ("data", pa.binary())])
#: Candidates that a task remembers to have sent.
SENT = 200_000


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of candidates, by class of the anchor's place, with a hash of what a class has in common and a digest.

    Of equal bytes in a task one goes on for all; it and the others are windows that repeat (data is null).
    """
    sent: dict[tuple, list] = {}
    for b in slices(batches):
        rows = []
        if len(sent) > SENT:
            sent.clear()
        for doc, h, text, own in zip(*(b.column(c).to_pylist() for c in ("doc", "h", "text", "own")), strict=True):
            raw = text.encode()
            flat = np.frombuffer(raw, np.uint8)
            part = []  # (anchor, first window, last window + 1, class, width, many)
            for x in own:
                at, low, width = x["first"] + x["place"], x["first"], HOT_CLASS if x["hot"] else CLASS
                while low < x["first"] + x["windows"]:
                    c = (at - low) // width
                    high = min(x["first"] + x["windows"], at - c * width + 1)  # windows low..high-1 have their anchor in class c
                    part.append((at, low, high, c, width, x["many"]))
                    low = high
            at, low, high, c, width, many = (np.array(v) for v in zip(*part, strict=True))
            a, z = at - c * width, at + LENGTH - np.minimum((c + 1) * width - 1, REACH - 1)
            salt = (width * LENGTH + c).astype(np.uint64)
            k1, k2 = (mixed(hashes.of(a, z) + salt).view(np.int64).tolist() for hashes in (Hashes(flat, B1, T1), Hashes(flat, B2, T2)))
            for i, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                data = raw[x : y - 1 + LENGTH]
                digest = hashlib.blake2b(data, digest_size=16).digest()
                d1, d2 = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                place = (doc, h, x, y - x)
                first = sent.setdefault((k1[i], k2[i], digest), [place, False])
                if first[0] is place:
                    rows.append((k1[i], k2[i], d1, d2, *place, bool(many[i]), data))
                    continue
                if not first[1]:
                    rows.append(_settled(first[0]))
                    first[1] = True
                rows.append(_settled(place))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CANDIDATE)], schema=_CANDIDATE)


def _settled(place: tuple) -> tuple:
    """A candidate all of whose windows repeat: it needs no class, so its key only spreads it."""
    return (place[1] ^ place[2], 0, 0, 0, *place, True, None)


def _meet_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class and digest: of copies the first goes on with its bytes, and all are windows that repeat.

    Nothing is held but the last row.
    """
    last, told = None, False  # the last row that went on, and whether it is known to have copies
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("k1", "k2", "d1", "d2")], axis=1)
        live = b.column("data").is_valid().to_numpy(zero_copy_only=False)
        yield b.filter(pa.array(~live))
        b, keys = b.filter(pa.array(live)), keys[live]
        if not len(keys):
            continue
        before = np.concatenate([keys[:1] if last is None else last[0][None], keys[:-1]])
        copy = (keys == before).all(axis=1)
        if last is None:
            copy[0] = False
        first = np.flatnonzero(~copy)
        has = np.zeros(len(keys), bool)
        has[first] = np.append(copy, False)[first + 1]
        places = list(zip(*(b.column(c).to_pylist() for c in ("doc", "h", "first", "windows")), strict=True))
        rows = [_settled(places[i]) for i in np.flatnonzero(copy | has).tolist()]
        if copy[0] and not told:
            rows.append(_settled(last[1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CANDIDATE)], schema=_CANDIDATE)
        yield b.filter(pa.array(~copy))
        if len(first):
            last, told = (keys[first[-1]], places[first[-1]]), bool(first[-1] < len(keys) - 1)
        else:
            told = True


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (uint8) in order of at least their first ``depth`` bytes, by two-stage sorting.

    A suffix is of type B if it is smaller than its successor. The B suffixes are sorted directly,
    eight bytes at a time; in each bucket of a first byte they come behind the others, which one
    scan from the left induces: a suffix of type A follows its successor.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(t[1:] != t[:-1]) + 1  # first of each run of equal bytes
    runs = np.concatenate([[0], change])
    later = np.concatenate([t[change].astype(np.int16), [-1]])  # the end is smaller than any byte
    type_b = np.repeat(later > t[runs], np.diff(np.concatenate([runs, [n]])))
    padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)])
    order = _sorted(padded, np.flatnonzero(type_b), depth)
    counts = np.bincount(t, minlength=256)
    heads = np.cumsum(counts) - counts
    sa = np.full(n, -1, np.int64)
    b_counts = np.bincount(t[order], minlength=256) if len(order) else np.zeros(256, np.int64)
    tails = heads + counts - b_counts
    first_b = np.cumsum(b_counts) - b_counts
    sa[np.repeat(tails - first_b, b_counts) + np.arange(len(order))] = order
    # the last suffix is of type A and smaller than all others of its bucket
    head = heads.copy()
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    # bucket of the suffix before each, -1 where that one is of type B or there is none
    before = np.full(n, -1, np.int16)
    before[1:] = np.where(type_b[:-1], -1, t[:-1].astype(np.int16))

    def induce(low: int, high: int) -> None:
        """The scan over places low to high: what they induce goes behind what their buckets hold, in order."""
        x = sa[low:high]
        to = before[x]
        x, to = x[to >= 0] - 1, to[to >= 0]
        if len(x):
            by = np.argsort(to, kind="stable")
            x, to = x[by], to[by]
            first, _ = _groups(to)
            size = np.diff(np.concatenate([first, [len(to)]]))
            sa[np.repeat(head[to[first]] - first, size) + np.arange(len(to))] = x
            head[to[first]] += size

    for c in np.flatnonzero(counts).tolist():
        at = heads[c]
        while at < head[c]:  # runs of one byte induce into their own bucket, ahead of the scan
            at, upto = head[c], at
            induce(upto, at)
        induce(tails[c], heads[c] + counts[c])
    return sa


def _words(padded: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number in their order."""
    n = len(padded) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    return out


def _sorted(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places by their first ``depth`` bytes: ties of the first words go on to later words."""
    words = _words(padded)
    order = at[np.argsort(words[at], kind="stable")]
    _, of = _groups(words[order]) if len(order) else (None, np.zeros(0, np.int64))
    tied, shift = np.arange(len(order)), 8
    while shift < depth and len(tied):
        size = np.bincount(of)
        tied = tied[size[of] > 1] if len(tied) == len(of) else tied
        of = of[size[of] > 1]
        if not len(tied):
            break
        places = order[tied]
        w = words[np.minimum(places + shift, len(words) - 1)]
        again = np.lexsort((w, of))
        order[tied] = places[again]
        _, of = _groups(of[again], w[again])
        shift += 8
    return order


def repeated_windows(parts: list[bytes], windows: np.ndarray, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether each window of each part (the first ``windows`` places) repeats; flat, part by part.

    ``ids``: (doc, h, first) of each part; equal (doc, h, place) are one window. ``many``: parts
    with copies elsewhere, whose windows all repeat.
    """
    size = np.array([len(p) for p in parts])
    t = np.zeros(int(size.sum()) + len(parts), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    for p, a in zip(parts, begin.tolist(), strict=True):
        t[a : a + len(p)] = np.frombuffer(p, np.uint8) + 1  # UTF-8 has no byte 255; 0 parts the texts
    sa = suffix_array(t, LENGTH)
    part = np.repeat(np.arange(len(parts)), size + 1)
    place = np.arange(len(t)) - begin[part]
    full = place + LENGTH <= size[part]
    sa = sa[full[sa]]
    words = _words(np.concatenate([t, np.zeros(16, np.uint8)]))
    same = np.ones(max(len(sa) - 1, 0), bool)  # common prefix of neighbours of LENGTH or more
    for k in range(0, LENGTH, 8):
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = words[sa[live] + k] == words[sa[live + 1] + k]
    of = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else np.zeros(0, np.int64)
    p = part[sa]
    keys = np.stack([of, ids[p, 0], ids[p, 1], ids[p, 2] + place[sa]], axis=1)
    order = np.lexsort(keys.T[::-1])
    start, _ = _groups(*keys[order].T) if len(order) else (np.zeros(0, np.int64), None)
    different = np.bincount(of[order][start], minlength=int(of[-1]) + 1 if len(of) else 0)
    copied = np.bincount(of, weights=many[p], minlength=len(different)) > 0
    repeats = np.zeros(len(t), bool)
    repeats[sa] = (different > 1)[of] | copied[of]
    return np.concatenate([repeats[a : a + w] for a, w in zip(begin.tolist(), windows.tolist(), strict=True)])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k1, k2): suffix arrays over groups of at least two, many groups at once.

    Copies of a candidate's bytes go on at once, as windows that repeat; a group holds each different
    candidate once.
    """
    schema = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("windows", pa.int32())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def solve(rows: list[list]) -> list[tuple]:
        windows = np.array([r[3] for r in rows])
        hit = repeated_windows([r[5] for r in rows], windows, np.array([r[:3] for r in rows], np.int64), np.array([r[4] for r in rows]))
        out, at = [], 0
        for r in rows:
            own = hit[at : at + r[3]]
            at += r[3]
            if not r[4]:  # else they have been sent
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()
                out += [(r[0], r[1], r[2] + a, z - a) for a, z in zip(edges[::2], edges[1::2], strict=True)]
        return out

    key, group, held, size, ready = None, {}, [], 0, []
    names = ["doc", "h", "first", "windows", "many", "data"]
    for b in batches:
        columns = [b.column(c).to_pylist() for c in names]
        for k, *r in zip(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True), *columns, strict=True):
            if r[5] is None:  # its equal went on for it
                ready.append(tuple(r[:4]))
                continue
            if k != key:
                if len(group) > 1:
                    held += group.values()
                    size += sum(map(len, group))
                key, group = k, {}
                if size >= SORT_BYTES:
                    ready += solve(held)
                    held, size = [], 0
            own = group.get(r[5])
            if own is None:
                group[r[5]] = r
                if r[4]:
                    ready.append(tuple(r[:4]))
            else:
                ready.append(tuple(r[:4]))
                if not own[4]:
                    own[4] = True
                    ready.append(tuple(own[:4]))
        if len(ready) > 10_000:
            yield batch(ready)
            ready = []
    if len(group) > 1:
        held += group.values()
    yield batch(ready + (solve(held) if held else []))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows that repeat, candidates by class): of equal candidates one has its bytes, the others are settled.

    Copies meet by their digest first, whatever their class, so a class is sent each different candidate
    once, however many documents hold a passage.
    """
    spark, n = docs.sparkSession, partitions_for(docs)
    rows = keyed(docs)
    found = rows.mapInArrow(_find_contexts, CONTEXT).repartition(n, "to").sortWithinPartitions("kind", "gram", "x1", "x2").mapInArrow(_compare_contexts, FOUND)
    at = shared_path(spark, "contexts")
    found.write.parquet(at)  # narrow: repeats and candidates only
    found = spark.read.schema(FOUND).parquet(at)
    near = found.where("kind = 0")
    hot = cut(near.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("gram", F.lit(True).alias("hot")))
    near = near.join(hot, "gram", "left").withColumn("hot", F.col("hot").isNotNull()) if hot.head(1) else near.withColumn("hot", F.lit(False))
    own = near.groupBy(*KEY).agg(F.collect_set(F.struct("first", "windows", "place", "many", "hot")).alias("own"))
    fetched = rows.join(own, KEY).dropDuplicates(KEY).select(*KEY, "text", "own").mapInArrow(_fetch, CANDIDATE)
    met = fetched.repartition(n, "k1", "k2", "d1", "d2").sortWithinPartitions("k1", "k2", "d1", "d2").mapInArrow(_meet_copies, CANDIDATE)
    return found.where("kind = 1").select(*KEY, "first", "windows"), met


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, h, spans array<struct<start, end>>: maximal runs of bytes to remove, of documents that have any."""
    found, met = candidates(docs)
    sorted_out = met.repartition(partitions_for(docs), "k1").sortWithinPartitions("k1", "k2").mapInArrow(_sort_groups, "doc long, h long, first long, windows int")
    windows = found.union(sorted_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = []
            for part in b.column("own"):
                first, count = part.values.field("first").to_numpy(), part.values.field("windows").to_numpy()
                s, e = merged(first, first + count - 1 + LENGTH)
                spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), pa.array(spans, span)], names=["doc", "h", "spans"])

    return windows.groupBy(*KEY).agg(F.collect_list(F.struct("first", "windows")).alias("own")).mapInArrow(run, "doc long, h long, spans array<struct<start:long,end:long>>")


def dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, spans, kept (binary), kept_sha256, rest.

    ``rest`` is a struct of the other columns. Null and empty texts, and texts below LENGTH bytes,
    lose nothing. Repeated rows are documents each, so they lose everything to each other. An empty
    table gives an empty result.
    """
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return without_spans(docs, repeated_spans(plain(docs, "doc_id", "text")).withColumn("n_repeated", length))
