"""Pairs of large blocks, tile by tile: what a pair has to pass first is tested for many pairs at once, outside the JVM.

Rows come sorted by their cell (``groups.cells``). A task holds the rows of one cell, two tiles at most, and
looks at ``AT_ONCE`` pairs together, so its memory doesn't grow with the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodestone.functions.similarity import COLOR_SIMILARITY, EARTH_M, FACE_DISTANCE, PREFILTER_BITS, SAME_SESSION_M, SAME_SESSION_S

CELL = ["__block", "__p", "__q"]
#: Pairs that are looked at together.
AT_ONCE = 1 << 20
NEAR_US = int(SAME_SESSION_S * 1_000_000)


def meters(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Great-circle distances; NaN where a coordinate is missing."""
    dy, dx = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    s = dy * dy + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * dx * dx
    return EARTH_M * 2 * np.arctan2(np.sqrt(s), np.sqrt(1 - s))


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells, in their order: as many as came together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        end = starts(pa.Table.from_batches([b]))[-1]
        goes_on = held and all(held[-1].column(c)[-1] == b.column(c)[0] for c in CELL)
        if held and (end or not goes_on):
            cut = end if goes_on else 0
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held, b, end = [], b.slice(cut), end - cut
        if end:
            yield pa.Table.from_batches([b.slice(0, end)]).combine_chunks()
            b = b.slice(end)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(table: pa.Table) -> np.ndarray:
    """Where the cells of a table begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in CELL:
        x = table.column(c).combine_chunks()
        if not pa.types.is_integer(x.type):
            x = x.dictionary_encode().indices
        x = np.asarray(x)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _plain(column: pa.Array, fill: int | float, t: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, which of them are there)."""
    return np.asarray(column.fill_null(fill)).astype(t, copy=False), np.asarray(column.is_valid())


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, -1 where there is no list; elements as rows, padded with zeros, NaN for null)."""
    size = np.asarray(column.value_lengths().fill_null(-1)).astype(np.int64)
    n = np.maximum(size, 0)
    out = np.zeros((len(size), int(n.max(initial=0))))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return size, out


class Rows:
    """Columns of some rows as arrays; ``rows[k]`` are the rows at places k."""

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    def __getitem__(self, k) -> Rows:
        return Rows(**{c: x[k] for c, x in self.__dict__.items()})

    def __len__(self) -> int:
        return len(self.id)


def near_columns(t: pa.Table) -> dict[str, np.ndarray]:
    column = lambda c: t.column(c).combine_chunks()
    hashes, hashed = _plain(column("hash"), 0, np.int64)
    us, dated = _plain(column("us"), 0, np.int64)
    return {"id": np.asarray(column("asset_id")), "hash": hashes.view(np.uint64), "hashed": hashed, "us": us, "dated": dated}


def near(a: Rows, b: Rows) -> np.ndarray:
    out = np.bitwise_count(a.hash[:, None] ^ b.hash) <= PREFILTER_BITS
    return out if a.hashed.all() and b.hashed.all() else out & a.hashed[:, None] & b.hashed


def close_in_time(a: Rows, b: Rows) -> np.ndarray | None:
    """Pairs within the time of a session; None if there are none."""
    if not (a.dated.any() and b.dated.any()):
        return None
    return (np.abs(a.us[:, None] - b.us) <= NEAR_US) & a.dated[:, None] & b.dated


def similar_color(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """``similarity.similar_color`` of all pairs of signatures (elements, sizes); a null element is NaN."""
    shared = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        shared += np.fmin(a[:, k, None], b[:, k])
    least = np.fmin(a.sum(1)[:, None], b.sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return ~((na[:, None] == nb) & (na > 0)[:, None] & (least > 0) & (shared / least < COLOR_SIMILARITY))


class Cell:
    """What the predicates of pairs read of the rows of some cells."""

    def __init__(self, t: pa.Table):
        column = lambda c: t.column(c).combine_chunks()
        lat, lat_there = _plain(column("lat"), np.nan, float)
        lon, lon_there = _plain(column("lon"), np.nan, float)
        faces, counted = _plain(column("face_count"), 0, np.int64)
        size, color = _lists(column("color_signature"))
        _, first, code = np.unique(np.column_stack([size, color]), axis=0, return_index=True, return_inverse=True)
        self.color_size, self.color = size[first], color[first]  # of each different signature
        prints = column("faceprints")
        n = np.maximum(np.asarray(prints.value_lengths().fill_null(-1)).astype(np.int64), 0)
        self.first = np.cumsum(n) - n
        self.dims, self.prints = _lists(prints.flatten())
        at = np.arange(t.num_rows)
        self.rows = Rows(**near_columns(t), lat=lat, lon=lon, located=lat_there & lon_there, faces=faces, counted=counted, n=n, at=at, code=code.ravel())

    def session(self, a: Rows, b: Rows, ok: np.ndarray | None) -> int:
        close = close_in_time(a, b)
        if close is None:
            return 0
        i, j = np.nonzero(close if ok is None else close & ok)
        apart = ~(meters(a.lat[i], a.lon[i], b.lat[j], b.lon[j]) <= SAME_SESSION_M)
        return len(i) - int(np.count_nonzero(apart & a.located[i] & b.located[j]))

    def colors(self, a: Rows, kb: np.ndarray, b_of: np.ndarray) -> np.ndarray:
        """Similar colours of rows and of those that have which (``b_of``) of the different signatures ``kb``."""
        ka, a_of = np.unique(a.code, return_inverse=True)
        return similar_color(self.color[ka], self.color_size[ka], self.color[kb], self.color_size[kb])[a_of][:, b_of]

    def people(self, a: Rows, b: Rows, left: np.ndarray) -> np.ndarray:
        """``similarity.same_people``; ``left``: where the row of a is the left one."""
        differ = a.counted[:, None] & b.counted & (a.faces[:, None] != b.faces)
        zero = np.where(left, (a.counted & (a.faces == 0))[:, None], b.counted & (b.faces == 0))
        i, j = np.flatnonzero(a.n), np.flatnonzero(b.n)
        if len(i) and len(j):
            zero[np.ix_(i, j)] |= self._match(a[i], b[j], left[np.ix_(i, j)])
        return zero & ~differ

    def _match(self, a: Rows, b: Rows, left: np.ndarray) -> np.ndarray:
        def places(x: Rows) -> tuple[np.ndarray, np.ndarray]:
            first = np.cumsum(x.n) - x.n
            return first, np.repeat(self.first[x.at] - first, x.n) + np.arange(x.n.sum())

        (fa, ka), (fb, kb) = places(a), places(b)
        s = np.zeros((len(ka), len(kb)))
        for k in range(self.prints.shape[1]):
            d = self.prints[ka, k][:, None] - self.prints[kb, k]
            s += d * d
        close = (np.sqrt(s) <= FACE_DISTANCE) & (self.dims[ka][:, None] == self.dims[kb]) & (self.dims[ka] >= 0)[:, None]
        a_in_b = np.logical_and.reduceat(np.logical_or.reduceat(close, fb, axis=1), fa, axis=0)
        b_in_a = np.logical_and.reduceat(np.logical_or.reduceat(close, fa, axis=0), fb, axis=1)
        return np.where((a.n[:, None] < b.n) | ((a.n[:, None] == b.n) & left), a_in_b, b_in_a)

    def counts(self, a: Rows, b: Rows, same: bool) -> np.ndarray:
        """Pairs, and those near in bits, in one session, of the same people and of similar colours."""
        out = np.zeros(5, np.int64)
        step = max(1, AT_ONCE // max(len(b), int(b.n.sum()), 1))
        plain = all((x.faces == 0).all() and x.counted.all() for x in (a, b))
        signatures = np.unique(b.code, return_inverse=True)
        for k in range(0, len(a), step):
            some = a[k : k + step]
            left = some.id[:, None] < b.id if same or not plain else None
            ok = left if same else None
            count = lambda x: int(np.count_nonzero(x if ok is None else x & ok))  # noqa: B023, E731
            n = len(some) * len(b) if ok is None else int(np.count_nonzero(ok))
            out += [n, count(near(some, b)), self.session(some, b, ok), n if plain else count(self.people(some, b, left)), count(self.colors(some, *signatures))]
        return out


COUNTS = ["n_pairs", "n_near", "n_session", "n_people", "n_color"]


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``__block`` and ``COUNTS`` of each cell."""
    for t in by_cell(batches):
        cell, at = Cell(t), starts(t)
        tile = np.asarray(t.column("__tile").combine_chunks())
        p, q = (np.asarray(t.column(c).combine_chunks()) for c in ("__p", "__q"))
        found = []
        for i, j in zip(at, [*at[1:], t.num_rows], strict=True):
            k = np.arange(i, j)
            same = p[i] == q[i]
            a, b = (k, k) if same else (k[tile[i:j] == p[i]], k[tile[i:j] == q[i]])
            found.append(cell.counts(cell.rows[a], cell.rows[b], same))
        yield pa.RecordBatch.from_arrays([t.column("__block").combine_chunks().take(pa.array(at)), *[pa.array(x) for x in np.array(found).T]], names=["__block", *COUNTS])


class Found:
    """Makes batches of pairs that passed the cheap tests, of the columns that ``pair_schema`` names.

    What a pair of rows without faces and without vectors needs is settled here: its distance is that of its bits. Only
    the other pairs carry the columns that the costly tests read.
    """

    def __init__(self, columns: list[str], strict: float, sessions: bool):
        self.columns, self.strict, self.sessions = columns, strict, sessions

    def batches(self, t: pa.Table, a: Rows, b: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, AT_ONCE // max(len(b), 1))
        for k in range(0, len(a) if len(b) else 0, step):
            some = a[k : k + step]
            passed = near(some, b)
            close = close_in_time(some, b) if self.sessions else None
            if close is not None:
                passed |= close
            i, j = np.nonzero(passed)
            if same:
                ordered = some.id[i] < b.id[j]
                i, j = i[ordered], j[ordered]
            for m in range(0, len(i), AT_ONCE // 16):
                part = slice(m, m + AT_ONCE // 16)
                yield self.batch(t, some[i[part]], b[j[part]])

    def batch(self, t: pa.Table, x: Rows, y: Rows) -> pa.RecordBatch:
        first = x.id < y.id
        left, right = np.where(first, x.at, y.at), np.where(first, y.at, x.at)
        distance = np.bitwise_count(x.hash ^ y.hash) / 64.0
        # near in bits (then both hashes are there) and near enough, without faces, not both with a vector
        settled = x.hashed & y.hashed & (distance <= min(self.strict, PREFILTER_BITS / 64)) & x.faceless & y.faceless & ~(x.vector & y.vector)
        take = lambda c, at, mask: t.column(c).combine_chunks().take(pa.array(at, mask=mask))
        out = [take("__block", left, None), pa.array(distance, mask=~settled), take("asset_id", left, None), take("asset_id", right, None)]
        out += [take(c, at, settled) for at in (left, right) for c in self.columns]
        return pa.RecordBatch.from_arrays(out, names=["__block", "settled", "a_asset_id", "b_asset_id", *[f"{s}_{c}" for s in "ab" for c in self.columns]])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_cell(batches):
            at = starts(t)
            faces, counted = _plain(t.column("face_count").combine_chunks(), 1, np.int64)
            vector = np.asarray(t.column("feature").combine_chunks().is_valid())
            rows = Rows(**near_columns(t), faceless=counted & (faces == 0), vector=vector, at=np.arange(t.num_rows))
            tile, p, q, new = (np.asarray(t.column(c).combine_chunks()) for c in ("__tile", "__p", "__q", "__new"))
            for i, j in zip(at, [*at[1:], t.num_rows], strict=True):
                k = np.arange(i, j)
                same = p[i] == q[i]
                a, b = (k, k) if same else (k[tile[i:j] == p[i]], k[tile[i:j] == q[i]])
                fresh = lambda x: (rows[x[new[x]]], rows[x[~new[x]]])  # noqa: B023, E731
                (a_new, a_old), (b_new, b_old) = fresh(a), fresh(b)
                yield from self.batches(t, a_new, b_new, same)
                yield from self.batches(t, a_new, b_old, False)
                if not same:  # pairs of two rows that aren't new were judged before
                    yield from self.batches(t, a_old, b_new, False)
