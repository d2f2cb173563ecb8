"""SimHash near-duplicates by a binary trie self-join.

Different fingerprints, each once, form binary tries. The self-join walks pairs of trie nodes
together from the root: a pair descends to its equal-bit children with the same number of
differing bits and to its unequal-bit children with one more, and is dropped beyond the
Hamming budget.

To share the work out, the tries are rotated: of any budget + 1 blocks of bits, two linked
fingerprints agree in at least one. For each block there is a trie that has it on top; there
only equal-bit pairs need walking, so each block value is an independent subtree, joined in
one task. A subtree with more than ``SUBTREE`` fingerprints is rotated again over its
remaining bits. Subtrees return a spanning set of links, not all pairs, and pairs of nodes whose
fingerprints are already one component are dropped; components are unaffected by that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import plain, slices
from lodestone.operators.graph import connected_components
from lodestone.sources.tables import cut

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 3
#: Fingerprints of a subtree that one task joins.
SUBTREE = 1 << 16
#: Node pairs that are walked at once.
FRONT = 1 << 18
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None) -> int:
    """64 bits: bit i is set if over half the shingles' hashes have it; no words: 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    raw = (text or "").encode().translate(LOWER).split()  # at the same six white-space characters as WORD
    if not raw:
        return 0
    if len(raw) < SHINGLE:
        return digest(b" ".join(raw), SEED)
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    total = np.zeros((8, 8), np.int64)  # by shift, by byte
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        cut_at = np.arange(0, len(part), 255)
        for k in range(8):
            sums = np.add.reduceat((part >> np.uint64(k)) & LANES, cut_at)  # eight counters of 8 bits each
            total[k] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    out = 0
    for k, byte in zip(*np.nonzero(2 * total > len(hashes)), strict=True):
        out |= 1 << int(8 * byte + k)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long (the 64 bits as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _root(up: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = up[x]
        if (y == x).all():
            return x
        x = up[y]


def _union(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join components (roots are their smallest members) along links a-b."""
    while len(a):
        a, b = _root(up, a), _root(up, b)
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(up, a, b)
        up[:] = up[up]


def trie_components(group: np.ndarray, rest: np.ndarray, bits: int, budget: int = BUDGET, front: int = FRONT) -> np.ndarray:
    """Smallest index linked to each key, over links of equal ``group`` and up to ``budget`` different ``bits`` of ``rest``.

    Keys are sorted by (group, rest) and different from each other. A trie node at a depth is a
    range of them; pairs of nodes are walked depth first in slices of at most ``front``.
    """
    n = len(rest)
    up = np.arange(n)
    if n < 2:
        return up
    bounds = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
    low, high = bounds[:-1], bounds[1:]
    ones = [np.concatenate([[0], np.cumsum((rest >> np.uint64(bits - 1 - d)) & np.uint64(1))]).astype(np.int64) for d in range(bits)]
    many = high - low > 1
    stack = [(0, low[many], high[many], low[many], high[many], np.zeros(int(many.sum()), np.int8))]
    same_to = _runs(up)
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > front:
            half = len(al) // 2
            stack += [(depth, al[half:], ah[half:], bl[half:], bh[half:], diff[half:]), (depth, al[:half], ah[:half], bl[:half], bh[:half], diff[:half])]
            continue
        # drop pairs that can't bring anything together
        done = (same_to[al] >= ah) & (same_to[bl] >= bh) & (up[al] == up[bl])
        al, ah, bl, bh, diff = (x[~done] for x in (al, ah, bl, bh, diff))
        # two single keys: compare what is left at once
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            hit = np.bitwise_count(rest[a] ^ rest[b]) <= budget
            if hit.any():
                _union(up, a[hit], b[hit])
                up = _root(up, up)
                same_to = _runs(up)
            al, ah, bl, bh, diff = (x[~single] for x in (al, ah, bl, bh, diff))
        if not len(al) or depth == bits:
            continue
        c = ones[depth]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])  # first keys with a one at this depth
        self_pair = al == bl
        new = [
            (al, am, bl, bm, diff, np.ones(len(al), bool)),
            (am, ah, bm, bh, diff, np.ones(len(al), bool)),
            (al, am, bm, bh, diff + 1, diff < budget),
            (am, ah, bl, bm, diff + 1, (diff < budget) & ~self_pair),
        ]
        parts = []
        for x in new:
            keep = x[5] & (x[0] < x[1]) & (x[2] < x[3]) & ~((x[0] == x[2]) & (x[1] - x[0] == 1))
            parts.append([y[keep] for y in x[:5]])
        stack.append((depth + 1, *(np.concatenate(z) for z in zip(*parts, strict=True))))
    return up


def _runs(up: np.ndarray) -> np.ndarray:
    """End of the run of equal components that each index stands in."""
    ends = np.concatenate([np.flatnonzero(up[1:] != up[:-1]) + 1, [len(up)]])
    return np.repeat(ends, np.diff(np.concatenate([[0], ends])))


def _without(mask: int) -> list[int]:
    return [i for i in range(BITS - 1, -1, -1) if not mask >> i & 1]


def _blocks(mask: int, parts: int) -> list[int]:
    """Masks of the bits outside ``mask``, in ``parts`` blocks."""
    free = _without(mask)
    edges = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def subtrees(keys: DataFrame, budget: int = BUDGET, most: int = SUBTREE) -> DataFrame:
    """mask, value, fp: each fingerprint in every subtree that must be joined.

    Two fingerprints within the budget share at least one subtree. Subtrees over ``most`` are
    rotated again until they fit or all bits are fixed (then they hold one fingerprint).
    """
    def spread(df: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        table = F.create_map(*[x for m, more in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | y)) for y in more]))])
        out = df.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")

    masks = {0: _blocks(0, budget + 1)}
    rows, done = spread(keys.select("fp", F.lit(0).cast("long").alias("mask")), masks), None
    for _ in range(4):
        heavy = cut(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("mask", "value"))
        if not heavy.head(1):
            break
        fits = rows.join(heavy, ["mask", "value"], "left_anti")
        done = fits if done is None else done.union(fits)
        masks = {m | y: _blocks(m | y, budget + 1) for m, more in masks.items() for y in more}
        rows = cut(spread(rows.join(heavy, ["mask", "value"], "left_semi"), masks).distinct())
    return rows if done is None else done.union(rows)


def links(keys: DataFrame, budget: int = BUDGET, most: int = SUBTREE) -> DataFrame:
    """src, dst: links that connect just those fingerprints (``fp``) that pairs within the budget connect."""
    schema = "src long, dst long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 4 * FRONT:
                table = pa.Table.from_batches(held)
                mask, value = table["mask"].to_numpy(), table["value"].to_numpy()
                whole = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))  # the last subtree may go on
                if len(whole):
                    n = int(whole[-1]) + 1
                    yield from join(table.slice(0, n))
                    held, size = table.slice(n).to_batches(), table.num_rows - n
        if size:
            yield from join(pa.Table.from_batches(held))

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        mask, value, fp = (table[c].to_numpy() for c in ("mask", "value", "fp"))
        for m in np.unique(mask):
            own = mask == m
            v, f = value[own], fp[own].view(np.uint64)
            free = _without(int(m) & (1 << 64) - 1)
            rest = np.zeros(len(f), np.uint64)
            for i in free:
                rest = rest << np.uint64(1) | (f >> np.uint64(i)) & np.uint64(1)
            order = np.lexsort((rest, v))
            v, f, rest = v[order], f[order], rest[order]
            up = trie_components(v, rest, len(free), budget)
            linked = up != np.arange(len(up))
            yield pa.RecordBatch.from_arrays([pa.array(f[linked].view(np.int64)), pa.array(f[up[linked]].view(np.int64))], names=["src", "dst"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = subtrees(keys, budget, most)
    return rows.repartition(n, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row a document: doc_id, fp, component_id (smallest doc_id among all it is linked to).

    Null and empty texts have the fingerprint zero and are linked like any other. Null doc_ids
    keep their row and are never the smallest; a component of null doc_ids only has a null id.
    Repeated rows each count. Copies share one fingerprint, which enters the join once. Other
    columns are ignored; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs))
    keys = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    members = connected_components(cut(links(keys.select("fp"), budget)))
    named = keys.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = cut(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the near-duplicate contract."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
