"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import cut

#: Edges of a block up to which one task settles it.
SETTLED = 1 << 18


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node of the undirected edges.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every step is one
    min-aggregation by node and one join, and rounds grow with the logarithm of the longest
    path. The minima are materialized, so both sides of a join are plain shuffles: a hub's edges are
    split over tasks where adaptive execution finds them skewed, and small sides are broadcast by their
    size. Self-loops make a node of their own; null ends are dropped; an empty table gives an
    empty result. Each round's edges are checkpointed, so a lost executor costs one round.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    ordered = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = ordered.where("u = v").select("u")
    now = ordered.where("u <> v")
    while True:
        # large star: all larger neighbours of u point to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its smaller neighbours point to the smallest of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        now = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        if not _unsettled(now):
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.union(roots).union(loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found.union(roots).select("node"), "node", "left_anti"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are anything but stars that point to their centres.

    In stars each u has one edge and no v is a u; then each v is the smallest of its component.
    """
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return bool(seen.where("out > 1 or out = 1 and into = 1").head(1))


def components_within(edges: DataFrame, block: str, src: str = "src", dst: str = "dst", most: int = SETTLED) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for edges (long) that never leave their block.

    One shuffle by block settles all blocks of up to ``most`` edges: a task reads them in order and
    holds the stars of one block and a batch. Larger blocks go through ``connected_components``.
    ``edges`` is read twice, so it should be materialized. Self-loops make a node of their own; null
    ends are dropped; a null block is a block; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(block).alias("block"), F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    large = cut(pairs.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("block").alias("large")))
    if not large.head(1):
        return _settled(pairs)
    same = F.col("block").eqNullSafe(F.col("large"))
    return _settled(pairs.join(large, same, "left_anti")).union(connected_components(pairs.join(large, same, "left_semi"), "u", "v"))


#: Edges that ``thinned`` looks at together.
THINNED = 1 << 18


def thinned(edges: DataFrame, block: str, at_once: int = THINNED) -> DataFrame:
    """Edges (block, src, dst) with the same nodes and components, but fewer where they are dense: no shuffle.

    Of each ``at_once`` edges of a task only the stars of their components stay, so a block in which
    most pairs are linked sends its nodes, not its pairs. No end is null and no edge is a self-loop.
    """
    schema = f"`{block}` string, src long, dst long"

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column(block).combine_chunks().dictionary_encode()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        of, node, component = stars_of(np.asarray(names.indices.fill_null(-1)), table.column("src").to_numpy(), table.column("dst").to_numpy())
        apart = node != component
        code = of[apart]
        kept = names.dictionary.take(pa.array(code, pa.int32(), mask=code < 0))
        return pa.RecordBatch.from_arrays([kept, pa.array(component[apart]), pa.array(node[apart])], names=[block, "src", "dst"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
            if n >= at_once:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return edges.select(F.col(block).cast("string"), F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(thin, schema)


def _settled(pairs: DataFrame) -> DataFrame:
    """node, component of edges (block, u, v), block by block."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node: np.ndarray, component: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

        last, stars = None, (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the block that may go on, its nodes and components so far
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("block")
            code = np.asarray(names.dictionary_encode().indices.fill_null(-1))
            of = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
            if names[0].as_py() != last:
                yield out(*stars)
                stars = (stars[0][:0], stars[1][:0])
            u, v = (np.concatenate([held, b.column(c).to_numpy()]) for held, c in zip(stars, "uv", strict=True))
            of = np.concatenate([np.zeros(len(stars[0]), np.int64), of])
            of, node, component = stars_of(of, u, v)
            goes_on = of == of[-1]
            yield out(node[~goes_on], component[~goes_on])
            last, stars = names[b.num_rows - 1].as_py(), (node[goes_on], component[goes_on])
        yield out(*stars)

    by_block = pairs.select("block", F.col("u").cast("long"), F.col("v").cast("long")).repartition("block").sortWithinPartitions("block")
    return by_block.mapInArrow(settle, "node long, component long")


def stars_of(of: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, node, smallest node reachable) of edges (u, v) in blocks ``of``, sorted by block and node."""
    both, blocks = np.concatenate([u, v]), np.concatenate([of, of])
    order = np.lexsort((both, blocks))
    both, blocks = both[order], blocks[order]
    new = np.concatenate([[True], (both[1:] != both[:-1]) | (blocks[1:] != blocks[:-1])])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1  # in the order of nodes, so the smallest rank is the smallest node
    a, b = rank[: len(u)], rank[len(u) :]
    node, up = both[new], np.arange(int(new.sum()))
    while len(a):  # each root moves below its smallest neighbour, then chains are shortened
        low = np.minimum(up[a], up[b])
        for end in (up[a], up[b]):
            np.minimum.at(up, end, low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    return blocks[new], node, node[up]
