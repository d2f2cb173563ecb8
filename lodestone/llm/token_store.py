"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give
equal chunks wherever they stand. A store is a folder with one folder a version:

- ``<version>/chunks/``: Parquet (key binary, n long, data binary), each different chunk once. data
  is the Zstandard-compressed little-endian ids, 16 bits each if every id of the vocabulary fits,
  else 32; key is SHA-256 over the uncompressed 32-bit ids.
- ``<version>/recipes/``: Parquet (doc_id, nth, start, n_tokens, digests array<binary>, root), in
  ascending doc_id order over files; root is the Merkle root over a document's chunk digests.
- ``manifest.json``: the version that counts, the numbers of documents and ids, and the Merkle root
  over all recipes in their order. It is written last and replaced by a rename: a store that is
  written again is the old one until then, and a folder without it is no store.

The Merkle tree is that of one list of all documents, pairs hashed level by level and an odd node
moved up, so its root doesn't depend on how Spark divides the rows. Readers rebuild it from the
recipes' digests, and the keys from the chunks' ids: what was lost, added, altered or reordered raises.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import Encoder, vocabulary_path
from lodestone.llm.common import partitions_for, plain, scan, slices, with_column
from lodestone.sources.tables import exists, hadoop, read_json, remove, write_json

#: Chunk lengths in ids: a cut where the rolling hash has MASK_BITS zero bits, within the bounds.
MASK_BITS, LEAST, MOST, WINDOW = 10, 256, 8192, 8


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of chunks: content-defined, by a gear-like hash of the last WINDOW ids."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint64(reach)
        reach *= 2
    ends, at = [], 0
    for c in (np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + 1).tolist():
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST:
            ends.append(c)
            at = c
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


#: Leaves of a subtree that one task folds: 2 to this power.
FOLD = 14


def merkle(digests: list[bytes]) -> bytes:
    """Root over leaves: pairs are hashed level by level, an odd one moves up; none: 32 zero bytes."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [_parent(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else bytes(32)


def _parent(left: bytes, right: bytes | None = None) -> bytes:
    return left if right is None else hashlib.sha256(b"\1" + left + right).digest()


def leaf(doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    """The leaf of a document in the tree over all documents: it binds its id, place and length too."""
    return hashlib.sha256(b"\0" + f"{'' if doc_id is None else doc_id} {start} {n_tokens} ".encode() + root).digest()


def subtree_nodes(first: int, leaves: list[bytes], most: int) -> list[tuple[int, int, bytes]]:
    """(level, number, hash) of the largest whole subtrees, up to level ``most``, over leaves first, first + 1 and so on."""
    out, level, at, row = [], 0, first, leaves
    while row:
        if level == most:
            return out + [(level, at + i, x) for i, x in enumerate(row)]
        if at & 1:
            out.append((level, at, row[0]))
            at, row = at + 1, row[1:]
        if len(row) & 1:
            out.append((level, at + len(row) - 1, row[-1]))
            row = row[:-1]
        row = [_parent(row[i], row[i + 1]) for i in range(0, len(row), 2)]
        at, level = at >> 1, level + 1
    return out


def subtree_root(level: int, number: int, nodes: dict[tuple[int, int], bytes]) -> bytes | None:
    """Hash of a node from those of whole subtrees below it; None where it has no leaves."""
    if (level, number) in nodes:
        return nodes[level, number]
    if level == 0:
        return None
    left = subtree_root(level - 1, 2 * number, nodes)
    return None if left is None else _parent(left, subtree_root(level - 1, 2 * number + 1, nodes))


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), reflected, modulo that of CRC-32."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return out


_BYTES = [0x00800000]  # x^8, then squares of it
for _ in range(63):
    _BYTES.append(_times(_BYTES[-1], _BYTES[-1]))


def crc32_join(first: int, second: int, n: int) -> int:
    """CRC-32 of two byte strings one after the other, n: length of the second."""
    if not first:  # nothing to carry on
        return second
    k = 0
    while n:
        if n & 1:
            first = _times(_BYTES[k], first)
        n >>= 1
        k += 1
    return first ^ second


def encode_chunks(docs: DataFrame, end: int, path: str) -> DataFrame:
    """A recipe row (kind 0) for each document and its chunks (kind 1), each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        encoder, sent = Encoder.of(path), set()
        width = "<u2" if encoder.tokenizer.get_vocab_size() <= 65536 else "<u4"
        for b in slices(batches):
            ids, at = encoder.encode_column(b.column("text"), end)
            kind, key, doc, n, digests, data = [], [], [], [], [], []  # a recipe's key is its root
            for i, k in enumerate(b.column("doc_id").to_pylist()):
                own, x, names = ids[at[i] : at[i + 1]], 0, []
                for y in cut_points(own):
                    part = own[x:y].astype("<u4")
                    name = hashlib.sha256(memoryview(part)).digest()
                    names.append(name)
                    if name not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(name)
                        for column, value in zip((kind, key, doc, n, digests, data), (1, name, None, y - x, None, pack.compress(part.astype(width).tobytes())), strict=True):
                            column.append(value)
                    x = y
                for column, value in zip((kind, key, doc, n, digests, data), (0, merkle(names), k, len(own), names, None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(data, pa.binary())],
                names=["kind", "key", "doc_id", "n", "digests", "data"],
            )

    return plain(docs, "doc_id", "text").mapInArrow(run, "kind int, key binary, doc_id long, n long, digests array<binary>, data binary")


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key): all recipes, and the first chunk of each key."""
    last = None
    for b in batches:
        keep = []
        for kind, key in zip(b.column("kind").to_pylist(), b.column("key").to_pylist(), strict=True):
            keep.append(kind == 0 or key != last)
            if kind:
                last = key
        yield b.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, store: str, end: int = 0, path: str | None = None) -> None:
    """Write a store of (doc_id, text) rows; ``end`` follows each document.

    Null text is an empty document (the end id alone). Null doc_ids come first; rows with equal
    doc_ids each keep a recipe of their own; other columns are ignored; an empty table gives a store
    without documents. Ids are encoded once; they move once, to their digest's partition, compressed
    and each chunk once a task, so a hot chunk doesn't gather. Older versions go once the new one
    counts.
    """
    spark, path, version = docs.sparkSession, vocabulary_path(path), uuid.uuid4().hex
    at = f"{store}/{version}"
    rows = encode_chunks(docs, end, path).withColumn("__to", F.when(F.col("kind") == 1, F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "n", "key")))
    rows = rows.repartition(partitions_for(docs), "__to").sortWithinPartitions("kind", "key").drop("__to")
    rows.mapInArrow(_first_of_each, rows.schema).withColumn("kind", F.when(F.col("kind") == 1, "chunk").otherwise("recipe")).write.partitionBy("kind").option("compression", "zstd").parquet(f"{at}/staged")
    staged = spark.read.schema("key binary, doc_id long, n long, digests array<binary>, data binary, kind string").parquet(f"{at}/staged")
    recipes = staged.where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "digests", F.col("key").alias("root"))

    def step(b: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        size = b.column("n_tokens").to_numpy()
        return with_column(b, start=state["base"] + np.cumsum(size) - size, nth=state["row"] + np.arange(b.num_rows))

    scan(recipes, step, ["doc_id", "n_tokens", "root"], "n_tokens", "doc_id long, n_tokens long, digests array<binary>, root binary, start long, nth long").write.parquet(f"{at}/recipes")
    fs, chunks = hadoop(spark, f"{at}/staged/kind=chunk")
    if not (fs.exists(chunks) and fs.rename(chunks, hadoop(spark, f"{at}/chunks")[1])):  # no rows
        spark.createDataFrame([], "key binary, n long, data binary").write.parquet(f"{at}/chunks")
    remove(spark, f"{at}/staged")
    write_json(spark, f"{store}/manifest.json", {"version": version, "end": end, "bits": 16 if Encoder.of(path).tokenizer.get_vocab_size() <= 65536 else 32, **_tree(spark, at)})
    for old in fs.listStatus(hadoop(spark, store)[1]):
        if old.isDirectory() and old.getPath().getName() != version:
            fs.delete(old.getPath(), True)


def _tree(spark: SparkSession, at: str) -> dict:
    """documents, tokens and the Merkle root, from the recipes' digests.

    A task folds what it reads to whole subtrees of 2^FOLD leaves and a few smaller ones at its ends;
    the subtrees are folded likewise until a few are left for the driver.
    """
    recipes = spark.read.parquet(f"{at}/recipes").select("doc_id", "nth", "start", "n_tokens", "digests", "root")
    kind = "level int, number long, hash binary, docs long, tokens long"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["level", "number", "hash", "docs", "tokens"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, nth, start, n, digests, root = (b.column(c).to_pylist() for c in ("doc_id", "nth", "start", "n_tokens", "digests", "root"))
            leaves = []
            for d, s, k, names, r in zip(doc, start, n, digests, root, strict=True):
                if merkle(names) != r:
                    raise ValueError(f"the recipe of document {d} is altered")
                leaves.append(leaf(d, s, k, r))
            edges = [0, *(np.flatnonzero(np.diff(nth) != 1) + 1).tolist(), len(nth)] if nth else [0]
            for x, y in zip(edges, edges[1:], strict=False):
                nodes = subtree_nodes(nth[x], leaves[x:y], FOLD)
                yield batch([(*node, (y - x) * (not i), sum(n[x:y]) * (not i)) for i, node in enumerate(nodes)])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for top, number, nodes, docs, tokens in zip(*(b.column(c).to_pylist() for c in ("top", "tree", "nodes", "docs", "tokens")), strict=True):
                known = {(x["level"], x["number"]): x["hash"] for x in nodes}
                root = subtree_root(top, number, known) if len(known) == len(nodes) else None
                rows.append((top, number, root or b"", docs, tokens))
            yield batch(rows)

    nodes, top = recipes.mapInArrow(fold, kind), FOLD
    while True:
        trees = nodes.groupBy(F.lit(top).alias("top"), F.expr(f"shiftright(number, {top} - level)").alias("tree"))
        roots = trees.agg(F.collect_list(F.struct("level", "number", "hash")).alias("nodes"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).mapInArrow(grow, kind)
        last = roots.select("level", "number", "hash", "docs", "tokens").limit((1 << FOLD) + 1).collect()
        if len(last) <= 1 << FOLD:
            break
        nodes, top = roots, top + FOLD
    known = {(r.level, r.number): bytes(r.hash) for r in last}
    for level in range(top, top + FOLD + 1):
        root = subtree_root(level, 0, known)
        if not any(n << top >= 1 << level for _, n in known):
            break
    return {"documents": sum(r.docs for r in last), "tokens": sum(r.tokens for r in last), "root": (root or bytes(32)).hex()}


def _opened(bits: int):
    width = "<u2" if bits == 16 else "<u4"

    def ids(data: bytes, n: int) -> np.ndarray:
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * 4), dtype=width).astype("<u4")

    return ids


def _checked(spark: SparkSession, store: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, chunks, uses of chunks by document) of a store whose recipes have the manifest's root."""
    if not exists(spark, f"{store}/manifest.json"):
        raise FileNotFoundError(f"{store} has no manifest: it was never committed")
    manifest = read_json(spark, f"{store}/manifest.json")
    at = f"{store}/{manifest['version']}"
    found = _tree(spark, at)
    if any(found[k] != manifest[k] for k in found):
        raise ValueError(f"the recipes of {store} aren't those of its manifest: {found}")
    uses = spark.read.parquet(f"{at}/recipes").select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("seq", "key"))
    return manifest, spark.read.parquet(f"{at}/chunks").select("key", "n", "data"), uses


def read_checksums(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored chunks' ids.

    Recipes are verified against the manifest's root. Every chunk is read and decompressed, its digest
    is verified, and only (digest, crc, length) moves; the checksums of a document's chunks join to
    that of their concatenation. A chunk that is missing or altered raises. A null doc_id stays null;
    a store without documents gives no rows.
    """
    manifest, chunks, uses = _checked(spark, store)
    opened = _opened(manifest["bits"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for key, n, data in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True):
                ids = memoryview(opened(data, n))
                if hashlib.sha256(ids).digest() != key:
                    raise ValueError(f"chunk {key.hex()} is altered")
                crc.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(crc, pa.int64())], names=["key", "n", "crc"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for total, parts in zip(b.column("n_tokens").to_pylist(), b.column("parts").to_pylist(), strict=True):
                crc = n = 0
                for part in parts:
                    if part["crc"] is None:
                        raise ValueError("a chunk is missing")
                    crc, n = crc32_join(crc, part["crc"], 4 * part["n"]), n + part["n"]
                if n != total:
                    raise ValueError("a document's chunks don't have its length")
                out.append(crc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = uses.join(chunks.mapInArrow(sums, "key binary, n long, crc long"), "key", "left")
    parts = found.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))
    return parts.mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, ids array<long>: the documents rebuilt from recipes and chunks, verified like checksums.

    A null doc_id stays null; a store without documents gives no rows.
    """
    manifest, chunks, uses = _checked(spark, store)
    opened = _opened(manifest["bits"])

    def verified(part: dict) -> np.ndarray:
        if part["data"] is None:
            raise ValueError(f"chunk {part['key'].hex()} is missing")
        ids = opened(part["data"], part["n"])
        if hashlib.sha256(memoryview(ids)).digest() != part["key"]:
            raise ValueError(f"chunk {part['key'].hex()} is altered")
        return ids

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # whole documents, one at a time
                ids = np.concatenate([verified(p) for p in b.column("parts")[i].as_py()]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), b.column("start").slice(i, 1), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    parts = uses.join(chunks, "key", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "key", "n", "data"))).alias("parts"))
    return parts.mapInArrow(join, "doc_id long, start long, ids array<long>")
