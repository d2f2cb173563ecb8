"""Near-duplicates by the Jaccard similarity of their five-word shingles, from two kinds of candidates.

SimHash: fingerprints over the shingles, joined by the rotated binary trie of ``simhash``; texts with
equal or linked fingerprints are candidates. Within a few bits of 64 that finds texts that are almost
equal, but only some of those at 0.8, and a budget wide enough for these is no filter any more.

MinHash bands: texts meet in a bucket where all ``ROWS`` minima of one of ``BANDS`` bands agree. A
pair at similarity s is missed by all bands with probability (1 - s^ROWS)^BANDS, 7 in 100,000 at 0.8
and less above.

Every link is verified on the whole shingle sets. Equal texts collapse before, by the first 128 bits of
their SHA-256, and a text is a number from then on. The first ``EARLY`` bands are verified
first. Of the other bands and SimHash's pairs only buckets that aren't in one component by then move texts
again, and of large ones only what is outside the largest component and a few leaders of it; so a text of a
large group of near copies moves about twice and not for each band. Buckets with the same
members are one. Within a bucket only texts that are not yet one component are compared, so a large group
of copies costs a comparison a text. Bands above ``BIG`` texts are counted before anything is gathered and
divided into parts that all hold a few common leaders; what then isn't one component with most of its
bucket meets all of the bucket, part by part. No task holds more than a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import partitions_for, plain, slices
from lodestone.llm.simhash import LOWER, links, majority
from lodestone.llm.spans import NO_ID
from lodestone.operators.graph import connected_components
from lodestone.sources.tables import cut

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 24
#: Bands that are verified before the others.
EARLY = 2
#: Links from a text to the name of its group before the components are known.
HOPS = 3
#: Texts of a bucket that one task compares, and those that stand in all its parts.
BIG, LEADERS = 512, 8
#: Shingles that are hashed at once.
STEP = 4096
#: Of ``ROWS * BANDS`` minima of a pair this share agrees at least, or it is not compared: 5 standard deviations below 0.8.
SKETCH = 0.6
_RNG = np.random.default_rng(5)
_ADD, _TIMES = (_RNG.integers(0, 1 << 64, ROWS * BANDS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of all runs of five words; a shorter text is one run, and so is none at all."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in (text or "").encode().translate(LOWER).split()], np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    out = np.full(n, min(len(w), SHINGLE), np.uint64)
    for j in range(min(len(w), SHINGLE)):
        out = mixed(out * _MIX + w[j : j + n])
    return np.unique(out)


def minima(own: np.ndarray) -> np.ndarray:
    """The smallest image of the shingles under each of the permutations."""
    least = np.full(len(_ADD), np.iinfo(np.uint64).max)
    for at in range(0, len(own), STEP):
        images = (own[at : at + STEP, None] ^ _ADD) * _TIMES
        np.minimum(least, images.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        out = mixed(out * _MIX + part)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have Jaccard similarity 0.8 or more."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 5 * common >= 4 * (len(both) - common)  # SIMILARITY without rounding


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest index of each set's component, over all pairs that are similar."""
    n = len(sets)
    up = np.arange(n)
    if n == 2:
        return np.zeros(2, np.int64) if similar(*sets) else up
    sketch = np.array([minima(x) for x in sets]) if n > 8 else None
    for i in range(1, n):
        while True:
            apart = up[:i] != up[i]
            if not apart.any():
                break
            # one text of each other component first, then all of those
            first = np.flatnonzero(apart & (up[:i] == np.arange(i)))[:8]
            more = np.flatnonzero(apart)
            if sketch is not None:
                more = np.concatenate([part[(sketch[part] == sketch[i]).mean(axis=1) >= SKETCH] for part in np.array_split(more, len(more) // STEP + 1)])
            hit = next((j for part in (first, more) for j in part.tolist() if similar(sets[i], sets[j])), None)
            if hit is None:
                break
            a, b = up[i], up[hit]
            up[up == max(a, b)] = min(a, b)
    return up


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(key, its rows) of batches that are sorted by the key."""
    at, held = None, []
    for b in batches:
        keys = b.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for x, y in zip(edges, edges[1:], strict=False):
            if held and keys[x] != at:
                yield at, held
                held = []
            at = keys[x]
            held.append(b.slice(x, y - x))
    if held:
        yield at, held


def signed(texts: DataFrame) -> DataFrame:
    """digest, fp, bands of texts (digest, text). Of equal texts that a task reads one is signed, so copies neither move nor cost much."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches):
            keys, names, prints = [], [], []
            for i, h in enumerate(b.column("digest").to_pylist()):
                if h not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(h)
                    own = shingles(b.column("text")[i].as_py())
                    names.append(h)
                    keys.append(bands(minima(own)))
                    prints.append(majority(own))
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))
            at = pa.array(np.arange(len(names) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.ListArray.from_arrays(at, flat)], names=["digest", "fp", "bands"])

    return texts.mapInArrow(sign, "digest binary, fp long, bands array<long>")


def buckets(signs: DataFrame) -> DataFrame:
    """bucket, h, n: the members of each MinHash bucket of n > 1 texts; of those up to ``BIG`` each set of members once.

    Members are counted by partial aggregates. Only buckets up to ``BIG`` are gathered.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, members, sizes = [], [], []
        for _, rows in _grouped(batches, "band"):
            own = np.unique(np.concatenate([x.column("h").to_numpy() for x in rows]))
            image = mixed(own.view(np.uint64))
            name = mixed(image.sum(keepdims=True) + mixed(np.bitwise_xor.reduce(image, keepdims=True) + np.uint64(len(own))))
            names.append(np.repeat(name.view(np.int64), len(own)))
            members.append(own)
            sizes.append(np.full(len(own), len(own), np.int64))
            if sum(map(len, members)) > STEP:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, members, sizes)], names=["bucket", "h", "n"])
                names, members, sizes = [], [], []
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, members, sizes)], names=["bucket", "h", "n"])

    rows = signs.select(F.explode("bands").alias("band"), "h")
    counted = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = rows.join(counted, "band")
    small = rows.where(F.col("n") <= BIG).select("band", "h").repartition(partitions_for(signs), "band").sortWithinPartitions("band").mapInArrow(meet, "bucket long, h long, n long")
    return small.distinct().union(rows.where(F.col("n") > BIG).select("band", "h", "n"))


def simhash_pairs(signs: DataFrame) -> DataFrame:
    """bucket, h, n: pairs of texts that hang together by equal or linked fingerprints (a pair is a bucket of two)."""
    own = signs.groupBy("fp").agg(F.min("h").alias("first"))
    equal = signs.join(own, "fp").where("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b"))
    near = links(own.select("fp"))
    near = near.join(own.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(own.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst").select("a", "b")
    return equal.union(near).select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("h"), F.lit(2).cast("long").alias("n"))


def _parts(large: DataFrame) -> DataFrame:
    """bucket, h of large buckets (bucket, h, n) divided into parts that hold their leaders too."""
    parts = F.ceil(F.col("n") / (BIG - LEADERS)).cast("int")
    lead = large.groupBy("bucket", "n", F.pmod(F.xxhash64("h"), F.lit(LEADERS)).alias("k")).agg(F.min("h").alias("h"))
    own = large.select("bucket", "h", F.pmod(F.xxhash64("h", F.lit(1)), parts).alias("part"))
    own = own.union(lead.select("bucket", "h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")))
    return own.select(F.xxhash64("bucket", "part").alias("bucket"), "h").distinct()


def _outside(large: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, h, n: what isn't in its large bucket's largest component of found, and a few leaders of that component."""
    at = cut(large.join(found.withColumnRenamed("node", "h"), "h", "left").select("bucket", "h", F.coalesce("component", "h").alias("component")))
    most = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("most"))
    at = at.join(cut(most), "bucket")
    lead = at.where("component = most").groupBy("bucket", F.pmod(F.xxhash64("h"), F.lit(LEADERS)).alias("k")).agg(F.min("h").alias("h"))
    rows = cut(at.where("component <> most").select("bucket", "h").union(lead.select("bucket", "h")))
    return rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")


def _apart(large: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, h: what isn't one component with most of its large bucket, with all of the bucket, in parts.

    ``found``: node, component.
    """
    at = cut(large.join(found.withColumnRenamed("node", "h"), "h", "left").select("bucket", "h", "n", F.coalesce("component", "h").alias("component")))
    most = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.sum("c").alias("all"), F.max("c").alias("c"))
    most = cut(most.where("c < all").select("bucket", "most", F.ceil((F.col("all") - F.col("c")) * 2 / BIG).cast("int").alias("rests"), F.ceil(F.col("all") * 2 / BIG).cast("int").alias("tiles")))
    rows = at.join(most, "bucket")
    tile = lambda n: F.pmod(F.xxhash64("h", F.lit(2)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rows.where("component <> most").select("bucket", "h", tile("rests").alias("r"), every("tiles").alias("t"))
    whole = rows.select("bucket", "h", every("rests").alias("r"), tile("tiles").alias("t"))
    return rest.union(whole).select(F.xxhash64("bucket", "r", "t").alias("bucket"), "h").distinct()


def text_digest(text: Column) -> Column:
    """128 bits that stand for a text; null is empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def labels(edges: DataFrame) -> DataFrame:
    """node, component of edges (src, dst), where component is the smallest node that ``HOPS`` links reach.

    Nodes of one label are of one component, not the other way round: enough to know that they need no
    comparison. The parts of a bucket hang together by their leaders, so few links are enough for most.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")))
    now = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"))
    for _ in range(HOPS - 1):
        now = cut(now)
        new = both.join(now, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("m"))
        now = new.join(now, F.col("src") == F.col("node")).select("node", F.least("m", "component").alias("component"))
    return cut(now)


def _unsettled(met: DataFrame, found: DataFrame) -> DataFrame:
    """The buckets of met (bucket, h, n) that aren't within one component of found (node, component)."""
    at = met.join(found.withColumnRenamed("node", "h"), "h", "left").select("bucket", "h", "n", F.coalesce("component", "h").alias("component"))
    at = cut(at)
    mixed_ = at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return at.join(mixed_, "bucket", "left_semi").select("bucket", "h", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each different (doc_id, text): doc (NO_ID for a null id), digest (of the text), first.

    ``first`` is the one row to keep of a component: that with the smallest id, null ids after all
    others, and of rows with this id that with the smallest digest. Case, white space and word order
    beyond five words count as in the shingles; null text is empty, and texts without words are alike.
    """
    text = F.coalesce("text", F.lit(""))
    rows = plain(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), text_digest(text).alias("digest"), text.alias("text"))
    keys = cut(rows.select("doc", "digest").distinct())
    lone = keys.groupBy("digest").agg(F.min(F.struct((F.col("doc") == NO_ID).alias("no_id"), "doc")).alias("least"))
    owner = cut(lone.select("digest", "least.*", F.monotonically_increasing_id().alias("h")))  # one row a text
    signs = cut(signed(rows.select("digest", "text")).dropDuplicates(["digest"]).join(owner.select("digest", "h"), "digest").select("h", "fp", "bands"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches, "bucket"):
            table = pa.Table.from_batches(parts)
            h = table["h"].to_numpy()
            up = linked([shingles(t.as_py()) for t in table["text"]])
            own = np.flatnonzero(up != np.arange(len(up)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(h[up[own]])], names=["src", "dst"])

    def verified(members: DataFrame) -> DataFrame:
        members = cut(members)
        named = members.select("h").distinct().join(owner, "h").select("doc", "digest", "h")
        there = rows.join(cut(named), ["doc", "digest"]).select("h", "text").dropDuplicates(["h"])
        placed = members.join(there, "h").select("bucket", "h", "text").repartition(partitions_for(docs), "bucket").sortWithinPartitions("bucket")
        return cut(placed.mapInArrow(verify, "src long, dst long"))

    def parted(met: DataFrame) -> DataFrame:
        large = met.where(F.col("n") > BIG)
        return met.where(F.col("n") <= BIG).select("bucket", "h").union(_parts(large))

    early = cut(buckets(signs.withColumn("bands", F.slice("bands", 1, EARLY))))
    edges = verified(parted(early))
    found = labels(edges)
    more = buckets(signs.withColumn("bands", F.slice("bands", EARLY + 1, BANDS))).union(simhash_pairs(signs)).distinct()
    late = cut(_unsettled(more, found))
    edges = edges.union(verified(parted(late.where(F.col("n") <= BIG).union(_outside(late.where(F.col("n") > BIG), found)))))
    wide = cut(early.union(late).where(F.col("n") > BIG))
    if wide.head(1):
        found = labels(edges)
        large = cut(_unsettled(wide, found))
        if large.head(1):
            edges = edges.union(verified(_apart(large, found)))
    found = connected_components(edges)
    named = owner.join(found.withColumnRenamed("node", "h"), "h", "left").select("digest", "no_id", "doc", F.coalesce("component", "h").alias("component"))
    least = named.groupBy("component").agg(F.min(F.struct("no_id", "doc", "digest")).alias("least"))
    stays = least.select(F.col("least.doc").alias("doc"), F.col("least.digest").alias("digest"), F.lit(True).alias("first"))
    return keys.join(cut(stays), ["doc", "digest"], "left").select("doc", "digest", F.coalesce("first", F.lit(False)).alias("first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the row that ``near_duplicates`` keeps.

    Of rows that share this id and text but differ in other columns the one with the smallest hash of the
    whole row stays, whatever the partitioning; of equal rows one stays. Columns stay as they are.
    """
    first = near_duplicates(docs).where("first").select("doc", "digest")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), text_digest(F.col("text")).alias("digest"), F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("order"))
    kept = kept.join(cut(first), ["doc", "digest"], "left_semi")
    if kept.groupBy("doc", "digest").count().where("count > 1").head(1):
        kept = kept.groupBy("doc", "digest").agg(F.min_by("row", "order").alias("row"))
    return kept.select("row.*")
