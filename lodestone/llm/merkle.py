"""Merkle manifests of tables: a tree a source, a tree over their roots, and a proof for each row.

H is the lowercase hex SHA-256 of its inputs' concatenation. A row's leaf hashes its fields; leaves of a
source ascend by id, and every ``FANOUT`` neighbours become their H until one node remains. The roots
of the sources, in their order, become the leaves of one more tree.

A proof is looked up by coordinates. The position of a leaf and the size of its tree say which (level,
index) its siblings have; these are joined with the stored table of nodes, put in order and
concatenated, and folding them with a leaf gives a root. Leaves of one run of neighbours need the same
coordinates, so a run asks for them once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import partitions_for, written
from lodestone.sources.tables import read_json, remove, write_json

FANOUT, BITS = 16, 4
#: Nodes of the upper levels that are broadcast, and the share of leaves from which a source's own path is.
UPPER, SHARE = 1 << 15, 1 << 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def H(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: Iterable[Column]) -> Column:
    return H(*map(field, values))


def _number(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Rows with ``idx``, their place in their ``tree`` by ``order`` (nulls first), and ``n``, the tree's size.

    Rows are range-partitioned by tree and order and stored so, which fixes their places; a window over
    one row a tree and partition has the places where partitions begin, so no tree meets in one task.
    """
    by = ["tree", *order]
    sort = rows.repartitionByRange(partitions_for(rows), *by).sortWithinPartitions(*by)
    flat = written(sort.withColumn("at", F.monotonically_increasing_id()), path).withColumn("part", F.shiftright("at", 33))
    parts = flat.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("m").over(own).alias("n"))
    out = flat.join(parts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return out.withColumn("idx", F.col("at") + F.col("shift")).drop("t", "p", "shift", "at", "part")


def _grow(leaves: DataFrame, path: str) -> DataFrame:
    """The stored table of nodes (tree, level, idx, n nodes of the level, hash), one level after the other."""
    spark = leaves.sparkSession
    level, most = leaves.select("tree", "idx", "n", "hash"), leaves.agg(F.max("n")).first()[0] or 1
    level = written(level, f"{path}/level=0")
    depth = 0
    while most > 1:
        depth, most = depth + 1, -(-most // FANOUT)
        runs = level.where("n > 1").groupBy("tree", "n", F.shiftright("idx", BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x"))
        up = runs.select("tree", F.col("run").alias("idx"), F.expr(f"shiftright(n + {FANOUT - 1}, {BITS})").alias("n"), H(F.array_join("x.hash", "")).alias("hash"))
        level = written(up, f"{path}/level={depth}")
    return spark.read.parquet(path)


def _runs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, n, run, members, upper) of each run of leaves: its leaves' hashes, and the steps above it.

    Coordinates of upper levels, which many runs ask for, meet broadcast nodes; their number is counted
    and at most ``UPPER``. Lower levels are a shuffled join in which a node has few that ask.
    """
    # levels of a tree of n leaves: those that have more than one node; index i of level 0 is shiftright(i, 4 l) on level l
    runs = leaves.where("n > 1").groupBy("tree", "n", F.shiftright("idx", BITS).alias("run")).agg(F.count(F.lit(1)).alias("__m")).drop("__m")
    counts, low, total = {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}, 1, 0
    for k in sorted(counts, reverse=True):
        total += counts[k]
        if total > UPPER:
            low = max(1, k + 1)
            break

    def asked(levels: str) -> DataFrame:
        first = f"shiftright(shiftleft(run, {BITS}), {BITS} * l)"  # the run's node of level l
        start = f"shiftleft(shiftright({first}, {BITS}), {BITS})"
        last = f"least({start} + {FANOUT - 1}, shiftright(n - 1, {BITS} * l))"
        coordinates = f"transform(filter(sequence({start}, {last}), i -> l = 0 OR i <> {first}), i -> struct(l AS level, i AS idx, i < {first} AS left))"
        return runs.select("tree", "n", "run", F.explode(F.expr(f"flatten(transform(filter({levels}, l -> n > shiftleft(1L, {BITS} * l)), l -> {coordinates}))")).alias("c")).select("tree", "n", "run", "c.*")

    known = nodes.select(F.col("tree").alias("t"), F.col("level").alias("v"), F.col("idx").alias("i"), "hash")
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("level") == F.col("v")) & (F.col("idx") == F.col("i"))
    found = asked(f"sequence({low}, 15)").join(F.broadcast(known.where(f"level >= {low}")), same)
    found = found.union(asked(f"sequence(0, {low - 1})").join(known.where(f"level < {low}"), same))
    whole = found.groupBy("tree", "n", "run").agg(F.array_sort(F.collect_list(F.struct("level", "idx", "left", "hash"))).alias("x"))
    side = "array_join(transform(filter(x, y -> y.level = l AND {}y.left), y -> y.hash), '')"
    steps = f"transform(filter(sequence(1, 15), l -> n > shiftleft(1L, {BITS} * l)), l -> struct({side.format('')} AS before, {side.format('NOT ')} AS after))"
    members = whole.select("tree", "n", "run", F.expr("transform(filter(x, y -> y.level = 0), y -> y.hash)").alias("members"), F.expr(steps).cast(_STEP).alias("upper"))
    alone = leaves.where("n = 1").select("tree", "n", F.lit(0).cast("long").alias("run"), F.array().cast("array<string>").alias("members"), F.array().cast(_STEP).alias("upper"))
    return members.union(alone)


def _steps(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """Leaves with ``steps``: for each level from the leaf up, what stands before and after it in its run."""
    r = runs.select(F.col("tree").alias("t"), F.col("run").alias("r"), *[c for c in runs.columns if c not in ("tree", "run", "n")])
    both = leaves.join(r, F.col("tree").eqNullSafe(F.col("t")) & (F.shiftright("idx", BITS) == F.col("r")))
    own = F.struct(F.expr(f"array_join(slice(members, 1, int(idx % {FANOUT})), '')").alias("before"), F.expr(f"array_join(slice(members, int(idx % {FANOUT}) + 2, {FANOUT}), '')").alias("after"))
    return both.withColumn("steps", F.when(F.col("n") > 1, F.concat(F.array(own).cast(_STEP), "upper")).otherwise(F.col("upper"))).drop("t", "r", "members", "upper")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, start, lambda h, s: H(s["before"], h, s["after"]))


def proof_text(steps: Column) -> Column:
    """The siblings' hashes, level by level, from left to right."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: F.array(s["before"], s["after"]))), "")


def write(docs: DataFrame, path: str, carry: dict[str, Column] | None = None) -> str | None:
    """Store the manifest of a table of documents below ``path``; its root, or None for an empty table.

    There: ``leaves`` (doc_id, source, leaf, place, and what ``carry`` says), ``nodes`` of the sources,
    ``top`` of their roots, and last ``manifest.json`` with the root, without which nothing is there.
    Nulls are a field of their own: null ids come first within a source, null sources before others.
    Rows of one id are ordered by leaf; repeated rows are leaves each. Other columns of ``docs`` don't count
    and may have any name. Texts are read once, for their hash.
    """
    spark = docs.sparkSession
    cols = [F.col(f"`{c}`") for c in FIELDS]
    rows = docs.select(cols[0].alias("doc_id"), cols[1].alias("tree"), leaf(cols).alias("hash"), *[c.alias(k) for k, c in (carry or {}).items()])
    raw = written(rows, f"{path}/raw")
    leaves = written(_number(raw, ["doc_id", "hash"], f"{path}/sorted"), f"{path}/leaves")
    nodes = _grow(leaves, f"{path}/nodes")
    roots = nodes.where("n = 1").select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "hash")
    top = written(_number(roots, ["source"], f"{path}/sorted-roots"), f"{path}/top-leaves")
    root = _grow(top, f"{path}/top").where("n = 1").select("hash").first()
    for name in ("raw", "sorted", "sorted-roots"):
        remove(spark, f"{path}/{name}")
    write_json(spark, f"{path}/manifest.json", {"root": root and root["hash"]})
    return root and root["hash"]


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """Each row of a stored manifest with its subroot, root and ``steps``, the path from its leaf to the root."""
    leaves, nodes = spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/nodes")
    top = spark.read.parquet(f"{path}/top-leaves")
    paths = _steps(top, _runs(top, spark.read.parquet(f"{path}/top")))
    size = leaves.groupBy(F.col("tree").alias("source")).agg(F.count(F.lit(1)).alias("size"))
    paths = paths.select("source", F.col("hash").alias("subroot"), F.col("steps").alias("top")).withColumnRenamed("source", "s")
    paths = paths.join(size, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    large = max(1, leaves.count() // SHARE)  # sources above this share are at most SHARE, and only they have many runs
    runs, same = _runs(leaves, nodes), F.col("tree").eqNullSafe(F.col("s"))
    runs = runs.where(F.col("n") > large).join(F.broadcast(paths.where(F.col("size") > large)), same).union(runs.where(F.col("n") <= large).join(paths.where(F.col("size") <= large), same))
    runs = runs.select("tree", "n", "run", "members", F.concat("upper", "top").alias("upper"), "subroot")
    out = _steps(leaves, runs).withColumn("root", F.lit(read_json(spark, f"{path}/manifest.json")["root"]))
    return out.withColumnsRenamed({"tree": "source", "hash": "leaf"})


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row after tampering: texts of every fifth id, by its checksum, in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(hit & (low != F.col("text")), leaf([low if c == "text" else F.col(c) for c in FIELDS]))


def digest(proven: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, if there is one), verified."""
    out = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
