"""Manifests and proofs against a plain recomputation."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import merkle, queries
from lodestone.sources.tables import shared_path

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `__m` int, idx string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """(root, siblings of each leaf by level as (before, after))."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    steps = []
    for i in range(len(leaves)):
        own, at = [], i
        for level in levels[:-1]:
            a = at // 16 * 16
            own.append((level[a:at], level[at + 1 : a + 16]))
            at //= 16
        steps.append(own)
    return levels[-1][0], steps


def plain(rows):
    if not rows:
        return []
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((leaf(r[:5]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    roots, paths = {}, {}
    for s in names:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        roots[s], paths[s] = tree([x[0] for x in by[s]])
    root, top = tree([roots[s] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (own, r) in enumerate(by[s]):
            steps = paths[s][i] + top[k]
            acc = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                acc = leaf([*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])])
            for before, after in steps:
                acc = h(*before, acc, *after)
            out.append((r[0], own, roots[s], root, h(*[x for b, a in steps for x in b + a]), acc, acc == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs, path = spark.createDataFrame(rows, SCHEMA), shared_path(spark, "manifest")
    root = merkle.write(docs, path, carry={"tampered": merkle.tampered(docs)})
    got = sorted(map(tuple, merkle.digest(merkle.proofs(spark, path)).collect()), key=str)
    assert got == plain(rows)
    assert all(g[3] == root for g in got)
    return got


@pytest.mark.parametrize("low", [False, True])
def test_odd_rows(spark, monkeypatch, low):
    if low:  # shuffled joins for all levels and sources
        monkeypatch.setattr(merkle, "UPPER", 1)
        monkeypatch.setattr(merkle, "SHARE", 1)
    rows = [(i, "big", "en", i, f"Text {i} É\n", 1, "x") for i in range(300)]
    rows += [(1000 + i, f"s{i}", None, None, None, 1, None) for i in range(18)]
    rows += [(5, "z", "a", 1, "Same", 2, "a"), (5, "z", "a", 1, "Same", 2, "a"), (5, "z", "a", 1, "Other", 2, "a"), (None, "z", "a", 1, "No id", 3, ""), (-3, None, "", 0, "", 4, ""), (7, "", None, -1, "x" * 50_000 + "Y", 5, ""), (8, "é", "de", 2, "ß", 5, ""), (9, "z" * 300, "de", 2, "Q", 5, "")]
    got = run(spark, rows)
    assert any(not g[-1] for g in got) and any(g[-1] for g in got)


def test_small_tables(spark):
    run(spark, [(1, "a", "b", 2, "Lone", 1, "")])
    run(spark, [(i, "a", "b", 2, "t", 1, "") for i in range(17)])
    run(spark, [])


def test_changed_siblings_do_not_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"T{i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    path = shared_path(spark, "manifest")
    merkle.write(docs, path)
    from pyspark.sql import functions as F

    bad = F.transform("steps", lambda s: F.struct(F.translate(s["before"], "0123", "1230").alias("before"), s["after"].alias("after")))
    n = merkle.proofs(spark, path).select((merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("good"), (merkle.fold(F.col("leaf"), bad) == F.col("root")).alias("bad"), F.expr("exists(steps, s -> length(s.before) > 0)").alias("has")).collect()
    assert all(r.good for r in n) and not any(r.bad for r in n if r.has)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) + (1, "") for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, sf).collect()), key=str) == plain(rows)
