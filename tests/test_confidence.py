"""Group confidence by counted bits against all pairs."""

import math
import random

from lodestone.operators import groups as G

SCHEMA = "asset_id long, group_id long, hash long, feature array<double>"


def plain(rows):
    by = {}
    for _, g, h, f in rows:
        by.setdefault(g, []).append((h, f))
    out = {}
    for g, own in by.items():
        found = []
        for i, (h, f) in enumerate(own):
            for k, e in own[:i]:
                if f is not None and e is not None and len(f) == len(e) and None not in [*f, *e]:
                    found.append(math.dist(f, e))
                elif h is not None and k is not None:
                    found.append(((h ^ k) & (1 << 64) - 1).bit_count() / 64)
        mean = sum(found) / len(found) if found else None
        out[g] = 1.0 if len(own) < 2 else 0.5 if mean is None else min(0.99, max(0.5, 1 - mean))
    return out


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.group_id: r.confidence for r in G.group_confidence(df.select("group_id", "asset_id"), df.drop("group_id")).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for g in got:
        assert abs(got[g] - want[g]) < 1e-9, (g, got[g], want[g])


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        feature = rng.choice([None, None, [rng.random() / 9, rng.random() / 9], [rng.random() / 9], [], [None, 1.0]])
        rows.append((i, rng.randrange(60), rng.choice([None, rng.randrange(-(1 << 63), 1 << 63), (1 << 40) - rng.randrange(9)]), feature))
    rows += [(1000, 900, 5, None), (1001, 901, None, None), (1002, 901, None, None), (1003, 902, -1, None), (1004, 902, 0, None)]
    same(result(spark, rows), plain(rows))


def test_large_group_without_vectors_makes_no_pairs(spark):
    df = spark.range(100_000).selectExpr("id asset_id", "1L group_id", "id % 7 hash", "cast(null as array<double>) feature")
    found = G.group_confidence(df.select("group_id", "asset_id"), df.drop("group_id"))
    n = [sum(i % 7 == k for i in range(100_000)) for k in range(7)]
    total = sum(n[i] * n[j] * (i ^ j).bit_count() / 64 for i in range(7) for j in range(i))
    assert abs(found.first().confidence - (1 - total / (100_000 * 99_999 / 2))) < 1e-9
    assert "class" in found._jdf.queryExecution().toString()
