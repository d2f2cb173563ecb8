import random

import pytest

from lodestone.operators.graph import components_within, connected_components


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7000, 7000), (None, 3), (900, 901), (901, 900)]
    up = {x: x for e in edges if None not in e for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in up)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 30])
def test_components_within_blocks(spark, most):
    rng = random.Random(6)
    edges = []  # a long path, random graphs, a star around a large node, and a block without a name
    for k, (name, size, n) in enumerate([("path", 70, 0), ("dense", 40, 300), ("sparse", 60, 25), (None, 30, 12), ("star", 50, 0)]):
        ids = [k * 1000 + x for x in rng.sample(range(1000), size)]
        ends = zip(ids, ids[1:], strict=False) if name == "path" else [(max(ids), x) for x in ids] if name == "star" else [(rng.choice(ids), rng.choice(ids)) for _ in range(n)]
        edges += [(name, a, b) for a, b in ends]
    rng.shuffle(edges)
    plain = [(a, b) for _, a, b in edges]
    up = {x: x for e in plain for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in plain:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    table = spark.createDataFrame([*edges, ("path", None, 5), ("path", 5, None)], "block string, src long, dst long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # blocks go on over batches
    try:
        assert sorted(map(tuple, components_within(table, "block", most=most).collect())) == sorted((x, root(x)) for x in up)
        assert components_within(table.limit(0), "block").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
