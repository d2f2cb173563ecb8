"""Dense edges are thinned to stars before they are stored or shuffled."""

from lodestone.operators.graph import connected_components, thinned


def parts(edges):
    return sorted(map(tuple, connected_components(edges).collect()))


def test_same_components_of_fewer_edges(spark):
    clique = [(b, i + k, j + k) for b, k in (("x", 0), ("y", 100), (None, 200)) for i in range(40) for j in range(i + 1, 40)]
    chain = [("z", i, i + 1) for i in range(300, 340)] + [("w", 500, 400)]
    edges = spark.createDataFrame(clique + chain, "block string, src long, dst long").repartition(3)
    for at_once in (1, 50, 1 << 18):
        few = thinned(edges, "block", at_once)
        assert parts(few) == parts(edges)
        rows = few.collect()
        assert {(r.block, n) for r in rows for n in (r.src, r.dst)} == {(b, n) for b, u, v in clique + chain for n in (u, v)}
    assert len(rows) <= 3 * (3 * 39 + 41)  # a star a block and task, where there were 2,381 edges
    assert thinned(edges.limit(0), "block").collect() == []
