"""Readers of a log of batches while others write and compact."""

import pytest

from lodestone.sources import tables
from lodestone.sources.tables import BatchLog, shared_path

SCHEMA = "id long, v long"


def rows(spark, *ids):
    return spark.createDataFrame([(i, i * 10) for i in ids], SCHEMA)


def merge(df):
    return df.coalesce(1)


@pytest.mark.parametrize("compacted", [0, 1])
def test_reader_between_steps(spark, monkeypatch, compacted):
    """Before each step of a read another session commits a batch and compacts twice: nothing is lost or doubled."""
    step, done = 0, False
    while not done:
        root = shared_path(spark, "log")
        log, other = BatchLog(spark, root, SCHEMA), BatchLog(spark, root, SCHEMA)
        log.commit(rows(spark, 0), "a")
        for _ in range(compacted):
            log.compact(merge)
        log.commit(rows(spark, 1), "b")
        count = [0]

        def interfere(count=count, other=other, step=step):
            count[0] += 1
            if count[0] == step + 1:
                other.compact(merge)
                other.commit(rows(spark, 2), "c")
                other.compact(merge)

        for name in ("_names", "_base", "_since", "_read"):
            monkeypatch.setattr(log, name, lambda *a, f=getattr(log, name): (interfere(), f(*a))[1])
        with monkeypatch.context() as m:
            plain = tables.read_json
            m.setattr(tables, "read_json", lambda s, p: (interfere() if "/commits/" in p else None, plain(s, p))[1])
            found = log.read()
        got = sorted(r.id for r in found.collect())
        assert got in ([0, 1], [0, 1, 2]), (step, got)
        done, step = count[0] <= step, step + 1
    assert step > 4


def test_pending_and_batches(spark):
    log = BatchLog(spark, shared_path(spark, "log"), SCHEMA)
    assert log.batches() == [] and log.pending() == 0
    for i in range(4):
        assert log.commit(rows(spark, i), f"b{i}")
        assert not log.commit(rows(spark, 99), f"b{i}")
        if i % 2:
            assert log.compact(merge)
    assert log.batches() == ["b0", "b1", "b2", "b3"] and log.pending() == 0
    assert sorted(r.id for r in log.read().collect()) == [0, 1, 2, 3]
