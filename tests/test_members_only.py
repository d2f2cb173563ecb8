"""Queries that read members alone don't work out the confidence of all groups on the way."""

import pytest

from lodestone.operators import groups as G
from lodestone.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["group_by_id", "stored_groups", "reviewed_groups", "duplicate_snapshot", "placeholder_keeper", "album_append"])
def test_no_confidence(spark, monkeypatch, name):
    def asked(members, rows):
        raise AssertionError("confidence isn't read")

    monkeypatch.setattr(G, "group_confidence", asked)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").head(1)
