"""Prompts rank groups once: the facts come from the ranking that the confidence comes from."""

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


def test_prompts_rank_once(spark, monkeypatch):
    calls, ranked = [], catalog.ranked_groups
    monkeypatch.setattr(catalog, "ranked_groups", lambda assets: calls.append(1) or ranked(assets))
    found = catalog.QUERIES["prompts"](spark, SF)
    assert found.head(1) and len(calls) == 1
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
