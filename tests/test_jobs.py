"""Scans that stop and go on, their coverage, and reviews of what they stored."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans.tools import Engine, Settings
from lodestone.sources import assets as A
from lodestone.sources.tables import Deletions, replace_table, shared_path, write_json
from lodestone.streaming.jobs import Journal, ScanJob

SF = "/root/testdata/sf0.001"


def rows(spark, n=400):
    return A.derive_assets(spark, SF).where(f"asset_id < {n}").cache()


def members(engine):
    return sorted((r.group_id, r.asset_id, r.keeper_id) for r in engine.groups().collect())


@pytest.mark.parametrize("stops", [[0], [1, 1], [3, 2, 1]])
def test_resumed_equals_uninterrupted(spark, stops):
    assets = rows(spark)
    whole = Engine(spark, assets, shared_path(spark, "scan"))
    request = whole.request(A.Everything())
    whole.start_photo_scan(request)
    calls = []

    def analyzer(batch):
        calls.append(sorted(r.asset_id for r in batch.collect()))
        return batch.where("analysis_version >= 3")

    store = shared_path(spark, "scan")
    engine = lambda: Engine(spark, assets, store, analyzer=analyzer, batch_rows=50)
    engine().begin(request, stops[0])
    for n in stops[1:]:
        e = engine()
        e.job(e.incomplete().first()).analyze(e.analyzer, n)
    last = engine()
    assert last.incomplete().first().kind == "duplicates"
    assert last.continue_last_scan().startswith("Continuing your last balanced scan.")
    assert members(last) == members(whole)
    targets = last.targets(request)
    assert last.coverage.targets == targets.count() and last.coverage.covered == targets.where("analysis_version >= 3").count()
    assert last.coverage.skipped == last.skipped(request) > 0
    seen = [i for batch in calls for i in batch]
    assert len(seen) == len(set(seen)) == targets.count()  # no batch was analysed twice
    newest = [r.asset_id for r in targets.orderBy(F.desc_nulls_last("capture_ts"), "asset_id").collect()]
    assert [sorted(newest[i : i + 50]) for i in range(0, len(newest), 50)] == calls
    assert engine().incomplete().count() == 0 and engine().continue_last_scan().startswith("Your last scan found")


def test_crash_within_a_batch(spark):
    assets, store = rows(spark, 200), shared_path(spark, "scan")
    broken = Engine(spark, assets, store, batch_rows=40)
    request = broken.request(A.Everything())
    calls = []

    def analyzer(batch):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return batch.where("analysis_version >= 3")

    broken.analyzer = analyzer
    with pytest.raises(OSError):
        broken.start_photo_scan(request)
    assert broken.groups().count() == 0
    again = Engine(spark, assets, store, batch_rows=40)
    job = again.job(again.incomplete().first())
    assert len(job.log.batches()) == 2
    again.continue_last_scan()
    whole = Engine(spark, assets, shared_path(spark, "scan"))
    whole.start_photo_scan(request)
    assert members(again) == members(whole)


def test_pending_needs_no_analysis_of_other_scans(spark):
    """What another scan has analysed isn't pending; analyses outside the targets don't count."""
    assets, store = rows(spark, 120), shared_path(spark, "scan")
    e = Engine(spark, assets, store, analyzer=lambda b: b.withColumn("analysis_version", F.lit(3)))
    e.start_photo_scan(e.request(A.Recent(40)))
    calls = []
    e.analyzer = lambda b: (calls.append(b.count()), b.withColumn("analysis_version", F.lit(3)))[1]
    e.start_photo_scan(e.request(A.Recent(70)))
    assert calls == [30] and (e.coverage.targets, e.coverage.covered) == (70, 70)
    e.start_photo_scan(e.request(A.Recent(10)))
    assert calls == [30] and e.coverage.skipped == 0


def test_empty_targets(spark):
    e = Engine(spark, rows(spark, 40).where("false"), shared_path(spark, "scan"))
    e.start_photo_scan(e.request(A.Everything()))
    assert (e.coverage.targets, e.coverage.covered, e.groups().count()) == (0, 0, 0)


def test_a_batch_reads_its_folder_only(spark):
    e = Engine(spark, rows(spark, 200), shared_path(spark, "scan"), batch_rows=50)
    job = e.begin(e.request(A.Everything()))
    plan = job.targets().where("batch = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and isinstance(job, ScanJob)


def test_journals_of_two_scans(spark):
    store = shared_path(spark, "scan")
    a, b = Journal(spark, store), Journal(spark, store)
    a.put("x", "duplicates", "balanced", "1", False)
    b.put("y", "sessions", "balanced", "2", False)
    a.put("x", "duplicates", "balanced", "1", True)
    assert {(r.signature, r.is_complete) for r in b.read().collect()} == {("x", True), ("y", False)}
    assert a.incomplete().first().job == "2"


def test_reviews(spark):
    at, schema = shared_path(spark, "groups"), "group_id long, asset_id long"
    data = spark.createDataFrame([(i // 3, i) for i in range(30)], schema)
    one, two = (Deletions(spark, at, schema, ["group_id"]) for _ in range(2))
    key = lambda i: spark.createDataFrame([(i,)], "group_id long")
    replace_table(data, at)
    one.delete(key(1))
    two.delete(key(2))  # neither sees the other's
    left = lambda: {r.group_id for r in one.read().collect()}
    assert left() == {0, *range(3, 10)}
    files = spark.read.parquet(f"{at}-deleted/rows/*")
    assert files.count() == 2
    one.compact()
    two.delete(key(4))
    assert left() == {0, 3, *range(5, 10)} and one.read().count() == 21
    one.compact()
    assert left() == {0, 3, *range(5, 10)}
    replace_table(data, at)  # a new scan's groups are whole
    assert left() == set(range(10))
    one.delete(key(0))
    one.compact()
    assert one.log.read().count() == 1 and left() == set(range(1, 10))


def test_session_review(spark):
    e = Engine(spark, rows(spark, 120), shared_path(spark, "scan"))
    e.find_best_drone_shots()
    first = e.session_roles().first()
    n = e.session_roles().select("library_id", "session").distinct().count()
    e.session_review_done(first.library_id, first.session)
    left = e.session_roles().select("library_id", "session").distinct()
    assert left.count() == n - 1 and left.where((F.col("library_id") == first.library_id) & (F.col("session") == first.session)).count() == 0


def test_settings_are_kept(spark):
    store = shared_path(spark, "scan")
    engine = lambda: Engine(spark, rows(spark, 8), store)
    assert engine().load_settings() == Settings()
    engine().save_settings(unprotected=("livePhoto",), include_screenshots=False)
    e = engine()
    assert e.load_settings() == Settings(unprotected=("livePhoto",), include_screenshots=False)
    e.update_dedupe_mode("conservative")
    assert engine().load_settings() == Settings(sensitivity="conservative", unprotected=("livePhoto",), include_screenshots=False)
    write_json(spark, f"{store}/settings.json", {"sensitivity": "aggressive", "of_a_later_version": 1})
    assert engine().load_settings() == Settings(sensitivity="aggressive")
