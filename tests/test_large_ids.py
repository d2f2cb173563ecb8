"""Assets of event ids beyond what a first run had: months past the range of 32-bit seconds."""

from datetime import datetime, timedelta

from lodestone.operators import groups as G
from lodestone.sources.assets import derive_assets


def test_capture_time_of_large_ids(spark, tmp_path):
    ids, ts = [0, 3, 828_999, 829_000, 6_000_001, 36_000_002], datetime(2024, 1, 2, 3, 4, 5)
    spark.createDataFrame([(i, ts) for i in ids], "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    rows = G.with_block(derive_assets(spark, str(tmp_path))).selectExpr("asset_id", "cast(capture_ts as timestamp_ntz) ts", "block").collect()
    assert len(rows) == len(ids)
    for r in rows:
        scene = r.asset_id // 4
        want = None if scene % 50 == 49 else ts + timedelta(days=30 * (scene // 250), seconds=20 * (r.asset_id % 4))
        assert r.ts == want
        assert r.block.startswith("nodate|" if want is None else f"{want:%Y-%j}|")
