import struct

from lodestone.plans.tools import Engine
from lodestone.sources import assets as A
from lodestone.sources import files


def test_commands(spark, tmp_path):
    assets = A.derive_assets(spark, "/root/testdata/sf0.001").where("asset_id < 240").cache()
    e = Engine(spark, assets, str(tmp_path / "store"), albums=A.album_members(assets), places=A.places(assets))
    assert e.get_duplicate_groups().startswith("I haven't found any") and e.generate_cleanup_plan().startswith("There's nothing")
    assert e.explain_recommendation().startswith("I don't have") and e.create_album("Best").startswith("I don't have")
    assert e.show_session_summary().startswith("No photo sessions")
    assert e.update_dedupe_mode("droneBurst") == "Okay, I'll use drone burst matching for your next scan." and e.settings.sensitivity == "aggressive"
    assert e.find_duplicate_photos().startswith("Starting a conservative scan.")
    groups = e.groups().cache()
    n = groups.select("group_id").distinct().count()
    assert n > 10 and e.incomplete().count() == 0
    assert e.get_duplicate_groups() == f"Your last scan found {n} groups with about {groups.count() - n} photos to review."
    first = groups.first().group_id
    assert "% match of" in e.get_group_details(first) and e.get_group_details(-1).startswith("I couldn't find")
    assert e.generate_cleanup_plan().endswith("Nothing is deleted until you review and confirm.")
    assert e.explain_recommendation().startswith("Recommended")
    assert e.create_album("Best", confirmed=True) == f'I created the album "Best" with {n} photos.'
    assert spark.read.parquet(str(tmp_path / "store/albums")).count() == n
    e.review_done(first)
    assert e.groups().where(f"group_id = {first}").count() == 0
    e.find_best_drone_shots()
    assert e.show_session_summary().startswith("Found ")
    assert e.skipped(e.request(A.Recent(1000))) == e.targets(e.request(A.Recent(1000))).where("analysis_version < 3").count()


def test_files(spark, tmp_path):
    pgm = b"P5\n2 2\n255\n" + bytes([0, 255, 255, 0])
    exif = b"\xff\xd8Exif\0\0MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHII", 1, 0x8825, 4, 1, 26) + struct.pack(">I", 0)
    gps = struct.pack(">HHHIBxxxHHII", 2, 5, 1, 1, 1, 6, 5, 1, 56) + struct.pack(">I", 0) + struct.pack(">II", 25, 2)
    for name, raw in (("a.pgm", pgm), ("b.jpg", exif + gps), ("c.bin", b"junk")):
        (tmp_path / name).write_bytes(raw)
    rows = {r.path[-5:]: r for r in files.pictures(spark, str(tmp_path)).collect()}
    assert len(rows["a.pgm"].pixels) == 4096 and rows["a.pgm"].pixels[0] == 0 and rows["a.pgm"].pixels[63] == 255
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    boxes = whole.selectExpr("path", "case when path not like '%.jpg' then named_struct('x', 0.0D, 'y', 0.0D, 'w', 1.0D, 'h', 2.0D) end crop")
    faces = {r.path[-5:]: r.face for r in files.face_pictures(whole, boxes).collect()}
    assert {k: v and v.pixels for k, v in faces.items()} == {"a.pgm": [0, 255], "c.bin": None}
    assert files.crop_levels(b"P5 8 4 255\n" + bytes(range(32)), 0, 0, 8, 4, side=4) == (4, 2, [0, 2, 4, 6, 16, 18, 20, 22])
    assert rows["b.jpg"].altitude == -12.5 and rows["b.jpg"].pixels is None and rows["c.bin"].altitude is None
