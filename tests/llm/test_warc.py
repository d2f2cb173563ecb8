import glob
import gzip
import hashlib
import os

import pytest

from lodestone.llm import warc
from lodestone.sources.tables import shared_path

LONG = "<html>é" + "x" * 200
PAGES = [(5, "http://a/é b\r\nX: y", LONG), (3, None, LONG), (9, "http://c", LONG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (3, "again", LONG), (None, "n", LONG), (None, "n", "y" * 300), (None, "n", "y" * 300), (7, "u", "z" * (17 << 20)), (8, "u", "q\r\n\r\n\0" * 90)]


def expected(pages):
    least = {}
    for p, _, h in pages:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    out = []
    for p, _, h in pages:
        raw = (h or "").encode()
        to = least.get(h or "") if len(raw) >= 100 and sum((x or "") == (h or "") for _, _, x in pages) > 1 else None
        to = None if to == p else to
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def held(spark, archive):
    return sorted(glob.glob(warc.current(spark, archive).removeprefix("file://") + "/*.warc.gz"))


@pytest.mark.parametrize("roll", [16 << 20, 300])
def test_round_trip(spark, roll):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, file int")
    at = shared_path(spark, "warc")
    warc.write(pages, at, roll_bytes=roll)
    rows = warc.read(spark, at).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected(PAGES)
    assert {(r.page_id, bytes(r.payload)) for r in rows if r.payload is not None} <= {(p, (h or "").encode()) for p, _, h in PAGES}
    files = held(spark, at)
    assert (len(files) > 3) == (roll == 300)
    order = []
    for f in files:
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        order += [h["x-page-id"] for h, _ in warc.parse(open(f, "rb").read()) if h["warc-type"] != "warcinfo"]
    assert order == [str(p) if p is not None else "" for p in sorted((p for p, _, _ in PAGES), key=lambda p: (p is not None, p or 0))]
    # the same bytes from other partitions
    other = shared_path(spark, "warc")
    warc.write(pages.repartition(3), other, roll_bytes=roll)
    again = held(spark, other)
    assert [open(f, "rb").read() for f in files] == [open(f, "rb").read() for f in again]


def test_nothing_and_alterations(spark):
    at = shared_path(spark, "warc")
    with pytest.raises(FileNotFoundError):
        warc.read(spark, at)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), at)
    assert warc.read(spark, at).count() == 0
    warc.write(spark.createDataFrame(PAGES[:5], "page_id long, url string, html string"), at)
    (f,) = held(spark, at)
    raw = open(f, "rb").read()
    open(f, "wb").write(raw + gzip.compress(b""))
    os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, at).collect()


def test_equal_and_missing_ids_fill_files_too(spark):
    odd = [(None, None, f"<p>{i}" + "ab" * 99) for i in range(60)] + [(None, "same", "copy" * 50)] * 300 + [(4, "same", "short")] * 200 + [(4, f"u{i}", f"text {i % 7} " * 30) for i in range(60)] + [(5, "x", "last")]
    want = expected(odd)
    seen = []
    for n in (1, 4):
        at = shared_path(spark, "warc")
        warc.write(spark.createDataFrame(odd, "page_id long, url string, html string").repartition(n), at, roll_bytes=4000)
        rows = warc.read(spark, at).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == want
        seen.append([open(f, "rb").read() for f in held(spark, at)])
        assert len(seen[-1]) > 20 and max(map(len, seen[-1])) < 4000 + 2000
    assert seen[0] == seen[1]


def test_written_again(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES[:6], "page_id long, url string, html string")
    at = shared_path(spark, "warc")
    warc.write(pages, at)
    before = sorted(map(str, warc.read(spark, at).collect()))

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(warc, "write_json", broken)
        with pytest.raises(OSError, match="lost"):
            warc.write(pages.limit(2), at)
    assert sorted(map(str, warc.read(spark, at).collect())) == before
    warc.write(pages.limit(2), at)
    assert warc.read(spark, at).count() == 2 and len(held(spark, at)) == 1
