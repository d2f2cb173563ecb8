"""Deterministic sharded WARC writer and reader.

Records are ordered by (page_id, digest, url) over files; a file takes records until their
compressed size reaches ``roll_bytes``. That size is summed over the global order of all records,
so the files of a table are the same bytes whatever the partitions. Every record is a gzip member of
its own, and headers and digests are made anew from the payload.

Only narrow rows are sorted globally. Page contents move once, to the file that holds their place in
the order: one key a file goes to all tasks. Equal rows are one narrow row with a count, and where
their copies go over a file's end, one of them moves to each of these files, with its number of copies.

Files are written by Spark's file committer under temporary names (each task's attempt apart) into a
new version folder, renamed when the job has ended, and listed in the table ``files`` there;
``manifest.json`` names the version and is replaced last. Until then an older version is the archive,
and a folder without a manifest is none. The text sink writes raw bytes with a separator after each
row; a gzip member ends in the high byte of its payload's length, zero below 16 MiB, so the
separator is that byte (a longer record gets an empty member behind it).
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import partitions_for, plain, scan, slices, with_column
from lodestone.sources.tables import cut, exists, hadoop, read_json, remove, write_json

#: Compressed bytes after which the next record starts a new file; a reader holds one file.
ROLL_BYTES = 16 << 20
#: Payloads below this many bytes are always written in full.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit holds the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(number: int, date: str = DATE) -> bytes:
    block = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{number}')}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name(number)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def name(number: int) -> str:
    return f"pages-{number:08d}.warc.gz"


def member(raw: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    out = gzip.compress(raw, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 6, mtime=0)


#: What records are ordered by; null comes first.
ORDER = ["page_id", "digest", "url"]


def _key(page_id: int | None, digest: str, url: str | None) -> tuple:
    return page_id is not None, page_id or 0, digest, url is not None, url or ""


class Places:
    """The file of each record, from the first key of each file. Page ids alone decide where they can."""

    def __init__(self, first: list[tuple[int, tuple]], shared: set[tuple]):
        first = sorted(first, key=lambda x: x[1])
        self.files, self.keys = [f for f, _ in first], [k for _, k in first]
        self.ids = np.array([k[1] for k in self.keys if k[0]], np.int64)
        self.nulls = len(self.keys) - len(self.ids)
        self.shared = shared  # keys whose copies are in several files: dealt out apart

    def of(self, page_id: pa.Array, digest: pa.Array, url: pa.Array) -> np.ndarray:
        """Number of the file of each row, -1 for shared keys."""
        page, null = page_id.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(page_id.is_null())
        low, high = (np.where(null, 0, self.nulls + np.searchsorted(self.ids, page, side)) for side in ("left", "right"))
        at = high - 1
        odd = null | (low != high)  # a file begins within this page id
        if self.shared:
            odd |= np.isin(page, [k[1] for k in self.shared])
        for i in np.flatnonzero(odd).tolist():
            key = _key(page_id[i].as_py(), digest[i].as_py(), url[i].as_py())
            at[i] = -2 if key in self.shared else bisect_right(self.keys, key) - 1
        known = np.array([*self.files, -1, -1], np.int64)
        return np.where(at == -2, -1, known[np.maximum(at, 0)])


def write(pages: DataFrame, archive: str, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> None:
    """Write (page_id, url, html) rows to the folder ``archive``.

    Null html is an empty payload; a null url becomes urn:page:<page_id>. Of equal payloads of at
    least ``LEAST_REVISIT`` bytes the smallest page_id is written in full and the others revisit
    it. Rows with that same page_id too are written in full; null page_ids sort first and are
    never referred to (so copies without any page_id are all written in full). Repeated rows are
    records each. Other columns are ignored; an empty table gives an archive without files.
    """
    spark, n = pages.sparkSession, partitions_for(pages)
    html = F.coalesce("html", F.lit(""))
    pages = plain(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size")]
            full = [len(member(record(p, u, h.encode(), d, s, None, False, date))) for p, u, h, d, s in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("page_id", "url", "digest", "size")] + [pa.array(full, pa.int64())], names=["page_id", "url", "digest", "size", "bytes"])

    def sized_revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "bytes", "refers_to")]
            size = np.array([f if r is None else len(member(record(p, u, None, d, s, r, True, date))) for p, u, d, s, f, r in zip(*columns, strict=True)], np.int64)
            names = ["page_id", "digest", "url", "refers_to", "copies"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(size), pa.array(size * b.column("copies").to_numpy())], names=[*names, "bytes", "total"])

    narrow = pages.mapInArrow(sized, "page_id long, url string, digest string, size long, bytes long")
    narrow = cut(narrow.groupBy(*ORDER, "size", "bytes").agg(F.count(F.lit(1)).alias("copies")))
    first = cut(narrow.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.sum("copies").alias("copies")).where("copies > 1").select("digest", "least"))
    marked = narrow.join(first, "digest", "left").select(*ORDER, "size", "bytes", "copies", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))
    sizes = marked.mapInArrow(sized_revisits, "page_id long, digest string, url string, refers_to long, copies long, bytes long, total long")

    def files(b: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        total, one = b.column("total").to_numpy(), b.column("bytes").to_numpy()
        start = state["base"] + np.cumsum(total) - total
        return with_column(b, start=start, file=start // roll_bytes, last=(start + total - one) // roll_bytes)

    placed = cut(scan(sizes, files, ORDER, "total", "page_id long, digest string, url string, refers_to long, copies long, bytes long, total long, start long, file long, last long"))
    key = F.struct("page_id", "digest", "url")
    opening = placed.where("last = file").groupBy("file").agg(F.min(key).alias("key")).collect()  # a row a file
    crossing = placed.where("last > file").collect()  # fewer than files
    places = Places([(r.file, _key(*r.key)) for r in opening], {_key(r.page_id, r.digest, r.url) for r in crossing})
    shared = spark.sparkContext.broadcast(places)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            yield with_column(b, file=shared.value.of(b.column("page_id"), b.column("digest"), b.column("url")))

    kind = "page_id long, url string, html string, digest string, size long, file long"
    rows = pages.mapInArrow(numbered, kind).where("file >= 0").select("file", "page_id", "url", "html", "digest", "size", F.lit(None).cast("long").alias("refers_to"), F.lit(1).cast("long").alias("copies"))
    if crossing:
        rows = rows.union(_dealt(pages, crossing, roll_bytes))
    marks = placed.where("refers_to is not null").select(F.explode(F.sequence("file", "last")).alias("file"), "page_id", "digest", "refers_to").distinct()
    rows = rows.union(marks.select("file", "page_id", F.lit(None).cast("string"), F.lit(None).cast("string"), "digest", F.lit(None).cast("long"), "refers_to", F.lit(None).cast("long")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, known, seq = None, {}, 0
        for b in batches:
            at, order, data, held = [], [], [], 0
            for f, p, u, h, d, s, r, copies in zip(*(b.column(c).to_pylist() for c in ("file", "page_id", "url", "html", "digest", "size", "refers_to", "copies")), strict=True):
                if f != file:
                    file, known = f, {}
                    at.append(f)
                    order.append(-1)
                    data.append(member(warcinfo(f, date))[:-1])
                if h is None:  # its revisit mark stands before the page
                    known = {k: v for k, v in known.items() if k[0] == p} if known and next(iter(known))[0] != p else known
                    known[p, d] = r
                    continue
                to = known.get((p, d))
                own = member(record(p, u, h.encode(), d, s, to, to is not None, date))[:-1]
                for _ in range(copies):
                    at.append(f)
                    order.append(seq)
                    data.append(own)
                    seq, held = seq + 1, held + len(own)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(order, pa.int64()), pa.array(data, pa.binary())], names=["file", "seq", "data"])
                        at, order, data, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(order, pa.int64()), pa.array(data, pa.binary())], names=["file", "seq", "data"])

    version = uuid.uuid4().hex
    built = rows.repartitionById(n, F.pmod(F.col("file"), F.lit(n)).cast("int")).sortWithinPartitions("file", "page_id", F.col("html").isNotNull(), "digest", "url").mapInArrow(members, "file long, seq long, data binary")
    built = built.sortWithinPartitions("file", "seq").select("file", F.col("data").cast("string").alias("value"))
    built.write.partitionBy("file").option("lineSep", "\0").text(f"{archive}/{version}/_writing")
    _commit(spark, archive, version, date)


def _dealt(pages: DataFrame, crossing: list, roll_bytes: int) -> DataFrame:
    """Rows whose copies are in several files: one of them for each file, with its number of copies there."""
    parts = []
    for r in crossing:
        at = 0
        while at < r.copies:
            file = (r.start + at * r.bytes) // roll_bytes
            upto = min(r.copies, -(-((file + 1) * roll_bytes - r.start) // r.bytes))  # copies that start before the next file
            parts.append((r.page_id, r.digest, r.url, file, upto - at))
            at = upto
    dealt = pages.sparkSession.createDataFrame(parts, "p long, d string, u string, file long, copies long")
    keys = dealt.select("p", "d", "u").distinct()
    same = F.col("digest").eqNullSafe(F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u"))
    one = pages.join(F.broadcast(keys), same, "left_semi").groupBy(*ORDER).agg(F.first("html").alias("html"), F.first("size").alias("size"))
    return one.join(F.broadcast(dealt), same).select("file", "page_id", "url", "html", "digest", "size", F.lit(None).cast("long").alias("refers_to"), "copies")


def _commit(spark: SparkSession, archive: str, version: str, date: str) -> None:
    """Name the files of a finished version, list them, let the manifest name the version, drop older ones."""
    at = f"{archive}/{version}"
    fs, writing = hadoop(spark, f"{at}/_writing")

    def named(folder) -> tuple[str, int] | None:
        m = re.fullmatch(r"file=(\d+)", folder.getPath().getName())
        if not m:
            return None
        (part,) = [x for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")]
        if not fs.rename(part.getPath(), hadoop(spark, f"{at}/{name(int(m[1]))}")[1]):
            raise OSError(f"could not rename {part.getPath()}")
        return name(int(m[1])), part.getLen()

    with ThreadPoolExecutor(8) as pool:
        listed = sorted(x for x in pool.map(named, fs.listStatus(writing)) if x)
    remove(spark, f"{at}/_writing")
    spark.createDataFrame(listed, "name string, bytes long").coalesce(1).write.parquet(f"{at}/files")
    write_json(spark, f"{archive}/manifest.json", {"version": version, "date": date, "files": len(listed), "bytes": sum(x for _, x in listed)})
    for old in fs.listStatus(hadoop(spark, archive)[1]):
        if old.isDirectory() and old.getPath().getName() != version:
            fs.delete(old.getPath(), True)


def current(spark: SparkSession, archive: str) -> str:
    """The folder of the version that the manifest names."""
    if not exists(spark, f"{archive}/manifest.json"):
        raise FileNotFoundError(f"{archive} has no manifest: it was never committed")
    return f"{archive}/{read_json(spark, f'{archive}/manifest.json')['version']}"


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a gzip file, a member at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, raw = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise EOFError("a gzip member is cut off")
            piece = view[at : at + (1 << 16)]
            raw.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        data = b"".join(raw)
        if data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            n = int(fields["content-length"])
            if rest[n:] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield fields, rest[:n]


def read(spark: SparkSession, archive: str) -> DataFrame:
    """page_id, url, payload (binary, null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Digests of responses are computed from the payload that was read and must equal the header's;
    block digests are verified too, and the files must be those of the manifest. Raises otherwise.
    Null page_ids are null again, a payload that was null is empty, a url that was null is
    urn:page:<page_id>; an archive without files gives no rows.
    """
    at = current(spark, archive)
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not read_json(spark, f"{archive}/manifest.json")["files"]:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(at)
    found = files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("found"))
    odd = found.join(spark.read.parquet(f"{at}/files"), "name", "full_outer").where("not (found <=> bytes)").first()
    if odd:
        raise ValueError(f"{odd.name} is not the file of the manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, held = [], 0
                for fields, block in parse(content.as_buffer()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    if fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                        raise ValueError(f"{path}: a record is altered")
                    payload, digest = None, fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload is altered")
                    number = lambda k: int(x) if (x := fields.get(k)) else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), fields["warc-target-uri"], payload, int(fields["x-payload-length"]) if payload is None else len(payload), digest, fields["warc-type"], number("x-refers-to-page")))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
