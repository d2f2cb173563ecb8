import hashlib
import random

import numpy as np

from lodestone.llm import substring
from lodestone.llm.common import utf8
from lodestone.llm.spans import merged
from lodestone.llm.substring import dedup, deduped

RNG = random.Random(4)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghijklmnoé") for _ in range(RNG.randint(1, 9))) for _ in range(n))


PASSAGE = prose(60)
A = prose(200)
ROWS = [
    (10, prose(80) + " " + PASSAGE + " " + prose(50)),
    (4, PASSAGE + " " + prose(70)),
    (7, A),
    (2, A),
    (7, A),
    (None, prose(40)),
    (1, None),
    (3, ""),
    (5, "x" * 3000),
    (6, prose(20000)),
    (8, prose(30) + PASSAGE + PASSAGE),
]


def parts(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    ends = substring.cut_points(data, substring.candidates(data)) if len(data) else []
    return list(zip([0, *ends], ends, strict=False))


def brute(rows, least=substring.LEAST_RUN):
    rows = [(k if k is not None else -1, (t or "").encode()) for k, t in rows]
    owner = {}
    for k, raw in sorted(rows):
        for a, z in parts(raw.decode()):
            owner.setdefault(raw[a:z], (k, a)) if not owner.get(raw[a:z]) else None
    out = []
    for k, raw in rows:
        runs = []
        for a, z in parts(raw.decode()):
            if owner[raw[a:z]] != (k, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
        runs = [r for r in runs if r[1] - r[0] >= least]
        left, at = b"", 0
        for a, z in runs:
            left, at = left + raw[at:a], z
        left += raw[at:]
        out.append((k if k != -1 else None, len(raw), sum(z - a for a, z in runs), len(runs), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_chunks_rebuild_and_resist_shifts():
    text = prose(3000)
    a, b = parts(text), parts("Ins" + text)
    raw = text.encode()
    assert b"".join(raw[x:y] for x, y in a) == raw and max(y - x for x, y in a) <= substring.MOST + 3
    new = ("Ins" + text).encode()
    assert len({raw[x:y] for x, y in a} & {new[x:y] for x, y in b}) >= len(a) - 8
    for x, y in a:
        raw[x:y].decode()


def test_equals_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, "p") for k, t in ROWS], "doc_id long, text string, h string").repartition(3)
    found = dedup(docs)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=str)
    assert got == brute(ROWS)
    by = {r[0]: r for r in got}
    assert by[7][2] == by[7][1] > 0 and by[2][2] == 0 and by[10][2] > 150 and by[4][2] == 0 and by[8][2] > 300 and by[6][2] == 0
    repeated = {r.doc_id: r.n_repeated for r in found.collect()}  # first ones too
    assert repeated[7] == repeated[2] == by[2][1] and repeated[4] >= by[10][2] and repeated[6] == repeated[1] == repeated[3] == 0
    left = {r.doc_id: r for r in deduped(docs, found).collect()}
    assert 7 not in left and left[2].text == A and left[2].h == "p" and left[1].text == ""


def test_hot_passage(spark):
    rows = [(i, prose(12) + PASSAGE) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup(docs).collect()), key=str)
    assert got == brute(rows)
    assert dedup(docs.limit(0)).count() == 0


def test_merged():
    s, e = merged(np.array([5, 0, 2, 20]), np.array([9, 3, 5, 21]))
    assert s.tolist() == [0, 20] and e.tolist() == [9, 21]
    s, e = merged(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(s) == len(e) == 0
    assert utf8(__import__("pyarrow").array(["a", None, "é"]))[1].tolist() == [0, 1, 1, 3]
