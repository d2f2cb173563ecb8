import hashlib
import itertools
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import suffixes
from lodestone.llm.suffixes import LENGTH, dedup, suffix_array
from pyspark.sql import functions as F

RNG = random.Random(6)


def prose(n):
    return "".join(RNG.choice("abcdé \n") for _ in range(n))


def rows():
    a, b, c = prose(230), prose(199), prose(900)
    out = [(1, prose(300) + a + prose(100)), (2, a[5:] + prose(400)), (3, b + "x"), (4, b + "y"), (5, c), (6, c), (6, c), (7, c[:450] + "Q" + c[450:])]
    out += [(8, None), (9, ""), (10, "z" * 199), (11, "z" * 200), (12, "w" * 201), (13, "ab" * 300), (None, a), (14, c[100:350] * 3), (15, prose(40) + "".join(chr(0) for _ in range(220)))]
    shared = prose(170)  # common, but shorter than a window: different surroundings
    out += [(100 + i, prose(50) + shared + prose(50)) for i in range(30)]
    out += [(200 + i, prose(50) + shared + a[:60] + prose(50)) for i in range(5)]
    return out


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        left = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        out.append((k, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 250]), max_size=60))
def test_suffix_array(values):
    t = np.array(values, np.uint8)
    raw = t.tobytes()
    assert suffix_array(t, 80).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_equals_brute_force(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(k, t, "x") for k, t in data], "doc_id long, text string, first string").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup(docs).collect()), key=str)
    want = brute(data)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 8 and sum(r[2] == 0 and r[1] > 200 for r in want) > 20
    assert dedup(docs.limit(0)).count() == 0


def test_blocks(spark, monkeypatch):
    """Contexts that are cut at block edges find their copies all the same."""
    data = [(i, prose(700)) for i in range(6)]
    data += [(10, data[0][1][50:500] + prose(300)), (11, prose(77) + data[1][1])]
    monkeypatch.setattr(suffixes, "BLOCK", 256)
    texts = [(t or "").encode() for _, t in data]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, first, count, place, gram, x1, x2 = suffixes.contexts(flat, at)
    windows = sorted((r, f + i) for r, f, c in zip(row, first, count, strict=True) for i in range(c))
    assert windows == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - LENGTH + 1)]
    for r, f, p, g in zip(row, first, place, gram, strict=True):
        a = texts[r][f + p : f + p + suffixes.GRAM]
        assert suffixes.mixed(suffixes.Hashes(np.frombuffer(a, np.uint8), suffixes.B1, suffixes.T1).of(np.array([0]), np.array([len(a)]))).view(np.int64)[0] == g


def test_hot_gram_with_many_surroundings(spark):
    """A string of 162 bytes in 3,000 surroundings, some of them equal: split by them, results as by brute force."""
    hot = prose(162).encode()[:162].decode(errors="ignore").ljust(162, "q")
    data = [(i, prose(12) + hot + prose(12)) for i in range(2600)]
    data += [(3000 + i, data[i][1][:12] + hot + data[i][1][-12:] + prose(20)) for i in range(0, 400, 2)]  # windows of 200 bytes in common
    data += [(4000 + i, prose(40) + data[i][1]) for i in range(1, 200, 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup(docs).collect()), key=str)
    want = brute(data)
    assert got == want and sum(r[2] > 0 for r in want) > 300


def test_groups_over_batches():
    """Contexts of one gram that are parted by batch edges are candidates and copies all the same."""
    rng = np.random.default_rng(4)
    n = 200
    rows = {"to": np.zeros(n, np.int64), "kind": np.zeros(n, np.int32), "gram": np.sort(rng.integers(0, 25, n)), "x1": rng.integers(0, 3, n), "x2": np.zeros(n, np.int64)}
    rows |= {"doc": np.arange(n), "h": np.zeros(n, np.int64), "first": np.zeros(n, np.int64), "windows": np.ones(n, np.int32), "place": np.zeros(n, np.int32), "many": np.zeros(n, bool)}
    order = np.lexsort((rows["x1"], rows["gram"]))
    rows = {k: c[order] for k, c in rows.items()}
    whole = pa.RecordBatch.from_pydict(rows)
    for step in (1, 3, 50, n):
        out = list(suffixes._compare_contexts(whole.slice(i, step) for i in range(0, n, step)))
        table = pa.Table.from_batches(out).to_pydict()
        copies, pairs = Counter(zip(rows["gram"], rows["x1"], strict=True)), {(g, x) for g, x in zip(rows["gram"], rows["x1"], strict=True)}
        repeats = {d for d, k in zip(table["doc"], table["kind"], strict=True) if k == 1}
        assert repeats == {d for d, g, x in zip(rows["doc"], rows["gram"], rows["x1"], strict=True) if copies[g, x] > 1}
        of = Counter(g for g, _ in pairs)
        assert Counter(g for g, k in zip(table["gram"], table["kind"], strict=True) if k == 0) == {g: c for g, c in of.items() if c > 1}


def test_one_passage_in_many_documents(spark):
    """A class is sent each different candidate of a common passage once, not one a document."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)[:260]
    rows = [(i, text(20) + " " + passage + " " + text(20)) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = suffixes.candidates(docs)[1].where("data is not null").cache()
    assert met.count() > 0
    by_class = met.groupBy("k1", "k2").agg(F.count("data").alias("n"), F.countDistinct("data").alias("different"))
    assert by_class.where("n > different").count() == 0
    got = {r.doc_id: r.n_removed for r in suffixes.dedup(docs).select("doc_id", "n_removed").collect()}

    def common(parts):
        """How many leading letters each part shares with some other one."""
        order, out = sorted(range(len(parts)), key=parts.__getitem__), [0] * len(parts)
        for a, b in itertools.pairwise(order):
            n = len(os.path.commonprefix([parts[a], parts[b]]))
            out[a], out[b] = max(out[a], n), max(out[b], n)
        return out

    left, right = common([t.split(passage)[0][::-1] for _, t in rows]), common([t.split(passage)[1] for _, t in rows])
    assert got == {i: 260 + a + b for (i, _), a, b in zip(rows, left, right, strict=True)}
