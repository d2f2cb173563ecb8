import hashlib

import numpy as np

from lodestone.llm.decontaminate import WORD, digest, find_contamination, words

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short ITEM here"),
    (2, "Short ITEM here"),
    (3, None),
    (4, "..."),
    (None, "never used at all"),
    (5, "a a a a a a a a a a a a"),
    (6, "soloÉ"),
    (10, "two three four five six seven eight nine ten eleven"),
]
DOCS = [
    (1, "x " * 5 + "one two, three four five. six seven eight nine ten eleven y"),
    (2, "one two three four five six seven eight nine"),
    (3, None),
    (4, ""),
    (5, "short item here SHORT item, here short"),
    (6, "a " * 40),
    (7, "a " * 9),
    (8, "z soloÉ soloé"),
    (None, "short item here"),
    (5, "short item here"),
    (9, "one two three four five six seven eight nine ten eleven twelve " * 3 + "tail " * 20000),
]


def brute(docs, items, window=10):
    out = []
    for k, text in docs:
        w, hit, names = words(text), set(), set()
        for item, other in items:
            o = words(other)
            if item is None:
                continue
            for i in range(max(1, len(o) - window + 1) if o else 0):
                part = o[i : i + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        names.add(str(item))
        out.append((k, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_words():
    assert words("A-b_C9 Éé\x80") == ["a", "b", "c9", "Éé\x80"] and words(None) == [] and WORD.findall("") == []


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "w") for k, t in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame([(k, t, "w") for k, t in ITEMS], "item_id long, text string, spans string")
    want = brute(DOCS, ITEMS)
    for chars in (8_000_000, 30):  # one block, and several
        assert sorted(map(tuple, digest(find_contamination(docs, items, block_chars=chars)).collect()), key=str) == want


def test_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(tuple, digest(find_contamination(docs, items)).collect()), key=str) == brute(DOCS, [])
    assert find_contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_many_matches_of_short_items(spark, monkeypatch):
    """A very long text full of one-word and shared-shingle items, compared a few places at a time."""
    from lodestone.llm import decontaminate

    items = [(1, "aa"), (2, "aa aa"), (3, "aa bb"), *((10 + i, f"aa cc w{i}") for i in range(30))]
    long = "aa " * 3000 + "aa cc w3 aa cc w29 bb"
    index = decontaminate.Index([(k, t) for k, t in items])
    index.order({k: np.zeros(len(a), np.int64) for k, a in index.all.items()})
    ids = index.ids(long.encode())
    whole = index.find(ids)
    monkeypatch.setattr(decontaminate, "PROPOSED", 50)
    parts = index.find(ids)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]
    assert {index.names[i] for i in whole[1]} == {"1", "2", "13", "39"} and whole[0].tolist() == [True] * 3006 + [False]
