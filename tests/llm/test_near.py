import random

import corpus_pipeline
import numpy as np
from lodestone.llm import near


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def components(sets):
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if up[i] != up[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = min(up[i], up[j]), max(up[i], up[j])
                up = [a if x == b else x for x in up]
    return up


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**9)}"
    return out


def corpus(rng):
    """Texts with copies at similarities from about 0.6 to 1, and unrelated ones."""
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 120, 400]))]
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, max(1, round(len(base) * rng.uniform(0.002, 0.06))))) for _ in range(3)]
    return texts + [None, "", " \n", "one two", "One  two", "one two three"]


def test_stage_equals_brute_force(spark):
    texts = corpus(random.Random(1))
    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(jaccard(sets[i], sets[j]) < 0.9 for i, j in pairs) > 20  # those that 3 of 64 bits miss
    comp = components(sets)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(comp))  # neither a pair missed nor one too many


def test_large_buckets_in_parts(spark, monkeypatch):
    """One group of near copies, and texts with a common band that aren't similar: divided, as whole as by brute force."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([1, 2, 3, 4]))) for _ in range(60)]
    texts += [" ".join(base[:75] + [f"t{i}x{j}" for j in range(rng.choice([20, 75]))]) for i in range(40)]
    monkeypatch.setattr(near, "BIG", 12)
    monkeypatch.setattr(near, "LEADERS", 2)
    seen = []
    apart = near._apart
    monkeypatch.setattr(near, "_apart", lambda *x: seen.append(1) or apart(*x))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(components([grams(t) for t in texts]))) and seen


def test_simhash_proposes_nearly_equal_texts(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(9999)}" for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 2))), (3, " ".join(rng.sample(base, 2000)))]
    signs = near.signed(spark.createDataFrame([(bytes([i]), i, t) for i, t in rows], "digest binary, h long, text string"))
    signs = signs.selectExpr("cast(conv(hex(digest), 16, 10) as long) h", "fp", "bands")
    assert {r.h for r in near.simhash_pairs(signs).collect()} == {1, 2}


def test_rows_have_their_own_decisions(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    rows = [(None, " ".join(edited(rng, base, 1))), (4, " ".join(base)), (4, " ".join(other)), (3, " ".join(edited(rng, other, 1))), (None, "lone"), (None, "lone"), (5, "x y")]
    docs = spark.createDataFrame([(k, t, t) for k, t in rows], "doc_id long, text string, h string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[6]], key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_ties_have_one_result(spark):
    """Rows that share id and text but differ elsewhere: the same one stays for any partitioning."""
    text = "a text of more than five words that all share"
    rows = [(1, text, s, i) for i, s in enumerate("abcdefgh")] + [(1, text, "a", 0), (None, "other", None, 1), (None, "other", "x", 2)]
    kept = set()
    for n in (1, 2, 3, 5):
        docs = spark.createDataFrame(rows[::-1] if n % 2 else rows, "doc_id long, text string, source string, k int").repartition(n)
        kept.add(tuple(sorted(map(str, near.deduplicated(docs).collect()))))
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_hot_band_is_divided(spark, monkeypatch):
    """3,000 near copies share bands: no task gathers them, and their texts move for few buckets."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(3_000)] + [(9_000 + i, f"alone {i} " + " ".join(f"q{i}x{j}" for j in range(30))) for i in range(50)]
    moved = []
    cut = near.cut
    monkeypatch.setattr(near, "cut", lambda df: moved.append(out := cut(df)) or out)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in near.deduplicated(docs).collect())
    assert got == [0, *range(9_000, 9_050)]
    members = [df for df in moved if df.columns == ["bucket", "h"]]
    assert members and max(df.groupBy("bucket").count().agg({"count": "max"}).first()[0] for df in members if df.head(1)) <= 2 * near.BIG
    assert sum(df.count() for df in members) < 4 * 3_000  # it was 22 times each text


def test_linked_is_whole():
    rng = random.Random(3)
    texts = corpus(rng)[:100]
    order = rng.sample(texts, len(texts))
    assert near.linked([near.shingles(t) for t in order]).tolist() == components([grams(t) for t in order])


def test_shingles_and_minima():
    a = near.shingles("A b c d e f " * 2000)
    assert len(a) == 6 and (a == near.shingles("a b c d e f " * 3000)).all()
    many = near.shingles(" ".join(f"w{i}" for i in range(10_000)))
    assert (near.minima(many) == np.minimum(near.minima(many[:5000]), near.minima(many[5000:]))).all()
