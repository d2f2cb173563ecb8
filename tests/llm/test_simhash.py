import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import simhash
from lodestone.llm.simhash import digest, near_duplicates


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = simhash.WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(fps, budget=3):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcÀÉ \t\n\x0b\x85")), max_size=400))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_majority_of_many():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 255 * 64 * 2 + 17, dtype=np.uint64) * np.uint64(2)
    want = sum(1 << i for i in range(64) if 2 * int(((h >> np.uint64(i)) & np.uint64(1)).sum()) > len(h))
    assert simhash.majority(h) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4095)), max_size=60, unique=True), st.integers(1, 40))
def test_trie(rows, front):
    rows.sort()
    group, rest = np.array([g for g, _ in rows], np.int64), np.array([r for _, r in rows], np.uint64)
    want = components([r | g * 0xFF0000 << g for g, r in rows])
    assert simhash.trie_components(group, rest, 12, front=front).tolist() == want


def near(rng, fp, n):
    for i in rng.choice(64, n, replace=False):
        fp ^= 1 << int(i)
    return fp


def test_links_connect_what_pairs_connect(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for _ in range(300):
        fps.append(near(rng, fps[rng.integers(len(fps))], int(rng.integers(1, 5))))
    fps = list(dict.fromkeys([*fps, 0, (1 << 64) - 1, (1 << 64) - 2]))
    keys = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = components(fps)
    for most in (1 << 16, 5):  # without and with subtrees that are rotated again
        up = {simhash._signed(x): simhash._signed(x) for x in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in simhash.links(keys, most=most).collect():
            assert ((r.src ^ r.dst) & (1 << 64) - 1).bit_count() <= 64
            up[root(r.src)] = root(r.dst)
        roots = [root(simhash._signed(x)) for x in fps]
        assert len(set(roots)) == len(set(want)) and len(set(zip(roots, want, strict=True))) == len(set(want))


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base, base.upper(), base + " more", base.replace("w7 ", "x7 "), "other text here now", None, "", " \n", "one", "one two", "x " * 5000, base[::-1]]
    rows = [(i * 3 if i != 1 else None, t, "c") for i, t in enumerate(texts)] + [(0, base, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    comp = components(fps)
    least = {c: min((k for (k, _, _), d in zip(rows, comp, strict=True) if d == c and k is not None), default=None) for c in comp}
    want = sorted(((k, f"{f:016x}", least[c]) for (k, _, _), f, c in zip(rows, fps, comp, strict=True)), key=str)
    assert sorted(map(tuple, digest(near_duplicates(docs)).collect()), key=str) == want
    assert near_duplicates(docs.limit(0)).count() == 0
