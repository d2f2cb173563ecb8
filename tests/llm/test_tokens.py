"""Encoding, the token store and packing against plain Python."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing, token_store
from lodestone.llm.bpe import Encoder, vocabulary_path
from lodestone.sources.tables import exists, read_json, shared_path

TEXTS = [None, "", "a", "Hello world.  Two  spaces\n\n\ttabs it's l'été — dash 12ab", "x  　 y", "<|endoftext|> a \x1c b\r\n", "word " * 3000, "word " * 3000, "ü" * 50]
ROWS = [(i if i != 3 else None, t, f"k{i}") for i, t in enumerate(TEXTS)] + [(8, "ü" * 50, "again"), (8, "ü" * 50, "again")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, `__pid` string")


TOKENIZER = Tokenizer.from_file(vocabulary_path())


def ids(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab' \n\t.,!1é×ñ—  日\x1c\r")), max_size=30), max_size=6))
def test_pieces_equal_whole_texts(texts):
    got, at = Encoder.of().encode_column(pa.array(texts, pa.string()), end=7)
    assert [got[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [ids(t, 7) for t in texts]


def structured(k):
    """The Thue-Morse word of 2^k letters and its complement: their polynomial hashes modulo 2^64 are equal from some length on."""
    word = [0]
    for _ in range(k):
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_structured_words_have_their_own_ids():
    fresh = Encoder(vocabulary_path())
    words = [w for k in range(8, 14) for w in structured(k)]
    got, at = fresh.encode_column(pa.array(words + words[::-1], pa.string()), end=7)  # one batch
    for i, t in enumerate(words + words[::-1]):
        assert got[at[i] : at[i + 1]].tolist() == ids(t, 7)
    fresh.clear()
    for t in [*words, *words, "x " + words[-1] + " y " + words[-2]]:  # batch by batch
        assert fresh.encode_column(pa.array([t], pa.string()), end=7)[0].tolist() == ids(t, 7)


def test_structured_words_in_store_and_packing(spark):
    rows = [(i, t) for i, t in enumerate([w for k in (9, 10, 11, 12) for w in structured(k)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = shared_path(spark, "store")
    token_store.write(docs, store, end=0)
    at, want = 0, []
    for i, t in rows:
        own = ids(t, 0)
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = token_store.read_checksums(spark, store)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
    packed = packing.pack(docs, capacity=1024, end=2)
    first = {i: ids(t, 2)[: (len(ids(t, 2)) - 1) % 1024 + 1] for i, t in rows}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in packed.where("piece = 0").collect()} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in first.items()}


def test_crc_join():
    a, b = b"hello", b"wonderful world" * 99
    assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store_round_trip(spark):
    store = shared_path(spark, "store")
    token_store.write(frame(spark), store)
    want, at = [], 0
    for k, t in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, len(ids(r[1], 0)))):
        own = ids(t, 0)
        want.append((k, at, own))
        at += len(own)
    got = {(r.doc_id, r.start): list(r.ids) for r in token_store.read_documents(spark, store).collect()}
    assert got == {(k, s): x for k, s, x in want}
    sums = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_checksums(spark, store).collect()}
    assert sums == {(k, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, s, x in want}
    chunks = spark.read.parquet(f"{at_version(spark, store)}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count() < sum(len(token_store.cut_points(np.array(x))) for _, _, x in want)


def at_version(spark, store):
    return f"{store}/{read_json(spark, f'{store}/manifest.json')['version']}"


RECIPES = "doc_id long, nth long, start long, n_tokens long, digests array<binary>, root binary"


def lost(rows):
    return rows[1:]


def doubled(rows):
    return rows + rows[-1:]


def reordered(rows):
    return [*rows[:-1], rows[-1] | {"digests": rows[-1]["digests"][::-1]}]


def other_root(rows):
    return [rows[0] | {"root": bytes(32)}, *rows[1:]]


def other_order(rows):
    return [rows[0] | {"nth": rows[1]["nth"]}, rows[1] | {"nth": rows[0]["nth"]}, *rows[2:]]


def renamed(rows):
    return [*rows[:-1], rows[-1] | {"doc_id": 99}]


@pytest.mark.parametrize("change", [lost, doubled, reordered, other_root, other_order, renamed])
def test_store_finds_altered_recipes(spark, change):
    store = shared_path(spark, "store")
    words = " ".join(f"w{i * i}" for i in range(20_000))
    token_store.write(frame(spark, [(1, "a", ""), (2, "b c", ""), (3, words, "")]), store)
    at = f"{at_version(spark, store)}/recipes"
    rows = [r.asDict() for r in spark.read.parquet(at).orderBy("nth").collect()]
    assert len(rows[-1]["digests"]) > 2
    spark.createDataFrame([tuple(r[k.split()[0]] for k in RECIPES.split(", ")) for r in change(rows)], RECIPES).coalesce(1).write.mode("overwrite").parquet(at)
    for read in (token_store.read_checksums, token_store.read_documents):
        with pytest.raises(Exception, match="aren't those of its manifest|is altered"):
            read(spark, store).collect()


@pytest.mark.parametrize("read", [token_store.read_checksums, token_store.read_documents])
def test_store_finds_lost_and_altered_chunks(spark, read):
    store = shared_path(spark, "store")
    token_store.write(frame(spark), store)
    at = f"{at_version(spark, store)}/chunks"
    held = [tuple(r) for r in spark.read.parquet(at).select("key", "n", "data").orderBy("key").collect()]
    for kept, says in ((held[1:], "missing"), ([(held[0][0], *held[1][1:]), *held[1:]], "altered")):
        spark.createDataFrame(kept, "key binary, n long, data binary").write.mode("overwrite").parquet(at)
        with pytest.raises(Exception, match=says):
            read(spark, store).collect()


def test_root_is_that_of_the_list(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), " ".join(f"w{x}" for x in rng.integers(0, 99, 5)), "") for k in rng.integers(0, 30, 45)] + [(None, "x", ""), (None, None, "")]
    found = set()
    for n, fold in ((2, 14), (7, 3), (51, 1)):
        monkeypatch.setattr(token_store, "FOLD", fold)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            store = shared_path(spark, "store")
            token_store.write(frame(spark, rows), store)
            found.add(read_json(spark, f"{store}/manifest.json")["root"])
            if n == 7:
                stored = spark.read.parquet(f"{at_version(spark, store)}/recipes").orderBy("nth").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    level = [token_store.leaf(r.doc_id, r.start, r.n_tokens, bytes(r.root)) for r in stored]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert found == {level[0].hex()}


def test_store_written_again(spark, monkeypatch):
    store = shared_path(spark, "store")
    token_store.write(frame(spark), store)
    before = {tuple(r) for r in token_store.read_checksums(spark, store).collect()}

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(token_store, "write_json", broken)
        with pytest.raises(OSError, match="lost"):
            token_store.write(frame(spark, ROWS[:3]), store)
    assert {tuple(r) for r in token_store.read_checksums(spark, store).collect()} == before
    token_store.write(frame(spark, ROWS[:3]), store)
    assert token_store.read_checksums(spark, store).count() == 3


def test_store_of_nothing(spark):
    store = shared_path(spark, "store")
    assert not exists(spark, store)
    token_store.write(frame(spark, []), store)
    assert token_store.read_checksums(spark, store).count() == token_store.read_documents(spark, store).count() == 0


def test_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50000, 40000).astype(np.uint32)
    b = np.concatenate([a[:500], [7, 8, 9], a[500:]]).astype(np.uint32)

    def parts(x):
        ends = token_store.cut_points(x)
        assert ends[-1] == len(x) and max(np.diff([0, *ends])) <= token_store.MOST
        return {x[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)}

    assert len(parts(a) & parts(b)) >= len(parts(a)) - 3


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = min((r for r in bins if r >= n), default=None)
        if room is None:
            bins.append(capacity - n)
        else:
            bins[bins.index(room)] = room - n
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, 40)
    assert plan["bins"] == plain_best_fit(lengths, 40)
    taken, placed = {}, {n: 0 for n in counts}
    for length, rank, n, first, per, offset in zip(*(plan[k].tolist() for k in ("length", "rank", "n", "bin", "per", "offset")), strict=True):
        assert rank == placed[length]
        placed[length] += n
        for j in range(n):
            taken.setdefault(first + j // per, []).append((offset + j % per * length, length))
    assert placed == counts and len(taken) == plan["bins"]
    for rows in taken.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 40


def test_pack(spark):
    got = packing.pack(frame(spark), capacity=64).collect()
    want = []
    for k, t, _ in ROWS:
        own = ids(t, 2)
        edges = [0, *range(len(own) % 64 or 64, len(own) + 1, 64)]
        want += [(k, j, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == plain_best_fit([r.length for r in got], 64)
    assert packing.pack(frame(spark, [])).count() == 0


def test_materialize(spark):
    docs = frame(spark, [(i, f"text number {i} " * (i % 7), "") for i in range(40)])
    packed = packing.pack(docs, capacity=32)
    out = {r.sequence_id: list(r.input_ids) for r in packing.materialize(docs, packed, capacity=32).collect()}
    for r in packed.collect():
        part = np.array(out[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
