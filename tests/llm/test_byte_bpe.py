"""Byte-level BPE in DuckDB against the tiktoken library."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import byte_bpe, queries
from lodestone.llm.byte_bpe import Vocabulary, decode, digest, encode

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Vocabulary.of().ranks, special_tokens={})


def same(texts):
    own, enc = Vocabulary.of(), library()
    ids, at = own.encode_column(pa.array(texts, pa.string()))
    back = list(own.decode_rows(ids, at))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.encode_ordinary(t or ""), repr(t[:80])
        assert back[i] == (t or "").encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x1c\x85\xa0'screvlmdtSR129!?.-éÉß×÷…–中ªŻ🙂", max_size=40), min_size=1, max_size=20))
def test_any_text(texts):
    same([None, "", *texts])


def test_all_characters():
    rng = random.Random(3)
    same(["a" + chr(c) + " " + chr(c) + "1" + chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x500 or rng.random() < 0.01)])


def test_structured_and_long_words():
    word = [0]
    while len(word) < 1 << 12:
        word += [1 - x for x in word]
    structured = ["".join(pair[x] for x in word[: 1 << k]) for k in range(8, 13) for pair in ("ab", "ba")]
    rng = random.Random(4)
    same([*structured, "a" * 60_000, "ab" * 20_000, *("".join(rng.choices("abcdefgXYZ", k=n)) for n in (200, 255, 256, 257, 700)), " " * 5_000 + "x", "é" * 3_000, "the cat. " * 30_000])


def test_words_are_forgotten_and_rounds_go_on(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST", 3)
    monkeypatch.setattr(byte_bpe, "ROWS", 20)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 7)
    same(["incomprehensibilities and antidisestablishmentarianism", "unquestionably " * 5])
    same(["incomprehensibilities again, unquestionably"])


def test_odd_rows(spark):
    rows = [(1, "Hello world", 5), (None, "Hello world", 6), (1, "Hello world", 5), (2, None, 1), (3, "", 1), (4, "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = digest(decode(encode(df))).collect()
    enc = library()
    want = sorted(((d, len(i := enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert digest(decode(encode(df.limit(0)))).count() == 0
    assert [r.decoded for r in decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()] == [b"", b""]
    with pytest.raises(Exception, match="vocabulary"):
        decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    enc = library()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_byte_bpe(spark, sf).collect()}
    assert got == want
