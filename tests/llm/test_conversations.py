"""Conversation repair against enumeration, a plain left-to-right search and SQL."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import conversations as C
from lodestone.llm import queries

FORM = re.compile("(s?(ua)+)?")


def enumerated(kinds):
    """Cheapest (cost, audit) of a few rows by trying all edits; kinds as the operator has them."""
    found = []
    for inserts in itertools.product(range(4), repeat=len(kinds) + 1):
        if sum(inserts) > 4:
            continue
        for edits in itertools.product("DKR", repeat=len(kinds)):
            if any(k == "x" and e != "D" for k, e in zip(kinds, edits, strict=True)):
                continue
            cost = 5 * sum(inserts) + sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and k.isupper()) for k, e in zip(kinds, edits, strict=True))
            turns, audit = [], ""
            for n, k, e in itertools.zip_longest(inserts, kinds, edits):
                turns += ["ua"] * n + ([] if e in (None, "D") else [k.lower() if e == "K" else "ua"])
                audit += "I" * n + (e or "")
            if any(FORM.fullmatch("".join(t)) for t in itertools.product(*turns)):
                found.append((cost, audit))
    return min(found)


def test_against_all_edits():
    for n in range(3):
        for kinds in itertools.product("suaxSUA-O", repeat=n):
            assert C.best(C.product("".join(kinds))) == enumerated("".join(kinds)), kinds
    rng = random.Random(1)
    for n in (3, 3, 3, 3, 3, 3, 4, 4, 4):
        kinds = "".join(rng.choices("suaxSUA-O", k=n))
        assert C.best(C.product(kinds)) == enumerated(kinds), kinds


def searched(kinds):
    """Left to right: for each state the cheapest way to it."""
    def close(at):
        at = dict(at)
        for _ in range(3):
            for c in "ua":
                for p, q in C.NEXT[c].items():
                    if p in at:
                        new = (at[p][0] + 5, at[p][1] + "I")
                        at[q] = min(at.get(q, new), new)
        return at

    at = {0: (0, "")}
    for k in kinds:
        at, new = close(at), defaultdict(list)
        for p, (cost, audit) in at.items():
            new[p].append((cost + 2, audit + "D"))
            for c in "sua":
                if k != "x" and p in C.NEXT[c] and (c == k.lower() or c != "s"):
                    new[C.NEXT[c][p]].append((cost + (c != k.lower()) + 5 * k.isupper(), audit + ("K" if c == k.lower() else "R")))
        at = {p: min(x) for p, x in new.items()}
    at = close(at)
    return min(at[q] for q in C.ACCEPTED if q in at)


def test_products_are_associative():
    rng = random.Random(2)
    for n in (5, 9, 17, 40, 300):
        kinds = "".join(rng.choices("suaxSUA-O", k=n))
        assert C.best(C.product(kinds)) == searched(kinds)
        cut = rng.randrange(n)
        assert C.best(C._times(C.product(kinds[:cut]), C.product(kinds[cut:]))) == searched(kinds)


def plain(rows):
    """Everything for rows (conv_id, turn, role, text) in Python."""
    by, out = defaultdict(list), []
    for conv, turn, role, text in rows:
        own = by[conv]
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            new = ("user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)
            own += [(turn is not None, turn or 0, role, *new)] * (2 if f == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: r[:3])
        seen, kinds, counts = set(), "", [0, 0, 0]
        for _, _, _, role, text in own:
            bare = text.rstrip(C.SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            k = role[:1] if role[:1] in ("s", "u", "a") else "-"
            kinds += "x" if fault in (0, 1) else {"-": "O"}.get(k, k.upper()) if fault == 2 else k
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = [r[1] for r in own if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = searched(kinds)
        state, left, todo = 0, [], iter(own)
        for e in audit:
            row = next(todo) if e != "I" else None
            if e == "D":
                continue
            role = row[3] if e == "K" else "assistant" if state == 2 else "user"
            left.append(f"{role}:{row[4] if row else ''}")
            state = C.NEXT[role[0]][state]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, part int, head string"


def rows_of(seed, n_convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(rng.choice([1, 2, 3, 8, longest])):
            rows.append((c, t + (t > 5), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice([f"Text {t}.", f"Text {t}", "Same!", " \n", f"é {t}?\x0b"])))
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, C.damage_and_repair(df).select(*NAMES).collect()), key=str)


def test_whole_operator(spark):
    rows = rows_of(3, 60, 30)
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (900, None, "user", "A."), (900, None, None, None), (900, 4, "assistant", "B."), (901, 5, "user", "x" * 300_000)]
    rows += [(902, 3, "user", "Tie."), (902, 3, "assistant", "Tie."), (902, 3, "user", "Tie.")]
    assert result(spark, rows) == plain(rows)


def test_long_conversation_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "BATCH", 16)
    rows = rows_of(4, 10, 20) + [(r[0] + 500, *r[1:]) for r in rows_of(5, 10, 20)]
    rng = random.Random(6)
    rows += [(77, t, rng.choice(["user", "assistant"]), f"{t % 700}" + rng.choice([".", "", "!"])) for t in range(4_000)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert result(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_merkle_manifest"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want
