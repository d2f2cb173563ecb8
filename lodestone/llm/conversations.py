"""Repair of conversations: the cheapest edits that give turns the form ``(s?(ua)+)?``.

Each row is a 4x4 matrix over (cost, audit) elements: entry (p, q) is the cheapest way from state p to
state q of that form's automaton by keeping, reassigning or deleting the row, after any insertions. The
sum of two elements is the smaller one (by cost, then by audit in ASCII order), the product adds costs and
joins audits; so products of matrices are associative, and a conversation is reduced as a tree. Of two
audits of equal cost for the same rows neither starts the other (it would hold more insertions), so
joining keeps their order.

Narrow rows are range-sorted by conversation and turn. Each task reduces the stretch it has of every
conversation; stretches of conversations that go on in other tasks (two a task at most) are reduced
sixteen at a time in further rounds. Texts move once, for the digest of what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import partitions_for, plain, slices, written
from lodestone.sources.tables import remove, shared_path

#: Costs of edits, and what a kept truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
BATCH = 4096

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def _least(a: Element, b: Element) -> Element:
    return b if a is None else a if b is None else min(a, b)


def _times(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for row in x:
        line = []
        for q in STATES:
            best = None
            for k, a in enumerate(row):
                b = y[k][q]
                if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                    best = _least(best, (a[0] + b[0], a[1] + b[1]))
            line.append(best)
        out.append(tuple(line))
    return tuple(out)


def _identity() -> Matrix:
    return tuple(tuple((0, "") if p == q else None for q in STATES) for p in STATES)


def _sum(x: Matrix, y: Matrix) -> Matrix:
    return tuple(tuple(map(_least, a, b)) for a, b in zip(x, y, strict=True))


def _closed() -> Matrix:
    """Any number of insertions: powers up to the number of states have the cheapest ones."""
    one = [[None] * 4 for _ in STATES]
    for steps in (NEXT["u"], NEXT["a"]):
        for p, q in steps.items():
            one[p][q] = _least(one[p][q], (INSERT, "I"))
    one = tuple(map(tuple, one))
    total = power = _identity()
    for _ in STATES:
        power = _times(power, one)
        total = _sum(total, power)
    return total


CLOSURE = _closed()


@lru_cache(None)
def _row(kind: str) -> Matrix:
    """The matrix of a row of a kind: its initial (``-`` for none of the three), or ``x`` if it has to go; in upper case if truncated."""
    own: list[list[Element]] = [[(DELETE, "D") if p == q else None for q in STATES] for p in STATES]
    if kind != "x":
        extra = TRUNCATED if kind.isupper() else 0
        for p in STATES:
            for c in "ua":
                if p in NEXT[c]:
                    own[p][NEXT[c][p]] = _least(own[p][NEXT[c][p]], (REROLE + extra, "R"))
            steps = NEXT.get(kind.lower(), {})
            if p in steps:
                own[p][steps[p]] = _least(own[p][steps[p]], (extra, "K"))
    return _times(CLOSURE, tuple(map(tuple, own)))


@lru_cache(1 << 13)
def _short(kinds: str) -> Matrix:
    if len(kinds) == 1:
        return _row(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return _times(_short(kinds[:half]), _short(kinds[half:]))


def product(kinds: str) -> Matrix:
    """The matrix of consecutive rows, by halves; short stretches are remembered."""
    if not kinds:
        return _identity()
    if len(kinds) <= 8:
        return _short(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return _times(product(kinds[:half]), product(kinds[half:]))


def best(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    last = _times(m, CLOSURE)
    cost, audit = min(e for e in (last[0][q] for q in ACCEPTED) if e is not None)
    return cost, audit


# damage and faults, as columns


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations after damage by a checksum of their place; ``dropped`` ones stay to name their conversation.

    Columns: conv_id, turn, role, text, ``tie`` (role and digest of the text before damage: the order of
    rows of one turn), ``copy`` (1 for a repetition) and ``dropped``.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    tie = F.struct(role.alias("role"), F.xxhash64(text).alias("hash"))
    new = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = plain(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), new.alias("text"), tie.alias("tie"), (fault == 0).alias("dropped"), F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("__copies"))
    return out.select("*", F.explode("__copies").alias("copy")).drop("__copies")


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


_NARROW = "conv_id long, at long, part long, turn long, initial string, blank boolean, truncated boolean, dropped boolean, again boolean"
_PART = "conv_id long, part long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
_STATS = ("n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")


def _empty() -> dict:
    return dict(n=0, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, turns=0)


def _joined(a: dict, b: dict) -> dict:
    """The figures of two neighbouring stretches."""
    if not b["n"] or not a["n"]:
        return a if a["n"] else b
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"first": a["first"], "last": b["last"], "low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"]}
    return out


class _Stretch:
    """Consecutive rows of one conversation: figures, and a matrix of what is complete plus the kinds since."""

    def __init__(self, conv: int | None, part: int):
        self.conv, self.part, self.figures, self.kinds, self.stack = conv, part, _empty(), [], []

    def add(self, turn, initial, blank, truncated, again) -> None:
        again = again and not blank
        truncated = truncated and not blank and not again
        one = dict(n=1, blank=int(blank), duplicate=int(again), truncated=int(truncated), illegal=0, first=initial, last=initial, low=turn, high=turn, turns=int(turn is not None))
        self.figures = _joined(self.figures, one)
        kind = "x" if blank or again else initial if initial in NEXT else "-"
        self.kinds.append({"-": "O"}.get(kind, kind.upper()) if truncated else kind)
        if len(self.kinds) == BATCH:
            self.pack()

    def pack(self) -> None:
        """Equal numbers of batches join, as bits carry: the stack stays logarithmic."""
        m, count = product("".join(self.kinds)), 1
        while self.stack and self.stack[-1][1] == count:
            m, count = _times(self.stack.pop()[0], m), 2 * count
        self.stack.append((m, count))
        self.kinds = []

    def matrix(self) -> Matrix:
        m = product("".join(self.kinds))
        for x, _ in reversed(self.stack):
            m = _times(x, m)
        return m


def _line(conv, part: int, whole: bool, figures: dict, m: Matrix) -> tuple:
    flat = [e for row in m for e in row]
    return (conv, part, whole, *[figures[k] for k in _STATS], [None if e is None else e[0] for e in flat], [None if e is None else e[1] for e in flat])


def _batch(lines: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], f.type) for i, f in enumerate(schema)], schema=schema)


_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), *[(k, pa.string() if k in ("first", "last") else pa.int64()) for k in _STATS], ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce each (part, conversation) of rows sorted by their place; a part's first and last stretch may go on elsewhere."""
    held: _Stretch | None = None
    opened, lines = None, []

    def close(stretch: _Stretch, ends: bool) -> None:
        nonlocal opened
        whole = not ends and opened == stretch.part
        opened = stretch.part
        lines.append(_line(stretch.conv, stretch.part, whole, stretch.figures, stretch.matrix()))

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "part", "turn", "initial", "blank", "truncated", "again", "dropped")]
        for conv, part, turn, initial, blank, truncated, again, dropped in zip(*columns, strict=True):
            if held is None or held.part != part or held.conv != conv:
                if held is not None:
                    close(held, held.part != part)
                held = _Stretch(conv, part)
            if not dropped:
                held.add(turn, initial, blank, truncated, again)
        if len(lines) >= 2_000:
            yield _batch(lines, _ARROW)
            lines.clear()
    if held is not None:
        close(held, True)
    if lines:
        yield _batch(lines, _ARROW)


def _merge(table: pa.Table) -> pa.Table:
    """Neighbouring stretches of one conversation as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total, m = None, None
    for r in rows:
        flat = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
        own = tuple(tuple(flat[4 * p : 4 * p + 4]) for p in STATES)
        figures = {k: r[k] for k in _STATS}
        total, m = (figures, own) if total is None else (_joined(total, figures), _times(m, own))
    return pa.Table.from_batches([_batch([_line(rows[0]["conv_id"], rows[0]["part"], False, total, m)], _ARROW)])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = []
        for r in b.to_pylist():
            flat = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
            cost, audit = best(tuple(tuple(flat[4 * p : 4 * p + 4]) for p in STATES))
            gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
            lines.append((r["conv_id"], gaps, *[r[k] for k in ("blank", "duplicate", "truncated", "illegal")], cost, audit))
        yield _batch(lines, _AUDITED)


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_AUDITED = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def audits(rows: DataFrame, work: str) -> DataFrame:
    """One row a conversation: gaps, faults, cost and audit. ``rows`` are as ``damaged`` gives them; ``work`` is a new folder.

    A null id names a conversation like others. Rows come by turn, null turns first, rows of one turn by
    their ``tie`` and ``copy``. Repeated rows count as duplicates. A conversation whose rows are all dropped has zeros
    and an empty audit. An empty table gives no rows.
    """
    spark, n = rows.sparkSession, partitions_for(rows)
    bare = _bare(F.col("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    narrow = rows.select("conv_id", "turn", "tie", "copy", "dropped", F.substring("role", 1, 1).alias("initial"), (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), F.unhex(F.substring(digest, 1, 32)).alias("digest"))
    order = ["conv_id", "turn", "tie", "copy"]
    flat = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("tie", "copy")
    flat = written(flat, f"{work}/rows")
    firsts = flat.where("not dropped and not blank").groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    marked = flat.join(firsts, "at", "left").withColumn("again", ~F.coalesce("new", F.col("dropped") | F.col("blank"))).withColumn("part", F.shiftright("at", 33))
    marked = marked.select([c.split()[0] for c in _NARROW.split(", ")])
    parts = written(marked.repartition(n, "part").sortWithinPartitions("at").mapInArrow(_stretches, _PART), f"{work}/parts-0")
    whole, open_ = parts.where("whole"), parts.where("not whole")
    width, level = int(parts.agg(F.max("part")).first()[0] or 0) + 1, 0
    while width > 1:  # sixteen neighbouring parts become one, until one part is all
        level, width = level + 1, -(-width // 16)
        joined = open_.groupBy("conv_id", F.shiftright("part", 4).alias("group")).applyInArrow(_merge, _PART)
        open_ = written(joined.withColumn("part", F.shiftright("part", 4)), f"{work}/parts-{level}")
    return whole.unionByName(open_).select("conv_id", *_STATS, "costs", "audits").mapInArrow(_audited, _AUDIT)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest what is left of each conversation: its audit comes first, then its rows in order, and none is held."""
    schema = pa.schema([*_AUDITED, ("repaired_sha256", pa.string())])
    names = _AUDITED.names
    done, head, state, at, sha, some = [], None, 0, 0, None, False

    def put(role: str, text: str) -> None:
        nonlocal some
        sha.update(f"{'' if not some else chr(10)}{role}:{text}".encode())
        some = True

    def inserted() -> None:
        nonlocal state, at
        while at < len(head["audit"]) and head["audit"][at] == "I":
            role = "a" if state == 2 else "u"
            put(ROLE[role], "")
            state, at = NEXT[role][state], at + 1

    def close() -> None:
        inserted()
        done.append((*[head[c] for c in names], sha.hexdigest()))

    for b in slices(batches):
        for r in b.to_pylist():
            if r["audit"] is not None:
                if head is not None:
                    close()
                head, state, at, sha, some = r, 0, 0, hashlib.sha256(), False
                continue
            inserted()
            edit, at = head["audit"][at], at + 1
            if edit == "D":
                continue
            role = r["role"] if edit == "K" else ROLE["a" if state == 2 else "u"]
            put(role, r["text"])
            state = NEXT[role[0]][state]
        if len(done) >= 2_000:
            yield _batch(done, schema)
            done.clear()
    if head is not None:
        close()
    if done:
        yield _batch(done, schema)


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``, the digest of the repaired rows ``role:text`` joined by newlines.

    SHA-256 runs over a conversation from its first to its last byte, so its rows pass through one task,
    sorted on disk and streamed: nothing of them is held.
    """
    names = _AUDITED.names
    none = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in names if c != "conv_id"]
    order = ["conv_id", "head", "turn", "tie", "copy"]
    body = rows.where("not dropped").select("conv_id", F.lit(1).alias("head"), "turn", "tie", "copy", "role", "text", *none)
    types = dict(rows.dtypes)
    heads = found.select("conv_id", F.lit(0).alias("head"), *[F.lit(None).cast(types[c]).alias(c) for c in ("turn", "tie", "copy", "role", "text")], *[c for c in names if c != "conv_id"])
    both = heads.union(body).repartition(partitions_for(rows), "conv_id").sortWithinPartitions(*order)
    return both.select("role", "text", *names).mapInArrow(_hashed, f"{_AUDIT}, repaired_sha256 string")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Damage conversations and report their faults and cheapest repair, one row a conversation.

    Null roles and texts are one space; rows of one turn come by role, then by a hash of the text, as before damage.
    """
    spark = conversations.sparkSession
    rows, work = damaged(conversations), shared_path(spark, "conversations")
    found = written(audits(rows, work), f"{work}/audits")
    out = written(repair(rows, found), f"{work}/repaired")
    for name in ("rows", "audits", *[f"parts-{i}" for i in range(20)]):
        remove(spark, f"{work}/{name}")
    return out
