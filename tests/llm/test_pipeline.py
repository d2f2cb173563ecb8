import itertools
import re
from collections import Counter

import corpus_pipeline
from lodestone.llm import quality, substring
from tests.llm import test_near

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def plain_line_fails(line):
    """The line rules once more, in other words."""
    words = re.split(f"[{SPACE}]+", line.strip(SPACE))
    if words == [""]:
        return False
    for phrase in re.findall("|".join(map(re.escape, quality.BOILERPLATE)), line.lower()):
        if len(words) <= 6 * (phrase.count(" ") + 1):
            return True
    menu = re.compile("[|<>«»›‹·•\\-–—/\\\\,.:]*(" + "|".join(quality.NAVIGATION) + ")?[|<>«»›‹·•\\-–—/\\\\,.:]*")
    if len(words) <= 6 and all(menu.fullmatch(w.lower()) for w in words):
        return True
    bars = [w for w in words if re.fullmatch("[|<>«»›‹·•]+", w)]
    if len(bars) > 2 and len(bars) / len(words) >= 0.25:
        return True
    if len([w for w in words if re.search(r"://|www\.", w)]) > len(words) / 2:
        return True
    return sum(line.count(c) for c in "#*$%&|<>") > sum(map(len, words)) / 5


def plain_scraps(lines):
    """For each line whether it is one of three or more short unfinished lines on end, in a text that isn't mostly such lines."""
    short = []
    for line in lines:
        bare = line.strip(SPACE)
        marked = re.match(r"\s*([-*+•–]|\d+[.)])[ \t]", line)
        short.append(bool(bare) and len(re.split(f"[{SPACE}]+", bare)) < 4 and bare[-1] not in ".!?…:;\"'»”)]。！？" and not marked)
    if sum(short) > sum(bool(x.strip(SPACE)) for x in lines) / 2:
        return [False] * len(lines)
    out = []
    for is_short, run in itertools.groupby(short):
        n = len(list(run))
        out += [is_short and n > 2] * n
    return out


def plain_quality(text):
    """What is left of a text that is kept, else None."""
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeat = {j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 2 * len(repeat) > len(words):
        return None
    lines = text.split("\n")
    left = [x for x, scrap in zip(lines, plain_scraps(lines), strict=True) if not scrap and not plain_line_fails(x)]
    out = "\n".join(left)
    if 2 * len(out) < len(text) or len(left) < text.count("\n") + 1 and len([w for w in re.split(f"[{SPACE}]+", out) if w]) < 50:
        return None
    return out


def plain_chunks(raw):
    """(start, end) of content-defined chunks, by a hash that rolls byte by byte."""
    gear, h, at, out = substring.GEAR.tolist(), 0, 0, []
    marks = []
    for i, c in enumerate(raw):
        h = (h << 1) + gear[c] - (gear[raw[i - 32]] << 32 if i >= 32 else 0) & (1 << 64) - 1
        if i >= 31 and h < (1 << 64) // substring.BEYOND:
            marks.append(i + 1)

    def whole(c):
        while c < len(raw) and raw[c] & 0xC0 == 0x80:
            c += 1
        return c

    for c in [*marks, len(raw)]:
        while c - at > substring.MOST:
            out.append((at, whole(at + substring.MOST)))
            at = out[-1][1]
        if c - at >= substring.LEAST or c == len(raw) and c > at:
            out.append((at, whole(c)))
            at = out[-1][1]
    return out


def plain_run(rows, items):
    """The first four stages in plain Python over (doc_id, text)."""
    kept = [(k, left) for k, t in rows if (left := plain_quality(t)) is not None]
    comp = test_near.components([test_near.grams(t) for _, t in kept])
    least = {}
    for (k, _), c in zip(kept, comp, strict=True):
        least[c] = min(k, least.get(c, k))
    kept = [(k, t) for (k, t), c in zip(kept, comp, strict=True) if least[c] == k]
    owner, texts = {}, []
    for k, t in sorted(kept):
        for a, z in plain_chunks(t.encode()):
            owner.setdefault(t.encode()[a:z], (k, a))
    for k, t in kept:
        raw, gone, runs = t.encode(), set(), []
        for a, z in plain_chunks(raw):
            if owner[raw[a:z]] != (k, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
        for a, z in runs:
            if z - a >= substring.LEAST_RUN:
                gone.update(range(a, z))
        left = bytes(x for i, x in enumerate(raw) if i not in gone).decode()
        if left:
            texts.append((k, left))
    split = lambda t: re.findall(r"(?:[0-9a-zA-Z]|[^\x00-\x7f])+", t)
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    windows = set()
    for _, t in items:
        w = [*map(lower, split(t or ""))]
        windows.update(tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9) if w else 0))
    sizes = {len(w) for w in windows}
    clean = []
    for k, t in texts:
        w = [*map(lower, split(t))]
        if not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1)):
            clean.append((k, t))
    return clean


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == docs.columns and dict(state.dtypes) == dict(docs.dtypes), name
        state = state.checkpoint()
        assert state.where("n_chars <> length(text)").count() == 0
    want = plain_run([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    got = sorted((r.doc_id, r.text) for r in state.collect())
    assert got == sorted(want) and 50 < len(got) < 200
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {k for k, _ in got}


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = "\n".join(" ".join(f"w{i}x{j}" for i in range(12)) + "." for j in range(8))
    rows = [(None, None, "s", None), (1, "", "s", 0), (2, prose, "s", 1), (2, prose, "s", 1), (3, prose, None, 1), (None, prose[::-1] + ".", "t", 9)]
    for name, table in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(table, "doc_id long, text string, h string, kept long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == ([(2, prose), (None, prose[::-1] + ".")] if table else []), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(table) // 6
