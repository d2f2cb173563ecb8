import re
from collections import Counter

from lodestone.llm.quality import clean, digest, filtered, line_reason

PROSE = " ".join(f"word{i} other{i * 7 % 11}" for i in range(40)) + "."
DOCS = [
    (1, PROSE + "\nHome | About | Contact\nReleased under the MIT License.\n\n" + PROSE.upper()),
    (2, None),
    (3, ""),
    (4, "short text"),
    (5, "a b c " * 40),
    (6, ("All rights reserved " * 12 + "\n") * 9 + PROSE),
    (7, "x\n" * 60),
    (8, PROSE),
    (8, PROSE),
    (None, PROSE + " \t\x0b\r" + "|" * 3),
    (9, "long " * 30000 + PROSE),
    (10, "w1 w2 w3 w4 w1 w2 w3 w4 " + PROSE),
]


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(k, t, "s", len(t or "")) for k, t in rows], "doc_id long, text string, reason string, n_chars long")


def test_base_figures(spark):
    got = digest(clean(frame(spark))).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((k, *brute(t)) for k, t in DOCS), key=str)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_verdicts(spark):
    rows = {r.doc_id: r for r in clean(frame(spark)).collect()}
    assert rows[1].kept and rows[1].n_lines_removed == 2 and rows[1].clean_text == PROSE + "\n\n" + PROSE.upper()
    assert rows[8].kept and rows[8].clean_text == PROSE and rows[None].kept
    assert {k: rows[k].reason for k in (2, 3, 4, 5, 6, 9)} == {2: "base", 3: "base", 4: "base", 5: "base", 6: "base", 9: "base"}
    notice = "\n".join(f"Word{i} of{i} cookie policy in{i} its{i} ways{i}." for i in range(60))
    assert clean(frame(spark, [(1, notice + "\n" + PROSE)])).first().reason == "lost"
    essay = " ".join(f"Word{i} on{i} privacy policy and{i} in{i} chapter{i}." for i in range(60))
    assert clean(frame(spark, [(1, essay)])).first().kept  # one long line of prose that mentions phrases


def test_lines():
    assert line_reason("Home » Blog » Archive") == "navigation"
    assert line_reason("one | two three | four, | five |") == "navigation" and line_reason("a | b and c | d goes on and on and on") is None
    assert line_reason("We use cookies to do things, and more things.") == "boilerplate"
    assert line_reason("Alle Rechte vorbehalten.") == line_reason("Tous droits réservés, 2020.") == line_reason("Todos los derechos reservados") == "boilerplate"
    assert line_reason("Startseite | Kontakt") == line_reason("« Précédent · Suivant »") == line_reason("Inicio › Ayuda") == "navigation"
    assert line_reason("https://a.example/x www.b.example and") == "navigation" and line_reason("See https://a.example/x for the whole of it.") is None
    assert line_reason("stray words") == "punctuation" and line_reason("Ered*** reed*** of###") == "punctuation"
    assert line_reason("") is None and line_reason("Ti.") is None and line_reason("Home is where the heart is, they say") is None


def test_filtered(spark):
    docs = frame(spark)
    kept = filtered(docs, clean(docs))
    assert kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) and r.reason == "s" for r in kept.collect())
    assert clean(docs.limit(0)).count() == 0
    assert clean(docs.select("doc_id", "text")).count() == len(DOCS)


POEM = "\n".join(f"a line {i}" for i in range(40))
MENU = "Latest news\nTop stories\nOur team\nJobs here"
CLEAN = [
    "The library is released under the MIT licence, and everyone may copy, change and share it as they like.",
    "- 12 eggs",
    "Chapter One",
    "3. sift flour",
]


def test_clean_lines_stay(spark):
    for line in CLEAN:
        text = PROSE + "\n" + line + "\n" + PROSE.upper()
        row = clean(frame(spark, [(1, text)])).first()
        assert row.kept and row.clean_text == text, line
    recipe = PROSE + "\n" + "\n".join(f"- {i} eggs" for i in range(60))
    assert clean(frame(spark, [(1, recipe)])).first().clean_text == recipe
    assert clean(frame(spark, [(1, POEM)])).first().clean_text == POEM


def test_runs_of_scraps_go(spark):
    row = clean(frame(spark, [(1, "\n".join([PROSE, *[f"This is sentence {i} of a text." for i in range(9)], MENU, "", "Part Two", PROSE.upper()]))])).first()
    assert row.kept and row.n_lines_removed == 4 and "Part Two" in row.clean_text and "Our team" not in row.clean_text


def test_sql_on_odd_texts(spark):
    import duckdb
    from lodestone.llm.sql import QUALITY

    rows = [*DOCS, *[(20 + i, PROSE + "\n" + x) for i, x in enumerate([*CLEAN, POEM, MENU, MENU + "\n\n" + MENU, "• a\n\tb c\n1) d\ne f\ng\nh", "All rights reserved and so on and on and on and on and on and on and on and on."])], (40, POEM), (41, MENU + "\n" + PROSE + "\n- x\n" + MENU)]
    con = duckdb.connect()
    con.register("given", spark.createDataFrame(rows, "doc_id long, text string").toPandas())
    con.execute("create view documents as select cast(doc_id as bigint) doc_id, text from given")
    found = con.execute(QUALITY)
    names = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in digest(clean(frame(spark, rows))).select(*names).collect())
