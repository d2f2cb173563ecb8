"""Line-first cleaning: rules judge each line, failing lines go, then the document is judged.

Line rules, in order (the first that fails names the reason):

- boilerplate: the line holds a phrase of site furniture or licensing that fills it, with at most
  ``FILL`` words to each of the phrase: prose may mention such a phrase;
- navigation: a short line of menu words, a line parted by separators, or a line of links;
- punctuation: a line that is mostly symbols, or a scrap: a short line without a sentence end that is
  no list item and has such neighbours, ``RUN`` lines or more on end. One or two are headings, and
  a text in which more than half of the lines are scraps is verse or a list, and keeps them.

A document fails if its base figures fail (too few words, too much repetition), if it lost more
than ``most_lost`` of its characters to line rules, or if too few words are left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lodestone.llm.common import slices

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOL = re.compile("[#*$%&|<>]")
#: Phrases of boilerplate lines, lower case, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "privacy policy",
    "released under",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "we use cookies",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "lizenziert unter",
    "nutzungsbedingungen",
    "wir verwenden cookies",
    "conditions d'utilisation",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "sous licence",
    "tous droits réservés",
    "bajo licencia",
    "política de privacidad",
    "términos de uso",
    "todos los derechos reservados",
    "utilizamos cookies",
)
#: A line with more words for each word of the phrase is prose about it.
FILL = 6
#: Words of navigation lines, lower case, in the same languages.
NAVIGATION = (
    "about", "archive", "back", "blog", "contact", "faq", "help", "home", "login", "menu", "next", "prev", "previous", "register", "search", "share", "sitemap", "skip", "top",
    "anmelden", "hilfe", "impressum", "kontakt", "startseite", "suche", "weiter", "zurück",
    "accueil", "aide", "connexion", "précédent", "recherche", "retour", "suivant",
    "anterior", "ayuda", "buscar", "contacto", "inicio", "siguiente", "volver",
)
#: What a word that is a link holds.
LINK = ("://", "www.")
END = re.compile("[.!?…:;\"'»”)\\]。！？]$")
MOST_LOST = 0.5
LEAST_WORDS = 50
#: A line with at most this many words may be judged navigation or an unfinished scrap.
SHORT = 3
#: Scraps on end from which they are no headings.
RUN = 3
#: How a list item starts.
ITEM = re.compile(r"[ \t]*([-*+•–]|[0-9]+[.)])[ \t]")
#: A line with so many words that are separators, and a quarter of all its words, is a menu.
BARS = 3
#: A line in which more than one of so many word characters is a symbol is no prose.
SYMBOL_SHARE = 5


def scrap(line: str) -> bool:
    """Whether a line is short and unfinished, and no list item: its neighbours say what it is."""
    n = len(WORD.findall(line))
    return 0 < n <= SHORT and not END.search(line.rstrip(" \t\n\v\f\r")) and not ITEM.match(line)


def line_reasons(lines: list[str]) -> list[str | None]:
    """Why each line of a text goes; None keeps it. Blank lines stay as paragraph marks."""
    scraps = [scrap(line) for line in lines]
    few = 2 * sum(scraps) <= sum(bool(WORD.search(line)) for line in lines)
    out, at = [], 0
    while at < len(lines):
        end = at + 1
        while scraps[at] and end < len(lines) and scraps[end]:
            end += 1
        out += [line_reason(line, few and scraps[at] and end - at >= RUN) for line in lines[at:end]]
        at = end
    return out


def line_reason(line: str, scraps: bool = True) -> str | None:
    """Why a line goes; None keeps it. ``scraps``: whether it goes as a scrap, if it is one."""
    words = WORD.findall(line)
    if not words:
        return None
    low = line.lower()
    if any(phrase in low and len(words) <= FILL * len(phrase.split()) for phrase in BOILERPLATE):
        return "boilerplate"
    if len(words) <= 2 * SHORT:
        bare = [w.strip("|<>«»›‹·•-–—/\\,.:").lower() for w in words]
        if all(not w or w in NAVIGATION for w in bare):
            return "navigation"
    bars = sum(not w.strip("|<>«»›‹·•") for w in words)
    if bars >= BARS and 4 * bars >= len(words):
        return "navigation"
    if 2 * sum(any(x in w for x in LINK) for w in words) > len(words):
        return "navigation"
    if scraps and scrap(line):
        return "punctuation"
    if SYMBOL_SHARE * len(SYMBOL.findall(line)) > sum(map(len, words)):
        return "punctuation"
    return None


def base(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = WORD.findall(text)
    lines = Counter(text.split("\n"))
    dups = sum(n - 1 for line, n in lines.items() if n > 1 and WORD.search(line))
    repeat, n = 0, len(words)
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(grams)
        if len(counts) < len(grams):
            last = 0  # first word not yet counted
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeat += i + 3 - max(last, i)
                    last = i + 3
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dups, repeat


def clean(docs: DataFrame, most_lost: float = MOST_LOST, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row a document: its columns doc_id and text, the base figures, what the line rules did.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, reason (null if kept), n_lines, n_lines_removed, lost (share of characters), clean_text,
    rest (a struct of the other columns, null if there are none).
    Null and empty texts have no words, so they fail the base; clean_text is never null. Repeated
    rows give a row each; an empty table gives an empty result.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", "n_lines", "n_lines_removed", "lost", "clean_text"]
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]

    def judge(text: str) -> tuple:
        figures = base(text)
        n_words, repeat = figures[0], figures[4]
        base_failed = n_words < 50 or 100 * repeat > 50 * n_words
        lines = text.split("\n")
        left = [line for line, reason in zip(lines, line_reasons(lines), strict=True) if reason is None]
        out = text if len(left) == len(lines) else "\n".join(left)
        lost = 1 - len(out) / len(text) if text else 0.0
        reason = None
        if base_failed:
            reason = "base"
        elif lost > most_lost:
            reason = "lost"
        elif out is not text and len(WORD.findall(out)) < least_words:
            reason = "short"
        return *figures, base_failed, reason is None, reason, len(lines), len(lines) - len(left), lost, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [judge(t or "") for t in b.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 12
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True)), b.column("rest")], names=[*names, "rest"])

    kind = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")).alias("rest"))
    schema = StructType([StructField(n, _parse_datatype_string(kind[t])) for n, t in zip(names, types, strict=True)] + [rows.schema["rest"]])
    return rows.mapInArrow(run, schema)


def digest(cleaned: DataFrame) -> DataFrame:
    """The columns of the quality contract, and the line figures."""
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed")


def filtered(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The kept documents of ``docs`` with their clean text; a column n_chars is brought up to date."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return cleaned.where("kept").select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])
