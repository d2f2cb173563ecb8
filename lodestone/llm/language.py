"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile lists the most frequent character n-grams by falling frequency. A document gets the
language whose profile is nearest by out-of-place distance: for each of the document's n-grams
the difference of its ranks in the two profiles, or the greatest rank where the language lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import plain, slices

SIZES = (1, 2, 3)
#: N-grams of a profile.
TOP = 300
#: About how many labelled documents of each language are learned from, chosen by a hash of their id.
TRAIN_DOCS = 4000
#: Documents whose crc32(doc_id) has this remainder by 4 are held out.
HELD_OUT = 2
EDGE = 1  # stands for what is between words; letters are far above

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of a text: code points packed by 21 bits, words parted by EDGE; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(is_letter, points, EDGE)
    c = np.concatenate([[EDGE], c, [EDGE]])
    c = c[np.concatenate([[True], (c[1:] != EDGE) | (c[:-1] != EDGE)])]
    parts, out = [c[c != EDGE]], c
    for n in SIZES[1:]:
        out = out[:-1] << 21 | c[n - 1 :]
        parts.append(out)
    return np.unique(np.concatenate(parts), return_counts=True)


def profile(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams by falling count; of equals the smaller number first."""
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:top]


class Model:
    """Profiles by language."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.top, self.names, self.profiles = top, sorted(profiles), []
        for name in self.names:
            order = np.argsort(profiles[name])
            self.profiles.append((profiles[name][order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 is the language's own profile, 0 has nothing in common; ('und', 0) without letters."""
        own = profile(*ngrams(text or ""), self.top)
        if not len(own) or not self.names:
            return "und", 0.0
        rank, best = np.arange(len(own)), []
        for grams, ranks in self.profiles:
            at = np.searchsorted(grams, own)
            at[at == len(grams)] = 0
            best.append(int(np.where(grams[at] == own, np.abs(ranks[at] - rank), self.top).sum()))
        k = int(np.argmin(best))
        return self.names[k], 1 - best[k] / (self.top * len(own))


def held_out() -> F.Column:
    """Whether a document is held out; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(labelled: DataFrame, top: int = TOP, train_docs: int = TRAIN_DOCS) -> Model:
    """Profiles from (doc_id, text, lang) rows; rows without text or language teach nothing.

    N-grams are counted in all chosen rows, about ``train_docs`` a language (all, where there are no
    more), rows without an id like any other; only the profiles, ``top`` n-grams a language, go to the driver.
    """
    rows = plain(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null")
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = [k for k, n in many.items() if n <= train_docs]
    share = F.lit(1.0)
    for lang, n in many.items():
        if lang not in rare:
            share = F.when(F.col("lang") == lang, F.lit(train_docs / n)).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held: dict[str, list] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                held.setdefault(lang, []).append(ngrams(text))
            for lang, parts in held.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    counted = rows.where(chance < share).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= top)
    found: dict[str, list] = {}
    for r in first.orderBy("lang", "k").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return Model({k: np.array(g, np.int64) for k, g in found.items()}, top)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row's whole text; ('und', 0) for null texts and those without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TOP numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame, top: int = TOP, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows that aren't held out.

    Repeated rows each count; other columns are ignored; an empty table gives an empty result, and
    a table without labels predicts 'und' only.
    """
    model = fit(docs.where(~held_out()), top, train_docs)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
