"""Operator 1: language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A text is lower-cased; runs of other characters than letters become one blank, also before the first and after the
last word. Its n-grams of 1 to 3 characters without a blank inside are ranked by count (ties by code point); the
first PROFILE_SIZE make its profile. A language's profile is that of its labelled texts together. The prediction is
the language with the least out-of-place distance, the sum over the text's profile of the differences of ranks, with
PROFILE_SIZE for an n-gram that the language's profile lacks; equal distances go to the smaller name.

Profiles are learned from a sample of the labelled rows that is bounded by SAMPLE_PER_LANGUAGE (by a hash of the id). Every
label has a profile, so the model is PROFILE_SIZE n-grams for each. Texts are predicted whole.

A null text or one without a letter gives `und` and score 0, as does everything if there is no labelled row. Repeated
rows are predicted each for itself.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, held_out, table

PROFILE_SIZE, SAMPLE_PER_LANGUAGE = 300, 3000
UNKNOWN = "und"
#: Characters looked at together; longer texts are counted in parts.
PART = 1 << 19
#: Below this score the pipeline drops a document.
REJECT_BELOW = 0.1

PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once for a worker process."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and how often each occurs (or the sum of its counts)."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(codes))) if counts is None else np.add.reduceat(counts, starts) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], sizes


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams (21 bits a character) and their counts."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    chars = np.where(letters()[chars], chars, 32).astype(np.int64)
    chars = np.concatenate(([32], chars, [32]))
    chars = chars[np.concatenate(([True], (chars[1:] != 32) | (chars[:-1] != 32)))]
    found = []
    for at in range(0, max(1, len(chars) - 2), PART):
        c = chars[at : at + PART + 2]
        own = min(PART, len(c)) if at + PART < len(chars) - 2 else len(c)  # where n-grams of this part begin
        one, two, three = c[:own], c[: own + 1], c[: own + 2]
        codes = [one[one != 32]]
        codes.append((two[:-1] << 21 | two[1:]) + (1 << 42))
        inner = three[1:-1] != 32
        codes.append(((three[:-2] << 42 | three[1:-1] << 21 | three[2:])[inner]) | np.int64(-(1 << 63)))
        found.append(summed(np.concatenate(codes)))
    if len(found) == 1:
        return found[0]
    return summed(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE_SIZE) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:most]]


def count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within the task."""
    held: dict[str, list] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            parts = held.setdefault(lang, [])
            parts.append(grams(text.as_py()))
            if len(parts) > 256:
                held[lang] = [summed(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]))]
    for lang, parts in held.items():
        codes, counts = summed(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]))
        yield batch(COUNTS, lang=pa.array([lang] * len(codes), pa.string()), gram=codes, n=counts)


class Profiles:
    """The learned profiles: language names and, for each n-gram of any of them, the languages that have it and its rank in each."""

    def __init__(self, by_language: dict[str, list[int]], most: int = PROFILE_SIZE):
        self.names, self.most = sorted(by_language), most
        own = [np.array(by_language[name], dtype=np.int64) for name in self.names]
        codes, langs, ranks = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (own, [np.full(len(p), k) for k, p in enumerate(own)], [np.arange(len(p)) for p in own]))
        order = np.argsort(codes, kind="stable")
        self.codes, starts = np.unique(codes[order], return_index=True)
        self.starts, self.langs, self.ranks = np.append(starts, len(codes)), langs[order], ranks[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), self.most)
        if not len(own) or not len(self.codes):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == own)  # also the n-gram's rank in the text
        first, n = self.starts[at[place]], self.starts[at[place] + 1] - self.starts[at[place]]
        every = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(place) else place
        gained = self.most - np.abs(self.ranks[every] - np.repeat(place, n))
        off = self.most * len(own) - np.bincount(self.langs[every], weights=gained, minlength=len(self.names))
        best = int(off.argmin())
        return self.names[best], float(1 - off[best] / (self.most * len(own)))


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = PROFILE_SIZE) -> Profiles:
    """Profiles of the rows with a label that are not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().collect()  # a row for each label
    if not sizes:
        return Profiles({}, most)
    share = F.map_from_arrays(F.lit([r["lang"] for r in sizes]), F.lit([min(1.0, per_language / r["count"]) for r in sizes]))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 20))
    counts = sample.select("lang", "text").mapInArrow(count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).filter(F.col("place") <= most).orderBy("lang", "place").collect():  # PROFILE_SIZE rows a label
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, most)


def predict_batches(profiles: Profiles):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(text.as_py()) for text in b.column(2)]
            yield batch(PREDICTED, doc_id=b.column(0), held_out=b.column(1), lang_pred=[x for x, _ in found], score=[s for _, s in found])

    return run


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    profiles = profiles or learn(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict_batches(profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def reject_unidentified(docs: DataFrame, below: float = REJECT_BELOW) -> DataFrame:
    """The documents, with their own columns, whose language is told with a score of `below` or more."""
    profiles = learn(docs)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([profiles.predict(x.as_py())[1] >= below for x in b.column(at)], pa.bool_()))

    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names may hold dots
    return numbered.mapInArrow(run, numbered.schema).toDF(*names)


def op1(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
