"""Operator 8: toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, look-alike letters of other scripts to Latin ones, full-width forms to plain ones, digits that stand
for letters where they stand by a letter, and @ and $ between letters. A lexicon entry is the beginning of a word, of
STEM_LETTERS, or a whole shorter word; its weight is the log ratio of its share of toxic to that of other labelled
documents. Entries are learned, as are exception phrases: pairs of neighbouring words around a hit that only other
documents hold. A hit inside an exception phrase does not count.

Score: a logistic function, fitted to the labelled rows, of the logarithm of the sum of weights and of the same sum
normalised by the text's length in words. Texts without a hit get the score of no hit, as do null and empty ones.

Learning takes a sample of the labelled rows that is bounded by SAMPLE_TOXIC and SAMPLE_OTHER (by a hash of the id), and all
entries and phrases that it supports. Without toxic or other rows to learn from, every score is 0. Texts are scored whole.
Repeated rows are scored each for itself; of documents that repeat an id the least text teaches; ids that `labels` repeats
count once, as toxic if any row says so; ids it lacks or nulls teach nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out, table

SAMPLE_TOXIC, SAMPLE_OTHER = 4000, 8000
STEM_LETTERS, LEAST_SHARE, LEAST_DOCUMENTS, LEAST_LOG_ODDS = (4, 8), 0.01, 3, 3.5
EXCEPTION_DOCUMENTS, PREDICT_AT = 3, 0.7

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ɡ": "g", "ſ": "s", "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
FOLDS, LETTERS_OF = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + k): chr(0x61 + k) for k in range(26)}), str.maketrans(DIGITS)
SYMBOLS = {"@": "a", "$": "s"}

WORDS, LETTER = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]")
COUNTED = pa.schema([("entry", pa.string()), ("n", pa.int64())])
FEATURES = pa.schema([("toxic", pa.int32()), ("total", pa.float64()), ("words", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


#: A run of letters and digits that begins with one kind and has the other.
MIXED = re.compile(r"\b(?:[^\W\d_]++\d|\d++[^\W\d_])\w*+")


def fold(text: str | None) -> str:
    folded = MIXED.sub(lambda m: m[0].translate(LETTERS_OF), (text or "").lower().translate(FOLDS))
    if "@" in folded or "$" in folded:
        folded = re.sub(r"(?<=[^\W\d_])[@$](?=[^\W\d_])", lambda m: SYMBOLS[m[0]], folded)
    return folded


def stems(folded: str) -> set[str]:
    """Beginnings of words, and words too short for one with a blank after them."""
    low, high = STEM_LETTERS
    return {w[:k] if len(w) >= low else w + " " for w in set(WORDS.findall(folded)) for k in range(low, max(low, min(len(w), high)) + 1)}


def count_stems(only: frozenset | None):
    """Texts to (stem, documents), summed within the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                own = stems(fold(text.as_py()))
                found.update(own if only is None else own & only)
        yield batch(COUNTED, entry=list(found), n=list(found.values()))

    return run


class Lexicon:
    """Entries with weights, exception phrases and the logistic function."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[tuple[str, str]] = frozenset(), model: tuple = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.model, self.automaton = weights, exceptions, model, None

    def __getstate__(self):
        return self.weights, self.exceptions, self.model

    def __setstate__(self, state):
        self.weights, self.exceptions, self.model = state
        self.automaton = None

    def matcher(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                stem = entry.rstrip(" ")
                self.automaton.add_word(stem, (len(stem), weight, stem != entry))
            self.automaton.make_automaton()
        return self.automaton

    def hits(self, folded: str) -> Iterator[tuple[str, str, str, float]]:
        """The word before, the word hit, the word after, and the weight; a word counts once, with its largest weight."""
        if not self.weights:
            return
        best: dict[int, float] = {}
        for end, (n, weight, whole) in self.matcher().iter(folded):
            start = end - n + 1
            if (start == 0 or not LETTER.match(folded, start - 1)) and not (whole and LETTER.match(folded, end + 1)):
                best[start] = max(weight, best.get(start, weight))
        if not best:
            return
        previous, before, start = "", "", -1
        for m in WORDS.finditer(folded):  # a hit is known when the word after it is
            if start in best:
                yield previous, before, m[0], best[start]
            previous, before, start = before, m[0], m.start()
        if start in best:
            yield previous, before, "", best[start]

    def total(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of hits outside exception phrases, and the text's words."""
        folded = fold(text)
        total = sum(w for before, word, after, w in self.hits(folded) if (before, word) not in self.exceptions and (word, after) not in self.exceptions)
        return total, len(folded.split())

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        total, words = self.total(text)
        z = self.model[0] + sum(m * x for m, x in zip(self.model[1:], features(total, words)))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / max(words, 10))


def choose(toxic: dict[str, int], other: dict[str, int], n_toxic: int, n_other: int) -> dict[str, float]:
    """Beginnings of words that tell toxic documents, none of which begins another."""
    odds = {s: math.log((t + 0.5) / (n_toxic + 1)) - math.log((other.get(s, 0) + 0.5) / (n_other + 1)) for s, t in toxic.items()}
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # beginnings of what is chosen
    for stem in sorted(odds, key=lambda s: (-odds[s], len(s), s)):
        if odds[stem] < LEAST_LOG_ODDS:
            break
        beginnings = {stem[:k] for k in range(1, len(stem) + 1)}
        if stem not in begun and not any(b in chosen for b in beginnings):
            chosen[stem] = odds[stem]
            begun |= beginnings
    return chosen


def fit(rows: list[tuple[int, float, int]], ridge: float = 1e-2, rounds: int = 30) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x = np.array([(1.0, *features(total, words)) for _, total, words in rows])
    y, beta = np.array([t for t, _, _ in rows], dtype=float), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """From the documents with a label that are not held out."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter(~held_out(F.col("l_id")))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon({})
    share = F.when(F.col("toxic") != 0, F.lit(min(1.0, SAMPLE_TOXIC / sizes[1]))).otherwise(F.lit(min(1.0, SAMPLE_OTHER / sizes[0])))
    ids = marked.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < share * (1 << 20)).select("l_id", (F.col("toxic") != 0).cast("int").alias("toxic"))
    # the ids' number is bounded by the sample's, so they go to the documents and no text is shuffled
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").persist()
    try:
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not n.get(1) or not n.get(0):
            return Lexicon({})
        counted = lambda toxic, only: sample.filter(F.col("toxic") == toxic).select("text").mapInArrow(count_stems(only), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
        least = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * n[1]))
        toxic = {r["entry"]: r["n"] for r in counted(1, None).filter(F.col("n") >= least).collect()}
        other = {r["entry"]: r["n"] for r in counted(0, frozenset(toxic)).collect()}
        weights = choose(toxic, other, n[1], n[0])
        phrases = sample.mapInArrow(count_phrases(Lexicon(weights)), "toxic int, before string, word string, n long").groupBy("before", "word").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"))
        phrases = phrases.filter((F.col("clean") >= EXCEPTION_DOCUMENTS) & F.col("bad").isNull())
        lexicon = Lexicon(weights, frozenset((r["before"], r["word"]) for r in phrases.collect()))
        rows = sample.mapInArrow(measure(lexicon), "toxic int, total double, words long").collect()  # SAMPLE_TOXIC + SAMPLE_OTHER rows, about
    finally:
        sample.unpersist()
    lexicon.model = fit(sorted(tuple(r) for r in rows))
    return lexicon


def count_phrases(lexicon: Lexicon):
    schema = pa.schema([("toxic", pa.int32()), ("before", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        found: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                own = set()
                for before, word, after, _ in lexicon.hits(fold(text.as_py())):
                    own |= {(before, word), (word, after)}
                found.update((toxic, *pair) for pair in own if all(pair))
        rows = list(found)
        yield batch(schema, toxic=[r[0] for r in rows], before=[r[1] for r in rows], word=[r[2] for r in rows], n=list(found.values()))

    return run


def measure(lexicon: Lexicon):
    def run(batches):
        for b in batches:
            found = [lexicon.total(text.as_py()) for text in b.column(0)]
            yield batch(FEATURES, toxic=b.column(1), total=[t for t, _ in found], words=[w for _, w in found])

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [lexicon.score(text.as_py()) for text in b.column(2)]
            yield batch(SCORED, doc_id=b.column(0), held_out=b.column(1), score=scores, predicted=[int(s >= PREDICT_AT) for s in scores])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
