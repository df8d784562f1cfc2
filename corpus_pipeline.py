"""A training corpus from `documents`: language ID, near-dedup, exact substring dedup, mixing, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of `documents`.

1. language_id: documents without a letter, or whose text resembles no learned language, go.
2. simhash_dedup: of each group linked by a similarity of 0.8 or more (5-word shingles) the smallest id stays.
3. substring_dedup: bytes covered by a 50-byte string of a document with a smaller id are cut out; a document left without
   a word goes.
4. mixing: sources are weighed; a row for each pass over a document, the text cut where the mix ends.
5. packing: pieces in windows of 4096 tokens at most. Passes of a document are packed each for itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language_id, mixing, near_copies, packing, substrings
from quarry.llm.common import materialised, table


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, again the length of the text."""
    return docs.withColumns({"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)}) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.reject_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(substrings.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned profiles, fingerprints and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
