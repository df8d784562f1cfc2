"""Queries of this subpackage for __spark_entry__.py: name -> callable, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import embeddings, html_text, language_id, mixing, packing, quality, simhash, substrings, toxicity, warc_fixity
from .common import table


def op5(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict:
    return {
        "op1_rank_order_language": language_id.op1,
        "op2_weighted_fair_mix": mixing.op2,
        "op3_merkle_fixity": warc_fixity.op3,
        "op4_sparse_suffix_array": substrings.op4,
        "op5_minimum_bin_slack": op5,
        "op6_text_tag_ratio": html_text.op6,
        "op7_line_frequency": quality.op7,
        "op8_weighted_lexicon": toxicity.op8,
        "op9_covering_simhash": simhash.op9,
        "op10_pca_tiles": embeddings.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_weighted_fair_mix": mixing.OP2_SQL,
        "op3_merkle_fixity": warc_fixity.OP3_SQL,
        "op7_line_frequency": quality.OP7_SQL,
        "op10_pca_tiles": embeddings.OP10_SQL,
    }
