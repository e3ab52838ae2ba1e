"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers

from brindle.llm import (
    byte_bpe,
    chat_parts,
    content_store,
    host_boilerplate,
    karmarkar_karp,
    masked_lm,
    quality_rules,
    simhash_dedup,
    url_rules,
    winnowing,
)
from brindle.llm.common import table


def op1_masked_pseudo_likelihood(spark, sf_dir):
    return masked_lm.score_corpus(table(spark, sf_dir, "documents"))


def op2_karmarkar_karp(spark, sf_dir):
    return karmarkar_karp.shards(table(spark, sf_dir, "documents"), 40)


def op3_winnowing(spark, sf_dir):
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_url_rules(spark, sf_dir):
    return url_rules.filter_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_mcd_outliers(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_typed_parts(spark, sf_dir):
    return chat_parts.conversations_digest(table(spark, sf_dir, "conversations"))


def op8_simhash_variants(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_host_suffix_array(spark, sf_dir):
    return host_boilerplate.extract(table(spark, sf_dir, "pages"))


def op10_content_store(spark, sf_dir):
    return content_store.stored(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def base_statistics(spark, sf_dir):
    """The part of op6 that SQL can express."""
    return quality_rules.base_statistics(table(spark, sf_dir, "documents")).drop("lang", "source")


def explicit_url_rules(spark, sf_dir):
    """The part of op5 that SQL can express."""
    return url_rules.explicit_verdicts(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_masked_pseudo_likelihood,
        op2_karmarkar_karp,
        op3_winnowing,
        op4_byte_bpe,
        op5_url_rules,
        op6_mcd_outliers,
        op7_typed_parts,
        op8_simhash_variants,
        op9_host_suffix_array,
        op10_content_store,
        base_statistics,
        explicit_url_rules,
    )
}

ORACLES = {
    "op3_winnowing": winnowing.ORACLE_SQL,
    "op7_typed_parts": chat_parts.ORACLE_SQL,
    "base_statistics": quality_rules.BASE_SQL,
    "explicit_url_rules": url_rules.EXPLICIT_SQL,
}
