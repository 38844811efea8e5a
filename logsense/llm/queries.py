"""One query per operator, over whole tables; their SQL is in sql.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logsense.llm import bpe, chat, html_text, language, mixing, quality, similar_sets, substrings, token_counts, topk
from logsense.llm.sql import ORACLES
from logsense.session import checkpoint, table

__all__ = ["ORACLES", "QUERIES"]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: sources weigh 5, 2, 1 and so on, sharing 150 % of all words."""
    sizes = checkpoint(mixing.sized(table(spark, sf_dir, "documents")))
    return mixing.mix_sizes(sizes, weights=(5, 2, 1), share=1.5, most=2)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 50-byte strings of smaller ids don't cover."""
    return substrings.repeat_digests(table(spark, sf_dir, "documents"), length=50)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{hard}' text")
    return chat.chat_digests(chat.format_chats(rows.unionByName(more)))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose sets of four words overlap by 85 % or more."""
    return similar_sets.link_groups(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    x = quality.quality(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products for every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.counted(bpe.round_trip(table(spark, sf_dir, "documents"), path))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_html_extraction, op3_substring_dedup, op4_chat_format, op5_ngram_join, op6_token_counts, op7_quality_rules, op8_exact_topk, op9_language_id, op10_byte_bpe)}
