"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the
columns of documents. SQL can't express the stages; tests hold each against a brute-force version.

Defined cases: a null text is rejected by the first stage, as are texts without letters; equal texts are one
document after the second, that of the least id, null last; ties go by id; an empty table gives an empty
result; columns that documents don't have pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsense.llm import bpe, language, mixing, similar_sets, substrings
from logsense.session import checkpoint, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without letters or with no likely language go."""
    return language.known(docs, language.train(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five words that overlap by 80 % or more."""
    return similar_sets.one_of_each(docs, words=5, num=80, den=100)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 50-byte strings of documents of smaller id cover."""
    out = substrings.without_repeats(docs, length=50)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs, checkpoint(mixing.sized(docs)), weights=(5, 2, 1), share=1.5, most=2)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and the digest of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(docs, path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
