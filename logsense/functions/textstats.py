"""Statistics of texts: byte histogram, entropy, repetition, pattern coverage, and an estimate of compressibility."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logsense.functions.arrays import flat, pieces, tidy
from logsense.functions.extract import priority_tokens
from logsense.functions.misc import compressed
from logsense.session import ship


#: Bytes counted at once: as places in a table they take eight times as much.
COUNTED = 1 << 18


@F.arrow_udf(T.ArrayType(T.LongType()))
def byte_counts(text: pa.Array) -> pa.Array:
    """How often each byte value occurs in the UTF-8 text."""
    data, at = flat(text)
    out = np.zeros((len(text), 256), np.int64)
    for i, j in pieces(at, COUNTED):
        row = np.repeat(np.arange(j - i) << 8, np.diff(at[i : j + 1]))
        out[i:j] = np.bincount(row | data[at[i] : at[j]], minlength=256 * (j - i)).reshape(j - i, 256)
    return pa.ListArray.from_arrays(np.arange(len(text) + 1, dtype=np.int32) * 256, out.ravel())


def byte_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """byte and n: how often each byte value occurs in all texts; each task counts its batches as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            data, _ = flat(b.column(0))
            for i in range(0, len(data), COUNTED):
                total += np.bincount(data[i : i + COUNTED], minlength=256)
        byte = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(byte, pa.int32()), pa.array(total[byte])], ["byte", "n"])

    ship(df.sparkSession)
    x = df.select(F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "byte int, n long")
    return x.groupBy("byte").agg(F.sum("n").alias("n"))


def entropy(counts: Column, n: Column) -> Column:
    """Shannon entropy in bits a byte."""
    part = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0)))
    return F.when(n > 0, F.log2(n) - part / n).otherwise(F.lit(0.0))


def unique_bytes(counts: Column) -> Column:
    return F.size(F.filter(counts, lambda c: c > 0))


def repetition(counts: Column, n: Column) -> Column:
    """Mean of how few byte values there are and how common the commonest is."""
    few = 1 - unique_bytes(counts) / F.least(F.lit(256), n)
    return F.when(n > 0, (few + F.array_max(counts) / n) / 2).otherwise(F.lit(0.0))


def coverage(text: Column, n: Column) -> Column:
    """Share of the bytes inside tokens of the priority extractor."""
    covered = F.aggregate(priority_tokens(text), F.lit(0), lambda a, m: a + F.octet_length(m["text"]))
    return F.when(n > 0, covered / n).otherwise(F.lit(0.0))


def quality(ratio: Column) -> Column:
    """Class of an estimated ratio."""
    # Class names and their upper bounds.
    out = F
    for bound, name in ((0.1, "Excellent"), (0.3, "Very Good"), (0.5, "Good"), (0.7, "Fair"), (0.9, "Poor")):
        out = out.when(ratio < bound, F.lit(name))
    return out.otherwise(F.lit("Not Recommended"))


def statistics(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per row: size, counts, entropy, unique bytes, repetition."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = df.select(key, t.alias("text"), F.octet_length(t).cast("long").alias("original_size"), byte_counts(t).alias("counts"))
    n = F.col("original_size")
    return x.select(key, "text", n, "counts", entropy(F.col("counts"), n).alias("shannon_entropy"), unique_bytes(F.col("counts")).cast("long").alias("unique_bytes"), repetition(F.col("counts"), n).alias("repetition_score"))


def estimate(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The estimate of each text's compressed size, with what it rests on."""
    x = statistics(df, key, text)
    n = F.col("original_size")
    x = x.withColumn("pattern_coverage", coverage(F.col("text"), n))
    # Factors of the size, weights of coverage and repetition, bounds of the ratio, bytes of the header.
    size_factor = F.when(n < 100, F.lit(1.5)).when(n < 1000, F.lit(0.9)).otherwise(F.lit(0.7))
    raw = F.col("shannon_entropy") / 8 * (1 - 0.3 * F.col("pattern_coverage")) * (1 - 0.2 * F.col("repetition_score")) * size_factor
    raw = F.least(F.greatest(raw, F.lit(0.05)), F.lit(1.5))
    x = x.withColumn("estimated_size", F.when(n > 0, F.ceil(n * raw).cast("long") + 42).otherwise(F.lit(42).cast("long")))
    x = x.withColumn("estimated_ratio", F.when(n > 0, F.col("estimated_size") / n).otherwise(F.lit(1.0)))
    x = x.withColumn("space_savings", F.when(n > 0, F.greatest(F.lit(0.0), 1 - F.col("estimated_ratio"))).otherwise(F.lit(0.0)))
    x = x.withColumn("quality", quality(F.col("estimated_ratio"))).withColumn("is_compressible", F.col("estimated_ratio") < 0.9)
    return x.drop("text", "counts")


# The code points of Unicode's White_Space property, as a class for regular expressions.
WHITE_SPACE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE_SPACE}]+")), F.lit(0)).cast("long")


def compression_stats(df: DataFrame, key: str, text: str = "text", level: str = "balanced") -> DataFrame:
    """Per row: sizes, words, matches of the priority extractor, ratio, exceptions a word, and savings."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = df.select(key, F.octet_length(t).cast("long").alias("original_size"), F.octet_length(compressed(t, level)).cast("long").alias("compressed_size"), word_count(t).alias("token_count"), F.size(priority_tokens(t)).cast("long").alias("exception_count"))
    ratio = F.when(F.col("original_size") > 0, F.col("compressed_size") / F.col("original_size")).otherwise(F.lit(0.0))
    rate = F.when(F.col("token_count") > 0, F.col("exception_count") / F.col("token_count")).otherwise(F.lit(0.0))
    return x.select("*", ratio.alias("compression_ratio"), rate.alias("exception_rate"), (1 - ratio).alias("space_savings"))


#: Parts in which the examples of a type are ranked.
PARTS = 64


def learn(df: DataFrame, keys: list[str], text: str = "text", examples: int = 5) -> DataFrame:
    """Pattern statistics: per type its count and the first distinct examples in text order.

    Only the first few rows of each distinct match are kept per task and merged, never all matches.
    """
    m = df.select(*keys, F.posexplode(priority_tokens(F.col(text))).alias("at", "m")).select(*keys, "at", F.col("m.ptype").alias("ptype"), F.col("m.text").alias("example"))
    first = m.groupBy("ptype", "example").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys, "at")).alias("first"))
    # Counts and first examples from one pass over the texts; the many examples of a type are ranked in parts.
    part = first.withColumn("part", F.pmod(F.xxhash64("example"), F.lit(PARTS)))
    w = Window.partitionBy("ptype", "part")
    few = part.select("ptype", "first", "example", F.sum("n").over(w).alias("n"), F.row_number().over(w.orderBy("first", "example")).alias("rank")).where(F.col("rank") <= examples)
    count = F.sum(F.when(F.col("rank") == 1, F.col("n"))).alias("count")
    return few.groupBy("ptype").agg(count, F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first", "example"))), 1, examples), lambda x: x["example"]).alias("examples"))


def top_patterns(learned: DataFrame, n: int) -> DataFrame:
    """The most frequent types; ties in order of name."""
    return learned.select("ptype", "count").orderBy(F.col("count").desc(), "ptype").limit(n)
