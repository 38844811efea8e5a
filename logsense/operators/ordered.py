"""Differences and running sums along a file or a symbol order, without sorting a file in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 20


def deltas(rows: DataFrame, file: str, at: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """rows with `delta`: the value less its predecessor's in the file, 0 for the first.

    Predecessors come from inside a chunk of `at`; a chunk's first row takes the last value of the chunk before.
    """
    x = rows.withColumn("__chunk", F.floor(F.col(at) / chunk))
    ends = x.groupBy(file, "__chunk").agg(F.max_by(value, at).alias("__last"))
    ends = ends.select(file, "__chunk", F.lag("__last").over(Window.partitionBy(file).orderBy("__chunk")).alias("__before"))
    before = F.lag(value).over(Window.partitionBy(file, "__chunk").orderBy(at))
    x = x.withColumn("__lag", before).join(ends, [file, "__chunk"])
    return x.withColumn("delta", F.coalesce(F.col(value) - F.coalesce("__lag", "__before"), F.lit(0))).drop("__chunk", "__lag", "__before")


def running_sum(rows: DataFrame, file: str, at: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """rows with `total`: the sum of the values up to each row in its file."""
    x = rows.withColumn("__chunk", F.floor(F.col(at) / chunk))
    sums = x.groupBy(file, "__chunk").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(file).orderBy("__chunk")
    sums = sums.select(file, "__chunk", (F.sum("__sum").over(w) - F.col("__sum")).alias("__base"))
    within = F.sum(value).over(Window.partitionBy(file, "__chunk").orderBy(at))
    return x.withColumn("__within", within).join(sums, [file, "__chunk"]).withColumn("total", F.col("__base") + F.col("__within")).drop("__chunk", "__within", "__base")


def cumulative_frequency(symbols: DataFrame, symbol: str, n: str) -> DataFrame:
    """symbol, low, high, total of a frequency table: the model of an arithmetic coder."""
    w = Window.orderBy(symbol)
    return symbols.select(F.col(symbol).alias("symbol"), (F.sum(n).over(w) - F.col(n)).alias("low"), F.sum(n).over(w).alias("high"), F.sum(n).over(Window.partitionBy()).alias("total"))


def coded_bits(low: Column, high: Column, total: Column) -> Column:
    """Bits that an arithmetic coder of this model spends on all occurrences of a symbol."""
    return (high - low) * (F.log2(total) - F.log2(high - low))
