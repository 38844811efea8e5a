"""Reading text files and storing extracted lines as Parquet; rendering of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsense.functions.extract import extract, once
from logsense.functions.misc import ZSTD_LEVELS
from logsense.functions.patterns import COLUMNS
from logsense.functions.typed import STORED, VALUES
from logsense.operators.logtable import LogTable, of_kind

#: Splits up to which their table is broadcast.
MANY = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, text of text files. A line ends with \\n; \\r before it is dropped.

    line_no grows with a line's place in its file: Spark numbers the lines of each split in order, and
    splits of a file in order of their start.
    """
    x = spark.read.option("lineSep", "\n").text(path)
    start, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return x.select(F.col("_metadata.file_path").alias("file"), start.alias("__start"), length.alias("__length"), within.alias("__k"), F.regexp_replace("value", "\r$", "").alias("text")).transform(_numbered)


def _numbered(x: DataFrame) -> DataFrame:
    sizes = x.groupBy("file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__first"))
    base = F.sum("__n").over(Window.partitionBy("file").orderBy("__start")) - F.col("__n")
    sizes = sizes.withColumn("__base", base)
    few = sizes.limit(MANY + 1).count() <= MANY if not x.isStreaming else False  # a row for each split of each file
    return x.join(F.broadcast(sizes) if few else sizes, ["file", "__start"]).select("file", (F.col("__base") + F.col("__k") - F.col("__first")).alias("line_no"), "text")


def columnar(lines: DataFrame) -> DataFrame:
    """Lines as they are stored: literals, and for each column its texts, places in the line, typed values, and the least and greatest value."""
    x = extract(lines.select("file", "line_no", "text"))
    out = [F.col("file"), F.col("line_no"), F.octet_length("text").alias("n_bytes"), F.col("literals")]
    x = once(x.select(*out, "tokens"), **{name: of_kind(F.col("tokens"), name) for name in COLUMNS})
    values = {}
    for name in COLUMNS:
        texts = F.transform(name, lambda t: t["text"])
        values[f"{name}_v"] = (F.transform(texts, VALUES[name]) if name in VALUES else texts).cast(f"array<{STORED[name]}>")
    x, out = once(x, **values), ["file", "line_no", "n_bytes", "literals"]
    for name in COLUMNS:
        v = F.col(f"{name}_v")
        out += [F.transform(name, lambda t: t["text"]).alias(name), F.transform(name, lambda t: t["tok_no"]).alias(f"{name}_at"), F.array_min(v).alias(f"{name}_lo"), F.array_max(v).alias(f"{name}_hi")]
        out += [v] if name in VALUES else []
    return x.select(*out)


def write(lines: DataFrame, path: str, level: str = "balanced") -> None:
    """Store lines by column; a level names the Zstandard level of the column chunks."""
    columnar(lines).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", ZSTD_LEVELS[level]).parquet(path)


def read(spark: SparkSession, path: str) -> LogTable:
    """The table stored at a path; only the columns a query needs are read, and filters reach the scan."""
    return LogTable.of_columns(spark.read.parquet(path))


def restored(table: LogTable) -> DataFrame:
    """The stored lines again, byte for byte."""
    return table.texts()


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """original_size, compressed_size, compression_ratio, row_count and column_count of a stored table."""
    x = spark.read.parquet(path)
    files = x.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).groupBy("f").agg(F.max("n").alias("n"))
    total = x.agg(F.coalesce(F.sum(F.col("n_bytes") + 1), F.lit(0)).alias("original_size"), F.count(F.lit(1)).alias("row_count"))
    kept = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compressed_size"))
    ratio = F.when(F.col("original_size") > 0, F.col("compressed_size") / F.col("original_size")).otherwise(F.lit(0.0))
    n = LogTable.of_columns(x).stats().agg(F.count(F.lit(1)).alias("column_count"))
    return total.crossJoin(kept).crossJoin(n).select("original_size", "compressed_size", ratio.alias("compression_ratio"), "row_count", "column_count")  # one row each


def save_patterns(learned: DataFrame, path: str) -> None:
    """Pattern statistics as lines of JSON."""
    learned.select("ptype", "count", "examples").write.mode("overwrite").json(path)


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ptype string, count long, examples array<string>").json(path)


def save_dialogue(entries: DataFrame, path: str) -> None:
    """Dialogue entries with their `locale`, a folder for each."""
    entries.write.mode("overwrite").partitionBy("locale").parquet(path)


def load_dialogue(spark: SparkSession, path: str, locale: int | None = None) -> DataFrame:
    """Stored entries, of one locale if asked: only its folder is read."""
    x = spark.read.parquet(path)
    return x if locale is None else x.where(F.col("locale") == locale)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_table_text(df: DataFrame, n: int = 100) -> str:
    """A few rows as tab-separated text with a rule and the number of rows shown."""
    rows = df.limit(n).collect()
    lines = ["\t".join(df.columns), "\t".join("-" * len(c) for c in df.columns)]
    lines += ["\t".join("" if v is None else str(v) for v in r) for r in rows]
    return "\n".join([*lines, f"({len(rows)} rows)"])
