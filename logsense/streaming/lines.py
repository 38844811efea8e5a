"""Token extraction over streams of lines: stateless per line, so a stream needs no watermark for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsense.functions.extract import extract
from logsense.functions.typed import timestamp_ms


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files that appear in a folder."""
    return spark.readStream.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("text"))


def stream_tokens(lines: DataFrame) -> DataFrame:
    """ptype and text of each token of a stream of lines."""
    return extract(lines.select("text"), wanted=("tokens",)).select(F.explode("tokens").alias("t")).select("t.ptype", "t.text")


def level_counts(lines: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Log levels by event-time window, by the first timestamp and level of each line; late lines are dropped."""
    x = extract(lines.select("text"), wanted=("tokens",))
    first = lambda kind: F.get(F.filter("tokens", lambda t: t["ptype"] == kind), F.lit(0))["text"]
    x = x.select(F.timestamp_millis(timestamp_ms(first("TIMESTAMP"))).alias("at"), first("LOGLEVEL").alias("level")).where("at is not null and level is not null")
    return x.withWatermark("at", late).groupBy(F.window("at", window), "level").agg(F.count(F.lit(1)).alias("n"))
