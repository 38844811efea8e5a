"""python -m logsense: store, restore, info, verify, estimate and query from a shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logsense.functions import textstats
from logsense.operators.logtable import QueryBuilder
from logsense.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logsense", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("store", help="text files to a table of tokens")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--level", default="balanced", choices=["fast", "balanced", "best"])
    c = sub.add_parser("restore", help="a table to text, in line order")
    c.add_argument("input")
    c.add_argument("output")
    for name, what in (("info", "values of each column"), ("verify", "read all and count lines")):
        c = sub.add_parser(name, help=what)
        c.add_argument("input")
    c = sub.add_parser("estimate", help="compressibility of text files")
    c.add_argument("input")
    c.add_argument("--detailed", action="store_true")
    c = sub.add_parser("query", help="rows of a table")
    c.add_argument("input")
    c.add_argument("--select", default="log_levels,ipv4,timestamps")
    c.add_argument("-w", "--where")
    c.add_argument("--columns", action="store_true", help="only name the columns that have values")
    c.add_argument("--stats", action="store_true", help="only show sizes and values of each column")
    c.add_argument("-v", "--verbose", action="store_true", help="also show the plan's scans")
    c.add_argument("--mode", default="line", choices=["line", "positional"])
    c.add_argument("--format", default="table", choices=["table", "csv", "json"])
    c.add_argument("--limit", type=int, default=100)
    c.add_argument("--output", help="folder for csv or json")
    return p


def run(spark: SparkSession, argv: list[str]) -> str:
    """What a command prints."""
    a = parser().parse_args(argv)
    if a.command == "store":
        store.write(store.read_lines(spark, a.input), a.output, a.level)
        return ""
    if a.command == "estimate":
        x = textstats.estimate(spark.read.text(a.input, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), "file")
        return store.to_table_text(x if a.detailed else x.select("file", "original_size", "estimated_size", "quality"))
    table = store.read(spark, a.input)
    if a.command == "restore":
        store.restored(table).orderBy("file", "line_no").select("text").write.mode("overwrite").text(a.output)
        return ""
    if a.command == "info":
        return store.to_table_text(table.stats().orderBy("column"))
    if a.command == "verify":
        n = store.restored(table).agg(F.count("text").alias("lines"), F.sum(F.octet_length("text") + 1).alias("bytes"))
        return store.to_table_text(n)
    if a.columns:
        return "\n".join(table.columns())
    if a.stats:
        return store.to_table_text(store.sizes(spark, a.input)) + "\n" + store.to_table_text(table.stats().orderBy("column"))
    q = QueryBuilder(table, a.mode).select(*a.select.split(","))
    q = q.where(a.where) if a.where else q
    if a.output and a.format != "table":
        {"csv": store.to_csv, "json": store.to_json}[a.format](q.run(), a.output)
        return ""
    rows = q.limit(a.limit).run()
    if a.verbose:
        rows.explain("formatted")
    if a.format == "table":
        return store.to_table_text(rows, a.limit)
    return "\n".join(rows.toJSON().collect() if a.format == "json" else [",".join(rows.columns), *rows.select(F.to_csv(F.struct("*"))).toPandas().iloc[:, 0]])


def main() -> None:
    spark = SparkSession.builder.appName("logsense").getOrCreate()
    print(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
