"""Dialogue and localisation tables: entries (id, speaker, text), per-locale overrides, speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logsense.functions.misc import fnv1a, merged_charset

# Locale codes.
LOCALES = {"JA": 0, "EN": 1, "ZH": 2, "ZH_TW": 3, "KO": 4, "FR": 5, "DE": 6, "ES": 7, "PT": 8, "RU": 9}
RUBY = T.ArrayType(T.StructType([T.StructField("base_start", T.IntegerType()), T.StructField("base_len", T.IntegerType()), T.StructField("ruby_text", T.StringType())]))


def speaker_dictionary(entries: DataFrame, order: list[str]) -> DataFrame:
    """name and idx, numbered by first appearance. Only one row a speaker meets in one task."""
    first = entries.groupBy(F.col("speaker").alias("name")).agg(F.min(F.struct(*order)).alias("first"))
    return first.select("name", (F.row_number().over(Window.orderBy("first", "name")) - 1).cast("int").alias("idx"))


def get(entries: DataFrame, id_: int) -> DataFrame:
    """The entry of an id; the filter reaches the scan."""
    return entries.where(F.col("id") == id_)


def contiguous(entries: DataFrame, table: str) -> DataFrame:
    """Per table whether ids are 0, 1, 2 and so on: as many distinct ids as rows, from 0 to that number."""
    return entries.groupBy(table).agg(((F.min("id") == 0) & (F.max("id") == F.count(F.lit(1)) - 1) & (F.countDistinct("id") == F.count(F.lit(1)))).alias("contiguous"))


def last_writes(deltas: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Overrides of which the last for each id holds."""
    rest = [c for c in deltas.columns if c not in keys]
    return deltas.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def localized(base: DataFrame, deltas: DataFrame, locale: int, base_locale: int, keys: list[str]) -> DataFrame:
    """Texts in a locale: its overrides where there are any, else the base; the base locale has none."""
    own = deltas.where((F.col("locale") == locale) & F.lit(locale != base_locale)).select(*keys, F.col("speaker").alias("d_speaker"), F.col("text").alias("d_text"), F.lit(True).alias("d"))
    x = base.select(*keys, "speaker", "text").join(own, keys, "full")
    pick = lambda c: F.when(F.col("d"), F.col(f"d_{c}")).otherwise(F.col(c)).alias(c)
    return x.select(*keys, pick("speaker"), pick("text"))


def available_locales(deltas: DataFrame, base_locale: int) -> DataFrame:
    """The base locale first, then those with overrides."""
    first = deltas.sparkSession.range(1).select(F.lit(base_locale).cast("int").alias("locale"))
    return first.unionByName(deltas.select(F.col("locale").cast("int").alias("locale"))).distinct().orderBy((F.col("locale") != base_locale).cast("int"), "locale")


def unique_chars(*tables: DataFrame) -> DataFrame:
    """Distinct characters over tables."""
    out = tables[0].select("text")
    for t in tables[1:]:
        out = out.unionByName(t.select("text"))
    return merged_charset(out, "text")


def content_hash(entries: DataFrame, table: str, locale: int | None = None) -> DataFrame:
    """FNV-1a over id (four little-endian bytes) and text of each table's entries, in order of id.

    With a locale, of a table of its overrides: two little-endian bytes of the locale come first.
    """
    le = F.concat(*[F.lpad(F.hex(F.shiftright("id", s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16, 24)])
    rows = entries.select(table, F.struct("id", F.concat(le, F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("hex")).alias("e"))
    whole = rows.groupBy(table).agg(F.array_sort(F.collect_list("e")).alias("all"))
    first = "" if locale is None else locale.to_bytes(2, "little").hex()
    joined = F.unhex(F.concat(F.lit(first), F.array_join(F.transform("all", lambda e: e["hex"]), "")))
    return whole.select(table, fnv1a(joined).alias("content_hash"))
