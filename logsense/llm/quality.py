"""Quality rules: one table of thresholds, compiled into a single projection of built-in functions.

Every statistic is an integer and every rule compares integers, so a verdict never depends on rounding.
Repeated three-word windows are found by sorting their hashes inside the row's own array and comparing
neighbours, which takes n log n steps for n words.

Defined cases: a null text has no words and fails; an empty text likewise; ties don't arise, as rows are
judged one by one; equal rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = "the of and to in that is it for on with be as at by this from are or was der die das und zu den mit von für auf ist im dem ein eine nicht le la les de des du et un une que qui en dans pour sur el los las del y es con por para".split()

#: (statistic, how often it counts, "<=" or ">=", the other statistic or one, its factor): all must hold.
RULES = [
    ("word_chars", 1, ">=", "n_words", 2),
    ("word_chars", 1, "<=", "n_words", 12),
    ("n_symbols", 10, "<=", "n_words", 1),
    ("n_dup_lines", 2, "<=", "n_lines", 1),
    ("n_stop_words", 100, ">=", "n_words", 2),
    ("n_upper_chars", 2, "<=", "word_chars", 1),
]
#: The base rules in the same form.
BASE = [("n_words", 1, ">=", "one", 50), ("n_repeat_words", 100, "<=", "n_words", 50)]


def compiled(rules: list[tuple]) -> Column:
    """The rules as one boolean column."""
    verdict = F.lit(True)
    for left, a, how, right, b in rules:
        x, y = F.lit(a) * F.col(left), F.lit(b) * (F.lit(1) if right == "one" else F.col(right))
        verdict = verdict & (x <= y if how == "<=" else x >= y)
    return verdict


def repeat_words(words: Column, sorted_windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more; sorted_windows as (h, i)."""
    again = F.filter(sorted_windows, lambda x, k: F.coalesce(F.get(sorted_windows, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_windows, k + 1)["h"] == x["h"], F.lit(False)))
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def quality(docs: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select("doc_id", text.alias("text"))
    x = x.select("doc_id", "text", F.filter(F.split("text", BLANK + "+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    w = F.col("words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    x = x.withColumn("windows", F.array_sort(windows))
    stop = F.array(*[F.lit(s) for s in dict.fromkeys(STOP_WORDS)])
    stats = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeat_words(w, F.col("windows")),
        "n_lines": F.size("lines"),
        "n_stop_words": F.size(F.filter(w, lambda s: F.lower(s).isin(STOP_WORDS))),
        "n_upper_chars": F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", "")),
    }
    x = x.select("doc_id", *[c.cast("long").alias(k) for k, c in stats.items()])
    x = x.withColumn("base_failed", ~compiled(BASE))
    return x.withColumn("kept", ~F.col("base_failed") & compiled(RULES if rules is None else rules))
