"""Accents: stripping, decomposition and composition of Latin letters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The composed letters that are decomposed.
COMPOSED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĆćČčĎďĒēĚěĞğĪīŃńŇňŌōŘřŚśŠšŪūŽž"
#: Characters that count as combining.
COMBINING = "[̀-̛̣-̨̰-̸̳]"
_PAIRS = {c: unicodedata.normalize("NFD", c) for c in COMPOSED}
_LETTERS = "".join(_PAIRS[c][0] for c in COMPOSED)
#: Accent to the composed letters that have it.
_WITH = {m: "".join(c for c in COMPOSED if _PAIRS[c][1] == m) for m in sorted({p[1] for p in _PAIRS.values()})}


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def strip_accents(text: Column) -> Column:
    """Letters without accents, and no combining characters."""
    return F.regexp_replace(F.translate(text, COMPOSED, _LETTERS), COMBINING, "")


# Canonical classes, by ranges of code points (first, last, class).
CLASSES = [(0x300, 0x314, 230), (0x315, 0x315, 232), (0x316, 0x319, 220), (0x31A, 0x31A, 232), (0x31B, 0x31B, 216), (0x323, 0x326, 220), (0x327, 0x328, 202), (0x330, 0x333, 220), (0x338, 0x338, 1)]
#: The characters of these classes.
_ORDERED = "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last, _ in CLASSES)


def _class(char: Column) -> Column:
    out = F
    for k in sorted({k for _, _, k in CLASSES}):
        out = out.when(char.rlike("[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b, c in CLASSES if c == k) + "]"), F.lit(k))
    return out


def is_combining(char: Column) -> Column:
    """Whether a character is one that accents are made of."""
    return char.rlike(f"^{COMBINING}$")


def _in_order(text: Column) -> Column:
    """Runs of accents in canonical order, equal classes as they are; other texts than those with a run of two aren't cut."""
    parts = F.split(text, f"(?<=[{_ORDERED}])(?![{_ORDERED}])|(?<![{_ORDERED}])(?=[{_ORDERED}])")
    marks = lambda run: F.array_sort(F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c, i: F.struct(_class(c).alias("class"), i.alias("i"), c.alias("c"))))
    sorted_ = F.transform(parts, lambda p: F.when(p.rlike(f"^[{_ORDERED}]{{2,}}"), F.array_join(F.transform(marks(p), lambda m: m["c"]), "")).otherwise(p))
    return F.when(text.rlike(f"[{_ORDERED}]{{2}}"), F.array_join(sorted_, "")).otherwise(text)


def to_nfd(text: Column) -> Column:
    """Letter and accent apart, accents in canonical order."""
    out = text
    for mark, letters in _WITH.items():  # the accent after its letters, which then lose theirs
        out = F.regexp_replace(out, f"[{letters}]", f"$0{mark}")
    once = F.transform(F.array(F.translate(out, COMPOSED, _LETTERS)), _in_order)
    return F.when(is_ascii(text), text).otherwise(F.get(once, F.lit(0)))


def to_nfc(text: Column) -> Column:
    """Letter and the accent right after it as one."""
    pairs = F.array(*[F.struct(F.lit(p).alias("apart"), F.lit(c).alias("one")) for c, p in _PAIRS.items()])
    joined = F.aggregate(pairs, to_nfd(text), lambda acc, p: F.replace(acc, p["apart"], p["one"]))
    return F.when(is_ascii(text), text).otherwise(joined)


def is_normalized(text: Column, form: str) -> Column:
    return text == {"NFD": to_nfd, "NFC": to_nfc}[form](text)
