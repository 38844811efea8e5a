"""Token extraction as column expressions: one pass of one regular expression, no Python per row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsense.functions.patterns import BY_PRIORITY, FUSED_FAST, REQUIRED, TYPES

_MARK, _SLOT, _ESC = "\u0001", "\u0002", "\u0010"
_ESCAPES = [(_ESC, _ESC + "\u0013"), (_MARK, _ESC + "\u0011"), (_SLOT, _ESC + "\u0012")]


def _escaped(text: Column) -> Column:
    out = text
    for raw, safe in _ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.when(text.rlike(f"[{_MARK}{_SLOT}{_ESC}]"), out).otherwise(text)


def _plain(text: Column) -> Column:
    out = text
    for raw, safe in reversed(_ESCAPES):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return F.when(text.contains(_ESC), out).otherwise(text)


def pieces(text: Column) -> Column:
    """The text cut at its tokens: literals at even places, tokens (a slot for each type) at odd ones."""
    slots = _MARK + _SLOT.join(f"${k + 1}" for k in range(len(TYPES))) + _MARK
    return F.split(F.regexp_replace(_escaped(F.coalesce(text, F.lit(""))), FUSED_FAST, slots), _MARK)


def tokens(cut: Column) -> Column:
    """Array of (tok_no, ptype, text) from pieces()."""
    odd = F.filter(cut, lambda x, i: i % 2 == 1)
    types = F.array(*[F.lit(t) for t in TYPES])

    def token(x: Column, i: Column) -> Column:
        kind = F.length(x) - F.length(F.ltrim(x, F.lit(_SLOT)))  # empty slots before the one that is filled
        return F.struct(i.alias("tok_no"), F.get(types, kind).alias("ptype"), _plain(F.trim(x, F.lit(_SLOT))).alias("text"))

    return F.transform(odd, token)


def literals(cut: Column) -> Column:
    """The texts between tokens, one more than tokens."""
    return F.transform(F.filter(cut, lambda x, i: i % 2 == 0), _plain)


def skeleton(lits: Column) -> Column:
    """The text with {i} in place of its ith token."""
    return F.array_join(F.transform(lits, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("{"), (i - 1).cast("string"), F.lit("}"), x))), "")


def restore(lits: Column, toks: Column) -> Column:
    """The text again, from ordered pieces; braces in the text need no care."""
    return F.array_join(F.transform(lits, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get(toks, i - 1)["text"], x))), "")


def with_offsets(lits: Column, toks: Column) -> Column:
    """Tokens with the byte ranges they take in the text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<tok_no:int,ptype:string,text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        a = (acc["at"] + F.octet_length(F.get(lits, t["tok_no"]))).cast("int")
        b = (a + F.octet_length(t["text"])).cast("int")
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(t["tok_no"].alias("tok_no"), t["ptype"].alias("ptype"), t["text"].alias("text"), a.alias("start"), b.alias("end")))).alias("out"))

    return F.aggregate(toks, start, step, lambda a: a["out"])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often later filters and projections use them."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.explode_outer(F.array(made)).alias("__once")).select(*df.columns, *[F.col("__once")[name].alias(name) for name in columns])


def extract(df: DataFrame, text: str = "text", wanted: tuple[str, ...] = ("literals", "tokens")) -> DataFrame:
    """df with the arrays `literals` and `tokens` of its text, or one of them; a narrow projection, made once a row."""
    make = {"literals": literals, "tokens": tokens}
    cut = once(df.drop(*wanted), __cut=pieces(F.col(text)))
    return once(cut, **{w: make[w](F.col("__cut")) for w in wanted}).drop("__cut")


def token_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each token: keys, tok_no, ptype, text."""
    x = extract(df.select(*keys, F.col(text).alias("__text")), "__text", ("tokens",)).select(*keys, F.explode_outer("tokens").alias("t"))
    return x.where("t is not null").select(*keys, "t.tok_no", "t.ptype", "t.text")


def _ranged(k: int, name: str):
    """A step that adds every other part, a match, with its range."""

    def step(acc: Column, p: Column) -> Column:
        end = (acc["at"] + F.length(p)).cast("int")
        m = F.array(F.struct(F.lit(k).alias("prio"), acc["at"].alias("start"), end.alias("end"), F.lit(name).alias("ptype"), p.alias("text")))
        return F.struct(end.alias("at"), F.when(acc["i"] % 2 == 1, F.concat(acc["out"], m)).otherwise(acc["out"]).alias("out"), (acc["i"] + 1).alias("i"))

    return step


def may_contain(text: Column, name: str) -> Column:
    """Whether a text has what each token of a type has."""
    need = REQUIRED[name]
    return text.rlike(need) if isinstance(need, str) else reduce(or_, [text.contains(x) for x in need])


def _candidates(text: Column) -> Column:
    """Matches of each pattern of the priority extractor alone, with character ranges, best priority first.

    A text that can't have a type isn't searched for it.
    """
    none = F.array().cast("array<struct<prio:int,start:int,end:int,ptype:string,text:string>>")
    groups = []
    for k, (name, pattern) in enumerate(BY_PRIORITY):
        parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<prio:int,start:int,end:int,ptype:string,text:string>>").alias("out"), F.lit(0).alias("i"))

        groups.append(F.when(may_contain(text, name), F.aggregate(parts, start, _ranged(k, name), lambda a: a["out"])).otherwise(none))
    return F.concat(*groups)


def priority_tokens(text: Column) -> Column:
    """Array of (start, end, ptype, text) in text order: types are matched one after another by priority,
    and a match that overlaps an earlier type's is dropped. Ranges are in characters."""
    none = F.array().cast("array<struct<prio:int,start:int,end:int,ptype:string,text:string>>")
    free = lambda acc, m: ~F.exists(acc, lambda a: (a["start"] < m["end"]) & (m["start"] < a["end"]))
    found = F.transform(F.array(_escaped(F.coalesce(text, F.lit("")))), _candidates)  # the escaped text once, not once a type
    kept = F.aggregate(F.get(found, F.lit(0)), none, lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))
    order = F.array_sort(F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["ptype"].alias("ptype"), _plain(m["text"]).alias("text"), m["prio"].alias("prio"))))
    return order


def replace_patterns(text: Column) -> Column:
    """The text with {Pi} in place of its ith match of priority_tokens(), and the matches, which are sought once."""
    return F.get(F.transform(F.array(priority_tokens(text)), lambda found: _replaced(text, found)), F.lit(0))


def _replaced(text: Column, found: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(acc: Column, m: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, m["start"] - acc["at"])
        return F.struct(m["end"].cast("int").alias("at"), F.concat(acc["out"], before, F.lit("{P"), acc["i"].cast("string"), F.lit("}")).alias("out"), (acc["i"] + 1).alias("i"))

    replaced = F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.struct(replaced.alias("text"), found.alias("matches"))


def restore_patterns(text: Column, matches: Column) -> Column:
    """replace_patterns() undone: each placeholder's match again, from the last to the first."""
    numbered = F.reverse(F.transform(matches, lambda m, i: F.struct(i.alias("i"), m["text"].alias("text"))))
    return F.aggregate(numbered, text, lambda acc, m: F.replace(acc, F.concat(F.lit("{P"), m["i"].cast("string"), F.lit("}")), m["text"]))
