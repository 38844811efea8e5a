"""Queries over documents, pages, conversations, benchmark texts and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsense.functions import misc, textstats, typed, unicode_norm
from logsense.functions.extract import once, priority_tokens, replace_patterns, restore_patterns, token_rows
from logsense.operators import dialogue, ordered
from logsense.plans.logs import tokens_sql
from logsense.session import shared_path, spread
from logsense.sources import store

QUERIES, ORACLES = {}, {}


def table(spark, sf_dir: str, name: str):
    """A table over all cores: what is done with its texts costs more than moving them."""
    return spread(spark, sf_dir, name)


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_DOCS = "SELECT doc_id, text FROM documents"
add("doc_token_counts", lambda s, d: token_rows(table(s, d, "documents"), ["doc_id"]).groupBy("doc_id", "ptype").agg(F.count(F.lit(1)).alias("n")), f"WITH {tokens_sql(_DOCS, 'doc_id')} SELECT doc_id, ptype, count(*) AS n FROM tok GROUP BY doc_id, ptype")
add(
    "page_paths",
    lambda s, d: token_rows(table(s, d, "pages"), ["page_id"], "html").where("ptype = 'PATH'").groupBy(F.col("text").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages")),
    f"WITH {tokens_sql('SELECT page_id, html AS text FROM pages', 'page_id')} SELECT text AS path, count(*) AS n, count(DISTINCT page_id) AS pages FROM tok WHERE ptype = 'PATH' GROUP BY text",
)
add(
    "page_url_hosts",
    lambda s, d: token_rows(table(s, d, "pages"), ["page_id"], "url").where("ptype = 'URL'").groupBy(F.regexp_extract("text", "^https?://([^/?#]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n")),
    f"WITH {tokens_sql('SELECT page_id, url AS text FROM pages', 'page_id')} SELECT regexp_extract(text, '^https?://([^/?#]*)', 1) AS host, count(*) AS n FROM tok WHERE ptype = 'URL' GROUP BY 1",
)

_BYTES = """b AS (SELECT doc_id, n, substr(h, 2 * i + 1, 2) AS byte FROM (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS h, unnest(range(0, strlen(text))) AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, n, byte, count(*) AS k FROM b GROUP BY ALL)"""


add("byte_histogram", lambda s, d: textstats.byte_totals(table(s, d, "documents")), f"WITH {_BYTES} SELECT ('0x' || byte)::INT AS byte, sum(k)::BIGINT AS n FROM c GROUP BY 1")
add(
    "shannon_entropy",
    lambda s, d: textstats.statistics(table(s, d, "documents"), "doc_id").select("doc_id", "original_size", F.round("shannon_entropy", 6).alias("shannon_entropy")),
    f"WITH {_BYTES} SELECT doc_id, n AS original_size, round(log2(n) - sum(k * log2(k)) / n, 6) AS shannon_entropy FROM c GROUP BY doc_id, n",
)
add(
    "repetition_score",
    lambda s, d: textstats.statistics(table(s, d, "documents"), "doc_id").select("doc_id", "unique_bytes", F.round("repetition_score", 6).alias("repetition_score")),
    f"WITH {_BYTES} SELECT doc_id, count(*) AS unique_bytes, round(((1 - count(*) / least(256, n)::DOUBLE) + max(k) / n::DOUBLE) / 2, 6) AS repetition_score FROM c GROUP BY doc_id, n",
)


def compress_estimate(s, d):
    x = textstats.estimate(table(s, d, "documents"), "doc_id")
    return x.select("doc_id", "original_size", *[F.round(c, 6).alias(c) for c in ("shannon_entropy", "pattern_coverage", "repetition_score", "estimated_ratio", "space_savings")], "estimated_size", "quality", "is_compressible")


add("compress_estimate", compress_estimate)
add("quality_class", lambda s, d: textstats.estimate(table(s, d, "documents"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n")))


def legacy_tokens(s, d):
    x = table(s, d, "documents").select("doc_id", F.explode(priority_tokens(F.col("text"))).alias("m"))
    return x.select("doc_id", "m.start", "m.end", "m.ptype", "m.text")


add("legacy_tokens", legacy_tokens)
add("pattern_coverage", lambda s, d: textstats.estimate(table(s, d, "documents"), "doc_id").select("doc_id", F.round("pattern_coverage", 6).alias("pattern_coverage")))
add("pattern_examples", lambda s, d: textstats.learn(table(s, d, "documents"), ["doc_id"]))
add("top_patterns", lambda s, d: textstats.top_patterns(textstats.learn(table(s, d, "documents"), ["doc_id"]), 3))

add("strip_accents", lambda s, d: table(s, d, "documents").select("doc_id", unicode_norm.strip_accents(F.col("text")).alias("plain")), "SELECT doc_id, strip_accents(text) AS plain FROM documents")
add(
    "nfd_length",
    lambda s, d: table(s, d, "documents").select("doc_id", F.length(unicode_norm.to_nfd(F.col("text"))).alias("n")),
    f"SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[{unicode_norm.COMPOSED}]')))::INT AS n FROM documents",
)
add("nfc_round_trip", lambda s, d: table(s, d, "documents").select("doc_id", unicode_norm.to_nfc(unicode_norm.to_nfd(F.col("text"))).alias("text")), "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
add("ascii_only_share", lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.round(F.avg(unicode_norm.is_ascii(F.col("text")).cast("int")), 6).alias("share")), r"SELECT lang, round(avg((NOT regexp_matches(text, '[^\x00-\x7F]'))::INT), 6) AS share FROM documents GROUP BY lang")


def entries(s, d):
    """Conversations as dialogue tables: turn is the id, role the speaker."""
    return table(s, d, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("role").alias("speaker"), "text")


def overrides(s, d):
    """English texts for every third entry, and for an id that the base lacks."""
    own = entries(s, d).where("(conv_id + id) % 3 = 0").select(F.lit(1).alias("locale"), "conv_id", "id", "speaker", F.concat(F.lit("[en] "), "text").alias("text"))
    return own.unionByName(entries(s, d).where("id = 0").select(F.lit(1).alias("locale"), "conv_id", F.lit(999).cast("long").alias("id"), F.lit("system").alias("speaker"), F.lit("only here").alias("text")))


add(
    "speaker_dictionary",
    lambda s, d: dialogue.speaker_dictionary(entries(s, d), ["conv_id", "id"]),
    "WITH f AS (SELECT role AS name, min({'c': conv_id, 't': turn}) AS first FROM conversations GROUP BY role) SELECT name, (row_number() OVER (ORDER BY first, name) - 1)::INT AS idx FROM f",
)
add("dialogue_get", lambda s, d: dialogue.get(entries(s, d), 2), "SELECT conv_id, turn AS id, role AS speaker, text FROM conversations WHERE turn = 2")
add(
    "localized_get",
    lambda s, d: dialogue.localized(entries(s, d), overrides(s, d), 1, 0, ["conv_id", "id"]),
    """WITH o AS (SELECT conv_id, turn AS id, role AS speaker, '[en] ' || text AS text FROM conversations WHERE (conv_id + turn) % 3 = 0
  UNION ALL SELECT conv_id, 999, 'system', 'only here' FROM conversations WHERE turn = 0)
SELECT coalesce(o.conv_id, c.conv_id) AS conv_id, coalesce(o.id, c.turn) AS id, CASE WHEN o.id IS NULL THEN c.role ELSE o.speaker END AS speaker, CASE WHEN o.id IS NULL THEN c.text ELSE o.text END AS text
FROM conversations c FULL JOIN o ON c.conv_id = o.conv_id AND c.turn = o.id""",
)
add("localized_base", lambda s, d: dialogue.localized(entries(s, d), overrides(s, d), 0, 0, ["conv_id", "id"]), "SELECT conv_id, turn AS id, role AS speaker, text FROM conversations")
add("available_locales", lambda s, d: dialogue.available_locales(overrides(s, d), 0), "SELECT unnest([0, 1])::INT AS locale")
add("unique_chars", lambda s, d: dialogue.unique_chars(entries(s, d)), "SELECT DISTINCT unnest(string_split(text, '')) AS char FROM conversations")
add(
    "contiguous_ids",
    lambda s, d: dialogue.contiguous(entries(s, d), "conv_id"),
    "SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id",
)
_GROUPS = "[" + ", ".join(f"CASE WHEN doc_id % {k + 2} = 0 THEN '0' ELSE lower(printf('%x', doc_id % 97)) END" for k in range(8)) + "]"
_SHORTEST = f"""WITH g AS (SELECT doc_id, {_GROUPS} AS g FROM documents),
runs AS (SELECT doc_id, g, list_filter(flatten(list_transform(range(1, 9), lambda a: list_transform(range(2, 10 - a), lambda n: [n, a]))), lambda r: len(list_filter(g[r[2] : r[2] + r[1] - 1], lambda v: v <> '0')) = 0) AS z FROM g),
best AS (SELECT doc_id, g, list_reverse_sort(list_transform(z, lambda r: [r[1], -r[2]]))[1] AS r FROM runs)
SELECT doc_id, CASE WHEN r IS NULL THEN array_to_string(g, ':') ELSE array_to_string(g[1 : -r[2] - 1], ':') || '::' || array_to_string(g[-r[2] + r[1] : 8], ':') END AS address FROM best"""
_HASH = "list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)), lambda a, b: ((xor(a, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"
_SIGNED = "(CASE WHEN v >= 9223372036854775808 THEN v::HUGEINT - 18446744073709551616 ELSE v::HUGEINT END)::BIGINT"
_LE = "printf('%02x%02x%02x%02x', id & 255, (id >> 8) & 255, (id >> 16) & 255, (id >> 24) & 255)"
_WHOLE = "SELECT conv_id, {first} || string_agg(" + _LE + " || lower(hex(encode(coalesce(text, '')))), '' ORDER BY id) AS h FROM e GROUP BY conv_id"
add(
    "content_hash",
    lambda s, d: dialogue.content_hash(entries(s, d), "conv_id"),
    f"WITH e AS (SELECT conv_id, turn AS id, text FROM conversations), w AS ({_WHOLE.format(first="''")}), r AS (SELECT conv_id, {_HASH} AS v FROM w) SELECT conv_id, {_SIGNED} AS content_hash FROM r",
)
add(
    "content_hash_delta",
    lambda s, d: dialogue.content_hash(overrides(s, d).where("id < 999"), "conv_id", locale=1),
    f"WITH e AS (SELECT conv_id, turn AS id, '[en] ' || text AS text FROM conversations WHERE (conv_id + turn) % 3 = 0), w AS ({_WHOLE.format(first="'0100'")}), r AS (SELECT conv_id, {_HASH} AS v FROM w) SELECT conv_id, {_SIGNED} AS content_hash FROM r",
)


def writes(s, d):
    """Overrides in the order in which they were made: a later turn writes over an entry again."""
    return entries(s, d).select(F.lit(1).alias("locale"), "conv_id", (F.col("id") % 3).alias("id"), "speaker", "text", F.col("id").alias("seq"))


add(
    "last_writes",
    lambda s, d: dialogue.last_writes(writes(s, d), ["locale", "conv_id", "id"], "seq").select("conv_id", "id", "speaker", "text"),
    "SELECT conv_id, turn % 3 AS id, arg_max(role, turn) AS speaker, arg_max(text, turn) AS text FROM conversations GROUP BY ALL",
)
add("dialogue_roundtrip", lambda s, d: _stored_dialogue(s, d), "SELECT conv_id, turn AS id, '[en] ' || text AS text FROM conversations WHERE (conv_id + turn) % 3 = 0 UNION ALL SELECT conv_id, 999, 'only here' FROM conversations WHERE turn = 0")


def _stored_dialogue(s, d):
    path = shared_path(s)
    store.save_dialogue(overrides(s, d), path)
    return store.load_dialogue(s, path, 1).select("conv_id", "id", "text")


add(
    "text_lengths",
    lambda s, d: table(s, d, "documents").select("doc_id", misc.text_len(F.col("text")).cast("long").alias("n_bytes"), textstats.word_count(F.col("text")).alias("words"), misc.charset_contains(misc.charset(F.col("text")), "é").alias("has_e_acute")),
    f"SELECT doc_id, strlen(text)::BIGINT AS n_bytes, len(regexp_extract_all(text, '[^{textstats.WHITE_SPACE}]+'))::BIGINT AS words, contains(text, 'é') AS has_e_acute FROM documents",
)
add(
    "patterns_roundtrip",
    lambda s, d: _patterns_roundtrip(s, d),
    "SELECT (SELECT count(*) FROM documents) AS n, 0::BIGINT AS mismatches",
)


def _patterns_roundtrip(s, d):
    x = once(table(s, d, "documents").select("text"), r=replace_patterns(F.col("text"))).select((F.col("text") == restore_patterns(F.col("r.text"), F.col("r.matches"))).alias("same"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("same")).alias("mismatches"))


add(
    "ipv6_shortest",
    lambda s, d: table(s, d, "documents").select("doc_id", typed.ipv6_text(typed.ipv6(F.concat_ws(":", *[F.hex(F.when(F.col("doc_id") % (k + 2) == 0, F.lit(0)).otherwise(F.col("doc_id") % 97)) for k in range(8)]))).alias("address")),
    _SHORTEST,
)
add("compression_stats", lambda s, d: textstats.compression_stats(table(s, d, "benchmark"), "item_id").select("item_id", "original_size", "token_count", (F.col("compression_ratio") + F.col("space_savings")).alias("one")), f"SELECT item_id, strlen(text)::BIGINT AS original_size, len(regexp_extract_all(text, '[^{textstats.WHITE_SPACE}]+'))::BIGINT AS token_count, 1.0::DOUBLE AS one FROM benchmark")


def cumulative_freq(s, d):
    return ordered.cumulative_frequency(textstats.byte_totals(table(s, d, "benchmark")), "byte", "n")


_FREQ = """b AS (SELECT substr(h, 2 * i + 1, 2) AS byte FROM (SELECT hex(encode(text)) AS h, unnest(range(0, strlen(text))) AS i FROM benchmark)),
c AS (SELECT ('0x' || byte)::INT AS symbol, count(*) AS n FROM b GROUP BY 1),
f AS (SELECT symbol, (sum(n) OVER (ORDER BY symbol) - n)::BIGINT AS low, (sum(n) OVER (ORDER BY symbol))::BIGINT AS high, (sum(n) OVER ())::BIGINT AS total FROM c)"""
add("cumulative_freq", cumulative_freq, f"WITH {_FREQ} SELECT * FROM f")
add("coded_bits", lambda s, d: cumulative_freq(s, d).select("symbol", F.round(ordered.coded_bits(F.col("low"), F.col("high"), F.col("total")), 6).alias("bits")), f"WITH {_FREQ} SELECT symbol, round((high - low) * (log2(total) - log2(high - low)), 6) AS bits FROM f")

_AT = "list_filter(range(0, length(text) - {n} + 1), lambda i: substr(text, i + 1, {n}) = '{p}')"
add("search_count", lambda s, d: table(s, d, "documents").select("doc_id", misc.search_count(F.col("text"), "nan").alias("n")), f"SELECT doc_id, len({_AT.format(n=3, p='nan')})::INT AS n FROM documents")
add(
    "search_locate",
    lambda s, d: table(s, d, "documents").select("doc_id", "text", F.explode(misc.search_locate(F.col("text"), "tion")).alias("pos")).select("doc_id", "pos", misc.context(F.col("text"), F.col("pos"), 4, 6).alias("around")),
    f"SELECT doc_id, pos::INT AS pos, substr(text, greatest(pos - 6, 0) + 1, pos + 4 + 6 - greatest(pos - 6, 0)) AS around FROM (SELECT doc_id, text, unnest({_AT.format(n=4, p='tion')}) AS pos FROM documents)",
)

#: A small ternary layer: rows of -1, 0 and 1 made by a rule.
WEIGHTS = [[(r * 7 + c * 5) % 3 - 1 for c in range(64)] for r in range(4)]


def logits(s, d):
    return table(s, d, "embeddings").select("vec_id", misc.ternary_logits(F.col("embedding"), WEIGHTS).alias("logits"))


_LOGITS = "l AS (SELECT vec_id, [" + ", ".join("list_sum(list_transform(list_zip(embedding, [" + ", ".join(map(str, w)) + "]), lambda z: z[1]::DOUBLE * z[2]))" for w in WEIGHTS) + "] AS logits FROM embeddings)"
add("ternary_logits", lambda s, d: logits(s, d).select("vec_id", *[F.round(F.get("logits", F.lit(k)), 6).alias(f"logit{k}") for k in range(4)]), f"WITH {_LOGITS} SELECT vec_id, " + ", ".join(f"round(logits[{k + 1}], 6) AS logit{k}" for k in range(4)) + " FROM l")
add(
    "softmax_top",
    lambda s, d: logits(s, d).select("vec_id", misc.argmax(F.col("logits")).alias("top"), F.round(F.array_max(misc.softmax(F.col("logits"))), 6).alias("p")),
    f"WITH {_LOGITS}, m AS (SELECT vec_id, logits, list_max(logits) AS top FROM l) SELECT vec_id, (4 - list_position(list_reverse(logits), top))::INT AS top, round(1 / list_sum(list_transform(logits, lambda v: exp(v - top))), 6) AS p FROM m",
)
add(
    "speech_hints",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", *misc.speech_hints(F.col("text"), F.octet_length(misc.compressed(F.col("text"))) / F.octet_length("text"), F.lit(0.0))).select("conv_id", "turn", "estimated_phonemes", "suggested_mode"),
    "SELECT conv_id, turn, ((strlen(text) + 2) // 3)::BIGINT AS estimated_phonemes, 'Parametric' AS suggested_mode FROM conversations",
)
add("charset_by_lang", lambda s, d: table(s, d, "documents").select("lang", misc.chars(F.col("text")).alias("char")).distinct(), "SELECT DISTINCT lang, unnest(string_split(text, '')) AS char FROM documents")
add("charset_merge", lambda s, d: misc.merged_charset(table(s, d, "documents").select("text").unionByName(table(s, d, "pages").select(F.col("html").alias("text"))), "text"), "SELECT DISTINCT char FROM (SELECT unnest(string_split(text, '')) AS char FROM documents UNION ALL SELECT unnest(string_split(html, '')) FROM pages)")


def codec_roundtrip(s, d):
    """Whether each text is the same when it is read back from the store's Parquet with Zstandard."""
    rows = table(s, d, "benchmark").select("item_id", "text")
    path = shared_path(s)
    store.write(rows.select(F.lit("benchmark").alias("file"), F.col("item_id").alias("line_no"), "text"), path, "best")
    back = store.restored(store.read(s, path)).groupBy("line_no", F.col("text").alias("stored")).agg(F.count(F.lit(1)).alias("found"))
    rows = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n"))
    both = rows.join(back, F.col("item_id").eqNullSafe(F.col("line_no")) & F.col("text").eqNullSafe(F.col("stored")), "left")
    return both.select("item_id", F.coalesce(F.col("found") == F.col("n"), F.lit(False)).alias("same"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


add("codec_roundtrip", codec_roundtrip, "SELECT item_id, true AS same FROM benchmark")
add("fnv_hash", lambda s, d: table(s, d, "benchmark").select("item_id", misc.fnv1a(F.encode("text", "UTF-8")).alias("hash")), f"WITH w AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark), r AS (SELECT item_id, {_HASH} AS v FROM w) SELECT item_id, {_SIGNED} AS hash FROM r")
