"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from logsense.llm.chat import TEMPLATE
from logsense.llm.quality import BASE, RULES, STOP_WORDS

ORACLES: dict[str, str] = {}

_PREFERENCE = "(1000 + floor((1000 * size) / (size + 500))::BIGINT)"

ORACLES["op1_mix_sources"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS n, sum(size * {_PREFERENCE})::BIGINT AS z,
         ([5, 2, 1])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos
  FROM sized GROUP BY source),
lev AS (
  SELECT *, (1.5::DOUBLE * (sum(n) OVER ())::DOUBLE
     - coalesce(sum(2 * n) OVER (ORDER BY n::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / (sum(weight) OVER (ORDER BY n::DOUBLE / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM src),
tgt AS (
  SELECT *, coalesce(least(2::DOUBLE * n, weight * first(CASE WHEN level * weight <= 2::DOUBLE * n THEN level END IGNORE NULLS)
     OVER (ORDER BY n::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 0::DOUBLE) AS target FROM lev),
rat AS (
  SELECT *, floor(CASE WHEN n > 0 THEN target / n ELSE 0 END)::BIGINT AS whole, CASE WHEN n > 0 THEN target / n ELSE 0 END AS ratio FROM tgt),
odd AS (SELECT *, ratio - whole::DOUBLE AS odds, target - whole * n AS lft FROM rat),
draw AS (
  SELECT s.*, o.lft,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    least(1::DOUBLE, odds * {_PREFERENCE}::DOUBLE / (z::DOUBLE / n::DOUBLE)) AS p
  FROM sized s JOIN odd o ON s.source IS NOT DISTINCT FROM o.source WHERE odds > 0 AND size > 0),
ranked AS (SELECT *, (u / (1::DOUBLE - u)) * ((1::DOUBLE - p) / p) AS q FROM draw),
cum AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size / 2::DOUBLE AS mid FROM ranked),
more AS (SELECT doc_id, source FROM cum WHERE mid <= lft)
SELECT s.doc_id, s.size, o.n AS source_size, o.target,
  (s.size * (o.whole + CASE WHEN m.doc_id IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM sized s JOIN odd o ON s.source IS NOT DISTINCT FROM o.source LEFT JOIN more m ON s.doc_id = m.doc_id
"""


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '&', '&amp;')"
    for raw, safe in TEMPLATE["escapes"].items():
        out = f"replace({out}, '{raw}', '{safe}')"
    return out


_ACCEPTED = " OR ".join(f"state = '{k}' AND role IN ({', '.join(repr(r) for r in v)})" for k, v in TEMPLATE["accepts"].items())
ORACLES["op4_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
steps AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(lag(role) OVER w, '') AS state FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(TEMPLATE['open'].format(role='') + TEMPLATE['close'])})::BIGINT AS formatted_chars,
  coalesce(min(k) FILTER (NOT ({_ACCEPTED})), -1) < 0 AND arg_max(role, k) IN ({', '.join(repr(r) for r in TEMPLATE['final'])}) AS valid,
  coalesce(min(k) FILTER (NOT ({_ACCEPTED})), -1)::INT AS first_bad_turn
FROM steps GROUP BY conv_id
"""


def _sql_rules(rules: list[tuple]) -> str:
    return " AND ".join(f"{a} * {left} {how} {b} * {1 if right == 'one' else right}" for left, a, how, right, b in rules)


ORACLES["op7_quality_rules"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t),
pos AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM pos) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS v(d) GROUP BY r),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper_chars,
  len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words
  FROM w LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT ({_sql_rules(BASE)}) AS base_failed, ({_sql_rules(BASE)}) AND ({_sql_rules(RULES)}) AS kept FROM s
"""


ORACLES["op8_exact_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM best WHERE rank <= 20
"""
