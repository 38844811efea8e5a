"""Queries over log lines derived from the events table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsense.functions.extract import extract, restore, skeleton, token_rows, with_offsets
from logsense.functions.patterns import FUSED_PLAIN, LEVELS, PATTERNS
from logsense.functions.typed import timestamp_ms
from logsense.operators.logtable import LogTable, QueryBuilder
from logsense.operators.ordered import deltas, running_sum
from logsense.session import spread, table

QUERIES, ORACLES = {}, {}


def logs(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """file, line_no, text: a line for each event; with gaps, every seventh has no address."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "signup", "DEBUG").otherwise("INFO")
    ip = F.concat(F.lit(" from 192.168."), F.expr("user_id div 256 % 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    ip = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(ip) if gaps else ip
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" User "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), ip, F.lit(" value="), F.col("value").cast("string"))
    return spread(spark, sf_dir, "events").select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), text.alias("text"))


def keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a UUID, an IPv6 address and a hex number made from the keys of orders."""
    h = F.md5(F.col("o_orderkey").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    v6 = F.concat_ws(":", *[part(k, 4) for k in range(1, 33, 4)])
    return spread(spark, sf_dir, "orders").select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit("id "), uuid, F.lit(" at "), v6, F.lit(" code 0x"), part(1, 6)).alias("text"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def kind_of(token: str) -> str:
    """SQL for the type of a token: the first pattern that it matches whole."""
    return "CASE " + " ".join(f"WHEN regexp_full_match({token}, '{_quoted(p)}') THEN '{name}'" for name, p in PATTERNS) + " END"


def line_sql(gaps: bool = False) -> str:
    ip = "' from 192.168.' || (user_id // 256 % 256) || '.' || (user_id % 256)"
    ip = f"(CASE WHEN event_id % 7 = 0 THEN '' ELSE {ip} END)" if gaps else ip
    return f"""SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' ||
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END ||
  ' User ' || user_id || ' ' || event_type || {ip} || ' value=' || value AS text FROM events"""


KEYED_SQL = """SELECT o_orderkey AS line_no, 'id ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
  || ' at ' || substr(h, 1, 4) || ':' || substr(h, 5, 4) || ':' || substr(h, 9, 4) || ':' || substr(h, 13, 4) || ':' || substr(h, 17, 4) || ':' || substr(h, 21, 4) || ':' || substr(h, 25, 4) || ':' || substr(h, 29, 4)
  || ' code 0x' || substr(h, 1, 6) AS text FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders)"""


def tokens_sql(lines: str, keys: str = "line_no") -> str:
    """CTEs: lines, tok (keys, tok_no from 1, text, ptype)."""
    return f"""lines AS ({lines}),
raw AS (SELECT {keys}, regexp_extract_all(text, '{_quoted(FUSED_PLAIN)}') AS toks FROM lines),
flat AS (SELECT {keys}, unnest(toks) AS text, generate_subscripts(toks, 1) AS tok_no FROM raw),
tok AS (SELECT *, {kind_of("text")} AS ptype FROM flat)"""


def first_sql(kind: str) -> str:
    return f"min_by(text, tok_no) FILTER (ptype = '{kind}')"


_LEVEL = "CASE upper(text) WHEN 'WARNING' THEN 3 " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(LEVELS)) + " ELSE 7 END"
_NAME = "CASE upper(text) WHEN 'WARNING' THEN 'WARN' ELSE upper(text) END"
_IPV4 = "(split_part(text, '.', 1)::BIGINT * 16777216 + split_part(text, '.', 2)::BIGINT * 65536 + split_part(text, '.', 3)::BIGINT * 256 + split_part(text, '.', 4)::BIGINT)"


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


add("tokens_by_type", lambda s, d: token_rows(logs(s, d), ["line_no"]).groupBy("ptype").agg(F.count(F.lit(1)).alias("n")), f"WITH {tokens_sql(line_sql())} SELECT ptype, count(*) AS n FROM tok GROUP BY ptype")

add(
    "keyed_tokens_by_type",
    lambda s, d: token_rows(keyed_lines(s, d), ["line_no"]).groupBy("ptype").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("least")),
    f"WITH {tokens_sql(KEYED_SQL)} SELECT ptype, count(*) AS n, min(text) AS least FROM tok GROUP BY ptype",
)


def skeleton_templates(s, d):
    x = extract(logs(s, d, gaps=True), wanted=("literals",)).select(skeleton(F.col("literals")).alias("template"))
    return x.groupBy("template").agg(F.count(F.lit(1)).alias("n"))


add(
    "skeleton_templates",
    skeleton_templates,
    f"""WITH lines AS ({line_sql(True)}),
p AS (SELECT string_split_regex(text, '{_quoted(FUSED_PLAIN)}') AS parts FROM lines),
t AS (SELECT array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE '{{' || (i - 2) || '}}' || x END), '') AS template FROM p)
SELECT template, count(*) AS n FROM t GROUP BY template""",
)


def restore_roundtrip(s, d):
    a = extract(logs(s, d, gaps=True).select("text"))
    b = extract(table(s, d, "documents").select("text"))
    x = a.unionByName(b).select((F.coalesce("text", F.lit("")) == restore(F.col("literals"), F.col("tokens"))).alias("same"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("same")).alias("mismatches"))


add("restore_roundtrip", restore_roundtrip, "SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) AS n, 0::BIGINT AS mismatches")


def token_offsets(s, d):
    x = extract(logs(s, d)).select("line_no", F.explode(with_offsets(F.col("literals"), F.col("tokens"))).alias("t"))
    return x.select("line_no", "t.ptype", "t.start", "t.end")


add(
    "token_offsets",
    token_offsets,
    f"""WITH lines AS ({line_sql()}),
p AS (SELECT line_no, regexp_extract_all(text, '{_quoted(FUSED_PLAIN)}') AS toks, string_split_regex(text, '{_quoted(FUSED_PLAIN)}') AS lits FROM lines),
e AS (SELECT line_no, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i, toks, lits FROM p),
o AS (SELECT line_no, tok, (list_sum(list_transform(lits[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(toks[1:i - 1], lambda x: strlen(x))), 0))::INT AS start FROM e)
SELECT line_no, {kind_of("tok")} AS ptype, start, (start + strlen(tok))::INT AS "end" FROM o""",
)

add(
    "select_columns_line",
    lambda s, d: LogTable(logs(s, d, gaps=True)).select_columns("log_levels", "ipv4", "timestamps").drop("file"),
    f"WITH {tokens_sql(line_sql(True))} SELECT line_no, {first_sql('LOGLEVEL')} AS log_levels, {first_sql('IPV4')} AS ipv4, {first_sql('TIMESTAMP')} AS timestamps FROM tok GROUP BY line_no",
)

_ORD = "ords AS (SELECT line_no, text, ptype, row_number() OVER (PARTITION BY ptype ORDER BY line_no, tok_no) - 1 AS ord FROM tok)"
_CELL = lambda kind: f"max(text) FILTER (ptype = '{kind}')"

add(
    "select_columns_positional",
    lambda s, d: LogTable(logs(s, d, gaps=True)).select_columns("log_levels", "ipv4", mode="positional").drop("file"),
    f"WITH {tokens_sql(line_sql(True))}, {_ORD} SELECT ord, {_CELL('LOGLEVEL')} AS log_levels, {_CELL('IPV4')} AS ipv4 FROM ords WHERE ptype IN ('LOGLEVEL', 'IPV4') GROUP BY ord",
)


def line_filter(name: str, column: str, op: str, value: str, kind: str, test: str, select=("timestamps", "ipv4"), lines=None, sql=None) -> None:
    """A query by line and its SQL: lines with a token of a kind that passes the test."""
    kinds = {"timestamps": "TIMESTAMP", "ipv4": "IPV4", "log_levels": "LOGLEVEL", "numbers": "NUMBER", "uuids": "UUID", "ipv6": "IPV6", "paths": "PATH", "urls": "URL", "emails": "EMAIL", "hex_values": "HEX"}
    shown = lambda c: rf"regexp_replace({first_sql(kinds[c])}, '(^|:)0{{1,3}}([0-9a-f])', '\1\2', 'g')" if c == "ipv6" else first_sql(kinds[c])
    cells = ", ".join(f"{shown(c)} AS {c}" for c in select)
    add(
        name,
        lambda s, d: LogTable((lines or logs)(s, d)).query(list(select), column, op, value).drop("file"),
        f"WITH {tokens_sql(sql or line_sql())}, hit AS (SELECT DISTINCT line_no FROM tok WHERE ptype = '{kind}' AND CASE WHEN ptype = '{kind}' THEN {test} END) SELECT line_no, {cells} FROM tok JOIN hit USING (line_no) GROUP BY line_no",
    )


line_filter("filter_level_eq", "log_levels", "=", "ERROR", "LOGLEVEL", f"({_LEVEL}) = 4")
line_filter("filter_level_ge", "log_levels", ">=", "warning", "LOGLEVEL", f"({_LEVEL}) >= 3")
line_filter("filter_level_ne", "log_levels", "!=", "INFO", "LOGLEVEL", f"({_LEVEL}) != 2")
line_filter("filter_level_lt", "log_levels", "<", "INFO", "LOGLEVEL", f"({_LEVEL}) < 2")
line_filter("filter_ts_range", "timestamps", ">=", "2024-01-20", "TIMESTAMP", "text::TIMESTAMP >= TIMESTAMP '2024-01-20'")
line_filter("filter_ts_le", "timestamps", "<=", "2024-01-03 12:00:00", "TIMESTAMP", "text::TIMESTAMP <= TIMESTAMP '2024-01-03 12:00:00'")
line_filter("filter_ipv4_eq", "ipv4", "=", "192.168.0.77", "IPV4", f"{_IPV4} = 3232235597")
line_filter("filter_ipv4_range", "ipv4", ">", "192.168.0.20", "IPV4", f"{_IPV4} > 3232235540")
line_filter("filter_ipv4_above_all", "ipv4", ">", "192.168.255.254", "IPV4", f"{_IPV4} > 3232301054")
line_filter("filter_number_gt", "numbers", ">", "95.5", "NUMBER", "text::DOUBLE > 95.5")
line_filter("filter_number_eq_eps", "numbers", "=", "42", "NUMBER", "abs(text::DOUBLE - 42) < 2.220446049250313e-16")
line_filter("filter_string_on_typed", "ipv4", "~", "192", "IPV4", "false")
_KEYED = {"select": ("uuids", "ipv6", "hex_values"), "lines": keyed_lines, "sql": KEYED_SQL}
line_filter("filter_uuid_eq", "uuids", "=", "C4CA4238-A0B9-2382-0DCC-509A6F75849B", "UUID", "replace(text, '-', '') = 'c4ca4238a0b923820dcc509a6f75849b'", **_KEYED)
line_filter("filter_uuid_lt", "uuids", "<", "10000000-0000-0000-0000-000000000000", "UUID", "replace(text, '-', '') < '10000000000000000000000000000000'", **_KEYED)
line_filter("filter_ipv6_range", "ipv6", ">=", "f000::", "IPV6", "replace(text, ':', '') >= 'f0000000000000000000000000000000'", **_KEYED)
line_filter("filter_hex_startswith", "hex_values", "^", "0xab", "HEX", "starts_with(text, '0xab')", **_KEYED)


def of_pages(column: str):
    return lambda s, d: table(s, d, "pages").select(F.lit("pages").alias("file"), F.col("page_id").alias("line_no"), F.col(column).alias("text"))


line_filter("filter_path_contains", "paths", "~", "tion", "PATH", "contains(text, 'tion')", ("paths",), of_pages("html"), "SELECT page_id AS line_no, html AS text FROM pages")
line_filter("filter_url_startswith", "urls", "^", "https://blog.", "URL", "starts_with(text, 'https://blog.')", ("urls",), of_pages("url"), "SELECT page_id AS line_no, url AS text FROM pages")
line_filter("filter_email_endswith", "emails", "$", ".com", "EMAIL", "ends_with(text, '.com')", ("emails",), lambda s, d: table(s, d, "documents").select(F.lit("d").alias("file"), F.col("doc_id").alias("line_no"), "text"), "SELECT doc_id AS line_no, text FROM documents")

add(
    "query_misaligned_positional",
    lambda s, d: LogTable(logs(s, d, gaps=True)).query(["ipv4", "timestamps"], "log_levels", "=", "ERROR", mode="positional").drop("file"),
    f"""WITH {tokens_sql(line_sql(True))}, {_ORD},
hit AS (SELECT ord FROM ords WHERE ptype = 'LOGLEVEL' AND text = 'ERROR'),
wide AS (SELECT ord, {_CELL('IPV4')} AS ipv4, {_CELL('TIMESTAMP')} AS timestamps FROM ords WHERE ptype IN ('IPV4', 'TIMESTAMP') GROUP BY ord)
SELECT ord, ipv4, timestamps FROM hit LEFT JOIN wide USING (ord)""",
)
add(
    "select_column",
    lambda s, d: LogTable(logs(s, d, gaps=True)).select_column("numbers").drop("file"),
    f"WITH {tokens_sql(line_sql(True))}, {_ORD} SELECT ord, CASE WHEN text::DOUBLE = floor(text::DOUBLE) THEN floor(text::DOUBLE)::BIGINT::VARCHAR ELSE text END AS numbers FROM ords WHERE ptype = 'NUMBER'",
)
add(
    "select_at",
    lambda s, d: LogTable(logs(s, d)).select_at("log_levels", [5, 0, 5, 17, 99_999_999]).drop("file"),
    f"WITH {tokens_sql(line_sql())}, {_ORD}, want(pos, ord) AS (VALUES (0, 5), (1, 0), (2, 5), (3, 17), (4, 99999999)) SELECT pos::BIGINT AS pos, ord, text AS log_levels FROM want JOIN ords USING (ord) WHERE ptype = 'LOGLEVEL'",
)
add(
    "limit_rows",
    lambda s, d: QueryBuilder(LogTable(logs(s, d))).select("log_levels", "ipv4").where("log_levels >= WARN").limit(25).run().drop("file"),
    f"WITH {tokens_sql(line_sql())}, hit AS (SELECT DISTINCT line_no FROM tok WHERE ptype = 'LOGLEVEL' AND ({_LEVEL}) >= 3) SELECT line_no, {first_sql('LOGLEVEL')} AS log_levels, {first_sql('IPV4')} AS ipv4 FROM tok JOIN hit USING (line_no) GROUP BY line_no ORDER BY line_no LIMIT 25",
)
add(
    "closure_filter",
    lambda s, d: LogTable(logs(s, d)).filter_by("log_levels", lambda c: F.length(c) == 5).drop("file"),
    f"WITH {tokens_sql(line_sql())}, {_ORD} SELECT ord FROM ords WHERE ptype = 'LOGLEVEL' AND length({_NAME}) = 5",
)
add(
    "column_stats",
    lambda s, d: LogTable(logs(s, d, gaps=True)).stats(),
    f"""WITH {tokens_sql(line_sql(True))} SELECT CASE ptype WHEN 'TIMESTAMP' THEN 'timestamps' WHEN 'LOGLEVEL' THEN 'log_levels' WHEN 'IPV4' THEN 'ipv4' ELSE 'numbers' END AS "column", count(*) AS row_count FROM tok GROUP BY ptype""",
)


def _ms(s, d):
    t = LogTable(logs(s, d)).tokens("timestamps")
    return t.select("file", "line_no", timestamp_ms(F.col("text")).alias("ms"))


_MS_SQL = "SELECT event_id AS line_no, epoch_ms(date_trunc('second', ts)) AS ms FROM events"
add("ts_delta", lambda s, d: deltas(_ms(s, d), "file", "line_no", "ms", chunk=1000).drop("file"), f"SELECT line_no, ms, coalesce(ms - lag(ms) OVER (ORDER BY line_no), 0) AS delta FROM ({_MS_SQL})")
add(
    "ts_prefix_sum",
    lambda s, d: running_sum(deltas(_ms(s, d), "file", "line_no", "ms", chunk=1000), "file", "line_no", "delta", chunk=1000).select("line_no", "total"),
    f"SELECT line_no, (ms - first_value(ms) OVER (ORDER BY line_no))::BIGINT AS total FROM ({_MS_SQL})",
)
