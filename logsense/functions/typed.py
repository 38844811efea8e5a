"""Typed values of tokens, as column expressions, and literals of filters."""

from __future__ import annotations

import datetime as dt
import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsense.functions.patterns import LEVELS

# How close equal numbers are, and the forms of a filter's timestamps.
EPSILON = 2.220446049250313e-16
FORMS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d")
_DAY = 86_400_000


def level(text: Column) -> Column:
    """Ordinal of a log level; WARNING is WARN, anything unknown is the last."""
    up = F.upper(text)
    out = F.when(up == "WARNING", F.lit(LEVELS.index("WARN")))
    for k, name in enumerate(LEVELS):
        out = out.when(up == name, F.lit(k))
    return out.when(text.isNotNull(), F.lit(len(LEVELS) - 1)).cast("tinyint")


def level_name(text: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level(text).cast("int") + 1)


def ipv4(text: Column) -> Column:
    """Address as an unsigned number; what isn't strictly dotted decimal is 0."""
    n = [F.element_at(F.split(text, r"\."), k).try_cast("bigint") for k in (1, 2, 3, 4)]
    value = n[0] * (1 << 24) + n[1] * (1 << 16) + n[2] * 256 + n[3]
    return F.when(text.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), value).when(text.isNotNull(), F.lit(0)).cast("bigint")


def ipv4_text(value: Column) -> Column:
    part = lambda k: F.shiftright(value, k).bitwiseAND(255).cast("string")
    return F.concat(part(24), F.lit("."), part(16), F.lit("."), part(8), F.lit("."), part(0))


def ipv6(text: Column) -> Column:
    """Address of eight groups as 32 hex digits, which sort like the number."""
    return F.array_join(F.transform(F.split(F.lower(text), ":"), lambda g: F.lpad(g, 4, "0")), "")


def uuid(text: Column) -> Column:
    """32 hex digits, or null."""
    digits = F.lower(F.regexp_replace(text, "[^0-9a-fA-F]", ""))
    return F.when(F.length(digits) == 32, digits)


def uuid_text(digits: Column) -> Column:
    return F.when(digits.isNotNull(), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def number(text: Column) -> Column:
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("double"), F.lit(0.0)))


def number_text(text: Column) -> Column:
    """Integral values without fraction or leading zeros, others as written."""
    x = number(text)
    return F.when((x == F.floor(x)) & (F.abs(x) < F.lit(9.2e18)), F.floor(x).cast("bigint").cast("string")).otherwise(text)


def date_days(text: Column) -> Column:
    """Days since 1970, or null for an impossible or earlier date."""
    d = F.unix_date(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return F.when(d >= 0, d)


def time_ms(text: Column) -> Column:
    """Milliseconds of the day of HH:mm:ss and an optional fraction, or null."""
    h, m, s = (F.substring(text, a, 2).try_cast("bigint") for a in (1, 4, 7))
    ms = F.rpad(F.substring(F.regexp_extract(text, r"^.{8}\.(\d+)", 1), 1, 3), 3, "0").cast("bigint")
    return F.when((h < 24) & (m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1000 + ms)


def timestamp_ms(text: Column) -> Column:
    """Milliseconds since 1970: without offset as UTC, with a numeric offset after a T form; else null."""
    clock = F.regexp_extract(text, r"^.{11}(\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    day = F.unix_date(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")).cast("bigint")
    base = day * _DAY + time_ms(clock)
    zone = F.regexp_replace(F.regexp_extract(text, r"([+-]\d{2}:?\d{2})$", 1), ":", "")
    shift = (F.substring(zone, 2, 2).try_cast("bigint") * 60 + F.substring(zone, 4, 2).try_cast("bigint")) * 60_000
    naive = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?$")
    aware = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{2}:?\d{2}$")
    return F.when(naive, base).when(aware, base - F.when(zone.startswith("-"), -shift).otherwise(shift))


def timestamp_text(text: Column) -> Column:
    """The moment to the second, with its offset as +hh:mm; what doesn't parse as written."""
    zone = F.regexp_replace(F.regexp_extract(text, r"([+-]\d{2}:?\d{2})$", 1), r"^(...)(\d\d)$", "$1:$2")
    zone = F.when(F.length(text) > 19, zone).otherwise(F.lit(""))
    return F.when(timestamp_ms(text).isNotNull(), F.concat(F.substring(text, 1, 19), zone)).otherwise(text)


def date_text(days: Column) -> Column:
    """Days since 1970 as yyyy-MM-dd."""
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")


def time_text(ms: Column) -> Column:
    """Milliseconds of the day as HH:mm:ss, with three digits more if they aren't zero."""
    part = lambda by, mod, n: F.lpad((F.floor(ms / by) % mod).cast("string"), n, "0")
    clock = F.concat_ws(":", part(3_600_000, 24, 2), part(60_000, 60, 2), part(1000, 60, 2))
    return F.when(ms % 1000 > 0, F.concat(clock, F.lit("."), part(1, 1000, 3))).when(ms.isNotNull(), clock)


def ipv6_text(digits: Column) -> Column:
    """32 hex digits in the shortest form: no leading zeros, :: for the first longest run of zero groups, dots in a mapped IPv4 address."""
    groups = [F.regexp_replace(F.substring(digits, k, 4), "^0{1,3}", "") for k in range(1, 33, 4)]
    plain = F.concat_ws(":", *groups)
    out = F.when(F.substring(digits, 1, 24) == "0" * 20 + "ffff", F.concat(F.lit("::ffff:"), ipv4_text(F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))))
    for n in range(8, 1, -1):
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
        out = out.when(plain.rlike(run), F.regexp_replace(plain, run, "$1::$2"))
    return F.when(digits.isNotNull(), out.otherwise(plain))


VALUES = {"timestamps": timestamp_ms, "log_levels": level, "ipv4": ipv4, "ipv6": ipv6, "uuids": uuid, "numbers": number, "dates": date_days, "times": time_ms}
#: Types of stored values.
STORED = {"timestamps": "bigint", "log_levels": "tinyint", "ipv4": "bigint", "ipv6": "string", "uuids": "string", "numbers": "double", "dates": "int", "times": "bigint", "emails": "string", "urls": "string", "paths": "string", "hex_values": "string"}
RENDERED = {"log_levels": level_name, "numbers": number_text, "uuids": lambda t: uuid_text(uuid(t)), "ipv4": lambda t: ipv4_text(ipv4(t)), "ipv6": lambda t: ipv6_text(ipv6(t)), "timestamps": timestamp_text, "dates": lambda t: F.coalesce(date_text(date_days(t)), t), "times": lambda t: F.coalesce(time_text(time_ms(t)), t)}


def literal(column: str, text: str):
    """The typed value of a filter's literal; ValueError if a column's literals must parse and it doesn't."""
    if column == "log_levels":
        up = {"WARNING": "WARN"}.get(text.upper(), text.upper())
        return LEVELS.index(up) if up in LEVELS else len(LEVELS) - 1
    if column == "ipv4":
        return int(ipaddress.IPv4Address(text))
    if column == "ipv6":
        return f"{int(ipaddress.IPv6Address(text)):032x}"
    if column == "uuids":
        digits = re.sub("[^0-9a-fA-F]", "", text).lower()
        if len(digits) != 32:
            raise ValueError(f"not a UUID: {text}")
        return digits
    if column == "numbers":
        try:
            return float(text)
        except ValueError:
            return 0.0
    if column in ("timestamps", "dates"):
        for form in FORMS:
            try:
                t = dt.datetime.strptime(text, form)
            except ValueError:
                continue
            ms = (t - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
            return ms if column == "timestamps" else ms // _DAY
        raise ValueError(f"not a timestamp: {text}")
    if column == "times":
        t = dt.time.fromisoformat(text)
        return ((t.hour * 60 + t.minute) * 60 + t.second) * 1000 + t.microsecond // 1000
    return text
