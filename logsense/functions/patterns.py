"""The token patterns, in the order in which alternatives are tried."""

from __future__ import annotations

# Name and pattern of each token type, most specific first.
PATTERNS = [
    ("TIMESTAMP", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("UUID", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("URL", r"""https?://[^\s<>"']+"""),
    ("IPV6", r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"),
    ("IPV4", r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"),
    ("DATE", r"\d{4}-\d{2}-\d{2}"),
    ("TIME", r"\d{2}:\d{2}:\d{2}(?:\.\d+)?"),
    ("PATH", r"(?:/[a-zA-Z0-9._-]+)+/?"),
    ("HEX", r"0x[0-9a-fA-F]+"),
    ("LOGLEVEL", r"(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE|CRITICAL)"),
    ("NUMBER", r"\d+(?:\.\d+)?"),
]
TYPES = [name for name, _ in PATTERNS]
#: One pattern with a group for each type.
FUSED = "|".join(f"({p})" for _, p in PATTERNS)
#: Types that are tried only where a run of their first characters begins, or where the last match ended: inside
#: the run they could only match what they match from its start. Saves a second look at every word.
_RUNS = {"EMAIL": r"(?:\G|(?<![a-zA-Z0-9._%+-]))", "HEX": "(?=0x)", "URL": "(?=http)", "PATH": "(?=/)", "LOGLEVEL": "(?=[DIWEFTC])"}
#: FUSED for Java's regular expressions.
FUSED_FAST = "|".join(f"({_RUNS.get(name, '')}{p})" for name, p in PATTERNS)
#: The same without groups, for engines that extract whole matches.
FUSED_PLAIN = "|".join(f"(?:{p})" for _, p in PATTERNS)

# Types that the priority extractor matches between word boundaries.
_BOUNDED = {"DATE", "TIME", "IPV4", "IPV6", "UUID", "LOGLEVEL", "NUMBER", "HEX", "EMAIL"}
#: Patterns of the priority extractor; the list order is its priority.
BY_PRIORITY = [(name, rf"\b{p}\b" if name in _BOUNDED else p) for name, p in PATTERNS]
#: What a text must contain if a type occurs in it, cheap to look for: one of some strings, or an expression that
#: begins with a rare character.
REQUIRED = {
    "TIMESTAMP": r"-[0-9]{2}[T ][0-9]{2}:", "UUID": r"-[0-9a-fA-F]{4}-", "EMAIL": ["@"], "URL": ["http"], "IPV6": r":[0-9a-fA-F]{1,4}:", "IPV4": r"\.[0-9]{1,3}\.", "DATE": r"-[0-9]{2}-",
    "TIME": r":[0-9]{2}:", "PATH": ["/"], "HEX": ["0x"], "LOGLEVEL": ["DEBUG", "INFO", "WARN", "ERROR", "FATAL", "TRACE", "CRITICAL"], "NUMBER": "[0-9]",
}

# Column name of each token type in a log table.
COLUMNS = {
    "timestamps": "TIMESTAMP", "ipv4": "IPV4", "ipv6": "IPV6", "log_levels": "LOGLEVEL", "numbers": "NUMBER", "uuids": "UUID",
    "emails": "EMAIL", "urls": "URL", "paths": "PATH", "dates": "DATE", "times": "TIME", "hex_values": "HEX",
}
# Log levels in ascending order.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL", "UNKNOWN"]
