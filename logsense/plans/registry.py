"""All registered queries of the library proper, with their DuckDB counterparts."""

from __future__ import annotations

from logsense.plans import logs, texts

QUERIES = logs.QUERIES | texts.QUERIES
ORACLES = logs.ORACLES | texts.ORACLES
