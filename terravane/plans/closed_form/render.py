"""SQL for DuckDB from texts with three macros.

``{t:name}`` is a base table, ``{seq:n}`` the integers 0..n-1 in a column i, and
``{each:n:k}`` after a relation repeats its rows for k from 0 to n, n included.
"""

from __future__ import annotations

import re

_TABLE, _SEQ, _EACH = re.compile(r"\{t:(\w+)\}"), re.compile(r"\{seq:([^}]+)\}"), re.compile(r"\{each:([^}:]+):(\w+)\}")


def for_duckdb(plan: str) -> str:
    plan = _EACH.sub(lambda m: f", unnest(range(0, CAST({m[1]} AS BIGINT) + 1)) AS each_{m[2]}({m[2]})", plan)
    return _SEQ.sub(lambda m: f"(SELECT range AS i FROM range({m[1]}))", _TABLE.sub(lambda m: m[1], plan))
