"""Errors with PostgreSQL's SQLSTATE codes."""

from __future__ import annotations

import re


class SqlError(Exception):
    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"{message} (SQLSTATE {sqlstate})")
        self.sqlstate, self.message = sqlstate, message


#: Spark's error classes whose SQLSTATE differs from PostgreSQL's.
_BY_CLASS = {"CAST_INVALID_INPUT": "22P02", "AMBIGUOUS_REFERENCE": "42702", "TABLE_OR_VIEW_NOT_FOUND": "42P01", "UNRESOLVED_COLUMN.WITH_SUGGESTION": "42703", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION": "42703", "MISSING_AGGREGATION": "42803", "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000", "CAST_OVERFLOW": "22003"}


_CLASS = re.compile(r"\[([A-Z][A-Z0-9_.]+)\] ([^\n]*?)(?: SQLSTATE: (\w{5}))?(?:;|\n|$)")
_OWN = re.compile(r"#(\w{5})#([^#\n]*)#")
#: Classes that only wrap another failure.
_WRAPPERS = frozenset(["TASK_WRITE_FAILED", "FAILED_EXECUTE_UDF"])


def from_spark(e: Exception) -> SqlError:
    """The error that a client of the dialect expects for one of Spark's, be it raised in a plan or in a task."""
    message = str(e)
    if own := _OWN.search(message):
        return SqlError(own[1], own[2])
    for name, text, state in _CLASS.findall(message):
        if name not in _WRAPPERS:
            return SqlError(_BY_CLASS.get(name) or state or "XX000", text)
    return SqlError("XX000", message.split("\n")[0])
