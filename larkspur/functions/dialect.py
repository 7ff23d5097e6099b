"""Spark SQL text of the dialect's scalar and aggregate functions."""

from __future__ import annotations

from larkspur.errors import SqlError

AGGREGATES = frozenset("count sum avg min max bool_and".split())


def fail(state: str, message: str) -> str:
    return f"raise_error('#{state}#{message}#')"


def _ln(a):
    return f"CASE WHEN {a[0]} <= 0 THEN {fail('2201E', 'cannot take logarithm of a number that is not positive')} ELSE ln({a[0]}) END"


def _log(a):
    bad = fail("2201E", "cannot take logarithm of a number that is not positive")
    if len(a) == 1:
        return f"CASE WHEN {a[0]} <= 0 THEN {bad} ELSE log10({a[0]}) END"
    return f"CASE WHEN {a[0]} <= 0 OR {a[1]} <= 0 THEN {bad} WHEN {a[0]} = 1 THEN {fail('22012', 'division by zero')} ELSE log({a[0]}, {a[1]}) END"


def _epoch(a):
    if a[0].strip("'").lower() != "epoch":
        raise SqlError("0A000", f"date_part field {a[0]} is not supported")
    return f"(unix_micros(CAST({a[1]} AS TIMESTAMP)) / 1e6D)"


def _greatest(a):
    if len(a) < 2:
        raise SqlError("42601", "greatest needs two arguments")
    return f"greatest({', '.join(a)})"


#: name -> (least arguments, most, how to write it)
SCALARS = {
    "coalesce": (1, 99, lambda a: f"coalesce({', '.join(a)})"),
    "upper": (1, 1, lambda a: f"upper({a[0]})"),
    "lower": (1, 1, lambda a: f"lower({a[0]})"),
    "length": (1, 1, lambda a: f"length({a[0]})"),
    "char_length": (1, 1, lambda a: f"length({a[0]})"),
    "abs": (1, 1, lambda a: f"abs({a[0]})"),
    "ln": (1, 1, _ln),
    "log": (1, 2, _log),
    "greatest": (1, 99, _greatest),
    "date_part": (2, 2, _epoch),
    "pg_table_is_visible": (1, 1, lambda a: "true"),
}

#: Filled in by the session when a statement is bound.
SESSION = frozenset("now current_timestamp transaction_timestamp statement_timestamp clock_timestamp current_date current_schema current_schemas current_database version pg_advisory_lock pg_advisory_unlock".split())


def scalar(name: str, args: list[str]) -> str:
    if name not in SCALARS:
        raise SqlError("42883", f"unsupported function {name}")
    least, most, write = SCALARS[name]
    if not least <= len(args) <= most:
        raise SqlError("42883", f"wrong number of arguments for {name}")
    return write(args)
