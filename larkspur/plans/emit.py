"""From syntax trees to Spark SQL. Catalyst plans and optimizes what comes out."""

from __future__ import annotations

import datetime as dt
import re

from larkspur.errors import SqlError
from larkspur.functions import dialect
from larkspur.plans import ast as A


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(v) -> str:
    """A Python value as a typed literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v) if -(2**31) <= v < 2**31 else f"{v}L"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, bytes):
        return f"X'{v.hex()}'"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP_NTZ '{v}'" if v.tzinfo is None else f"TIMESTAMP '{v}'"
    if isinstance(v, dt.date):
        return f"DATE '{v}'"
    return text(str(v))


_INTERVAL = re.compile(r"\s*([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|min|second|sec|millisecond|microsecond)s?\s*$", re.I)
_MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "min": 60_000_000, "second": 1_000_000, "sec": 1_000_000, "millisecond": 1000, "microsecond": 1}


def interval(s: str) -> str:
    m = _INTERVAL.match(s)
    if not m:
        raise SqlError("22007", f"invalid interval {s!r}")
    micros = round(float(m[1]) * _MICROS[m[2].lower()])
    return f"make_dt_interval(0, 0, 0, CAST({micros} AS DECIMAL(27, 6)) / 1000000)"


_HEX_MARK = r"^\\{1,2}x"
_HEX = _HEX_MARK + "([0-9a-fA-F]{2})*$"


class Emitter:
    """Writes one statement. `resolve` turns a table name into a temporary view's name; `session` gives session functions."""

    def __init__(self, resolve, session, params=()):
        self.resolve, self.session, self.params = resolve, session, params
        self.rename = None  # hook for column references
        self.leaf = None  # hook for the tables of a source

    # ---- expressions
    def e(self, x) -> str:
        return getattr(self, f"_{type(x).__name__.lower()}")(x)

    def _lit(self, x):
        if x.kind == "int" and not -(2**31) <= x.value < 2**31:
            return f"{x.value}L"
        if x.kind == "float":
            return f"{x.value!r}D"
        return literal(x.value)

    def _param(self, x):
        if not 1 <= x.index <= len(self.params):
            raise SqlError("08P01", f"no value for parameter ${x.index}")
        return literal(self.params[x.index - 1])

    def _col(self, x):
        if self.rename:
            return self.rename(x.parts)
        return ".".join(map(quote, x.parts[-2:]))

    def _star(self, x):
        return "*"

    def _default(self, x):
        raise SqlError("42601", "DEFAULT is not allowed here")

    def _cast(self, x):
        if x.type == "interval":
            if isinstance(x.arg, A.Lit) and x.arg.kind == "string":
                return interval(x.arg.value)
            return f"CAST({self.e(x.arg)} AS INTERVAL DAY TO SECOND)"
        v = self.e(x.arg)
        if x.type in ("json", "jsonb"):
            bad = dialect.fail("22P02", "invalid input syntax for type json")
            return f"CASE WHEN {v} IS NULL OR try_parse_json(CAST({v} AS STRING)) IS NOT NULL THEN CAST({v} AS STRING) ELSE {bad} END"
        if x.type == "string":
            return self.as_text(x.arg)
        if x.type == "binary":
            return self.as_bytes(v)
        return f"CAST({v} AS {x.type})"

    @staticmethod
    def as_bytes(v: str) -> str:
        """Bytes as they are; a text's own bytes, or those that it spells after \\x."""
        bad = dialect.fail("22001", "invalid input syntax for type bytea")
        own = f"CAST({v} AS STRING)"
        hexed = f"CASE WHEN {own} RLIKE {text(_HEX)} THEN unhex(regexp_replace({own}, {text(_HEX_MARK)}, '')) ELSE {bad} END"
        return f"CASE WHEN {v} IS NULL OR typeof({v}) = 'binary' THEN CAST({v} AS BINARY) WHEN {own} RLIKE {text(_HEX_MARK)} THEN {hexed} ELSE CAST({own} AS BINARY) END"

    def as_text(self, x) -> str:
        """Text form of a value; booleans are t and f."""
        v = self.e(x)
        if self.is_bool(x):
            return f"CASE {v} WHEN true THEN 't' WHEN false THEN 'f' END"
        if isinstance(x, A.Lit) and x.kind == "string":
            return v
        return f"CASE typeof({v}) WHEN 'boolean' THEN CASE CAST({v} AS STRING) WHEN 'true' THEN 't' WHEN 'false' THEN 'f' END WHEN 'double' THEN regexp_replace(CAST({v} AS STRING), '\\\\.0$', '') ELSE CAST({v} AS STRING) END"

    @staticmethod
    def is_bool(x) -> bool:
        return isinstance(x, A.InList | A.InQuery) or isinstance(x, A.Lit) and x.kind == "bool" or isinstance(x, A.Op) and x.name in ("and", "or", "not", "=", "<>", "<", "<=", ">", ">=", "is null", "is not null")

    def _op(self, x):
        if x.name == "neg":
            return f"(- {self.e(x.args[0])})"
        if x.name == "not":
            return f"(NOT {self.e(x.args[0])})"
        if x.name.startswith("is"):
            return f"({self.e(x.args[0])} {x.name.upper()})"
        if x.name == "||":
            return f"concat({', '.join(self.as_text(a) for a in x.args)})"
        a, b = (self.e(y) for y in x.args)
        return f"({a} {x.name.upper()} {b})"

    def _case(self, x):
        head = f" {self.e(x.operand)}" if x.operand is not None else ""
        whens = " ".join(f"WHEN {self.e(c)} THEN {self.e(r)}" for c, r in x.whens)
        tail = f" ELSE {self.e(x.default)}" if x.default is not None else ""
        return f"CASE{head} {whens}{tail} END"

    def _inlist(self, x):
        if not x.items:
            return "false" if not x.negated else "true"
        return f"({self.e(x.arg)} {'NOT ' * x.negated}IN ({', '.join(map(self.e, x.items))}))"

    def _inquery(self, x):
        return f"({self.e(x.arg)} {'NOT ' * x.negated}IN ({self.select(x.query)}))"

    def _subquery(self, x):
        q = x.query
        if q.source is None and len(q.items) == 1 and q.where is None:  # an expression in disguise
            return f"({self.e(q.items[0][0])})"
        if len(q.items) != 1:
            raise SqlError("42601", "subquery must return only one column")
        return f"({self.select(q)})"

    def _func(self, x):
        if x.over is not None:
            if x.name != "row_number" or x.args:
                raise SqlError("0A000", f"window function {x.name} is not supported")
            part = f"PARTITION BY {', '.join(map(self.e, x.over.partition))} " if x.over.partition else ""
            order = self.order(x.over.order) if x.over.order else "ORDER BY NULL"
            return f"CAST(row_number() OVER ({part}{order}) AS BIGINT)"
        if x.name in dialect.AGGREGATES:
            if x.args and isinstance(x.args[0], A.Star):
                if x.name != "count":
                    raise SqlError("42601", f"{x.name}(*) is not supported")
                return "count(*)"
            if len(x.args) != 1:
                raise SqlError("42883", f"wrong number of arguments for {x.name}")
            v = self.e(x.args[0])
            return f"{x.name}({'DISTINCT ' * x.distinct}{v})"
        if x.name == "row_number":
            raise SqlError("42809", "row_number needs OVER")
        if x.name in dialect.SESSION:
            return self.session(x.name, x.args)
        return dialect.scalar(x.name, [self.e(a) for a in x.args])

    # ---- queries
    @staticmethod
    def title(x) -> str:
        if isinstance(x, A.Col):
            return x.parts[-1]
        if isinstance(x, A.Cast):
            return Emitter.title(x.arg)
        if isinstance(x, A.Func):
            return x.name
        if isinstance(x, A.Case):
            return "case"
        return "?column?"

    def items(self, items) -> str:
        return ", ".join("*" if isinstance(x, A.Star) else f"{self.e(x)} AS {quote(alias or self.title(x))}" for x, alias in items)

    def order(self, sorts, items=()) -> str:
        out = []
        for s in sorts:
            if isinstance(s.expr, A.Lit) and s.expr.kind == "int" and items and not 1 <= s.expr.value <= max(len(items), 1) and not any(isinstance(x, A.Star) for x, _ in items):
                raise SqlError("42P10", f"ORDER BY position {s.expr.value} is not in select list")
            first = (not s.asc) if s.nulls_first is None else s.nulls_first
            out.append(f"{self.e(s.expr)} {'ASC' if s.asc else 'DESC'} NULLS {'FIRST' if first else 'LAST'}")
        return "ORDER BY " + ", ".join(out)

    def source(self, x) -> str:
        if self.leaf is not None and not isinstance(x, A.Join):
            return self.leaf(x)
        if isinstance(x, A.Table):
            return f"{quote(self.resolve(x.name))} AS {quote(x.alias or x.name[-1])}"
        if isinstance(x, A.Derived):
            return f"({self.select(x.query)}) AS {quote(x.alias)}"
        if x.kind == "cross":
            return f"{self.source(x.left)} CROSS JOIN {self.source(x.right)}"
        left, right = self.source(x.left), self.source(x.right)
        if isinstance(x.right, A.Join):
            right = f"({right})"
        return f"{left} {x.kind.upper()} JOIN {right} ON {self.e(x.on)}"

    def count(self, x, what: str) -> int:
        """A limit or offset: a number or a parameter, perhaps cast."""
        while isinstance(x, A.Cast):
            x = x.arg
        sign = 1
        if isinstance(x, A.Op) and x.name == "neg":
            sign, x = -1, x.args[0]
        v = self.params[x.index - 1] if isinstance(x, A.Param) and x.index <= len(self.params) else x.value if isinstance(x, A.Lit) else None
        if isinstance(v, bool) or not isinstance(v, int):
            try:
                v = int(v)
            except (TypeError, ValueError):
                raise SqlError("0A000", f"{what} must be a number or a parameter") from None
        if sign * v < 0:
            raise SqlError("2201W" if what == "LIMIT" else "2201X", f"{what} must not be negative")
        return sign * v

    def select(self, q: A.Select, extra: str = "", paged: bool = True) -> str:
        """extra: more select items; paged: with limit and offset."""
        out = [f"SELECT {'DISTINCT ' * q.distinct}{self.items(q.items)}{extra}"]
        if q.source is not None:
            out.append(f"FROM {self.source(q.source)}")
        if q.where is not None:
            out.append(f"WHERE {self.e(q.where)}")
        if q.group:
            out.append(f"GROUP BY {', '.join(map(self.e, q.group))}")
        if q.having is not None:
            out.append(f"HAVING {self.e(q.having)}")
        if q.order:
            out.append(self.order(q.order, q.items))
        if paged and q.limit is not None and not (isinstance(q.limit, A.Lit) and q.limit.value is None):
            out.append(f"LIMIT {self.count(q.limit, 'LIMIT')}")
        if paged and q.offset is not None:
            out.append(f"OFFSET {self.count(q.offset, 'OFFSET')}")
        return " ".join(out)


def references(x, found: set[str]) -> set[str]:
    """Unqualified table names that a tree mentions."""
    if isinstance(x, A.Table):
        if len(x.name) == 1:
            found.add(x.name[0])
    elif isinstance(x, list | tuple):
        for y in x:
            references(y, found)
    elif hasattr(x, "__dataclass_fields__"):
        for k in x.__dataclass_fields__:
            v = getattr(x, k)
            if isinstance(x, A.Insert | A.Update | A.Delete) and k == "table":
                continue
            references(v, found)
    return found


def ordered_ctes(ctes: list[A.Cte]) -> list[A.Cte]:
    """CTEs so that each comes after those it mentions; forward references are allowed, cycles are not."""
    by = {}
    for c in ctes:
        if c.name in by:
            raise SqlError("42712", f"WITH query name {c.name!r} specified more than once")
        by[c.name] = c
    out, state = [], {}

    def visit(c):
        if state.get(c.name) == 1:
            raise SqlError("0A000", "recursive WITH is not supported")
        if c.name in state:
            return
        state[c.name] = 1
        for n in sorted(references(c.body, set()) & by.keys()):
            visit(by[n])
        state[c.name] = 2
        out.append(c)

    for c in ctes:
        visit(c)
    return out
