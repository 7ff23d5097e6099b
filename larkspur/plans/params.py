"""Types of a statement's parameters, from where they stand."""

from __future__ import annotations

import datetime as dt

from larkspur.plans import ast as A

#: A value of each type, to plan a statement with before its parameters are known.
SAMPLES = {"int": 1, "bigint": 1, "double": 1.0, "boolean": True, "string": "", "binary": b"", "date": dt.date(2000, 1, 1), "timestamp": dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc), "timestamp_ntz": dt.datetime(2000, 1, 1), "interval": "1 day", "json": "{}", "jsonb": "{}"}

_COMPARES = frozenset(["=", "<>", "<", "<=", ">", ">="])


def types(tree, session) -> list[str | None]:
    """Type names by parameter: a cast's, the compared or assigned column's, or that of a limit."""
    found: dict[int, str | None] = {}
    tables: list = []

    def column(x) -> str | None:
        if isinstance(x, A.Cast):
            return x.type
        if not isinstance(x, A.Col):
            return None
        for names, meta in tables:
            if (len(x.parts) == 1 or x.parts[-2] in names) and meta.column(x.parts[-1]) is not None:
                return meta.column(x.parts[-1]).type
        return None

    def hint(x, kind: str | None) -> None:
        if isinstance(x, A.Param) and kind and not found.get(x.index):
            found[x.index] = kind

    def known(name: list[str], alias: str | None = None) -> None:
        meta = session.find(name)
        if meta is not None:
            tables.append(({alias or name[-1], name[-1]}, meta))

    def gather(x) -> None:  # tables of the whole statement first
        if isinstance(x, A.Table):
            known(x.name, x.alias)
        elif isinstance(x, A.Insert):
            known(x.table)
        each(x, gather)

    def each(x, f) -> None:
        if isinstance(x, list | tuple):
            for y in x:
                f(y)
        else:
            for k in getattr(x, "__dataclass_fields__", ()):
                f(getattr(x, k))

    def walk(x) -> None:
        if isinstance(x, A.Param):
            found.setdefault(x.index, None)
        elif isinstance(x, A.Cast):
            hint(x.arg, x.type)
        elif isinstance(x, A.Op) and x.name in _COMPARES:
            hint(x.args[0], column(x.args[1]))
            hint(x.args[1], column(x.args[0]))
        elif isinstance(x, A.InList):
            for y in x.items:
                hint(y, column(x.arg))
        elif isinstance(x, A.Select):
            hint(x.limit, "bigint")
            hint(x.offset, "bigint")
        elif isinstance(x, A.Insert):
            meta = session.find(x.table)
            names = x.columns or ([c.name for c in meta.columns] if meta else [])
            for row in x.rows or []:
                for name, y in zip(names, row):
                    hint(y, meta.column(name).type if meta and meta.column(name) else None)
        elif isinstance(x, A.Update):
            meta = session.find(x.table.name)
            for name, y in x.sets:
                hint(y, meta.column(name).type if meta and meta.column(name) else None)
        each(x, walk)

    gather(tree)
    walk(tree)
    return [found.get(k) for k in range(1, max(found, default=0) + 1)]
