"""Syntax trees of statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    value: Any
    kind: str = ""  # int, float, string, bool, null


@dataclass
class Col:
    parts: list[str]


@dataclass
class Param:
    index: int


@dataclass
class Star:
    pass


@dataclass
class Func:
    name: str
    args: list
    distinct: bool = False
    over: "Over | None" = None


@dataclass
class Over:
    partition: list
    order: list


@dataclass
class Op:
    name: str
    args: list


@dataclass
class Cast:
    arg: Any
    type: str


@dataclass
class Case:
    operand: Any
    whens: list
    default: Any


@dataclass
class InList:
    arg: Any
    items: list
    negated: bool = False


@dataclass
class InQuery:
    arg: Any
    query: "Select"
    negated: bool = False


@dataclass
class SubQuery:
    query: "Select"


@dataclass
class Default:
    pass


@dataclass
class Sort:
    expr: Any
    asc: bool = True
    nulls_first: bool | None = None


@dataclass
class Table:
    name: list[str]
    alias: str | None = None


@dataclass
class Derived:
    query: "Select"
    alias: str


@dataclass
class Join:
    kind: str
    left: Any
    right: Any
    on: Any = None


@dataclass
class Cte:
    name: str
    columns: list[str]
    body: Any


@dataclass
class Select:
    items: list
    source: Any = None
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    order: list = field(default_factory=list)
    limit: Any = None
    offset: Any = None
    lock: str | None = None  # wait, nowait, skip
    distinct: bool = False
    ctes: list = field(default_factory=list)


@dataclass
class Insert:
    table: list[str]
    columns: list[str] | None
    rows: list | None
    query: Select | None
    conflict: "Conflict | None" = None
    returning: list | None = None
    overriding: bool = False
    ctes: list = field(default_factory=list)


@dataclass
class Conflict:
    columns: list[str] | None
    constraint: str | None
    sets: list | None  # None: do nothing
    where: Any = None


@dataclass
class Update:
    table: Table
    sets: list
    source: Any = None
    where: Any = None
    returning: list | None = None
    ctes: list = field(default_factory=list)


@dataclass
class Delete:
    table: Table
    where: Any = None
    returning: list | None = None
    ctes: list = field(default_factory=list)


@dataclass
class Command:
    """A statement that is no query: its kind and its arguments."""

    kind: str
    args: dict = field(default_factory=dict)
