"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

from larkspur.errors import SqlError


class Token(NamedTuple):
    kind: str  # word, quoted, string, number, param, op, end
    text: str


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>[eE]?'(?:[^']|'')*')
    |(?P<dollar>\$(?P<tag>\w*)\$(?P<body>.*?)\$(?P=tag)\$)
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<param>\$\d+)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>[^\W\d][\w$]*)
    |(?P<op>::|<>|!=|<=|>=|\|\||[-+*/<>=(),.;\[\]])""",
    re.X | re.S,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError("42601", f"syntax error at {sql[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("tag", "body") else "dollar"
        if kind == "space":
            continue
        text = m[0]
        if kind == "string":
            text = text.lstrip("eE")[1:-1].replace("''", "'")
        elif kind == "dollar":
            kind, text = "string", m["body"]
        elif kind == "quoted":
            text = text[1:-1].replace('""', '"')
        elif kind == "word":
            text = text.lower()
        out.append(Token(kind, text))
    return out


def statements(sql: str) -> list[list[Token]]:
    """Tokens of each statement; empty ones are left out."""
    out: list[list[Token]] = [[]]
    for t in tokens(sql):
        if t == Token("op", ";"):
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]
