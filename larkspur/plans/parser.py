"""Recursive-descent parser of the dialect."""

from __future__ import annotations

from larkspur.errors import SqlError
from larkspur.plans import ast as A
from larkspur.plans.lexer import Token, statements

_RESERVED = frozenset("select from where group having order limit offset for join inner left right full cross on using union intersect except as when then else end and or not in is null case returning set values conflict do natural fetch window with".split())
_TYPES = {
    "int": "int", "int4": "int", "integer": "int", "bigint": "bigint", "int8": "bigint", "oid": "bigint", "float8": "double", "double": "double", "text": "string", "varchar": "string", "regtype": "string",
    "json": "json", "jsonb": "jsonb", "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary", "interval": "interval",
}


class Parser:
    def __init__(self, toks: list[Token]):
        self.toks, self.i = [*toks, Token("end", "")], 0

    # ---- helpers
    @property
    def cur(self) -> Token:
        return self.toks[self.i]

    def at(self, *words: str) -> bool:
        return all(self.toks[min(self.i + k, len(self.toks) - 1)].text == w and self.toks[min(self.i + k, len(self.toks) - 1)].kind in ("word", "op") for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError("42601", f"syntax error at {self.cur.text!r}, expected {' '.join(words)!r}")

    def name(self) -> str:
        t = self.cur
        if t.kind not in ("word", "quoted"):
            raise SqlError("42601", f"syntax error at {t.text!r}, expected a name")
        self.i += 1
        return t.text

    def dotted(self) -> list[str]:
        out = [self.name()]
        while self.take("."):
            out.append(self.name())
        return out

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def comma(self, f) -> list:
        out = [f()]
        while self.take(","):
            out.append(f())
        return out

    def no(self, what: str):
        raise SqlError("0A000", f"{what} is not supported")

    # ---- statements
    def statement(self):
        ctes = []
        if self.take("with"):
            if self.at("recursive"):
                self.no("WITH RECURSIVE")
            ctes = self.comma(self.cte)
        word = self.cur.text
        if word == "select":
            out = self.select()
        elif word == "insert":
            out = self.insert()
        elif word == "update":
            out = self.update()
        elif word == "delete":
            out = self.delete()
        elif ctes:
            raise SqlError("42601", f"syntax error at {word!r}")
        else:
            out = self.command()
        if ctes:
            out.ctes = ctes
        if self.cur.kind != "end":
            if self.cur.text in ("union", "intersect", "except"):
                self.no("set operation")
            raise SqlError("42601", f"syntax error at {self.cur.text!r}")
        return out

    def cte(self) -> A.Cte:
        name = self.name()
        columns = self.names() if self.at("(") else []
        self.need("as")
        if self.at("materialized") or self.at("not"):
            self.no("MATERIALIZED")
        self.need("(")
        word = self.cur.text
        body = {"select": self.select, "insert": self.insert, "update": self.update, "delete": self.delete}.get(word, lambda: self.no(f"{word} in WITH"))()
        self.need(")")
        return A.Cte(name, columns, body)

    def select(self) -> A.Select:
        self.need("select")
        out = A.Select([])
        if self.take("distinct"):
            out.distinct = True
            if self.at("on"):
                self.no("DISTINCT ON")
        self.take("all")
        out.items = self.comma(self.item)
        if self.take("from"):
            out.source = self.sources()
        if self.take("where"):
            out.where = self.expr()
        if self.take("group", "by"):
            out.group = self.comma(self.expr)
        if self.take("having"):
            out.having = self.expr()
        if self.take("order", "by"):
            out.order = self.comma(self.sort)
        while True:
            if self.take("limit"):
                out.limit = None if self.take("all") else self.expr()
            elif self.take("offset"):
                out.offset = self.expr()
                self.take("rows") or self.take("row")
            elif self.take("for", "update"):
                out.lock = "wait"
                if self.take("nowait"):
                    out.lock = "nowait"
                elif self.take("skip", "locked"):
                    out.lock = "skip"
            else:
                return out

    def item(self):
        if self.take("*"):
            return A.Star(), None
        e = self.expr()
        if self.take("as"):
            return e, self.name()
        if self.cur.kind == "quoted" or self.cur.kind == "word" and self.cur.text not in _RESERVED:
            return e, self.name()
        return e, None

    def sort(self) -> A.Sort:
        out = A.Sort(self.expr())
        if self.take("desc"):
            out.asc = False
        else:
            self.take("asc")
        if self.take("nulls", "first"):
            out.nulls_first = True
        elif self.take("nulls", "last"):
            out.nulls_first = False
        return out

    def sources(self):
        out = self.joined()
        while self.take(","):
            out = A.Join("cross", out, self.joined())
        return out

    def joined(self):
        out = self.source()
        while True:
            if self.take("cross", "join"):
                out = A.Join("cross", out, self.source())
                continue
            kind = None
            if self.take("join") or self.take("inner", "join"):
                kind = "inner"
            elif self.take("left", "join") or self.take("left", "outer", "join"):
                kind = "left"
            elif self.at("right") or self.at("full") or self.at("natural"):
                self.no(f"{self.cur.text.upper()} JOIN")
            if kind is None:
                return out
            right = self.source()
            if self.at("using"):
                self.no("USING")
            self.need("on")
            out = A.Join(kind, out, right, self.expr())

    def source(self):
        if self.take("("):
            if self.at("select"):
                q = self.select()
                self.need(")")
                self.take("as")
                return A.Derived(q, self.name())
            out = self.joined()
            self.need(")")
            return out
        name = self.dotted()
        return A.Table(name, self.alias())

    def alias(self) -> str | None:
        if self.take("as"):
            return self.name()
        if self.cur.kind == "quoted" or self.cur.kind == "word" and self.cur.text not in _RESERVED:
            return self.name()
        return None

    def returning(self):
        return self.comma(self.item) if self.take("returning") else None

    def insert(self) -> A.Insert:
        self.need("insert", "into")
        table = self.dotted()
        columns = self.names() if self.at("(") else None
        overriding = False
        if self.take("overriding"):
            self.take("system") or self.take("user")
            self.need("value")
            overriding = True
        rows = query = None
        if self.take("values"):
            rows = self.comma(self.row)
        elif self.take("default", "values"):
            rows = [[]]
        else:
            query = self.select()
        conflict = None
        if self.take("on", "conflict"):
            columns_, constraint = None, None
            if self.at("("):
                columns_ = self.names()
            elif self.take("on", "constraint"):
                constraint = self.name()
            self.need("do")
            if self.take("nothing"):
                conflict = A.Conflict(columns_, constraint, None)
            else:
                self.need("update", "set")
                sets = self.comma(self.assign)
                conflict = A.Conflict(columns_, constraint, sets, self.expr() if self.take("where") else None)
        return A.Insert(table, columns, rows, query, conflict, self.returning(), overriding)

    def row(self) -> list:
        self.need("(")
        out = self.comma(lambda: A.Default() if self.take("default") else self.expr())
        self.need(")")
        return out

    def assign(self):
        name = self.name()
        self.need("=")
        return name, A.Default() if self.take("default") else self.expr()

    def update(self) -> A.Update:
        self.need("update")
        table = A.Table(self.dotted(), self.alias())
        self.need("set")
        sets = self.comma(self.assign)
        source = self.sources() if self.take("from") else None
        where = self.expr() if self.take("where") else None
        return A.Update(table, sets, source, where, self.returning())

    def delete(self) -> A.Delete:
        self.need("delete", "from")
        table = A.Table(self.dotted(), self.alias())
        if self.at("using"):
            self.no("DELETE USING")
        where = self.expr() if self.take("where") else None
        return A.Delete(table, where, self.returning())

    # ---- DDL and session commands
    def command(self) -> A.Command:
        if self.take("create"):
            return self.create()
        if self.take("alter"):
            return self.alter()
        if self.take("drop"):
            return self.drop()
        if self.take("truncate"):
            self.take("table")
            return A.Command("truncate", {"table": self.dotted()})
        if self.take("begin") or self.take("start", "transaction"):
            return self.rest(A.Command("begin"))
        if self.take("commit") or self.take("end"):
            return self.rest(A.Command("commit"))
        if self.take("rollback"):
            if self.at("to"):
                self.no("savepoint")
            return self.rest(A.Command("rollback"))
        if self.at("savepoint") or self.at("release") or self.at("prepare"):
            self.no(self.cur.text)
        if self.take("set"):
            self.take("session") or self.take("local")
            name = "timezone" if self.take("time", "zone") else self.name()
            if name == "transaction":
                return self.rest(A.Command("set", {"name": "transaction_isolation", "value": "read committed"}))
            self.take("=") or self.take("to")
            values = []
            while self.cur.kind != "end":
                if not self.take(","):
                    sign = "-" if self.take("-") else ""
                    values.append(sign + self.cur.text)
                    self.i += 1
            return A.Command("set", {"name": name, "value": values if name == "search_path" else " ".join(values)})
        if self.take("show"):
            name = self.name()
            if name == "transaction":
                self.need("isolation", "level")
                name = "transaction_isolation"
            elif name == "time":
                self.need("zone")
                name = "timezone"
            return A.Command("show", {"name": name})
        self.no(f"statement {self.cur.text!r}")

    def rest(self, out):
        self.i = len(self.toks) - 1
        return out

    def if_not_exists(self) -> bool:
        return self.take("if", "not", "exists")

    def create(self) -> A.Command:
        if self.at("database"):
            self.no("CREATE DATABASE")
        if self.take("schema"):
            quiet = self.if_not_exists()
            return A.Command("create_schema", {"name": self.name(), "quiet": quiet})
        unique = self.take("unique")
        if self.take("index"):
            self.take("concurrently")
            quiet = self.if_not_exists()
            name = None if self.at("on") else self.name()
            self.need("on")
            table = self.dotted()
            if self.take("using"):
                self.name()
            columns = [c for c in self._index_columns()]
            if self.take("where"):
                self.expr()
            return A.Command("create_index", {"name": name, "table": table, "columns": columns, "unique": unique, "quiet": quiet})
        self.need("table")
        quiet = self.if_not_exists()
        table = self.dotted()
        columns, constraints = [], []
        self.need("(")
        while True:
            if self.at("constraint") or self.at("primary") or self.at("unique") or self.at("foreign") or self.at("check"):
                constraints.append(self.constraint())
            else:
                col, more = self.column()
                columns.append(col)
                constraints += more
            if not self.take(","):
                break
        self.need(")")
        return A.Command("create_table", {"table": table, "columns": columns, "constraints": constraints, "quiet": quiet})

    def _index_columns(self):
        self.need("(")
        while True:
            yield self.name()
            self.take("asc") or self.take("desc")
            if not self.take(","):
                break
        self.need(")")

    def column(self) -> tuple[dict, list]:
        name = self.name()
        col = {"name": name, "type": self.type(), "nullable": True, "default": None, "identity": None}
        more = []
        while True:
            cname = self.name() if self.take("constraint") else None
            if self.take("not", "null"):
                col["nullable"] = False
            elif self.take("null"):
                pass
            elif self.take("primary", "key"):
                col["nullable"] = False
                more.append({"kind": "primary", "name": cname, "columns": [name]})
            elif self.take("unique"):
                more.append({"kind": "unique", "name": cname, "columns": [name]})
            elif self.at("references"):
                more.append(self.references({"kind": "foreign", "name": cname, "columns": [name]}))
            elif self.take("check"):
                self.need("(")
                self.expr()
                self.need(")")
            elif self.take("default"):
                col["default"] = self.expr()
            elif self.take("generated"):
                always = self.take("always")
                if not always:
                    self.need("by", "default")
                self.need("as", "identity")
                ident = {"always": always, "start": 1, "step": 1}
                if self.take("("):
                    while not self.take(")"):
                        if self.take("start"):
                            self.take("with")
                            ident["start"] = self.integer()
                        elif self.take("increment"):
                            self.take("by")
                            ident["step"] = self.integer()
                        else:
                            self.no("identity option")
                col["identity"] = ident
                col["nullable"] = False
            else:
                return col, more

    def integer(self) -> int:
        sign = -1 if self.take("-") else 1
        t = self.cur
        if t.kind != "number":
            raise SqlError("42601", f"syntax error at {t.text!r}, expected a number")
        self.i += 1
        return sign * int(t.text)

    def constraint(self) -> dict:
        name = self.name() if self.take("constraint") else None
        if self.take("primary", "key"):
            return {"kind": "primary", "name": name, "columns": self.names()}
        if self.take("unique"):
            return {"kind": "unique", "name": name, "columns": self.names()}
        if self.take("check"):
            self.need("(")
            self.expr()
            self.need(")")
            return {"kind": "check", "name": name, "columns": []}
        self.need("foreign", "key")
        return self.references({"kind": "foreign", "name": name, "columns": self.names()})

    def references(self, out: dict) -> dict:
        self.need("references")
        out["target"] = self.dotted()
        out["to"] = self.names() if self.at("(") else None
        out["cascade"] = False
        while self.take("on"):
            what = self.name()
            act = self.name()
            if act == "no":
                self.need("action")
            elif act == "set":
                self.no("ON DELETE SET")
            if what == "delete":
                out["cascade"] = act == "cascade"
        return out

    def type(self) -> str:
        word = self.name()
        if word == "double":
            self.take("precision")
        if word == "timestamp":
            if self.take("with", "time", "zone"):
                word = "timestamptz"
            else:
                self.take("without", "time", "zone")
        if word == "character":
            self.need("varying")
            word = "varchar"
        if self.take("("):
            self.integer()
            self.need(")")
        if word not in _TYPES:
            raise SqlError("0A000", f"unsupported type {word}")
        return _TYPES[word]

    def alter(self) -> A.Command:
        if self.at("database"):
            self.no("ALTER DATABASE")
        if self.take("schema"):
            name = self.name()
            self.need("rename", "to")
            return A.Command("rename_schema", {"name": name, "to": self.name()})
        self.need("table")
        quiet_table = self.take("if", "exists")
        table = self.dotted()
        a = {"table": table, "quiet_table": quiet_table}
        if self.take("rename", "to"):
            return A.Command("rename_table", a | {"to": self.name()})
        if self.take("add"):
            if self.at("constraint") or self.at("primary") or self.at("unique") or self.at("foreign") or self.at("check"):
                return A.Command("add_constraint", a | {"constraint": self.constraint()})
            self.take("column")
            quiet = self.if_not_exists()
            col, more = self.column()
            return A.Command("add_column", a | {"column": col, "constraints": more, "quiet": quiet})
        self.need("drop")
        if self.take("constraint"):
            quiet = self.take("if", "exists")
            return A.Command("drop_constraint", a | {"name": self.name(), "quiet": quiet})
        self.take("column")
        quiet = self.take("if", "exists")
        return A.Command("drop_column", a | {"name": self.name(), "quiet": quiet})

    def drop(self) -> A.Command:
        what = self.name()
        if what not in ("table", "schema", "index"):
            self.no(f"DROP {what.upper()}")
        quiet = self.take("if", "exists")
        names = self.comma(self.dotted)
        cascade = self.take("cascade")
        self.take("restrict")
        return A.Command(f"drop_{what}", {"names": names, "quiet": quiet, "cascade": cascade})

    # ---- expressions, by rising precedence
    def expr(self):
        out = self.conj()
        while self.take("or"):
            out = A.Op("or", [out, self.conj()])
        return out

    def conj(self):
        out = self.neg()
        while self.take("and"):
            out = A.Op("and", [out, self.neg()])
        return out

    def neg(self):
        return A.Op("not", [self.neg()]) if self.take("not") else self.test()

    def test(self):
        out = self.sum()
        while True:
            if self.take("is", "not", "null"):
                out = A.Op("is not null", [out])
            elif self.take("is", "null"):
                out = A.Op("is null", [out])
            elif self.take("in"):
                out = self.in_(out, False)
            elif self.take("not", "in"):
                out = self.in_(out, True)
            elif self.at("like") or self.at("between") or self.at("exists") or self.at("ilike"):
                self.no(self.cur.text.upper())
            elif self.cur.kind == "op" and self.cur.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.cur.text
                self.i += 1
                if self.take("any"):
                    if op != "=":
                        self.no(f"{op} ANY")
                    self.need("(")
                    self.need("array", "[")
                    items = [] if self.at("]") else self.comma(self.expr)
                    self.need("]")
                    self.need(")")
                    out = A.InList(out, items)
                else:
                    out = A.Op("<>" if op == "!=" else op, [out, self.sum()])
            else:
                return out

    def in_(self, arg, negated):
        self.need("(")
        if self.at("select"):
            out = A.InQuery(arg, self.select(), negated)
        else:
            out = A.InList(arg, self.comma(self.expr), negated)
        self.need(")")
        return out

    def sum(self):
        out = self.product()
        while self.cur.kind == "op" and self.cur.text in ("+", "-", "||"):
            op = self.cur.text
            self.i += 1
            out = A.Op(op, [out, self.product()])
        return out

    def product(self):
        out = self.unary()
        while self.cur.kind == "op" and self.cur.text in ("*", "/"):
            op = self.cur.text
            self.i += 1
            out = A.Op(op, [out, self.unary()])
        return out

    def unary(self):
        if self.take("-"):
            return A.Op("neg", [self.unary()])
        self.take("+")
        out = self.primary()
        while self.take("::"):
            out = A.Cast(out, self.type())
        return out

    def primary(self):
        t = self.cur
        if t.kind == "number":
            self.i += 1
            whole = t.text.isdigit()
            return A.Lit(int(t.text) if whole else float(t.text), "int" if whole else "float")
        if t.kind == "string":
            self.i += 1
            return A.Lit(t.text, "string")
        if t.kind == "param":
            self.i += 1
            return A.Param(int(t.text[1:]))
        if self.take("("):
            out = A.SubQuery(self.select()) if self.at("select") else self.expr()
            self.need(")")
            return out
        if t.kind == "word":
            for word, value in (("true", True), ("false", False), ("null", None)):
                if self.take(word):
                    return A.Lit(value, "null" if value is None else "bool")
            if self.take("case"):
                operand = None if self.at("when") else self.expr()
                whens = []
                while self.take("when"):
                    c = self.expr()
                    self.need("then")
                    whens.append((c, self.expr()))
                default = self.expr() if self.take("else") else None
                self.need("end")
                return A.Case(operand, whens, default)
            if self.take("cast", "("):
                e = self.expr()
                self.need("as")
                out = A.Cast(e, self.type())
                self.need(")")
                return out
            if self.take("extract", "("):
                what = self.cur.text
                self.i += 1
                self.need("from")
                e = self.expr()
                self.need(")")
                return A.Func("date_part", [A.Lit(what, "string"), e])
            if t.text in ("current_timestamp", "current_date") and self.toks[self.i + 1].text != "(":
                self.i += 1
                return A.Func(t.text, [])
            if t.text in ("date", "timestamp", "timestamptz", "interval", "json", "jsonb", "bytea") and self.toks[self.i + 1].kind == "string":
                kind = self.type()
                s = self.cur.text
                self.i += 1
                return A.Cast(A.Lit(s, "string"), kind)
            if t.text == "exists":
                self.no("EXISTS")
        if t.kind == "word" and t.text in _RESERVED:
            raise SqlError("42601", f"syntax error at {t.text!r}")
        parts = self.dotted()
        if self.take("("):
            return self.call(parts[-1])
        return A.Col(parts)

    def call(self, name: str) -> A.Func:
        out = A.Func(name, [])
        if self.take("*"):
            out.args = [A.Star()]
        elif not self.at(")"):
            out.distinct = self.take("distinct")
            out.args = self.comma(self.expr)
        self.need(")")
        if self.take("over"):
            if not self.at("("):
                self.no("named window")
            self.need("(")
            part = self.comma(self.expr) if self.take("partition", "by") else []
            order = self.comma(self.sort) if self.take("order", "by") else []
            if not self.at(")"):
                self.no("window frame")
            self.need(")")
            out.over = A.Over(part, order)
        return out


def parse(sql: str) -> list:
    """Statements of a text."""
    return [Parser(t).statement() for t in statements(sql)]
