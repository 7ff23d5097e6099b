"""Schema changes: they edit the driver's catalog and, where rows matter, validate with a query."""

from __future__ import annotations

from larkspur.errors import SqlError
from larkspur.operators import constraints as K
from larkspur.sources.storage import Column, Constraint, TableMeta, Version, spark_type


def _split(session, name: list[str]) -> tuple[str, str]:
    schema = name[-2] if len(name) > 1 else session.create_schema()
    if schema not in session.db.schemas:
        raise SqlError("3F000", f"schema {schema!r} does not exist")
    return schema, name[-1]


def _constraint(session, meta: TableMeta, d: dict) -> Constraint:
    cols = d["columns"]
    for c in cols:
        if meta.column(c) is None:
            raise SqlError("42703", f"column {c!r} does not exist")
    default = {"primary": f"{meta.name}_pkey", "unique": f"{meta.name}_{'_'.join(cols)}_key", "foreign": f"{meta.name}_{'_'.join(cols)}_fkey", "check": f"{meta.name}_check"}[d["kind"]]
    out = Constraint(d["kind"], d["name"] or default, cols)
    if any(c.name == out.name for c in meta.constraints):
        raise SqlError("42710", f"constraint {out.name!r} for relation {meta.name!r} already exists")
    if d["kind"] == "primary":
        if meta.primary is not None:
            raise SqlError("42P16", f"multiple primary keys for table {meta.name!r} are not allowed")
        for c in cols:
            meta.column(c).nullable = False
    if d["kind"] == "foreign":
        parent = meta if d["target"] in ([meta.name], [meta.schema, meta.name]) else session.table(d["target"])
        if d["to"] is None and parent.primary is None:
            raise SqlError("42830", f"there is no primary key for referenced table {parent.name!r}")
        to = d["to"] or parent.primary.columns
        if len(to) != len(cols) or not any(k.columns == to or set(k.columns) == set(to) for k in parent.keys()):
            raise SqlError("42830", f"there is no unique constraint matching given keys for referenced table {parent.name!r}")
        for a, b in zip(cols, to):
            if spark_type(meta.column(a).type) != spark_type(parent.column(b).type):
                raise SqlError("42804", f"key columns {a!r} and {b!r} are of incompatible types")
        out.target, out.to, out.cascade = parent.id, to, d["cascade"]
    meta.constraints.append(out)
    return out


def create_table(session, a) -> None:
    schema, name = _split(session, a["table"])
    if session.find([schema, name]) is not None:
        if a["quiet"]:
            return
        raise SqlError("42P07", f"relation {name!r} already exists")
    columns = [Column(**c) for c in a["columns"]]
    if len({c.name for c in columns}) != len(columns):
        raise SqlError("42701", "column specified more than once")
    for c in columns:
        session.check_default(c)
    meta = TableMeta(session.db.next_id, schema, name, columns)
    for d in sorted(a["constraints"], key=lambda d: d["kind"] == "foreign"):
        _constraint(session, meta, d)
    session.db.next_id += 1
    session.db.tables[meta.id], session.db.versions[meta.id] = meta, Version()


def _table(session, a):
    found = session.find(a["table"])
    if found is None and not a.get("quiet_table"):
        raise SqlError("42P01", f"relation {'.'.join(a['table'])!r} does not exist")
    if found is not None:
        session.alone(found)
    return found


def add_column(session, a) -> None:
    meta = _table(session, a)
    if meta is None:
        return
    col = Column(**a["column"])
    if meta.column(col.name) is not None:
        if a["quiet"]:
            return
        raise SqlError("42701", f"column {col.name!r} of relation {meta.name!r} already exists")
    session.check_default(col)
    rows = session.read(meta)
    if not col.nullable and col.default is None and not rows.isEmpty():
        raise SqlError("23502", f"column {col.name!r} contains null values")
    if col.default is not None:
        col.fill = session.default_sql(col)  # what older parts are read with
    meta.add(col)
    for d in a["constraints"]:
        _validated(session, meta, d)


def _validated(session, meta, d) -> None:
    rows = session.read(meta)
    c = _constraint(session, meta, d)
    try:
        if c.kind == "primary":
            K.check_not_null(rows, meta)
        if c.kind in ("primary", "unique"):
            K.check_unique(rows, rows.limit(0), meta, [c])
        if c.kind == "foreign":
            K.check_foreign(rows, TableMeta(meta.id, meta.schema, meta.name, meta.columns, [c]), lambda fk: session.read_id(fk.target))
    except SqlError:
        meta.constraints.remove(c)
        raise


def add_constraint(session, a) -> None:
    meta = _table(session, a)
    if meta is not None:
        _validated(session, meta, a["constraint"])


def drop_constraint(session, a) -> None:
    meta = _table(session, a)
    if meta is None:
        return
    found = next((c for c in meta.constraints if c.name == a["name"]), None)
    if found is None:
        if a["quiet"]:
            return
        raise SqlError("42704", f"constraint {a['name']!r} of relation {meta.name!r} does not exist")
    if found.kind in ("primary", "unique") and any(set(fk.to) == set(found.columns) for _, fk in K.inbound(session.db, meta.id)):
        raise SqlError("2BP01", f"other objects depend on constraint {found.name!r}")
    meta.constraints.remove(found)


def drop_column(session, a) -> None:
    meta = _table(session, a)
    if meta is None:
        return
    name = a["name"]
    if meta.column(name) is None:
        if a["quiet"]:
            return
        raise SqlError("42703", f"column {name!r} of relation {meta.name!r} does not exist")
    if len(meta.columns) == 1:
        raise SqlError("0A000", "cannot drop the only column")
    used = any(name in c.columns for c in meta.constraints if c.kind in ("primary", "foreign")) or any(name in fk.to for _, fk in K.inbound(session.db, meta.id))
    if used:
        raise SqlError("2BP01", f"other objects depend on column {name!r}")
    meta.columns = [c for c in meta.columns if c.name != name]
    meta.constraints = [c for c in meta.constraints if name not in c.columns]
    meta.indexes = [i for i in meta.indexes if name not in i.columns]


def rename_table(session, a) -> None:
    meta = _table(session, a)
    if meta is None:
        return
    if session.find([meta.schema, a["to"]]) is not None:
        raise SqlError("42P07", f"relation {a['to']!r} already exists")
    meta.name = a["to"]


def rename_schema(session, a) -> None:
    if a["name"] not in session.db.schemas:
        raise SqlError("3F000", f"schema {a['name']!r} does not exist")
    if a["to"] in session.db.schemas:
        raise SqlError("42P06", f"schema {a['to']!r} already exists")
    session.db.schemas[session.db.schemas.index(a["name"])] = a["to"]
    for t in session.db.tables.values():
        if t.schema == a["name"]:
            t.schema = a["to"]


def drop_table(session, a) -> None:
    metas = []
    for name in a["names"]:
        meta = session.find(name)
        if meta is None and not a["quiet"]:
            raise SqlError("42P01", f"table {'.'.join(name)!r} does not exist")
        if meta is not None:
            metas.append(meta)
    ids = {m.id for m in metas}
    for meta in metas:
        session.alone(meta)
        if any(t.id not in ids for t, _ in K.inbound(session.db, meta.id)):
            raise SqlError("2BP01", f"cannot drop table {meta.name!r} because other objects depend on it")
    for i in ids:
        del session.db.tables[i], session.db.versions[i]
        session.db.counters.pop(i, None)
        session.pending.pop(i, None)


def create_schema(session, a) -> None:
    if a["name"] in session.db.schemas:
        if a["quiet"]:
            return
        raise SqlError("42P06", f"schema {a['name']!r} already exists")
    session.db.schemas.append(a["name"])


def drop_schema(session, a) -> None:
    for (name,) in a["names"]:
        if name not in session.db.schemas:
            if a["quiet"]:
                continue
            raise SqlError("3F000", f"schema {name!r} does not exist")
        inside = [[t.schema, t.name] for t in session.db.tables.values() if t.schema == name]
        if inside and not a["cascade"]:
            raise SqlError("2BP01", f"cannot drop schema {name!r} because other objects depend on it")
        if inside:
            drop_table(session, {"names": inside, "quiet": True})
        session.db.schemas.remove(name)


def create_index(session, a) -> None:
    meta = _table(session, a)
    name = a["name"] or f"{meta.name}_{'_'.join(a['columns'])}_idx"
    if any(i.name == name for t in session.db.tables.values() for i in t.indexes):
        if a["quiet"]:
            return
        raise SqlError("42P07", f"relation {name!r} already exists")
    for c in a["columns"]:
        if meta.column(c) is None:
            raise SqlError("42703", f"column {c!r} does not exist")
    index = Constraint("unique" if a["unique"] else "index", name, a["columns"], index=True)
    if a["unique"]:
        rows = session.read(meta)
        K.check_unique(rows, rows.limit(0), meta, [index])
    meta.indexes.append(index)


def drop_index(session, a) -> None:
    for name in a["names"]:
        for t in session.db.tables.values():
            hit = [i for i in t.indexes if i.name == name[-1]]
            if hit:
                t.indexes.remove(hit[0])
                break
        else:
            if not a["quiet"]:
                raise SqlError("42704", f"index {name[-1]!r} does not exist")


def truncate(session, a) -> None:
    meta = _table(session, a)
    if any(t.id != meta.id for t, _ in K.inbound(session.db, meta.id)):
        raise SqlError("0A000", "cannot truncate a table referenced in a foreign key constraint")
    session.db.versions[meta.id] = Version()
    session.pending.pop(meta.id, None)
