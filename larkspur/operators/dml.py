"""INSERT, UPDATE and DELETE over immutable table versions.

A statement computes the rows it adds and the ids of the rows it removes as DataFrames, checks constraints against
them, writes both as new files and hands the change to the session, which swaps pointers when the transaction ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import SqlError
from larkspur.operators import constraints as K
from larkspur.plans import ast as A
from larkspur.plans.emit import quote, text
from larkspur.sources.storage import ROW_ID, TableMeta, Version, spark_type


def _c(name: str):
    return F.col(f"`{name}`")


def _store(session, meta: TableMeta, added: DataFrame | None, gone: str | None) -> DataFrame | None:
    """Write the added rows and note the change in the session; gives back the added rows as stored. gone: the file of the ids that go.

    Row ids follow __ord, the order of the input: a monotonically increasing id, so its high bits tell how many ids to set aside.
    """
    st = session.storage
    parts, out = (), None
    if added is not None:
        last = added.agg(F.max("__ord")).first()[0] or 0
        base = session.next_row_ids((last >> 33) + 1)
        parts = (st.add(meta, added.withColumn(ROW_ID, F.lit(base) + F.col("__ord"))),)
        out = st.read(meta, Version(parts))
    session.note(meta.id, Version(parts, () if gone is None else (gone,)))
    return out


def _lock(session, meta: TableMeta, ids: DataFrame) -> str:
    """Write down the ids of rows that a change takes away; until the transaction ends they are this session's.

    Fails if another session holds one of them. Both sides are files, so the number of rows does not matter. The
    table's latch is held, so nobody else locks meanwhile.
    """
    st, locks = session.storage, session.engine.locks
    path = st.write(ids.select(ROW_ID))
    held = [p for _, p in locks.files_of_others(session, meta.id)]
    single = locks.rows_of_others(session, meta.id)
    others = ([st.ids(held)] if held else []) + ([session.spark.createDataFrame([(r,) for r in single], f"{ROW_ID} long")] if single else [])
    for df in others:
        if not st.ids([path]).join(df, ROW_ID, "left_semi").isEmpty():
            raise SqlError("55P03", f"could not obtain lock on row in relation {meta.name!r}")
    locks.take_file(session, meta.id, path)
    return path


def _uncommitted(session, meta: TableMeta) -> DataFrame | None:
    """Rows that other sessions have added and not yet committed; their keys are taken."""
    out = None
    for v in session.others(meta.id):
        if v.parts:
            rows = session.storage.read(meta, v)
            out = rows if out is None else out.union(rows)
    return out


def _taken(session, meta: TableMeta, visible: DataFrame) -> DataFrame:
    """Rows whose keys a new row must not have."""
    more = _uncommitted(session, meta)
    return visible if more is None else visible.union(more.select(*visible.columns))


def _parents(session, meta: TableMeta, *now: DataFrame):
    """How a foreign key check reads tables: the changed one as it will be, for keys that point to itself; others without rows that another session is about to delete."""
    names = [c.name for c in meta.columns]

    def read(fk) -> DataFrame:
        if fk.target == meta.id:
            out = now[0].select(*map(_c, names))
            for df in now[1:]:
                out = out.union(df.select(*map(_c, names)))
            return out
        out = session.read_id(fk.target)
        for v in session.others(fk.target):
            if not v.deletes:
                continue
            parent = session.db.tables[fk.target]
            ids = session.storage.ids(v.deletes)
            stays = out.join(ids, ROW_ID, "left_anti").select(*out.columns)
            if v.parts:  # rows that it changes keep their keys
                stays = stays.union(out.join(ids, ROW_ID, "left_semi").select(*out.columns).join(session.storage.read(parent, v).select(*map(_c, fk.to)), fk.to, "left_semi").select(*out.columns))
            out = stays
        return out

    return read


def returning(session, items, rows: DataFrame, alias: str, emitter, extra: dict | None = None) -> DataFrame | None:
    """rows: the table's columns; extra: (qualifier, column) -> hidden column of a joined source."""
    if items is None:
        return None
    view = session.view(rows.drop(ROW_ID) if ROW_ID in rows.columns else rows)
    hidden = set((extra or {}).values())

    def rename(parts):
        if len(parts) > 1 and parts[-2] != alias and extra and (parts[-2], parts[-1]) in extra:
            return quote(extra[parts[-2], parts[-1]])
        if len(parts) == 1 and parts[0] not in rows.columns and extra:
            own = [h for (_, c), h in extra.items() if c == parts[0]]
            if len(own) == 1:
                return quote(own[0])
        return quote(parts[-1])

    old, emitter.rename = emitter.rename, rename
    try:
        out = []
        for x, name in items:
            if isinstance(x, A.Star):
                out += [quote(c) for c in rows.columns if c != ROW_ID and c not in hidden]
            else:
                out.append(f"{emitter.e(x)} AS {quote(name or emitter.title(x))}")
        return session.spark.sql(f"SELECT {', '.join(out)} FROM {quote(view)}")
    finally:
        emitter.rename = old


# ---- INSERT
def insert(session, s: A.Insert, em) -> tuple[int, DataFrame | None]:
    meta = session.table(s.table)
    names = s.columns or [c.name for c in meta.columns]
    for n in names:
        if meta.column(n) is None:
            raise SqlError("42703", f"column {n!r} of relation {meta.name!r} does not exist")
    if len(set(names)) != len(names):
        raise SqlError("42701", "column specified more than once")
    rows = _values(session, meta, s, names, em) if s.rows is not None else _selected(session, meta, s, names, em)
    rows = session.spark.read.parquet(session.storage.write(rows))  # computed once, whatever follows
    rows = K.coerce(rows, meta.columns)
    K.check_not_null(rows, meta)
    count = rows.count()
    with session.latched(meta):
        existing = session.read(meta)
        if s.conflict is not None:
            return _conflict(session, meta, s, rows, existing, em)
        K.check_unique(rows, _taken(session, meta, existing), meta)
        K.check_foreign(rows, meta, _parents(session, meta, existing, rows))
        stored = _store(session, meta, rows, None)
    return count, returning(session, s.returning, stored, meta.name, em)


def _cast(em, x, kind: str) -> str:
    """An expression as a value of a column's type."""
    return f"CAST({em.e(A.Cast(x, kind)) if kind in ('json', 'jsonb', 'binary') else em.e(x)} AS {spark_type(kind)})"


def _default(meta_col, em) -> str:
    return _cast(em, meta_col.default, meta_col.type) if meta_col.default is not None else f"CAST(NULL AS {spark_type(meta_col.type)})"


def _identity(session, meta, df: DataFrame, taken: list[str]) -> DataFrame:
    """Identity columns without given values: a counter in steps, in input order.

    __ord holds a row's partition and its place there; the rows before each partition are counted, so no row moves.
    """
    missing = [c for c in meta.columns if c.identity is not None and c.name not in taken]
    if not missing:
        return df
    df = session.spark.read.parquet(session.storage.write(df))
    part = F.shiftrightunsigned("__ord", 33)
    sizes = df.groupBy(part.alias("__p")).count()
    before = sizes.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    n = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    df = df.join(before, part == F.col("__p"))
    place = F.col("__before") + F.col("__ord").bitwiseAND((1 << 33) - 1)
    for c in missing:
        df = df.withColumn(c.name, F.lit(session.next_identity(meta.id, c, n)) + place * c.identity["step"])
    return df.drop("__p", "__before")


def _guard_identity(meta, s, names, given) -> None:
    for c in meta.columns:
        if c.identity and c.identity["always"] and c.name in names and given(c.name) and not s.overriding:
            raise SqlError("428C9", f"cannot insert a non-DEFAULT value into column {c.name!r}")


def _values(session, meta, s, names, em) -> DataFrame:
    out = []
    for k, row in enumerate(s.rows):
        if row and len(row) != len(names) and (s.columns or len(row) > len(names)):
            raise SqlError("42601", "INSERT has more expressions than target columns" if len(row) > len(names) else "INSERT has more target columns than expressions")
        given = dict(zip(names, row))
        _guard_identity(meta, s, names, lambda c, g=given: not isinstance(g.get(c, A.Default()), A.Default))
        cells = []
        for c in meta.columns:
            x = given.get(c.name, A.Default())
            if isinstance(x, A.Default):
                v = session.identity_literal(meta.id, c) if c.identity else _default(c, em)
            else:
                v = _cast(em, x, c.type)
            cells.append(f"{v} AS {quote(c.name)}")
        out.append(f"SELECT {', '.join(cells)}, {k}L AS __ord")
    return session.spark.sql(" UNION ALL ".join(out))


def _selected(session, meta, s, names, em) -> DataFrame:
    df = session.spark.sql(em.select(s.query))
    if len(df.columns) > len(names):
        raise SqlError("42601", "INSERT has more expressions than target columns")
    names = names[: len(df.columns)]
    df = df.toDF(*names).withColumn("__ord", F.monotonically_increasing_id())
    _guard_identity(meta, s, names, lambda c: True)
    for c in meta.columns:
        if c.name in names and c.type == "binary":
            df = df.withColumn(c.name, F.expr(em.as_bytes(quote(c.name))))
        if c.name not in names and c.identity is None:
            df = df.withColumn(c.name, F.expr(_default(c, em)))
    df = _identity(session, meta, df, names)
    return df.select(*[_c(c.name) for c in meta.columns], "__ord")


def _target(meta, s) -> list:
    """Keys on which a conflict is handled; other keys raise."""
    if s.conflict.constraint:
        found = [k for k in meta.keys() if k.name == s.conflict.constraint]
        if not found:
            raise SqlError("42704", f"constraint {s.conflict.constraint!r} for table {meta.name!r} does not exist")
        return found
    if s.conflict.columns:
        found = [k for k in meta.keys() if set(k.columns) == set(s.conflict.columns)]
        if not found:
            raise SqlError("42P10", "there is no unique constraint matching the ON CONFLICT specification")
        return found
    if s.conflict.sets is not None:
        raise SqlError("42601", "ON CONFLICT DO UPDATE requires a conflict target")
    return meta.keys()


def _conflict(session, meta, s, rows, existing, em):
    target = _target(meta, s)
    rest = [k for k in meta.keys() if k not in target]
    if s.conflict.sets is None:
        keep, existing = rows, _taken(session, meta, existing)
        for key in target:  # the first row of each key, if the table has none
            cols = [_c(c) for c in key.columns]
            full = _full(keep, key.columns)
            odd = keep.join(full.select("__ord"), "__ord", "left_anti")
            first = full.withColumn("__n", F.row_number().over(Window.partitionBy(*cols).orderBy("__ord"))).where("__n = 1").drop("__n")
            keep = first.join(existing.select(*cols), key.columns, "left_anti").select(*rows.columns).union(odd.select(*rows.columns))
        K.check_unique(keep, existing, meta, rest)
        K.check_foreign(keep, meta, _parents(session, meta, existing, keep))
        stored = _store(session, meta, keep, None)
        return stored.count(), returning(session, s.returning, stored, meta.name, em)
    return _upsert(session, meta, s, rows, existing, target[0], em)


def _nodes(x):
    """All nodes of a syntax tree."""
    if isinstance(x, list | tuple):
        for y in x:
            yield from _nodes(y)
    elif hasattr(x, "__dataclass_fields__"):
        yield x
        for k in x.__dataclass_fields__:
            yield from _nodes(getattr(x, k))


def _assignments(meta, s, em, new: str, old: str, mark: str = "") -> tuple[dict[str, str], str]:
    """What DO UPDATE sets, and its condition; `new` and `old` are what the input's and the table's row are called."""
    em.rename = lambda parts: f"{new}.{quote(mark + parts[-1])}" if len(parts) > 1 and parts[-2] == "excluded" else f"{old}.{quote(parts[-1])}"
    try:
        sets = {c: _default(meta.column(c), em) if isinstance(e, A.Default) else _cast(em, e, meta.column(c).type) for c, e in s.conflict.sets}
        return sets, f"({em.e(s.conflict.where)})" if s.conflict.where is not None else "true"
    finally:
        em.rename = None


def _folded(session, meta, s, rows, state, key, em) -> DataFrame:
    """The rows that the input leaves, with __touched: how many of its rows each took."""
    names = [c.name for c in meta.columns]
    sets, cond = _assignments(meta, s, em, "x", "acc")
    full = _full(rows, key.columns)
    groups = session.view(full.groupBy(*map(_c, key.columns)).agg(F.array_sort(F.collect_list(F.struct("__ord", *map(_c, names)))).alias("__in")))
    record = lambda f, n: f"named_struct({', '.join(f'{text(c)}, {f(c)}' for c in names)}, '__touched', {n})"
    start = f"if(t.{ROW_ID} IS NULL, {record(lambda c: f'g.__in[0].{quote(c)}', 1)}, {record(lambda c: f't.{quote(c)}', 0)})"
    step = f"if({cond}, {record(lambda c: sets.get(c, f'acc.{quote(c)}'), 'acc.__touched + 1')}, acc)"
    on = " AND ".join(f"t.{quote(c)} = g.{quote(c)}" for c in key.columns)
    folded = session.spark.sql(f"SELECT t.{ROW_ID}, aggregate(if(t.{ROW_ID} IS NULL, slice(g.__in, 2, size(g.__in)), g.__in), {start}, (acc, x) -> {step}) AS f FROM {quote(groups)} g LEFT JOIN {quote(session.view(state))} t ON {on}")
    out = folded.select(*[F.col("f")[c].alias(c) for c in names], ROW_ID, F.col("f")["__touched"].alias("__touched"))
    apart = rows.join(full.select("__ord"), "__ord", "left_anti")  # a null in the key conflicts with nothing
    return out.union(apart.select(*map(_c, names), F.lit(None).cast("long"), F.lit(1)))


def _full(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        rows = rows.where(_c(c).isNotNull())
    return rows


def _in_rounds(session, meta, s, rows, state, key, em) -> DataFrame:
    """As _folded, by a join for each repetition of a key."""
    names = [c.name for c in meta.columns]
    spark, st = session.spark, session.storage
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*[_c(c) for c in key.columns]).orderBy("__ord")))
    sets, cond = _assignments(meta, s, em, "x", "t", "__x_")
    on = " AND ".join(f"t.{quote(c)} = x.{quote('__x_' + c)}" for c in key.columns)
    hit = f"(x.{quote('__x_' + key.columns[0])} IS NOT NULL)"
    cells = [f"CASE WHEN {hit} AND {cond} THEN {sets[n]} ELSE t.{quote(n)} END AS {quote(n)}" if n in sets else f"t.{quote(n)}" for n in names]
    for k in range(1, (rows.agg(F.max("__n")).first()[0] or 0) + 1):
        new_view = session.view(rows.where(F.col("__n") == k).select(*[_c(n).alias(f"__x_{n}") for n in names]))
        old_view = session.view(state)
        updated = spark.sql(f"SELECT {', '.join(cells)}, t.{ROW_ID}, t.__touched + CASE WHEN {hit} AND {cond} THEN 1 ELSE 0 END AS __touched FROM {quote(old_view)} t LEFT JOIN {quote(new_view)} x ON {on}")
        fresh = spark.sql(f"SELECT {', '.join(f'x.{quote("__x_" + n)} AS {quote(n)}' for n in names)}, CAST(NULL AS BIGINT) AS {ROW_ID}, 1 AS __touched FROM {quote(new_view)} x LEFT ANTI JOIN {quote(old_view)} t ON {on}")
        state = spark.read.parquet(st.write(updated.union(fresh)))
    return state


def _upsert(session, meta, s, rows, existing, key, em):
    """Rows of one key are applied in input order.

    Only the table's rows with a key of the input take part and only they are written: they are joined once with the
    input, whose rows of a key are folded into them. Only where the assignments hold subqueries is there a round of
    joins for each repetition of a key.
    """
    cols = [_c(c) for c in key.columns]
    spark, st = session.spark, session.storage
    busy = _uncommitted(session, meta)
    if busy is not None and not rows.join(busy.select(*cols), key.columns, "left_semi").isEmpty():
        raise SqlError("55P03", f"could not obtain lock on row in relation {meta.name!r}")
    for c, _ in s.conflict.sets:
        if meta.column(c) is None:
            raise SqlError("42703", f"column {c!r} does not exist")
    # rows as they are after what is applied so far; row id null where new
    state = existing.join(rows.select(*cols).distinct(), key.columns, "left_semi").select(*existing.columns).withColumn("__touched", F.lit(0))
    state = spark.read.schema(state.schema).parquet(st.write(state))
    before = state
    simple = not any(isinstance(x, A.SubQuery | A.InQuery) for x in _nodes([s.conflict.sets, s.conflict.where]))
    state = (_folded if simple else _in_rounds)(session, meta, s, rows, state, key, em)
    state = spark.read.parquet(st.write(state.withColumn("__ord", F.monotonically_increasing_id())))
    touched = state.where("__touched > 0")
    count = int(touched.agg(F.coalesce(F.sum("__touched"), F.lit(0))).first()[0])
    old = touched.where(_c(ROW_ID).isNotNull())
    others = existing.join(old.select(ROW_ID), ROW_ID, "left_anti").select(*existing.columns)
    K.check_not_null(touched, meta)
    K.check_unique(touched, _taken(session, meta, others), meta)
    K.check_foreign(touched, meta, _parents(session, meta, others, touched))
    _guard_parents(session, meta, old, before, [c for c, _ in s.conflict.sets])
    gone = _lock(session, meta, old)
    stored = _store(session, meta, touched, gone)
    return count, returning(session, s.returning, stored, meta.name, em)


# ---- UPDATE
def update(session, s: A.Update, em) -> tuple[int, DataFrame | None]:
    meta = session.table(s.table.name)
    with session.latched(meta):
        return _update(session, meta, s, em)


def _numbered(session, em, source) -> tuple[str, list[str]]:
    """The source of an UPDATE … FROM, and the columns that order its rows as they were put in: by its first table, then the next."""
    order: list[str] = []

    def leaf(x) -> str:
        em.leaf = None  # a subquery's own tables need no numbers
        try:
            name, alias = f"__at{len(order)}", x.alias or x.name[-1]
            if isinstance(x, A.Table):
                meta = None if len(x.name) == 1 and x.name[0] in em.resolve.ctes else session.find(x.name)
                rows = session.read(meta).withColumnRenamed(ROW_ID, name) if meta is not None else session.spark.table(em.resolve(x.name)).withColumn(name, F.monotonically_increasing_id())
                inner = quote(session.view(rows))
            else:
                inner = f"(SELECT *, monotonically_increasing_id() AS {name} FROM ({em.select(x.query)}))"
            order.append(f"{quote(alias)}.{name}")
            return f"{inner} AS {quote(alias)}"
        finally:
            em.leaf = leaf

    em.leaf = leaf
    try:
        return em.source(source), order
    finally:
        em.leaf = None


def _update(session, meta, s: A.Update, em) -> tuple[int, DataFrame | None]:
    alias = s.table.alias or meta.name
    for c, _ in s.sets:
        col = meta.column(c)
        if col is None:
            raise SqlError("42703", f"column {c!r} of relation {meta.name!r} does not exist")
    if len({c for c, _ in s.sets}) != len(s.sets):
        raise SqlError("42601", "multiple assignments to same column")
    rows = session.read(meta)
    view = session.view(rows)
    sets = {c: _default(meta.column(c), em) if isinstance(e, A.Default) else _cast(em, e, meta.column(c).type) for c, e in s.sets}
    cells = [f"{sets[c.name]} AS {quote(c.name)}" if c.name in sets else f"{quote(alias)}.{quote(c.name)} AS {quote(c.name)}" for c in meta.columns]
    extra: dict = {}
    if s.source is not None and s.returning is not None:
        for t in _leaves(s.source):
            q = (t.alias or t.name[-1]) if isinstance(t, A.Table) else t.alias
            for c in session.columns_of(t, em):
                extra[q, c] = f"__src_{q}_{c}"
                cells.append(f"{quote(q)}.{quote(c)} AS {quote(f'__src_{q}_{c}')}")
    from_sql, order = _numbered(session, em, s.source) if s.source is not None else ("", [])
    source = f" CROSS JOIN {from_sql}" if from_sql else ""
    where = f" WHERE {em.e(s.where)}" if s.where is not None else ""
    at = "".join(f", {x} AS __at{i}" for i, x in enumerate(order))
    hit = session.spark.sql(f"SELECT {', '.join(cells)}, {quote(alias)}.{ROW_ID} AS {ROW_ID}{at} FROM {quote(view)} AS {quote(alias)}{source}{where}")
    if s.source is not None:  # the first source row for each target row, by an aggregate that starts on the map side
        names = [c for c in hit.columns if c != ROW_ID and not c.startswith("__at")]
        first = hit.groupBy(ROW_ID).agg(F.min(F.struct(*[f"__at{i}" for i in range(len(order))], *map(_c, names))).alias("__first"))
        hit = first.select(*[F.col("__first")[c].alias(c) for c in names], ROW_ID)
    hit = session.spark.read.parquet(session.storage.write(hit.withColumn("__ord", F.monotonically_increasing_id())))
    K.check_not_null(hit, meta)
    changed = [k for k in meta.keys() if set(k.columns) & sets.keys()]
    others = rows.join(hit.select(ROW_ID), ROW_ID, "left_anti").select(*rows.columns)
    if changed:
        K.check_unique(hit, _taken(session, meta, others), meta, changed)
    K.check_foreign(hit, meta, _parents(session, meta, others, hit))
    _guard_parents(session, meta, hit, rows, list(sets))
    gone = _lock(session, meta, hit)
    count = hit.count()
    _store(session, meta, hit, gone)
    return count, returning(session, s.returning, hit.drop("__ord"), alias, em, extra)


def _leaves(x):
    return [*_leaves(x.left), *_leaves(x.right)] if isinstance(x, A.Join) else [x]


def _guard_parents(session, meta, new: DataFrame, old: DataFrame, touched: list[str]) -> None:
    """A key that other rows may reference cannot change."""
    for key in {tuple(fk.to) for _, fk in K.inbound(session.db, meta.id)}:
        if not set(key) & set(touched):
            continue
        before = old.select(ROW_ID, *[_c(c).alias(f"__o_{c}") for c in key])
        differs = F.lit(False)
        for c in key:
            differs = differs | ~_c(c).eqNullSafe(_c(f"__o_{c}"))
        if not new.join(before, ROW_ID).where(differs).isEmpty():
            raise SqlError("0A000", "updating a referenced key is not supported")


# ---- DELETE
def delete(session, s: A.Delete, em) -> tuple[int, DataFrame | None]:
    meta = session.table(s.table.name)
    with session.latched(meta):
        return _delete(session, meta, s, em)


def _delete(session, meta, s: A.Delete, em) -> tuple[int, DataFrame | None]:
    alias = s.table.alias or meta.name
    view = session.view(session.read(meta))
    where = f" WHERE {em.e(s.where)}" if s.where is not None else ""
    gone = session.spark.sql(f"SELECT * FROM {quote(view)} AS {quote(alias)}{where}")
    gone = session.spark.read.schema(gone.schema).parquet(session.storage.write(gone))
    count = gone.count()
    for m, rows in cascade(session, meta, gone):
        _store(session, m, None, _lock(session, m, rows))
    return count, returning(session, s.returning, gone, alias, em)


def cascade(session, meta, gone: DataFrame) -> list[tuple[TableMeta, DataFrame]]:
    """All rows that go with `gone`, by table: semi joins along the foreign keys until nothing is added."""
    doomed, todo = {meta.id: (meta, gone)}, [(meta, gone)]
    limits = []
    while todo:
        parent, rows = todo.pop()
        for child, fk in K.inbound(session.db, parent.id):
            unseen = _uncommitted(session, child)  # children that another session has added
            if unseen is not None and not K.children(rows, unseen, fk).isEmpty():
                raise SqlError("23503", f"delete violates foreign key constraint {fk.name!r} on table {child.name!r}")
            hit = K.children(rows, session.read(child), fk)
            if child.id in doomed:
                hit = hit.join(doomed[child.id][1].select(ROW_ID), ROW_ID, "left_anti")
            if not fk.cascade:
                limits.append((child, fk, rows))
                continue
            hit = session.spark.read.schema(hit.schema).parquet(session.storage.write(hit))
            if hit.isEmpty():
                continue
            names = hit.columns
            old = doomed.get(child.id)
            doomed[child.id] = (child, hit if old is None else old[1].select(*map(_c, names)).union(hit))
            todo.append((child, hit))
    for child, fk, rows in limits:
        left = session.read(child)
        if child.id in doomed:
            left = left.join(doomed[child.id][1].select(ROW_ID), ROW_ID, "left_anti")
        if not K.children(rows, left, fk).isEmpty():
            raise SqlError("23503", f"delete violates foreign key constraint {fk.name!r} on table {child.name!r}")
    return list(doomed.values())
