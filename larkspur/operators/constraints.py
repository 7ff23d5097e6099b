"""Constraint checks as queries over the rows a statement adds or takes away.

Each check joins the few rows in question with the table and stops at the first offender, so its cost follows the
change, and Catalyst picks the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.errors import SqlError
from larkspur.sources.storage import Column, Constraint, TableMeta, spark_type


def coerce(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Columns cast to the table's types (ANSI casts raise on bad values)."""
    return df.withColumns({c.name: F.col(f"`{c.name}`").cast(spark_type(c.type)) for c in columns})


def check_not_null(df: DataFrame, meta: TableMeta) -> None:
    need = [c.name for c in meta.columns if not c.nullable]
    if not need:
        return
    row = df.agg(*[F.max(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in need]).first()
    for c in need:
        if row[c]:
            raise SqlError("23502", f"null value in column {c!r} of table {meta.name!r}")


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(f"`{c}`").isNotNull())
    return df


def check_unique(new: DataFrame, others: DataFrame, meta: TableMeta, keys: list[Constraint] | None = None) -> None:
    """No key of `new` occurs twice in it or once in `others`. Keys with a null part are distinct."""
    for key in meta.keys() if keys is None else keys:
        cols = [F.col(f"`{c}`") for c in key.columns]
        own = _filled(new, key.columns).select(*cols)
        twice = own.groupBy(*cols).count().where("count > 1").drop("count")
        there = own.join(others.select(*cols), key.columns, "left_semi")
        if not twice.union(there).isEmpty():
            raise SqlError("23505", f"duplicate key value violates unique constraint {key.name!r}")


def check_foreign(new: DataFrame, meta: TableMeta, read) -> None:
    """Each foreign key of `new` has its parent; any null part skips the check. read(foreign key) gives the rows of the table that it points to."""
    for fk in (c for c in meta.constraints if c.kind == "foreign"):
        parent = read(fk)
        own = _filled(new, fk.columns).select(*[F.col(f"`{a}`").alias(f"k{i}") for i, a in enumerate(fk.columns)]).distinct()
        keys = parent.select(*[F.col(f"`{b}`").alias(f"k{i}") for i, b in enumerate(fk.to)])
        if not own.join(keys, own.columns, "left_anti").isEmpty():
            raise SqlError("23503", f"insert or update on table {meta.name!r} violates foreign key constraint {fk.name!r}")


def inbound(db, table_id: int) -> list[tuple[TableMeta, Constraint]]:
    """Foreign keys of other tables (and of itself) that point here."""
    return [(t, c) for t in db.tables.values() for c in t.constraints if c.kind == "foreign" and c.target == table_id]


def children(gone: DataFrame, child_rows: DataFrame, fk: Constraint) -> DataFrame:
    """Rows of the child table that reference one of the rows in `gone`."""
    keys = gone.select(*[F.col(f"`{b}`").alias(a) for a, b in zip(fk.columns, fk.to)]).distinct()
    return child_rows.join(keys, fk.columns, "left_semi")
