"""Tables as immutable Parquet parts.

A version of a table is a list of parts and a list of delete files. A write adds files in proportion to the rows it
touches and swaps a pointer; a read is the union of the parts without the deleted rows. A part knows its columns, so
that a column which is added or dropped rewrites nothing. Files live in the session's shared folder, so executors may
come and go.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__row_id"
#: Delete files, and parts, after which they are merged; parts are rewritten whole only where a quarter of the rows is gone.
MERGE_DELETES, MERGE_PARTS = 16, 64


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    default: object = None
    identity: dict | None = None
    stored: str = ""  # its name in the parts
    fill: str | None = None  # what rows of parts without it have, as SQL


@dataclass
class Constraint:
    kind: str  # primary, unique, foreign, check
    name: str
    columns: list[str]
    target: int | None = None
    to: list[str] | None = None
    cascade: bool = False
    index: bool = False


@dataclass
class TableMeta:
    id: int
    schema: str
    name: str
    columns: list[Column]
    constraints: list[Constraint] = field(default_factory=list)
    indexes: list[Constraint] = field(default_factory=list)
    used: set[str] = field(default_factory=set)  # names that parts may have

    def __post_init__(self):
        for c in self.columns:
            self._name(c)

    def _name(self, c: Column) -> None:
        if not c.stored:  # a name that a dropped column had means another one in older parts
            c.stored = c.name if c.name not in self.used else f"{c.name}__{len(self.used)}"
        self.used.add(c.stored)

    def add(self, c: Column) -> None:
        self._name(c)
        self.columns.append(c)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def primary(self) -> Constraint | None:
        return next((c for c in self.constraints if c.kind == "primary"), None)

    def keys(self) -> list[Constraint]:
        """Constraints and indexes that make columns unique."""
        return [c for c in self.constraints if c.kind in ("primary", "unique")] + [i for i in self.indexes if i.kind == "unique"]


@dataclass(frozen=True)
class Part:
    path: str
    columns: frozenset[str]


@dataclass(frozen=True)
class Version:
    parts: tuple[Part, ...] = ()
    deletes: tuple[str, ...] = ()

    def plus(self, other: "Version") -> "Version":
        return Version(self.parts + other.parts, self.deletes + other.deletes)


@dataclass
class Database:
    """A catalog and the current version of each table. copy() costs a copy of pointers."""

    schemas: list[str] = field(default_factory=lambda: ["public"])
    tables: dict[int, TableMeta] = field(default_factory=dict)
    versions: dict[int, Version] = field(default_factory=dict)
    counters: dict = field(default_factory=dict)
    next_id: int = 16_384

    def copy(self) -> "Database":
        return Database(list(self.schemas), {k: replace(t, columns=[replace(c) for c in t.columns], constraints=[replace(c) for c in t.constraints], indexes=[replace(c) for c in t.indexes], used=set(t.used)) for k, t in self.tables.items()}, dict(self.versions), {k: dict(v) for k, v in self.counters.items()}, self.next_id)


def spark_type(name: str) -> str:
    return {"json": "string", "jsonb": "string", "interval": "interval day to second"}.get(name, name)


def schema_of(meta: TableMeta) -> T.StructType:
    return T.StructType([*(_field(c, c.name) for c in meta.columns), T.StructField(ROW_ID, T.LongType())])


def _field(c: Column, name: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(spark_type(c.type)))


class Storage:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame) -> str:
        """Rows under a new path."""
        path = f"{self.path}/part-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def add(self, meta: TableMeta, df: DataFrame) -> Part:
        """Rows of a table (with their row ids) as a new part."""
        return Part(self.write(df.select(*[F.col(f"`{c.name}`").alias(c.stored) for c in meta.columns], ROW_ID)), frozenset(c.stored for c in meta.columns))

    def ids(self, paths) -> DataFrame:
        """Row ids in delete files."""
        return self.spark.read.schema(f"{ROW_ID} long").parquet(*paths)

    def read(self, meta: TableMeta, version: Version) -> DataFrame:
        """All rows with their row ids. Columns that a part lacks (added later) have the value that they were added with."""
        if not version.parts:
            return self.spark.createDataFrame([], schema_of(meta))
        alike: dict[frozenset, list[str]] = {}
        for p in version.parts:
            alike.setdefault(p.columns, []).append(p.path)
        df = None
        for have, paths in alike.items():
            own = [c for c in meta.columns if c.stored in have]
            rows = self.spark.read.schema(T.StructType([*(_field(c, c.stored) for c in own), T.StructField(ROW_ID, T.LongType())])).parquet(*paths)
            absent = lambda c: F.expr(c.fill) if c.fill is not None else F.lit(None)
            rows = rows.select(*[(F.col(f"`{c.stored}`") if c.stored in have else absent(c).cast(spark_type(c.type))).alias(c.name) for c in meta.columns], ROW_ID)
            df = rows if df is None else df.union(rows)
        if version.deletes:
            df = df.join(self.ids(version.deletes), ROW_ID, "left_anti").select(*[F.col(f"`{c.name}`") for c in meta.columns], ROW_ID)
        return df

    def compacted(self, meta: TableMeta, version: Version) -> Version | None:
        """The same rows with the same ids in fewer files, at a cost in proportion to what was written since; None where files are few."""
        parts, deletes = version.parts, version.deletes
        if len(deletes) >= MERGE_DELETES:
            gone = self.ids(deletes)
            if 4 * gone.count() >= self.ids([p.path for p in parts]).count():
                return Version((self.add(meta, self.read(meta, version)),), ())
            deletes = (self.write(gone),)
        if len(parts) >= MERGE_PARTS:
            kept = MERGE_PARTS // 2
            parts = (*parts[:kept], self.add(meta, self.read(meta, Version(parts[kept:]))))
        return Version(parts, deletes) if (parts, deletes) != (version.parts, version.deletes) else None
