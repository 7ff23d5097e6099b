"""System catalog tables, built from the driver's catalog when a statement reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame

NAMES = {"pg_namespace": "pg_catalog", "pg_class": "pg_catalog", "pg_tables": "pg_catalog", "pg_type": "pg_catalog", "tables": "information_schema"}

#: Object ids of the supported types.
TYPE_OIDS = {"bool": 16, "bytea": 17, "int8": 20, "int4": 23, "text": 25, "json": 114, "float8": 701, "varchar": 1043, "date": 1082, "timestamp": 1114, "timestamptz": 1184, "interval": 1186, "jsonb": 3802}


def is_system(name: list[str]) -> bool:
    return name[-1] in NAMES and (len(name) == 1 and name[0].startswith("pg_") or len(name) > 1 and name[-2] == NAMES[name[-1]])


def table(session, name: str) -> DataFrame:
    db, make = session.db, session.spark.createDataFrame
    schemas = ["pg_catalog", "information_schema", *db.schemas]
    oid = {s: 11 if s == "pg_catalog" else 2200 + i for i, s in enumerate(schemas)}
    if name == "pg_namespace":
        return make([(oid[s], s) for s in schemas], "oid long, nspname string")
    if name == "pg_class":
        rows = [(t.id, t.name, oid[t.schema], "r") for t in db.tables.values()] + [(t.id * 1000 + k, i.name, oid[t.schema], "i") for t in db.tables.values() for k, i in enumerate(t.indexes)]
        return make(rows, "oid long, relname string, relnamespace long, relkind string")
    if name == "pg_tables":
        return make([(t.schema, t.name, "postgres", bool(t.indexes) or bool(t.keys())) for t in db.tables.values()], "schemaname string, tablename string, tableowner string, hasindexes boolean")
    if name == "pg_type":
        return make([(o, n, 11, "b") for n, o in TYPE_OIDS.items()], "oid long, typname string, typnamespace long, typtype string")
    return make([("postgres", t.schema, t.name, "BASE TABLE") for t in db.tables.values()], "table_catalog string, table_schema string, table_name string, table_type string")
