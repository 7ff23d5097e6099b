"""Engine and sessions: SQL text in, DataFrames out.

The driver keeps the catalog, table pointers, transactions and locks; rows stay in Spark. A query becomes Spark SQL over
temporary views, so Catalyst sees the whole plan. A transaction collects its changes as lists of files; commit appends
them to the shared pointers, which makes concurrent changes to different rows of a table compatible. What sessions have
not yet committed counts in the checks of keys: a statement holds its tables' latches while it checks and notes its
change, so that two transactions cannot both write a key, or a child and the deletion of its parent. Changes of the
schema take effect at once, whatever becomes of the transaction, and are all or nothing.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import re
import tempfile
import threading
import time
import uuid
import weakref
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import SqlError, from_spark
from larkspur.operators import ddl, dml
from larkspur.operators.locks import AdvisoryLocks, RowLocks
from larkspur.plans import ast as A
from larkspur.plans import params as P
from larkspur.plans.emit import Emitter, literal, ordered_ctes, text
from larkspur.plans.parser import Parser
from larkspur.plans.lexer import statements
from larkspur.sources import system
from larkspur.sources.storage import ROW_ID, Database, Storage, TableMeta, Version

VERSION = "PostgreSQL 15.0 compatible dialect on Apache Spark (larkspur 0.1)"


class Result:
    """What one statement gave: a tag, a count, and rows where there are any."""

    def __init__(self, tag: str, count: int = 0, df: DataFrame | None = None):
        self.command, self.count, self.df = tag, count, df

    @property
    def tag(self) -> str:
        if self.command == "INSERT":
            return f"INSERT 0 {self.count}"
        return f"{self.command} {self.count}" if self.command in ("UPDATE", "DELETE") else self.command

    def rows(self) -> list[tuple]:
        try:
            return [] if self.df is None else [tuple(r) for r in self.df.collect()]
        except (PySparkException, Py4JJavaError) as e:
            raise from_spark(e) from e


class Engine:
    """Tables and locks that sessions share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        shared = path or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir, or give a path, that the driver and all executors share")
            shared = f"file://{tempfile.mkdtemp(prefix='larkspur-tables-')}"
        self.path = f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.db, self.frozen = Database(), None
        self.mutex = threading.RLock()
        self.latches: dict[int, threading.RLock] = {}
        self.sessions: weakref.WeakSet[Session] = weakref.WeakSet()
        self.locks, self.advisory = RowLocks(), AdvisoryLocks()
        self.next_partition = 1  # of new rows; row ids are numbered within it
        self.sources: dict[str, DataFrame | Callable[[SparkSession], DataFrame]] = {}

    def session(self) -> "Session":
        return Session(self)

    def close(self) -> None:
        """Delete the tables' files."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def register(self, name: str, source: DataFrame | Callable[[SparkSession], DataFrame]) -> None:
        """Make a DataFrame (a Parquet table, say), or what a function of the Spark session gives when it is first read, readable under a name. It is scanned where it is."""
        self.sources[name] = source

    @contextlib.contextmanager
    def latched(self, tables):
        """Hold tables while a statement changes them: always in the same order, so that nobody waits in a circle."""
        with self.mutex:
            own = [self.latches.setdefault(k, threading.RLock()) for k in sorted(set(tables))]
        with contextlib.ExitStack() as stack:
            for x in own:
                stack.enter_context(x)
            yield


class Session:
    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark
        self.storage = Storage(self.spark, engine.path)
        self.settings = {"search_path": ["public"], "timezone": "UTC", "lock_timeout": 0, "transaction_isolation": "read committed", "default_transaction_isolation": "read committed", "client_min_messages": "notice"}
        self.in_tx = self.failed = False
        self.pending: dict[int, Version] = {}
        self.trial: Database | None = None  # the catalog while a change of the schema is tried
        self.own_db: Database | None = None  # after a freeze
        self.tx_time = None
        self._views: list[str] = []
        with engine.mutex:
            engine.sessions.add(self)

    # ---- catalog and rows
    @property
    def shared(self) -> Database:
        if self.engine.frozen is None:
            return self.engine.db
        if self.own_db is None:
            self.own_db = self.engine.frozen.copy()
        return self.own_db

    @property
    def db(self) -> Database:
        return self.trial or self.shared

    def create_schema(self) -> str:
        for s in self.settings["search_path"]:
            if s in self.db.schemas:
                return s
        raise SqlError("3F000", "no schema has been selected to create in")

    def find(self, name: list[str]) -> TableMeta | None:
        for s in [name[-2]] if len(name) > 1 else self.settings["search_path"]:
            for t in self.db.tables.values():
                if t.schema == s and t.name == name[-1]:
                    return t
        return None

    def table(self, name: list[str]) -> TableMeta:
        found = self.find(name)
        if found is None:
            raise SqlError("42P01", f"relation {'.'.join(name)!r} does not exist")
        return found

    def version(self, table_id: int) -> Version:
        return self.db.versions.get(table_id, Version()).plus(self.pending.get(table_id, Version()))

    def read(self, meta: TableMeta) -> DataFrame:
        return self.storage.read(meta, self.version(meta.id))

    def read_id(self, table_id: int) -> DataFrame:
        return self.read(self.db.tables[table_id])

    def others(self, table_id: int) -> list[Version]:
        """What other sessions have done to a table and not yet committed."""
        with self.engine.mutex:
            return [s.pending[table_id] for s in self.engine.sessions if s is not self and table_id in s.pending and s.shared is self.shared]

    def alone(self, meta: TableMeta) -> None:
        """The columns and keys of a table cannot change under other sessions' changes."""
        if self.others(meta.id):
            raise SqlError("55P03", f"could not obtain lock on relation {meta.name!r}")

    def note(self, table_id: int, change: Version) -> None:
        with self.engine.mutex:
            self.pending[table_id] = self.pending.get(table_id, Version()).plus(change)

    def latched(self, meta: TableMeta):
        """Hold a table and all that foreign keys tie to it."""
        tied, todo = {meta.id}, [meta.id]
        tables = self.db.tables
        links = [(t.id, c.target) for t in tables.values() for c in t.constraints if c.kind == "foreign"]
        while todo:
            k = todo.pop()
            new = {b if a == k else a for a, b in links if k in (a, b)} - tied
            tied |= new
            todo += new
        return self.engine.latched(tied)

    def adopt(self, df: DataFrame) -> DataFrame:
        """A DataFrame of another Spark session of the application, in this one's."""
        if df.sparkSession is self.spark:
            return df
        name = f"g_{uuid.uuid4().hex}"
        df.createGlobalTempView(name)
        return self.spark.table(f"global_temp.{name}")

    def next_row_ids(self, partitions: int) -> int:
        """The first of the ids set aside for so many partitions of new rows."""
        with self.engine.mutex:
            first = self.engine.next_partition
            self.engine.next_partition += partitions
        return first << 33

    def next_identity(self, table_id: int, col, n: int) -> int:
        with self.engine.mutex:
            counters = self.shared.counters.setdefault(table_id, {})
            first = counters.get(col.name, col.identity["start"])
            counters[col.name] = first + n * col.identity["step"]
            return first

    def identity_literal(self, table_id: int, col) -> str:
        return f"CAST({self.next_identity(table_id, col, 1)} AS {col.type})"

    def view(self, df: DataFrame) -> str:
        name = f"v_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self._views.append(name)
        return name

    def columns_of(self, leaf, em) -> list[str]:
        if isinstance(leaf, A.Table):
            return self.spark.table(em.resolve(leaf.name)).columns
        return self.spark.sql(em.select(leaf.query)).columns

    def _resolver(self, ctes: dict[str, str]):
        known: dict[tuple, str] = {}

        def resolve(name: list[str]) -> str:
            if len(name) == 1 and name[0] in ctes:
                return ctes[name[0]]
            if tuple(name) not in known:
                meta = self.find(name)
                if meta is not None:
                    df = self.read(meta).drop(ROW_ID)
                elif system.is_system(name):
                    df = system.table(self, name[-1])
                elif len(name) == 1 and name[0] in self.engine.sources:
                    source = self.engine.sources[name[0]]
                    df = self.adopt(source) if isinstance(source, DataFrame) else source(self.spark)
                else:
                    raise SqlError("42P01", f"relation {'.'.join(name)!r} does not exist")
                known[tuple(name)] = self.view(df)
            return known[tuple(name)]

        resolve.ctes = ctes
        return resolve

    # ---- session functions
    def _function(self, name: str, args: list) -> str:
        if name in ("now", "current_timestamp", "transaction_timestamp"):
            return literal(self.tx_time or self.stmt_time)
        if name == "statement_timestamp":
            return literal(self.stmt_time)
        if name == "clock_timestamp":
            return literal(dt.datetime.now(dt.timezone.utc))
        if name == "current_date":
            return literal(self.stmt_time.date())
        if name == "current_schema":
            return next((text(s) for s in self.settings["search_path"] if s in self.db.schemas), "CAST(NULL AS STRING)")
        if name == "current_schemas":
            implicit = isinstance(args[0], A.Lit) and args[0].value is True
            return text("{" + ",".join((["pg_catalog"] if implicit else []) + [s for s in self.settings["search_path"] if s in self.db.schemas]) + "}")
        if name == "current_database":
            return text("postgres")
        if name == "version":
            return text(VERSION)
        key = args[0].args[0].value * -1 if isinstance(args[0], A.Op) else self.params[args[0].index - 1] if isinstance(args[0], A.Param) else args[0].value
        if name == "pg_advisory_lock":
            self.engine.advisory.take(self, key)
            return "NULL"
        return literal(self.engine.advisory.free(self, key))

    def check_default(self, col) -> None:
        def walk(x):
            if isinstance(x, A.Col | A.SubQuery | A.InQuery | A.Param):
                raise SqlError("0A000", "a default must be constant")
            if isinstance(x, A.Func) and x.name == "clock_timestamp":
                raise SqlError("0A000", "clock_timestamp() is not allowed in a default")
            for k in getattr(x, "__dataclass_fields__", ()):
                v = getattr(x, k)
                for y in v if isinstance(v, list) else [v]:
                    walk(y)

        if col.default is not None:
            walk(col.default)

    def default_sql(self, col) -> str:
        return dml._default(col, Emitter(self._resolver({}), self._function))

    # ---- running statements
    def execute(self, sql: str, params=()) -> Result:
        """One statement."""
        found = statements(sql)
        if len(found) != 1:
            raise SqlError("42601", "cannot insert multiple commands into a prepared statement" if found else "empty statement")
        return self._run(Parser(found[0]).statement(), params)

    def query(self, sql: str, params=()) -> DataFrame:
        """The rows of one statement as a lazy DataFrame."""
        return self.execute(sql, params).df

    def prepare(self, sql: str) -> "Prepared":
        found = statements(sql)
        if len(found) != 1:
            raise SqlError("42601", "cannot insert multiple commands into a prepared statement")
        return Prepared(self, Parser(found[0]).statement())

    def describe(self, s: A.Select, params) -> list[tuple[str, str]]:
        """Names and types of a query's columns."""
        self.params, self.stmt_time = params, dt.datetime.now(dt.timezone.utc)
        ctes: dict[str, str] = {}
        em = Emitter(self._resolver(ctes), lambda name, args: "CAST(NULL AS BOOLEAN)" if name.startswith("pg_advisory") else self._function(name, args), params)
        try:
            for c in ordered_ctes(s.ctes):
                body = c.body
                if not isinstance(body, A.Select):
                    body = A.Select(body.returning or [], A.Table(body.table) if isinstance(body, A.Insert) else body.table)
                df = self.spark.sql(em.select(body))
                ctes[c.name] = self.view(df.toDF(*c.columns, *df.columns[len(c.columns) :]) if c.columns else df)
            return [(f.name, f.dataType.simpleString()) for f in self.spark.sql(em.select(s)).schema.fields]
        finally:
            self._drop_views()

    def execute_batch(self, sql: str) -> list[Result]:
        """Statements in a row, in one implicit transaction unless they open their own; an error undoes all."""
        found = [Parser(t).statement() for t in statements(sql)]
        own = len(found) > 1 and not self.in_tx and not any(isinstance(s, A.Command) and s.kind in ("begin", "commit", "rollback") for s in found)
        if not own:
            return [self._run(s, ()) for s in found]
        self._begin()
        try:
            out = []
            for s in found:
                r = self._run(s, ())
                if r.df is not None:  # rows as of this statement, in their order
                    names = r.df.columns
                    kept = self.storage.write(r.df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("__at", F.monotonically_increasing_id()))
                    r = Result(r.command, r.count, self.spark.read.parquet(kept).orderBy("__at").drop("__at").toDF(*names))
                out.append(r)
        except Exception:
            self._end(False)
            raise
        self._end(True)
        return out

    def _run(self, s, params) -> Result:
        self.params, self.stmt_time = params, dt.datetime.now(dt.timezone.utc)
        if self.failed and not (isinstance(s, A.Command) and s.kind in ("rollback", "commit")):
            raise SqlError("25P02", "current transaction is aborted")
        single = not self.in_tx
        try:
            out = self._command(s) if isinstance(s, A.Command) else self._query(s, params)
            if single and not self.in_tx:
                self._end(True)
            return out
        except Exception as e:
            if single and not self.in_tx:
                self._end(False)
            elif self.in_tx:
                self.failed = True
            if isinstance(e, PySparkException | Py4JJavaError):
                raise from_spark(e) from e
            raise
        finally:
            self._drop_views()

    def _drop_views(self) -> None:
        for v in self._views:
            self.spark.catalog.dropTempView(v)
        self._views.clear()

    def _query(self, s, params) -> Result:
        ctes: dict[str, str] = {}
        em = Emitter(self._resolver(ctes), self._function, params)
        for c in ordered_ctes(s.ctes):
            df = self._body(c.body, em, params).df
            if df is None:
                raise SqlError("0A000", f"WITH query {c.name!r} has no RETURNING clause")
            if c.columns:
                if len(c.columns) > len(df.columns):
                    raise SqlError("42601", f"WITH query {c.name!r} has {len(df.columns)} columns but {len(c.columns)} were specified")
                df = df.toDF(*c.columns, *df.columns[len(c.columns) :])
            ctes[c.name] = self.view(df)
        return self._body(s, em, params)

    def _body(self, s, em, params) -> Result:
        if isinstance(s, A.Insert):
            n, df = dml.insert(self, s, em)
            return Result("INSERT", n, df)
        if isinstance(s, A.Update):
            n, df = dml.update(self, s, em)
            return Result("UPDATE", n, df)
        if isinstance(s, A.Delete):
            n, df = dml.delete(self, s, em)
            return Result("DELETE", n, df)
        special = self._snapshot_call(s)
        if special is not None:
            return special
        if s.lock:
            return Result("SELECT", 0, self._locking(s, em))
        return Result("SELECT", 0, self.spark.sql(em.select(s)))

    def _snapshot_call(self, s: A.Select) -> Result | None:
        if s.source is None and len(s.items) == 1 and isinstance(s.items[0][0], A.Func) and s.items[0][0].name in ("engine_freeze", "engine_reset"):
            name = s.items[0][0].name
            if self.in_tx:
                raise SqlError("25001", f"{name}() cannot run inside a transaction block")
            ok = self.freeze() if name == "engine_freeze" else self.reset()
            return Result("SELECT", 0, self.spark.createDataFrame([(ok,)], f"{name} boolean"))
        return None

    def _locking(self, s: A.Select, em) -> DataFrame:
        """Rows in order, each locked as it is taken; locks come after sorting and before the limit."""
        if not isinstance(s.source, A.Table) or s.group or s.having or s.distinct or (len(s.source.name) == 1 and self.find(s.source.name) is None):
            raise SqlError("0A000", "FOR UPDATE is only allowed on a single table")
        timeout = self.settings["lock_timeout"] / 1000
        end = time.monotonic() + timeout if timeout else None
        while True:
            with self.engine.latched([self.table(s.source.name).id]):
                df, owner = self._try_locking(s, em)
            if df is not None:
                return df
            if s.lock == "nowait" or not self.engine.locks.wait_for(owner, end):  # then again, with rows as of now
                raise SqlError("55P03", f"could not obtain lock on row in relation {s.source.name[-1]!r}")

    def _try_locking(self, s: A.Select, em) -> tuple[DataFrame | None, "Session | None"]:
        """The rows, all locked; or a session that holds one of them."""
        locks, meta = self.engine.locks, self.table(s.source.name)
        held, owners = locks.files_of_others(self, meta.id), []
        rows = self.read(meta).withColumn("__held", F.lit(None).cast("int"))
        if held:
            owners = [o for o, _ in held]
            ids = None
            for k, (_, path) in enumerate(held):
                one = self.storage.ids([path]).withColumn("__held", F.lit(k))
                ids = one if ids is None else ids.union(one)
            rows = rows.drop("__held").join(ids.groupBy(ROW_ID).agg(F.min("__held").alias("__held")), ROW_ID, "left")
        limit = em.count(s.limit, "LIMIT") if s.limit is not None else None
        skip = em.count(s.offset, "OFFSET") if s.offset is not None else 0
        items = s.items
        if any(isinstance(x, A.Star) for x, _ in items):
            items = [(A.Col([c.name]), c.name) for c in meta.columns]

        def ordered(base: DataFrame, order: list, extra: str) -> DataFrame:
            view = self.view(base)
            own = Emitter(lambda name: view if name == s.source.name else em.resolve(name), self._function, em.params)
            return self.spark.sql(own.select(A.Select(items, A.Table(s.source.name, s.source.alias or s.source.name[-1]), s.where, order=order), extra=extra))

        if limit is None:  # any number of rows: they are locked by a file, and come back in order
            single = locks.rows_of_others(self, meta.id)
            hit = self.spark.read.schema(f"{ROW_ID} long, __held int").parquet(self.storage.write(ordered(rows, [], f", {ROW_ID}, __held").select(ROW_ID, "__held")))
            if single:
                held_singly = self.spark.createDataFrame([(r,) for r in single], f"{ROW_ID} long")
                busy = hit.join(held_singly, ROW_ID, "left_semi").first()
                if s.lock == "skip":
                    hit = hit.join(held_singly, ROW_ID, "left_anti")
                elif busy is not None:
                    return None, locks.holder(self, meta.id, busy[ROW_ID])
            if s.lock == "skip":
                hit = hit.where("__held is null")
            elif held and (busy := hit.where("__held is not null").first()) is not None:
                return None, owners[busy["__held"]]
            path = self.storage.write(hit.select(ROW_ID))
            locks.take_file(self, meta.id, path)
            out = ordered(rows.join(self.storage.ids([path]), ROW_ID, "left_semi"), s.order, "")
            return out.offset(skip) if skip else out, None
        taken, mine = [], []
        df = ordered(rows, s.order, f", {ROW_ID}, __held")
        for row in df.toLocalIterator():
            if len(taken) >= limit + skip:
                break
            owner = locks.holder(self, meta.id, row[ROW_ID]) or (owners[row["__held"]] if row["__held"] is not None else None)
            if owner is None:
                mine.append(row[ROW_ID])
                taken.append(tuple(row)[:-2])
            elif s.lock != "skip":
                return None, owner
        for r in mine:
            locks.take(self, meta.id, r)
        return self.spark.createDataFrame(taken[skip:], df.drop(ROW_ID, "__held").schema), None

    # ---- transactions, snapshots, settings
    def _begin(self) -> None:
        self.in_tx, self.failed, self.tx_time = True, False, dt.datetime.now(dt.timezone.utc)

    def _end(self, commit: bool) -> None:
        done, tables = commit and not self.failed, list(self.pending)
        with self.engine.latched(tables):
            try:
                with self.engine.mutex:
                    base = self.shared
                    for k, change in self.pending.items() if done else ():
                        if k in base.tables:
                            base.versions[k] = base.versions.get(k, Version()).plus(change)
            finally:
                with self.engine.mutex:
                    self.in_tx = self.failed = False
                    self.pending, self.tx_time = {}, None
                self.engine.locks.release(self)
        if done:
            for k in tables:
                self._tidy(k)

    def _tidy(self, table_id: int) -> None:
        """Merge a table's files where they have become many; others may go on meanwhile, and what they add stays behind it."""
        with self.engine.mutex:
            base = self.shared
            meta, seen = base.tables.get(table_id), base.versions.get(table_id)
        if meta is None or (done := self.storage.compacted(meta, seen)) is None:
            return
        with self.engine.mutex:
            now = base.versions.get(table_id)
            n, m = len(seen.parts), len(seen.deletes)
            if now is not None and base.tables.get(table_id) is meta and (now.parts[:n], now.deletes[:m]) == (seen.parts, seen.deletes):
                base.versions[table_id] = done.plus(Version(now.parts[n:], now.deletes[m:]))

    def freeze(self) -> bool:
        """The database as it is becomes the start of every session's own copy; later calls do nothing."""
        with self.engine.mutex:
            if self.engine.frozen is None:
                self.engine.frozen = self.engine.db.copy()
        return True

    def reset(self) -> bool:
        """Forget what this session changed since the freeze."""
        self.own_db = None
        return True

    def close(self) -> None:
        if self.in_tx:
            self._end(False)
        self.engine.locks.release(self)
        self.engine.advisory.release(self)

    def _command(self, c: A.Command) -> Result:
        k, a = c.kind, c.args
        if k == "begin":
            if self.in_tx:
                raise SqlError("25001", "there is already a transaction in progress")
            self._begin()
            return Result("BEGIN")
        if k in ("commit", "rollback"):
            if not self.in_tx:
                raise SqlError("25P01", "there is no transaction in progress")
            done = k == "commit" and not self.failed
            self._end(done)
            return Result("COMMIT" if done else "ROLLBACK")
        if k == "set":
            return self._set(a["name"], a["value"])
        if k == "show":
            return Result("SHOW", 0, self.spark.createDataFrame([(self._show(a["name"]),)], f"`{a['name']}` string"))
        with self.engine.latched(list(self.shared.tables)), self.engine.mutex:
            base, self.trial = self.shared, self.shared.copy()
            try:
                getattr(ddl, k)(self, a)
                new = self.trial
                base.schemas, base.tables, base.versions, base.counters, base.next_id = new.schemas, new.tables, new.versions, new.counters, new.next_id
            finally:
                self.trial = None
        return Result(k.replace("_", " ").upper())

    def _set(self, name: str, value) -> Result:
        if name == "timezone":
            m = re.fullmatch(r"(?:utc|gmt|z)|([+-]?)(\d{1,2})(?::?(\d{2}))?", str(value).strip("'").lower())
            if not m:
                raise SqlError("22023", f"invalid value for timezone: {value!r}")
            zone = "UTC" if m[2] is None else f"{m[1] or '+'}{int(m[2]):02d}:{m[3] or '00'}"
            self._zone(zone)
            value = zone
        elif name == "lock_timeout":
            m = re.fullmatch(r"(\d+)\s*(ms|s|min)?", str(value))
            if not m:
                raise SqlError("22023", f"invalid value for lock_timeout: {value!r}")
            value = int(m[1]) * {"ms": 1, "s": 1000, "min": 60_000}[m[2] or "ms"]
        elif name in ("transaction_isolation", "default_transaction_isolation") and str(value).lower() != "read committed":
            raise SqlError("0A000", f"isolation level {value!r} is not supported")
        elif name not in self.settings:
            raise SqlError("42704", f"unrecognized configuration parameter {name!r}")
        self.settings[name] = value
        return Result("SET")

    def _zone(self, zone: str) -> None:
        """A Spark session of its own, alike but for the time zone: other sessions keep theirs."""
        old = self.spark
        if old.conf.get("spark.sql.session.timeZone") == zone:
            return
        self.spark = old.newSession()
        for k, v in old.conf.getAll.items():
            if k.startswith("spark.sql.") and self.spark.conf.isModifiable(k):
                self.spark.conf.set(k, v)
        self.spark.conf.set("spark.sql.session.timeZone", zone)
        self.storage = Storage(self.spark, self.engine.path)

    def _show(self, name: str) -> str:
        fixed = {"server_version": "15.0", "standard_conforming_strings": "on"}
        if name in fixed:
            return fixed[name]
        if name not in self.settings:
            raise SqlError("42704", f"unrecognized configuration parameter {name!r}")
        v = self.settings[name]
        return ", ".join(v) if isinstance(v, list) else f"{v}ms" if name == "lock_timeout" and v else str(v)


class Prepared:
    """A parsed statement; it sees the catalog as of each call."""

    def __init__(self, session: Session, tree):
        self.session, self.tree = session, tree

    def execute(self, *params) -> Result:
        return self.session._run(self.tree, params)

    def parameters(self) -> list[str | None]:
        """The type of each parameter, as its place in the statement says; None where it says nothing."""
        return P.types(self.tree, self.session)

    def columns(self) -> list[tuple[str, str]]:
        """Names and types of the result's columns, from the plan alone; empty where there are none."""
        s = self.tree
        if isinstance(s, A.Command):
            return []
        sample = [P.SAMPLES.get(t, "") for t in self.parameters()]
        if isinstance(s, A.Insert | A.Update | A.Delete):
            if s.returning is None:
                return []
            name = s.table if isinstance(s, A.Insert) else s.table.name
            alias = name[-1] if isinstance(s, A.Insert) else s.table.alias or name[-1]
            source = A.Table(name, alias)
            if isinstance(s, A.Update) and s.source is not None:
                source = A.Join("cross", source, s.source)
            s = A.Select(s.returning, source, ctes=s.ctes)
        return self.session.describe(s, sample)
