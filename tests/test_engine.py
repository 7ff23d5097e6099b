import struct
import threading

import pytest

from larkspur.engine import Engine
from larkspur.errors import SqlError
from larkspur.plans.parser import parse
from larkspur.sources import storage
from larkspur.sources.wire import as_binary


@pytest.fixture
def engine(spark):
    return Engine(spark)


@pytest.fixture
def s(engine):
    return engine.session()


def rows(s, sql, *params):
    return s.execute(sql, params).rows()


def fails(s, state, sql, *params):
    with pytest.raises(SqlError) as e:
        s.execute(sql, params).rows()
    assert e.value.sqlstate == state, e.value


def test_where_order_limit(s):
    s.execute("CREATE TABLE t (a int NOT NULL, b int)")
    s.execute("INSERT INTO t VALUES (7,31),(8,-4),(9,NULL),(11,12)")
    assert rows(s, "SELECT a, b FROM t ORDER BY 2 DESC") == [(9, None), (7, 31), (11, 12), (8, -4)]
    assert [r[0] for r in rows(s, "SELECT a FROM t ORDER BY b LIMIT $1 OFFSET $2::int", 2, 2)] == [7, 9]
    assert rows(s, "SELECT a + b AS x FROM t WHERE b > 10 ORDER BY x") == [(23,), (38,)]
    assert rows(s, "SELECT a FROM t ORDER BY b DESC NULLS LAST, a") == [(7,), (11,), (8,), (9,)]
    fails(s, "2201W", "SELECT a FROM t LIMIT $1", -1)
    fails(s, "2201X", "SELECT a FROM t OFFSET -1")
    fails(s, "42P10", "SELECT a FROM t ORDER BY 3")
    fails(s, "42803", "SELECT a, count(*) FROM t")
    fails(s, "23502", "INSERT INTO t VALUES (NULL, 1)")


def test_three_valued_logic_nan_and_casts(s):
    s.execute("CREATE TABLE p (id int PRIMARY KEY, active boolean, v float8, note text)")
    s.execute("INSERT INTO p VALUES (1,true,1,NULL),(2,false,'NaN','x'),(3,NULL,3,'y')")
    assert rows(s, "SELECT id FROM p WHERE active") == [(1,)]
    assert rows(s, "SELECT id FROM p WHERE NOT active") == [(2,)]
    assert rows(s, "SELECT id FROM p ORDER BY v DESC") == [(2,), (3,), (1,)]
    assert rows(s, "SELECT active::text || '!' AS t FROM p ORDER BY id") == [("t!",), ("f!",), (None,)]
    assert rows(s, "SELECT 7 / 2, 1.0::text, '42'::int4 + 1, 'abc' || 1") == [(3.5, "1", 43, "abc1")]
    fails(s, "22P02", "SELECT 'x'::int")
    fails(s, "22003", "SELECT 3000000000::int")
    fails(s, "22012", "SELECT 1 / 0")
    fails(s, "2201E", "SELECT ln(0)")
    fails(s, "22P02", "SELECT '{bad'::json")
    assert rows(s, """SELECT '{"a": 1}'::jsonb""") == [('{"a": 1}',)]
    fails(s, "42702", "SELECT id FROM p a JOIN p b ON a.id = b.id")
    fails(s, "42P01", "SELECT 1 FROM missing")
    fails(s, "42703", "SELECT missing FROM p")


def test_joins_and_subqueries(s):
    s.execute_batch("CREATE TABLE ports (k int PRIMARY KEY, town text); CREATE TABLE ships (k int PRIMARY KEY, p int, hull text)")
    s.execute("INSERT INTO ports VALUES (5,'Lund'),(6,'Nice'),(7,'Oban')")
    s.execute("INSERT INTO ships VALUES (1,5,'oak'),(2,6,'elm'),(3,6,'fir'),(4,NULL,'ash')")
    assert rows(s, "SELECT town, hull FROM ports a LEFT JOIN ships b ON a.k = b.p AND b.hull <> 'oak' ORDER BY a.k, hull") == [("Lund", None), ("Nice", "elm"), ("Nice", "fir"), ("Oban", None)]
    assert rows(s, "SELECT town FROM ports WHERE k NOT IN (SELECT p FROM ships)") == []  # a null in the list
    assert rows(s, "SELECT count(*) FROM ports, ships") == [(12,)]
    assert rows(s, "SELECT x.town FROM (SELECT town, row_number() OVER (ORDER BY k DESC) AS rn FROM ports) x WHERE rn = 1") == [("Oban",)]
    for state, sql in [("0A000", "SELECT 1 FROM ports a RIGHT JOIN ships b ON a.k = b.p"), ("0A000", "SELECT 1 UNION SELECT 2"), ("0A000", "WITH RECURSIVE a AS (SELECT 1) SELECT * FROM a"), ("0A000", "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM a) SELECT * FROM a"), ("42601", "SELECT FROM"), ("0A000", "CREATE DATABASE d"), ("42601", "UPDATE ports SET k = (SELECT k, p FROM ships)")]:
        fails(s, state, sql)
    fails(s, "21000", "UPDATE ports SET town = (SELECT hull FROM ships)")


def test_upsert_rounds_and_targets(s):
    s.execute("CREATE TABLE i (id int PRIMARY KEY, qty int, u int UNIQUE)")
    s.execute("INSERT INTO i VALUES (1, 10, 1)")
    r = s.execute("INSERT INTO i VALUES (1,5,1),(2,10,2),(1,99,1) ON CONFLICT (id) DO UPDATE SET qty = excluded.qty + i.qty RETURNING id, qty")
    assert r.tag == "INSERT 0 3" and sorted(r.rows()) == [(1, 114), (2, 10)]
    assert s.execute("INSERT INTO i VALUES (2,0,7),(3,0,8),(3,1,9) ON CONFLICT (id) DO NOTHING").tag == "INSERT 0 1"
    fails(s, "23505", "INSERT INTO i VALUES (4,0,1) ON CONFLICT (id) DO NOTHING")
    fails(s, "42P10", "INSERT INTO i VALUES (4,0,1) ON CONFLICT (qty) DO NOTHING")
    assert rows(s, "SELECT id, qty, u FROM i ORDER BY id") == [(1, 114, 1), (2, 10, 2), (3, 0, 8)]
    s.execute("INSERT INTO i VALUES (5, 1, NULL), (6, 1, NULL)")  # nulls are distinct


def test_foreign_keys(s):
    s.execute_batch("CREATE TABLE n (id int PRIMARY KEY, up int REFERENCES n (id) ON DELETE CASCADE); CREATE TABLE r (id int PRIMARY KEY, n int REFERENCES n (id))")
    s.execute("INSERT INTO n VALUES (1,NULL),(2,NULL)")
    s.execute("INSERT INTO n VALUES (3,1),(4,3),(5,2)")
    s.execute("INSERT INTO r VALUES (1, 5)")
    assert s.execute("DELETE FROM n WHERE id = 1").tag == "DELETE 1"
    assert rows(s, "SELECT id FROM n ORDER BY id") == [(2,), (5,)]
    fails(s, "23503", "DELETE FROM n WHERE id = 2")
    fails(s, "23503", "INSERT INTO r VALUES (2, 77)")
    fails(s, "0A000", "UPDATE n SET id = 9 WHERE id = 5")
    fails(s, "2BP01", "DROP TABLE n")
    fails(s, "42830", "CREATE TABLE bad (x int REFERENCES r (n))")
    s.execute("CREATE TABLE c2 (a int, b int, PRIMARY KEY (a, b))")
    s.execute("CREATE TABLE d2 (x int, y int, FOREIGN KEY (x, y) REFERENCES c2)")
    s.execute("INSERT INTO d2 VALUES (1, NULL)")
    fails(s, "23503", "INSERT INTO d2 VALUES (1, 2)")


def test_schema_changes(s):
    s.execute("CREATE TABLE t (a int, b text)")
    s.execute("INSERT INTO t VALUES (1,'x'),(1,'y')")
    fails(s, "23505", "ALTER TABLE t ADD PRIMARY KEY (a)")
    s.execute("ALTER TABLE t ADD CONSTRAINT u UNIQUE (b)")
    fails(s, "23505", "INSERT INTO t VALUES (2,'x')")
    s.execute("ALTER TABLE t DROP CONSTRAINT u")
    s.execute("CREATE INDEX IF NOT EXISTS ix ON t (a)")
    fails(s, "23505", "CREATE UNIQUE INDEX ux ON t (a)")
    s.execute("ALTER TABLE t ADD COLUMN z int NOT NULL DEFAULT 5")
    assert rows(s, "SELECT z FROM t") == [(5,), (5,)]
    s.execute("ALTER TABLE t DROP COLUMN IF EXISTS nope")
    s.execute("ALTER TABLE t RENAME TO q")
    fails(s, "42P07", "CREATE TABLE q (a int)")
    s.execute("CREATE SCHEMA s1")
    s.execute("CREATE TABLE s1.k (a int)")
    fails(s, "2BP01", "DROP SCHEMA s1")
    s.execute("DROP SCHEMA s1 CASCADE")
    fails(s, "42P01", "SELECT * FROM s1.k")
    s.execute("DROP TABLE IF EXISTS nope, q")


def test_transactions_between_sessions(engine):
    a, b = engine.session(), engine.session()
    a.execute("CREATE TABLE t (id int PRIMARY KEY, v int)")
    a.execute("INSERT INTO t VALUES (1,1),(2,2)")
    a.execute("BEGIN")
    fails(b, "25P01", "COMMIT")
    a.execute("UPDATE t SET v = 10 WHERE id = 1")
    assert rows(b, "SELECT v FROM t ORDER BY id") == [(1,), (2,)]
    fails(b, "55P03", "UPDATE t SET v = 11 WHERE id = 1")
    b.execute("UPDATE t SET v = 20 WHERE id = 2")
    a.execute("COMMIT")
    assert rows(b, "SELECT v FROM t ORDER BY id") == [(10,), (20,)]
    with pytest.raises(SqlError):
        b.execute_batch("INSERT INTO t VALUES (3,3); INSERT INTO t VALUES (3,4)")
    assert rows(b, "SELECT count(*) FROM t") == [(2,)]
    a.execute("BEGIN")
    fails(a, "42703", "SELECT nope FROM t")
    fails(a, "25P02", "SELECT 1")
    assert a.execute("COMMIT").tag == "ROLLBACK"


def test_row_locks_and_advisory_locks(engine):
    a, b = engine.session(), engine.session()
    a.execute("CREATE TABLE jobs (id int PRIMARY KEY, ready boolean)")
    a.execute("INSERT INTO jobs VALUES (1,true),(2,true),(3,true)")
    a.execute("BEGIN")
    b.execute("BEGIN")
    assert rows(a, "SELECT id FROM jobs WHERE ready ORDER BY id FOR UPDATE SKIP LOCKED LIMIT 1") == [(1,)]
    assert rows(b, "SELECT id FROM jobs WHERE ready ORDER BY id FOR UPDATE SKIP LOCKED LIMIT 1") == [(2,)]
    b.execute("ROLLBACK")
    fails(b, "55P03", "SELECT id FROM jobs ORDER BY id FOR UPDATE NOWAIT")
    b.execute("SET lock_timeout = 50")
    fails(b, "55P03", "SELECT id FROM jobs ORDER BY id FOR UPDATE")
    fails(b, "0A000", "SELECT count(*) FROM jobs GROUP BY id FOR UPDATE")
    a.execute("SELECT pg_advisory_lock(5)")
    done = threading.Event()
    t = threading.Thread(target=lambda: (engine.advisory.take(b, 5), done.set()))
    t.start()
    assert not done.wait(0.2)
    a.close()
    assert done.wait(2)
    t.join()


def test_freeze_and_reset(engine):
    a = engine.session()
    a.execute("CREATE TABLE f (id int PRIMARY KEY)")
    a.execute("INSERT INTO f VALUES (1)")
    assert rows(a, "SELECT engine_freeze()") == [(True,)]
    b = engine.session()
    a.execute("INSERT INTO f VALUES (2)")
    assert rows(a, "SELECT count(*) FROM f") == [(2,)] and rows(b, "SELECT count(*) FROM f") == [(1,)]
    a.execute("SELECT engine_reset()")
    assert rows(a, "SELECT count(*) FROM f") == [(1,)]


def test_prepared_settings_identity(s):
    s.execute("CREATE TABLE t (i bigint GENERATED ALWAYS AS IDENTITY, a text, at timestamptz DEFAULT now())")
    p = s.prepare("INSERT INTO t (a) VALUES ($1)")
    p.execute("x")
    p.execute(None)
    assert rows(s, "SELECT i, a, at IS NOT NULL FROM t ORDER BY i") == [(1, "x", True), (2, None, True)]
    fails(s, "428C9", "INSERT INTO t (i, a) VALUES (9, 'y')")
    s.execute("INSERT INTO t (i, a) OVERRIDING SYSTEM VALUE VALUES (9, 'y')")
    s.execute("CREATE TABLE many (i bigint GENERATED BY DEFAULT AS IDENTITY (START WITH 5 INCREMENT BY 2), a text)")
    s.engine.register("src", s.spark.range(0, 40, 1, 4).selectExpr("cast(id as string) AS a"))
    s.execute("INSERT INTO many (a) SELECT a FROM src")
    s.execute("INSERT INTO many (a) VALUES ('z')")
    assert sorted(r[0] for r in rows(s, "SELECT i FROM many")) == list(range(5, 87, 2))
    fails(s, "42601", "SELECT 1; SELECT 2")
    assert rows(s, "SHOW search_path") == [("public",)]
    fails(s, "42704", "SHOW nothing")


def test_splitting_and_comments():
    assert len(parse("SELECT 'a;b'; -- no; \n /* ; */ SELECT $$x;y$$;;")) == 2


def test_registered_source_is_pruned(spark, engine, s, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS w").write.parquet(path)
    engine.register("src", spark.read.parquet(path))
    df = s.query("SELECT id FROM src WHERE v > 150")
    assert df.count() == 24
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,150)]" in plan and "w:string" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_bytes(s):
    s.execute("CREATE TABLE b (i int PRIMARY KEY, x bytea DEFAULT '\\x00ff', y timestamptz)")
    s.execute(r"INSERT INTO b (i, x) VALUES (1, '\x616263'), (2, DEFAULT), (3, 'plain'), (4, NULL)")
    assert rows(s, "SELECT i, x, length(x) FROM b ORDER BY i") == [(1, b"abc", 3), (2, b"\0\xff", 2), (3, b"plain", 5), (4, None, None)]
    assert rows(s, r"SELECT length('\x0102'::bytea), length('\x'::bytea)") == [(2, 0)]
    fails(s, "22001", r"SELECT '\x012'::bytea")
    s.execute(r"UPDATE b SET x = '\x01' WHERE i = 4")
    assert rows(s, "SELECT x FROM b WHERE i = 4") == [(b"\x01",)]


def test_binary_rows(s):
    df = s.query("SELECT 1::int AS a, -2::bigint AS b, 1.5::float8 AS c, true AS d, 'é' AS e, date '1999-12-31' AS f, timestamp '2000-01-01 00:00:01' AS g, timestamptz '2000-01-01 00:00:00+00' AS h, NULL::int AS i, '\\x0a'::bytea AS j, interval '90 seconds' AS k")
    got = [None if v is None else bytes(v) for v in as_binary(df).first()]
    want = [struct.pack(">i", 1), struct.pack(">q", -2), struct.pack(">d", 1.5), b"\1", "é".encode(), struct.pack(">i", -1), struct.pack(">q", 10**6), struct.pack(">q", 0), None, b"\n", b"00:01:30"]
    assert got == want
    assert as_binary(df.limit(0)).count() == 0


def test_added_and_dropped_columns_rewrite_nothing(engine, s):
    s.execute("CREATE TABLE t (a int, b text)")
    s.execute("INSERT INTO t VALUES (1, 'x'), (2, NULL)")
    meta = s.table(["t"])
    before = s.version(meta.id)
    s.execute("ALTER TABLE t ADD COLUMN z text DEFAULT upper('ab')")
    s.execute("ALTER TABLE t DROP COLUMN b")
    s.execute("ALTER TABLE t ADD COLUMN b int")
    assert s.version(meta.id) == before
    s.execute("INSERT INTO t (a, z, b) VALUES (3, NULL, 7)")
    assert rows(s, "SELECT a, z, b FROM t ORDER BY a") == [(1, "AB", None), (2, "AB", None), (3, None, 7)]
    fails(s, "23502", "ALTER TABLE t ADD COLUMN n int NOT NULL")
    fails(s, "23505", "ALTER TABLE t ADD COLUMN u int DEFAULT 1 UNIQUE")
    assert rows(s, "SELECT * FROM t WHERE a = 3") == [(3, None, 7)]  # what failed has left nothing behind


def test_upsert_writes_only_what_it_touches(spark, s):
    s.execute("CREATE TABLE t (k bigint PRIMARY KEY, v bigint)")
    s.engine.register("many", spark.range(5000).selectExpr("id AS k", "0L AS v"))
    s.execute("INSERT INTO t SELECT k, v FROM many")
    meta, base = s.table(["t"]), s.storage.write
    sizes = []

    def counted(df):
        path = base(df)
        sizes.append(s.spark.read.parquet(path).count())
        return path

    s.storage.write = counted
    assert s.execute("INSERT INTO t VALUES (7, 1), (7, 2), (6000, 3), (7, 4) ON CONFLICT (k) DO UPDATE SET v = t.v + excluded.v").count == 4
    assert max(sizes) <= 4 and rows(s, "SELECT count(*), sum(v) FROM t") == [(5001, 10)] and len(s.version(meta.id).deletes) == 1


@pytest.mark.parametrize("other", ["0", "(SELECT 0)"])  # without and with a subquery
def test_upsert_folds_repeated_keys(spark, s, other):
    s.execute("CREATE TABLE t (k bigint PRIMARY KEY, v bigint, n text DEFAULT 'd', u bigint UNIQUE)")
    s.execute("INSERT INTO t (k, v) VALUES (1, 100)")
    s.execute(f"INSERT INTO t VALUES (1, 5, 'a', NULL), (2, 7, 'b', 1), (1, -200, 'c', NULL), (2, 1, 'e', 2), (1, 9, 'f', NULL) ON CONFLICT (k) DO UPDATE SET v = t.v * 2 + excluded.v + {other}, n = DEFAULT WHERE t.v + excluded.v > 0")
    one = 2 * (2 * (2 * 100 + 5) - 200) + 9  # all three rows fit the condition in turn
    assert rows(s, "SELECT k, v, n, u FROM t ORDER BY k") == [(1, one, "d", None), (2, 2 * 7 + 1, "d", 1)]
    s.execute(f"INSERT INTO t VALUES (8, 1, 'x', NULL), (9, 1, 'y', NULL) ON CONFLICT (u) DO UPDATE SET v = {other}")
    assert rows(s, "SELECT count(*) FROM t WHERE u IS NULL") == [(3,)]


def test_files_are_merged(s, monkeypatch):
    monkeypatch.setattr(storage, "MERGE_DELETES", 3)
    monkeypatch.setattr(storage, "MERGE_PARTS", 4)
    s.execute("CREATE TABLE t (k int PRIMARY KEY, v int)")
    s.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, 0)" for i in range(12)))
    for i in range(7):
        s.execute(f"UPDATE t SET v = v + 1 WHERE k IN ({i}, {i + 1})")
        v = s.version(s.table(["t"]).id)
        assert len(v.parts) <= 4 and len(v.deletes) <= 3
    assert rows(s, "SELECT count(*), sum(v) FROM t") == [(12, 14)]


def test_first_source_row_of_joins_and_subqueries(s):
    s.execute_batch("CREATE TABLE t (k int, v int, w int); INSERT INTO t VALUES (1, 0, 0), (2, 0, 0); CREATE TABLE u (k int, v int); CREATE TABLE x (v int, w int)")
    s.execute("INSERT INTO u VALUES (1, 9), (1, 3), (2, 5)")
    s.execute("INSERT INTO x VALUES (3, 30), (9, 91), (9, 90), (5, 51), (5, 50)")
    assert s.execute("UPDATE t SET v = u.v, w = x.w FROM u JOIN x ON x.v = u.v WHERE u.k = t.k RETURNING t.k, x.w").count == 2
    assert rows(s, "SELECT k, v, w FROM t ORDER BY k") == [(1, 9, 91), (2, 5, 51)]
    s.execute("UPDATE t SET v = d.v FROM (SELECT k, v FROM u ORDER BY v) d WHERE d.k = t.k")
    assert rows(s, "SELECT k, v FROM t ORDER BY k") == [(1, 3), (2, 5)]
    s.execute("WITH u AS (SELECT 1 AS k, 77 AS v) UPDATE t SET v = u.v FROM u WHERE u.k = t.k")
    assert rows(s, "SELECT k, v FROM t ORDER BY k") == [(1, 77), (2, 5)]


def test_keys_of_open_transactions(engine):
    a, b = engine.session(), engine.session()
    a.execute_batch("CREATE TABLE p (k int PRIMARY KEY, v int); CREATE TABLE c (k int PRIMARY KEY, p int REFERENCES p (k) ON DELETE CASCADE); INSERT INTO p VALUES (1, 0), (2, 0), (3, 0)")
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("INSERT INTO p VALUES (10, 0)")
    fails(b, "23505", "INSERT INTO p VALUES (10, 1)")
    b.execute("ROLLBACK")
    assert b.execute("INSERT INTO p VALUES (10, 1) ON CONFLICT DO NOTHING").count == 0
    fails(b, "55P03", "INSERT INTO p VALUES (10, 1) ON CONFLICT (k) DO UPDATE SET v = 2")
    a.execute("DELETE FROM p WHERE k = 1")
    a.execute("UPDATE p SET v = 5 WHERE k = 2")
    fails(b, "23503", "INSERT INTO c VALUES (1, 1)")
    assert b.execute("INSERT INTO c VALUES (2, 2)").count == 1  # the parent keeps its key
    a.execute("ROLLBACK")
    assert b.execute("INSERT INTO p VALUES (10, 1)").count == 1 and b.execute("INSERT INTO c VALUES (1, 1)").count == 1
    b.execute("BEGIN")
    b.execute("INSERT INTO c VALUES (3, 3)")
    fails(a, "23503", "DELETE FROM p WHERE k = 3")
    fails(a, "55P03", "ALTER TABLE c ADD COLUMN z int")
    fails(a, "55P03", "TRUNCATE c")
    b.execute("COMMIT")
    assert a.execute("DELETE FROM p WHERE k = 3").count == 1 and rows(a, "SELECT count(*) FROM c") == [(2,)]


def test_concurrent_writers(engine):
    a = engine.session()
    a.execute_batch("CREATE TABLE t (k int PRIMARY KEY, v int); INSERT INTO t VALUES (0, 0)")
    done, lost = [], []

    def work(n):
        x = engine.session()
        for i in range(3):
            try:
                done.append(x.execute(f"INSERT INTO t VALUES ({i + 1}, {n})").count)
            except SqlError as e:
                lost.append(e.sqlstate)
            while True:
                try:
                    x.execute("UPDATE t SET v = v + 1 WHERE k = 0")
                    break
                except SqlError as e:
                    assert e.sqlstate == "55P03"

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 3 and set(lost) == {"23505"} and len(lost) == 6
    assert rows(a, "SELECT count(*), max(CASE WHEN k = 0 THEN v END) FROM t") == [(4, 9)]


def test_locks_of_many_rows_and_waiting(engine, spark):
    a, b = engine.session(), engine.session()
    engine.register("many", lambda s: s.range(12_000).selectExpr("id AS k", "0L AS v"))
    a.execute_batch("CREATE TABLE t (k bigint PRIMARY KEY, v bigint); INSERT INTO t SELECT k, v FROM many")
    a.execute("BEGIN")
    a.execute("UPDATE t SET v = 1 WHERE k < 11000")
    assert b.execute("UPDATE t SET v = 2 WHERE k = 11500").count == 1
    fails(b, "55P03", "UPDATE t SET v = 2 WHERE k = 10999")
    assert rows(b, "SELECT k FROM t ORDER BY k FOR UPDATE SKIP LOCKED LIMIT 1") == [(11_000,)]
    assert b.execute("SELECT k FROM t FOR UPDATE SKIP LOCKED").df.count() == 1000
    fails(b, "55P03", "SELECT k FROM t WHERE k = 5 FOR UPDATE NOWAIT")
    b.execute("SET lock_timeout = 100")
    fails(b, "55P03", "SELECT k FROM t WHERE k = 5 FOR UPDATE LIMIT 1")
    b.execute("SET lock_timeout = 0")
    out = []
    t = threading.Thread(target=lambda: out.append(rows(b, "SELECT v FROM t WHERE k = 5 FOR UPDATE")))
    t.start()
    t.join(1)
    assert t.is_alive()
    a.execute("COMMIT")
    t.join(60)
    assert out == [[(1,)]]  # as committed meanwhile


def test_zone_belongs_to_a_session(engine, spark):
    a, b = engine.session(), engine.session()
    a.execute_batch("CREATE TABLE t (at timestamptz); INSERT INTO t VALUES ('2024-05-01 12:00:00+00')")
    engine.register("src", spark.range(3).selectExpr("id"))
    a.execute("SET timezone TO '+02:00'")
    assert rows(a, "SELECT at::text FROM t") == [("2024-05-01 14:00:00",)] and rows(b, "SELECT at::text FROM t") == [("2024-05-01 12:00:00",)]
    a.execute("INSERT INTO t VALUES ('2024-05-01 12:00:00')")  # local time
    assert rows(b, "SELECT at::text FROM t ORDER BY at") == [("2024-05-01 10:00:00",), ("2024-05-01 12:00:00",)]
    assert rows(a, "SELECT count(*) FROM src") == [(3,)] and spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_described_statements(s):
    s.execute("CREATE TABLE t (k bigint PRIMARY KEY, p float8, note text)")
    p = s.prepare("SELECT k, p * 2 AS d FROM t WHERE note = $1 AND p > $2 AND k IN ($3, 4) LIMIT $4")
    assert p.parameters() == ["string", "double", "bigint", "bigint"] and p.columns() == [("k", "bigint"), ("d", "double")]
    assert s.prepare("INSERT INTO t (p, k) VALUES ($2, $1) RETURNING k").parameters() == ["bigint", "double"]
    assert s.prepare("INSERT INTO t (p, k) VALUES ($2, $1) RETURNING k").columns() == [("k", "bigint")]
    assert s.prepare("UPDATE t SET p = $1, note = $2 WHERE k = $3").parameters() == ["double", "string", "bigint"]
    assert s.prepare("SELECT $1").parameters() == [None] and s.prepare("DELETE FROM t").columns() == []
    assert s.prepare("WITH x AS (SELECT k FROM t WHERE p = $1) SELECT k + $2::int AS n FROM x").columns() == [("n", "bigint")]


def test_lineage_of_a_batch_keeps_order(s):
    out = s.execute_batch("CREATE TABLE t (k int); INSERT INTO t VALUES (3), (1), (2); SELECT k, k FROM t ORDER BY k DESC; DELETE FROM t")
    assert out[2].rows() == [(3, 3), (2, 2), (1, 1)]
