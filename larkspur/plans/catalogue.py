"""Registered queries of the engine's own operators and the SQL that checks them.

Each runs dialect SQL through a session over the whole Parquet tables. Where DuckDB reads the same text, it is its own
oracle; else a second text states the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.engine import Engine, Session
from larkspur.errors import SqlError
from larkspur.sources.text import as_text
from larkspur.sources.wire import as_binary

TABLES = "region nation customer supplier part orders lineitem events".split()

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def open_session(spark: SparkSession, sf_dir: str) -> Session:
    engine = Engine(spark)
    for name in TABLES:  # a table is opened when a statement first names it
        engine.register(name, lambda spark, path=f"{sf_dir}/{name}.parquet": spark.read.parquet(path))
    return engine.session()


def query(name: str, sql: str, oracle: str | None = None, params=()) -> None:
    QUERIES[name] = lambda spark, sf_dir: open_session(spark, sf_dir).query(sql, params)
    ORACLES[name] = oracle or sql


def script(name: str, statements: list[str], oracle: str) -> None:
    """Statements in a row; the last one gives the rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = open_session(spark, sf_dir)
        for sql in statements[:-1]:
            s.execute_batch(sql)
        return s.query(statements[-1])

    QUERIES[name] = run
    ORACLES[name] = oracle


def state(name: str, setup: list[str], bad: str, sqlstate: str) -> None:
    """The SQLSTATE that a statement fails with."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = open_session(spark, sf_dir)
        for sql in setup:
            s.execute_batch(sql)
        try:
            s.execute(bad).rows()
            got = "00000"
        except SqlError as e:
            got = e.sqlstate
        return spark.createDataFrame([(got,)], "sqlstate string")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT '{sqlstate}' AS sqlstate"


def calls(name: str, f, schema: str, oracle: str) -> None:
    """Rows that f(engine's first session) gives."""
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(f(open_session(spark, sf_dir)), schema)
    ORACLES[name] = oracle


FLAGSHIP = """
SELECT c_mktsegment, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment."""
    return open_session(spark, sf_dir).query(FLAGSHIP)


# ---- scans and sources
query("S1_scan_columns", "SELECT o.o_orderkey, o.o_totalprice FROM orders AS o")
query("S2_cte_scan", "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
script("S3_values_rows", ["CREATE TABLE t (a int, b text)", "INSERT INTO t VALUES (1, 'x'), (2, NULL), (3, 'z')", "SELECT a, b FROM t"], "SELECT * FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) t(a, b)")
query("S4_literal_select", "SELECT 1 AS a, 'x' AS b, 1.5 AS c, true AS d", "SELECT 1 AS a, 'x' AS b, 1.5::DOUBLE AS c, true AS d")
query("S5_derived_table", "SELECT d.k, d.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 10")
script("S6_system_catalog", ["CREATE SCHEMA s1", "CREATE TABLE s1.t (a int)", "CREATE TABLE u (a int PRIMARY KEY)", "SELECT schemaname, tablename, hasindexes FROM pg_catalog.pg_tables"], "SELECT * FROM (VALUES ('s1', 't', false), ('public', 'u', true)) t(schemaname, tablename, hasindexes)")
QUERIES["S7_text_rows"] = lambda spark, sf_dir: as_text(open_session(spark, sf_dir).query("SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice > 100000 AS b, o_custkey * 1.0 AS f FROM orders"))
ORACLES["S7_text_rows"] = "SELECT o_orderkey::VARCHAR AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d, CASE WHEN o_totalprice > 100000 THEN 't' ELSE 'f' END AS b, o_custkey::VARCHAR AS f FROM orders"
QUERIES["S7_binary_rows"] = lambda spark, sf_dir: spark.sql("SELECT hex(k) AS k, hex(c) AS c, hex(d) AS d, hex(b) AS b, hex(s) AS s FROM {df}", df=as_binary(open_session(spark, sf_dir).query("SELECT o_orderkey::bigint AS k, o_custkey::int AS c, o_orderdate::date AS d, o_totalprice > 100000 AS b, o_orderstatus AS s FROM orders")))
ORACLES["S7_binary_rows"] = "SELECT printf('%016X', o_orderkey::BIGINT) AS k, printf('%08X', o_custkey::INT) AS c, CASE WHEN o_orderdate::DATE >= DATE '2000-01-01' THEN printf('%08X', date_diff('day', DATE '2000-01-01', o_orderdate::DATE)) ELSE printf('%08X', 4294967296 + date_diff('day', DATE '2000-01-01', o_orderdate::DATE)) END AS d, CASE WHEN o_totalprice > 100000 THEN '01' ELSE '00' END AS b, hex(o_orderstatus) AS s FROM orders"
query("S8_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderpriority = $2", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderpriority = '1-URGENT'", (250000, "1-URGENT"))
# ---- projections
query("P1_expressions", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
query("P2_star", "SELECT * FROM nation")
query("P3_qualified_columns", "SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
query("P4_output_names", "SELECT count(*), max(o_totalprice) FROM orders", 'SELECT count(*) AS count, max(o_totalprice) AS max FROM orders')
query("P5_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done FROM orders")
query("P6_boolean_value", "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus IS NOT NULL AS big FROM orders")
query("P7_casts", "SELECT c_custkey, CAST(c_custkey AS text) AS t, c_nationkey::bigint AS b, '42'::int4 AS i, '3.5'::float8 AS f FROM customer")
query("P8_inline_scalar_subquery", "SELECT n_nationkey, (SELECT 7) AS k FROM nation")
query("P9_where_only_column", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
# ---- filters
query("F1_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05")
query("F2_comparisons", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size <> 15 AND p_retailprice != 1000")
query("F3_three_valued", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 OR c_mktsegment = 'BUILDING') AND NULL IS NULL")
query("F4_is_null", "SELECT e.event_id, e.user_id IS NULL AS a, e.value IS NOT NULL AS b FROM events e")
query("F5_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
query("F6_any_array", "SELECT n_name FROM nation WHERE n_regionkey = ANY(ARRAY[1, 2])", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2)")
query("F7_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
query("F8_bare_boolean", "SELECT k FROM (SELECT o_orderkey AS k, o_totalprice > 150000 AS big FROM orders) d WHERE big")
query("F9_boolean_literal", "SELECT n_name FROM nation WHERE true")
query("F10_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000")
# ---- joins
query("J1_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
query("J1_theta_join", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
query("J2_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
query("J3_comma_join", "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
query("J3_cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region")
query("J4_join_tree", "SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
query("J5_self_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
query("J6_semi_join", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
query("J7_anti_join", "SELECT p_partkey FROM part WHERE NOT p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
# ---- aggregation
query("A1_group_by", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
query("A2_global_on_nothing", "SELECT sum(l_quantity) AS s, count(*) AS n, max(l_tax) AS m FROM lineitem WHERE false")
query("A3_count_star", "SELECT count(*) AS n FROM lineitem")
query("A4_count_expression", "SELECT count(CASE WHEN l_tax > 0.05 THEN 1 END) AS n FROM lineitem")
query("A5_sum", "SELECT sum(l_linenumber) AS i, sum(l_quantity) AS d FROM lineitem", "SELECT sum(l_linenumber)::BIGINT AS i, sum(l_quantity) AS d FROM lineitem")
query("A6_avg", "SELECT o_orderpriority, avg(o_custkey) AS a FROM orders GROUP BY o_orderpriority")
query("A7_min_max", "SELECT o_orderstatus, min(o_orderdate) AS a, max(o_orderpriority) AS b, min(o_totalprice) AS c FROM orders GROUP BY o_orderstatus")
query("A8_bool_and", "SELECT c_mktsegment, bool_and(c_acctbal > -900) AS b FROM customer GROUP BY c_mktsegment")
query("A9_over_aggregates", "SELECT o_orderstatus, coalesce(sum(o_custkey), 0) + 1 AS a, sum(o_custkey) / count(*) AS b FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, (coalesce(sum(o_custkey), 0) + 1)::BIGINT AS a, sum(o_custkey) / count(*) AS b FROM orders GROUP BY o_orderstatus")
query("A10_aggregate_of_expression", "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders GROUP BY o_custkey", "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f FROM orders GROUP BY o_custkey")
# ---- windows, sorting, paging
query("W1_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
query("W2_two_windows", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS b FROM customer")
query("W3_first_of_each", "SELECT k, p FROM (SELECT o_custkey AS k, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) r WHERE rn = 1")
query("O1_order_by", "SELECT n_name AS a, n_regionkey FROM nation ORDER BY 2 DESC, a, n_nationkey + 1")
query("O2_null_order", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC, c_custkey) AS rn FROM customer", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS FIRST, c_custkey) AS rn FROM customer")
query("O4_order_by_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
query("L1_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
query("L2_limit_parameter", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT $1::int OFFSET $2", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3", (7, 3))
query("L3_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
# ---- scalar functions
query("X1_arithmetic", "SELECT c_custkey, c_nationkey + 2 * 3 - 1 AS a, c_acctbal * 2 - 0.5 AS b FROM customer", "SELECT c_custkey, c_nationkey + 2 * 3 - 1 AS a, c_acctbal * 2 - 0.5::DOUBLE AS b FROM customer")
query("X2_division", "SELECT o_orderkey, o_custkey / 7 AS a FROM orders")
query("X3_minus", "SELECT c_custkey, - c_acctbal AS a, -c_nationkey AS b FROM customer")
query("X4_concat", "SELECT c_custkey, c_name || '-' || c_custkey || ':' || (c_acctbal > 0) AS t FROM customer", "SELECT c_custkey, c_name || '-' || c_custkey || ':' || CASE WHEN c_acctbal > 0 THEN 't' ELSE 'f' END AS t FROM customer")
query("X5_coalesce", "SELECT c_custkey, coalesce(NULL, CASE WHEN c_acctbal > 0 THEN c_name END, 'none') AS c FROM customer")
query("X6_upper_lower", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
query("X7_length", "SELECT c_custkey, length(c_name) AS n, char_length(c_mktsegment) AS m FROM customer", "SELECT c_custkey, length(c_name)::INT AS n, length(c_mktsegment)::INT AS m FROM customer")
query("X7_length_of_bytes", r"SELECT c_custkey, length('\x0102ff'::bytea) AS n, length(c_name::bytea) AS m FROM customer", "SELECT c_custkey, 3 AS n, octet_length(encode(c_name))::INT AS m FROM customer")
query("X8_abs", "SELECT c_custkey, abs(c_acctbal) AS a FROM customer")
query("X9_ln", "SELECT o_orderkey FROM orders WHERE ln(o_totalprice) > 11.5")
query("X10_log", "SELECT o_orderkey FROM orders WHERE log(o_totalprice) > 5.1 AND log(2, o_totalprice) > 17", "SELECT o_orderkey FROM orders WHERE log10(o_totalprice) > 5.1 AND ln(o_totalprice) / ln(2) > 17")
query("X11_greatest", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 25.0, NULL) AS g FROM lineitem", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 25.0) AS g FROM lineitem")
query("X12_epoch", "SELECT event_id, extract(epoch FROM ts) AS a, date_part('epoch', ts) AS b FROM events")
query("X13_now", "SELECT now() = transaction_timestamp() AS a, current_timestamp > timestamptz '2020-01-01 00:00:00+00' AS b", "SELECT true AS a, true AS b")
query("X14_statement_timestamp", "SELECT statement_timestamp() = now() AS a", "SELECT true AS a")
query("X15_clock_timestamp", "SELECT clock_timestamp() >= now() AS a", "SELECT true AS a")
query("X16_current_date", "SELECT current_date > date '2020-01-01' AS a", "SELECT true AS a")
query("X17_interval_arithmetic", "SELECT event_id, extract(epoch FROM (ts::timestamptz + interval '2 hours' - interval '30 minutes')) AS a FROM events", "SELECT event_id, epoch(ts) + 5400 AS a FROM events")
query("X18_interval_literal", "SELECT timestamptz '2024-01-02 00:00:00+00' - timestamptz '2024-01-01 00:00:00+00' = interval '1 day' AS a", "SELECT true AS a")
query("X19_current_schema", "SELECT current_schema() AS a, current_schemas(true) AS b, current_database() AS c", "SELECT 'public' AS a, '{pg_catalog,public}' AS b, 'postgres' AS c")
query("X20_version", "SELECT length(version()) > 0 AS a", "SELECT true AS a")
query("X21_table_is_visible", "SELECT n_nationkey FROM nation WHERE pg_table_is_visible(n_nationkey)", "SELECT n_nationkey FROM nation")
script("X22_advisory_lock", ["SELECT pg_advisory_lock(7)", "SELECT pg_advisory_unlock(7) AS a, pg_advisory_unlock(8) AS b"], "SELECT true AS a, false AS b")
# ---- subqueries and common table expressions
query("Q1_in_subquery_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) IN (SELECT n_nationkey FROM nation)")
query("Q2_nested_aggregates", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) d GROUP BY n")
query("C1_with", "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM customer JOIN t ON k = c_custkey WHERE s > 1000000 GROUP BY c_mktsegment")
query("C2_column_aliases", "WITH t(a, b) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT a, b FROM t")
query("C3_forward_reference", "WITH a AS (SELECT k + 1 AS k FROM b), b AS (SELECT n_nationkey AS k FROM nation) SELECT k FROM a", "SELECT n_nationkey + 1 AS k FROM nation")
query("C4_shadowing", "WITH nation AS (SELECT r_name AS n FROM region) SELECT n FROM nation")
query("C5_reused", "WITH t AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT a.r AS r, b.n AS n FROM t a JOIN t b ON a.r = b.r")

# ---- data changes
_ORDERS = "CREATE TABLE o (k bigint PRIMARY KEY, c bigint, s text, p float8)"
_FILL = "INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_BASE = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders"
script("D1_insert_values", ["CREATE TABLE t (a int NOT NULL, b text DEFAULT 'n/a', c int DEFAULT 1 + 2)", "INSERT INTO t (a, b) VALUES (1, 'x'), (2, DEFAULT)", "INSERT INTO t (a) VALUES (3)", "SELECT a, b, c FROM t"], "SELECT * FROM (VALUES (1, 'x', 3), (2, 'n/a', 3), (3, 'n/a', 3)) t(a, b, c)")
script("D2_insert_select", [_ORDERS, _FILL, "SELECT k, c, s, p FROM o"], _BASE)
script("D3_on_conflict_nothing", [_ORDERS, "INSERT INTO o SELECT o_orderkey, 0, 'x', 0.0 FROM orders WHERE o_orderstatus = 'F'", "INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ON CONFLICT (k) DO NOTHING", "SELECT k, c, s, p FROM o"], "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS c, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE o_orderstatus END AS s, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS p FROM orders")
script("D4_on_conflict_update", [_ORDERS, "INSERT INTO o SELECT o_orderkey, 0, 'x', 1.0 FROM orders WHERE o_orderstatus = 'F'", "INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ON CONFLICT (k) DO UPDATE SET p = o.p + excluded.p, s = excluded.s WHERE excluded.c > 10", "SELECT k, c, s, p FROM o"], "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS c, CASE WHEN o_orderstatus = 'F' AND o_custkey <= 10 THEN 'x' ELSE o_orderstatus END AS s, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey > 10 THEN 1 + o_totalprice ELSE 1 END ELSE o_totalprice END AS p FROM orders")
script("D5_update_from", [_ORDERS, _FILL, "UPDATE o t SET s = d.m FROM (SELECT c_custkey AS ck, c_mktsegment AS m FROM customer) d WHERE d.ck = t.c AND t.p > 100000", "SELECT k, s FROM o"], "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN coalesce(c_mktsegment, o_orderstatus) ELSE o_orderstatus END AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
script("D6_delete", [_ORDERS, _FILL, "DELETE FROM o WHERE c IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR p < 50000", "SELECT k FROM o"], "SELECT o_orderkey AS k FROM orders WHERE NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_totalprice < 50000)")
script("D7_cascade", ["CREATE TABLE c (k bigint PRIMARY KEY)", "CREATE TABLE o (k bigint PRIMARY KEY, c bigint REFERENCES c (k) ON DELETE CASCADE)", "INSERT INTO c SELECT c_custkey FROM customer", "INSERT INTO o SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", "DELETE FROM c WHERE k < 100", "SELECT k, c FROM o"], "SELECT o_orderkey AS k, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey >= 100")
script("D8_returning", [_ORDERS, _FILL, "UPDATE o SET p = p * 2 WHERE s = 'F' RETURNING k, p AS doubled"], "SELECT o_orderkey AS k, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F'")
script("D10_truncate", [_ORDERS, _FILL, "TRUNCATE o", "SELECT count(*) AS n FROM o"], "SELECT 0::BIGINT AS n")
script("D12_default_expression", ["CREATE TABLE t (a int, b text DEFAULT upper('ab' || 'cd'))", "INSERT INTO t (a) SELECT n_nationkey FROM nation", "SELECT a, b FROM t"], "SELECT n_nationkey AS a, 'ABCD' AS b FROM nation")
script("D13_identity_of_many", ["CREATE TABLE t (i bigint GENERATED ALWAYS AS IDENTITY (START WITH 10 INCREMENT BY 5), k bigint)", "INSERT INTO t (k) SELECT o_orderkey FROM orders", "SELECT min(i) AS a, max(i) AS b, count(*) AS n, count(DISTINCT i) AS m, sum(k) AS s FROM t"], "SELECT 10::BIGINT AS a, (5 + 5 * count(*))::BIGINT AS b, count(*) AS n, count(*) AS m, sum(o_orderkey)::BIGINT AS s FROM orders")
script("D13_identity", ["CREATE TABLE t (i bigint GENERATED ALWAYS AS IDENTITY (START WITH 10 INCREMENT BY 5), a text)", "INSERT INTO t (a) VALUES ('x'), ('y')", "INSERT INTO t (a) VALUES ('z')", "SELECT i, a FROM t"], "SELECT * FROM (VALUES (10::BIGINT, 'x'), (15::BIGINT, 'y'), (20::BIGINT, 'z')) t(i, a)")
script("Q3_scalar_subquery_in_set", [_ORDERS, _FILL, "UPDATE o SET p = (SELECT max(c_acctbal) FROM customer) WHERE s = 'O'", "SELECT k, p FROM o"], "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN (SELECT max(c_acctbal) FROM customer) ELSE o_totalprice END AS p FROM orders")
query("Q4_scalar_subquery_without_from", "SELECT o_orderkey, (SELECT o_custkey + 1) AS a, CASE WHEN (SELECT o_totalprice > 100000) THEN (SELECT 1) ELSE 0 END AS b FROM orders WHERE o_custkey <> (SELECT 7) ORDER BY (SELECT o_orderkey)", "SELECT o_orderkey, o_custkey + 1 AS a, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS b FROM orders WHERE o_custkey <> 7")
script("C6_modifying_cte", [_ORDERS, _FILL, "WITH gone AS (DELETE FROM o WHERE s = 'F' RETURNING c, p) SELECT c, count(*) AS n FROM gone GROUP BY c"], "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
# ---- schema changes and constraints
script("E2_add_column", [_ORDERS, _FILL, "ALTER TABLE o ADD COLUMN z int DEFAULT 7", "SELECT k, z FROM o"], "SELECT o_orderkey AS k, 7 AS z FROM orders")
script("E3_drop_column", [_ORDERS, _FILL, "ALTER TABLE o DROP COLUMN s", "SELECT * FROM o"], "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders")
script("E8_rename", [_ORDERS, _FILL, "ALTER TABLE o RENAME TO renamed", "SELECT count(*) AS n FROM renamed"], "SELECT count(*) AS n FROM orders")
# ---- transactions
script("T1_rollback", [_ORDERS, _FILL, "BEGIN", "DELETE FROM o WHERE s = 'F'", "ROLLBACK", "SELECT count(*) AS n FROM o"], "SELECT count(*) AS n FROM orders")
script("T1_commit", [_ORDERS, "BEGIN", _FILL, "DELETE FROM o WHERE s = 'F'", "COMMIT", "SELECT count(*) AS n FROM o"], "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
script("T4_for_update_of_many", [_ORDERS, _FILL, "SELECT k FROM o WHERE s = 'F' ORDER BY p DESC, k FOR UPDATE SKIP LOCKED"], "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'")
script("T4_for_update", [_ORDERS, _FILL, "SELECT k FROM o WHERE s = 'F' ORDER BY p DESC, k FOR UPDATE SKIP LOCKED LIMIT 20"], "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
script("T4_for_update_skipped", ["CREATE TABLE j (id int PRIMARY KEY, ready boolean)", "INSERT INTO j VALUES (3, true), (1, false), (2, true), (4, true)", "SELECT id FROM j WHERE ready ORDER BY id FOR UPDATE SKIP LOCKED LIMIT 2"], "SELECT * FROM (VALUES (2), (3)) t(id)")
script("T6_freeze_reset", [_ORDERS, _FILL, "SELECT engine_freeze()", "DELETE FROM o WHERE s = 'F'", "SELECT engine_freeze()", "SELECT engine_reset()", "SELECT count(*) AS n, sum(p) AS p FROM o"], "SELECT count(*) AS n, sum(o_totalprice) AS p FROM orders")
script("T8_settings", ["SET search_path TO s2, public", "CREATE SCHEMA s2", "CREATE TABLE t (a int)", "INSERT INTO s2.t VALUES (5)", "SELECT a, current_schema() AS s FROM t"], "SELECT 5 AS a, 's2' AS s")
# ---- checks, counts and sessions
_PAIR = "CREATE TABLE a (k int PRIMARY KEY, u int UNIQUE); CREATE TABLE b (k int PRIMARY KEY, a int REFERENCES a (k)); INSERT INTO a VALUES (1, 1), (2, 2); INSERT INTO b VALUES (1, 1)"
state("A11_group_by_validity", [], "SELECT o_custkey, count(*) FROM orders", "42803")
state("D11_not_null", [_PAIR], "INSERT INTO a VALUES (NULL, 3)", "23502")
state("K1_primary_key", [_PAIR], "INSERT INTO a VALUES (1, 3)", "23505")
state("K2_unique", [_PAIR], "INSERT INTO a VALUES (3, 2)", "23505")
state("K3_foreign_key", [_PAIR], "INSERT INTO b VALUES (2, 9)", "23503")
state("K4_referenced_key", [_PAIR], "UPDATE a SET k = 9 WHERE k = 1", "0A000")
state("K5_foreign_key_target", [_PAIR], "CREATE TABLE c (x int REFERENCES b (a))", "42830")
state("E4_add_primary_key", ["CREATE TABLE t (a int)", "INSERT INTO t VALUES (1), (1)"], "ALTER TABLE t ADD PRIMARY KEY (a)", "23505")
state("E5_add_unique", ["CREATE TABLE t (a int)", "INSERT INTO t VALUES (1), (1)"], "ALTER TABLE t ADD CONSTRAINT u UNIQUE (a)", "23505")
state("E6_add_foreign_key", [_PAIR, "CREATE TABLE t (a int)", "INSERT INTO t VALUES (7)"], "ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES a (k)", "23503")
state("E7_check_is_recorded", ["CREATE TABLE t (a int)", "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0)"], "INSERT INTO t VALUES (-1)", "00000")
state("E9_drop_table", [_PAIR], "DROP TABLE a", "2BP01")
state("E10_drop_schema", ["CREATE SCHEMA s1", "CREATE TABLE s1.t (a int)"], "DROP SCHEMA s1", "2BP01")
state("E11_unique_index", ["CREATE TABLE t (a int)", "CREATE UNIQUE INDEX ux ON t (a)", "INSERT INTO t VALUES (1)"], "INSERT INTO t VALUES (1)", "23505")
state("E12_no_databases", [], "CREATE DATABASE d", "0A000")
script("E1_create_table", [_PAIR, "SELECT k, u FROM a"], "SELECT * FROM (VALUES (1, 1), (2, 2)) t(k, u)")
calls("D9_affected_rows", lambda s: [(s.execute(_ORDERS).tag, s.execute(_FILL).count, s.execute("UPDATE o SET p = 0 WHERE s = 'F'").count, s.execute("DELETE FROM o WHERE s = 'F'").count)], "t string, i long, u long, d long", "SELECT 'CREATE TABLE' AS t, count(*) AS i, count(*) FILTER (WHERE o_orderstatus = 'F') AS u, count(*) FILTER (WHERE o_orderstatus = 'F') AS d FROM orders")
query("O3_nan_order", "SELECT k, row_number() OVER (ORDER BY CASE WHEN k = 3 THEN 'NaN'::float8 ELSE k * 1.0 END DESC, k) AS rn FROM (SELECT n_nationkey AS k FROM nation) d", "SELECT k, row_number() OVER (ORDER BY CASE WHEN k = 3 THEN 'NaN'::DOUBLE ELSE k * 1.0::DOUBLE END DESC, k) AS rn FROM (SELECT n_nationkey AS k FROM nation) d")


def _first_source_row(s: Session):
    s.execute_batch("CREATE TABLE t (k int, v int); INSERT INTO t VALUES (1, 0), (2, 0), (4, 0); CREATE TABLE u (k int, v int); INSERT INTO u VALUES (1, 6), (4, 9), (1, 5)")
    s.execute("INSERT INTO u VALUES (1, 7), (3, 7), (4, 8)")
    return [(s.execute("UPDATE t SET v = u.v FROM u WHERE u.k = t.k").count, *(r[0] for r in s.execute("SELECT v FROM t ORDER BY k").rows()))]


calls("J8_first_source_row", _first_source_row, "n long, a int, b int, c int", "SELECT 2::BIGINT AS n, 6 AS a, 0 AS b, 9 AS c")
script("J8_first_of_sorted_source", ["CREATE TABLE c (k bigint PRIMARY KEY, p float8)", "INSERT INTO c SELECT c_custkey, 0 FROM customer", "UPDATE c SET p = d.p FROM (SELECT o_custkey AS ck, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC) d WHERE d.ck = c.k", "SELECT k, p FROM c"], "SELECT c_custkey AS k, coalesce(max(o_totalprice), 0) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")


def _fate(s: Session, sql: str) -> str:
    try:
        s.execute(sql).rows()
        return "00000"
    except SqlError as e:
        return e.sqlstate


def _two_sessions(s: Session):
    t = s.engine.session()
    s.execute_batch("CREATE TABLE t (k int PRIMARY KEY, v int); INSERT INTO t VALUES (1, 1), (2, 2)")
    s.execute("BEGIN")
    s.execute("UPDATE t SET v = 9 WHERE k = 1")
    seen = t.execute("SELECT v FROM t WHERE k = 1").rows()[0][0]
    try:
        t.execute("UPDATE t SET v = 8 WHERE k = 1")
        locked = "00000"
    except SqlError as e:
        locked = e.sqlstate
    s.execute("COMMIT")
    return [(seen, locked, t.execute("SELECT v FROM t WHERE k = 1").rows()[0][0])]


calls("T2_read_committed", _two_sessions, "before int, locked string, after int", "SELECT 1 AS before, '55P03' AS locked, 9 AS after")


def _change_locks(s: Session):
    """However many rows a change locks, others may change the rest."""
    t = s.engine.session()
    s.execute_batch(f"{_ORDERS}; {_FILL}")
    free, held = (s.execute(f"SELECT min(k) FROM o WHERE s {x} 'F'").rows()[0][0] for x in ("<>", "="))
    s.execute("BEGIN")
    n = s.execute("UPDATE o SET p = 0 WHERE s = 'F'").count
    out = (n, _fate(t, f"UPDATE o SET p = 1 WHERE k = {free}"), _fate(t, f"UPDATE o SET p = 1 WHERE k = {held}"), _fate(t, f"DELETE FROM o WHERE k = {held}"), _fate(t, f"SELECT k FROM o WHERE k = {held} FOR UPDATE NOWAIT"))
    s.execute("ROLLBACK")
    return [(*out, _fate(t, f"UPDATE o SET p = 1 WHERE k = {held}"))]


calls("T5_locks_of_changes", _change_locks, "n long, free string, upd string, del string, sel string, later string", "SELECT count(*) AS n, '00000' AS free, '55P03' AS upd, '55P03' AS del, '55P03' AS sel, '00000' AS later FROM orders WHERE o_orderstatus = 'F'")


def _keys_between_sessions(s: Session):
    t = s.engine.session()
    s.execute_batch("CREATE TABLE p (k bigint PRIMARY KEY, u bigint UNIQUE); INSERT INTO p SELECT n_nationkey, n_nationkey FROM nation; CREATE TABLE c (k bigint PRIMARY KEY, p bigint REFERENCES p (k))")
    s.execute("BEGIN")
    s.execute("INSERT INTO p VALUES (100, 100)")
    s.execute("DELETE FROM p WHERE k = 1")
    s.execute("INSERT INTO c VALUES (1, 2)")
    out = [_fate(t, q) for q in ("INSERT INTO p VALUES (100, 101)", "INSERT INTO p VALUES (101, 100)", "INSERT INTO c VALUES (2, 1)", "INSERT INTO c VALUES (2, 100)", "DELETE FROM p WHERE k = 2", "INSERT INTO p VALUES (102, 102)")]
    s.execute("COMMIT")
    return [(*out, t.execute("SELECT count(*) FROM p").rows()[0][0])]


calls("K1_keys_between_sessions", _keys_between_sessions, "pk string, uq string, gone string, unseen string, child string, other string, n long", "SELECT '23505' AS pk, '23505' AS uq, '23503' AS gone, '23503' AS unseen, '23503' AS child, '00000' AS other, count(*) + 1 AS n FROM nation")


def _schema_between_sessions(s: Session):
    t = s.engine.session()
    s.execute_batch("CREATE TABLE t (k bigint); INSERT INTO t SELECT n_nationkey FROM nation")
    s.execute("BEGIN")
    s.execute("CREATE TABLE x (a int)")
    s.execute("ALTER TABLE t ADD COLUMN z int DEFAULT 3")
    t.execute_batch("CREATE TABLE y (a int); INSERT INTO y VALUES (1); INSERT INTO t (k) VALUES (77)")
    s.execute("INSERT INTO t (k, z) VALUES (78, 4)")
    s.execute("COMMIT")
    return [(t.execute("SELECT count(*) FROM y").rows()[0][0], *t.execute("SELECT count(*), sum(z) FROM t").rows()[0])]


calls("T1_schema_between_sessions", _schema_between_sessions, "y long, n long, z long", "SELECT 1::BIGINT AS y, count(*) + 2 AS n, (3 * count(*) + 7)::BIGINT AS z FROM nation")


def _zones(s: Session):
    t = s.engine.session()
    s.execute("SET timezone TO '+05:00'")
    return [(s.execute("SELECT timestamptz '2024-01-01 00:00:00+00'::text").rows()[0][0], t.execute("SELECT timestamptz '2024-01-01 00:00:00+00'::text").rows()[0][0], s.execute("SHOW timezone").rows()[0][0], t.execute("SHOW timezone").rows()[0][0])]


calls("T8_zone_of_a_session", _zones, "a string, b string, c string, d string", "SELECT '2024-01-01 05:00:00' AS a, '2024-01-01 00:00:00' AS b, '+05:00' AS c, 'UTC' AS d")


def _batch(s: Session):
    s.execute("CREATE TABLE t (k int PRIMARY KEY)")
    try:
        s.execute_batch("INSERT INTO t VALUES (1); INSERT INTO t VALUES (1)")
    except SqlError:
        pass
    return [(s.execute("SELECT count(*) FROM t").rows()[0][0],)]


calls("T3_implicit_transaction", _batch, "n long", "SELECT 0::BIGINT AS n")


def _released(s: Session):
    t = s.engine.session()
    s.execute("SELECT pg_advisory_lock(1)")
    s.close()
    t.execute("SELECT pg_advisory_lock(1)")
    return [(t.execute("SELECT pg_advisory_unlock(1)").rows()[0][0],)]


calls("T9_locks_end_with_session", _released, "freed boolean", "SELECT true AS freed")
calls("T10_statement_splitting", lambda s: [(len(s.execute_batch("SELECT 'a;b'; -- no; \n SELECT 1")),)], "n int", "SELECT 2 AS n")
calls("T11_prepared", lambda s: s.prepare("SELECT n_name FROM nation WHERE n_nationkey = $1").execute(3).rows(), "n_name string", "SELECT n_name FROM nation WHERE n_nationkey = 3")
calls("T11_described", lambda s: [(str(p.parameters()), str(p.columns())) for p in [s.prepare("SELECT n_name, count(*) AS n FROM nation WHERE n_nationkey > $1::bigint GROUP BY n_name LIMIT $2")]], "a string, b string", "SELECT '[''bigint'', ''bigint'']' AS a, '[(''n_name'', ''string''), (''n'', ''bigint'')]' AS b")


def _reset(s: Session):
    """A session that resets loses its own changes; others keep theirs."""
    t = s.engine.session()
    s.execute_batch("CREATE TABLE t (k bigint); INSERT INTO t SELECT n_nationkey FROM nation")
    s.execute("SELECT engine_freeze()")
    for x in (s, t):
        x.execute("DELETE FROM t WHERE k < 5")
    s.execute("SELECT engine_reset()")
    return [tuple(x.execute("SELECT count(*) FROM t").rows()[0][0] for x in (s, t))]


calls("T7_reset", _reset, "own long, other long", "SELECT count(*) AS own, count(*) FILTER (WHERE n_nationkey >= 5) AS other FROM nation")
calls("X23_snapshot_functions", lambda s: [(*[s.execute(f"SELECT engine_{x}()").rows()[0][0] for x in ("freeze", "freeze", "reset", "reset")], s.execute("BEGIN").tag, _fate(s, "SELECT engine_freeze()"))], "a boolean, b boolean, c boolean, d boolean, e string, f string", "SELECT true AS a, true AS b, true AS c, true AS d, 'BEGIN' AS e, '25001' AS f")
query("flagship_revenue", FLAGSHIP)
