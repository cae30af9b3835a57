"""Queries that run statements over a driver table in a warehouse of their own, and read the result.

Each loads rows of the driver's tables into stored tables by INSERT ... SELECT,
changes them, and returns what is there afterwards; the twin says the same as a
plain SELECT.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowsql.plans import admin
from sparrowsql.plans.session import Session
from sparrowsql.sources.store import Conflict
from sparrowsql.sources.tables import TABLES, frame


def warehouse(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a local one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared}/warehouse-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="sparrow-warehouse-")


def open_session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, warehouse(spark), {t: lambda t=t: frame(spark, sf_dir, t) for t in TABLES})


CUSTOMERS = "CREATE TABLE cust (id BIGINT PRIMARY KEY, name VARCHAR(50) NOT NULL, seg VARCHAR(20), bal DOUBLE DEFAULT 0.0)"
FILL = "INSERT INTO cust SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer"
ORDERS = "CREATE TABLE ord (id BIGINT PRIMARY KEY, cust BIGINT, total DOUBLE, CONSTRAINT fk_c FOREIGN KEY (cust) REFERENCES cust(id) ON DELETE {delete} ON UPDATE CASCADE)"
FILL_ORDERS = "INSERT INTO ord SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
BASE = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer"

# name: (statements, the last one a query; DuckDB twin)
SCRIPTS: dict[str, tuple[list[str], str]] = {
    "dml_insert_select": ([CUSTOMERS, FILL, "SELECT * FROM cust WHERE bal > 0"], f"SELECT * FROM ({BASE}) WHERE bal > 0"),
    "dml_insert_values_default": (
        ["CREATE TABLE t (id INT AUTO INCREMENT PRIMARY KEY, a VARCHAR(10) DEFAULT 'x', b DECIMAL(8,2) CHECK (b >= 0))", "INSERT INTO t (b) VALUES (1.5), (2), (NULL)", "INSERT INTO t (id, a) VALUES (10, 'y')", "INSERT INTO t (a) VALUES (DEFAULT)", "SELECT id, a, CAST(b AS DOUBLE) AS b FROM t"],
        "SELECT * FROM (VALUES (1, 'x', 1.5::DOUBLE), (2, 'x', 2.0), (3, 'x', NULL), (10, 'y', NULL), (11, 'x', NULL)) v(id, a, b)",
    ),
    "dml_insert_ignore": ([CUSTOMERS, FILL, "INSERT IGNORE INTO cust SELECT c_custkey + 1000, 'again', 'S', 1.0 FROM customer", "SELECT seg, count(*) AS n FROM cust GROUP BY seg"],
                          f"SELECT seg, count(*) AS n FROM (SELECT seg FROM ({BASE}) UNION ALL SELECT 'S' FROM customer WHERE c_custkey + 1000 NOT IN (SELECT c_custkey FROM customer)) GROUP BY seg"),
    "dml_upsert": ([CUSTOMERS, FILL, "INSERT INTO cust VALUES (5, 'n', 's', 1.0), (900001, 'new', 's', 2.0) ON DUPLICATE KEY UPDATE bal = bal + 100, seg = 'UP'", "SELECT * FROM cust WHERE id < 10 OR id > 900000"],
                   f"SELECT id, name, CASE WHEN id = 5 THEN 'UP' ELSE seg END AS seg, CASE WHEN id = 5 THEN bal + 100 ELSE bal END AS bal FROM ({BASE}) WHERE id < 10 UNION ALL SELECT 900001, 'new', 's', 2.0"),
    "dml_returning": ([CUSTOMERS, FILL, "DELETE FROM cust WHERE bal < 0 RETURNING id, name"], f"SELECT id, name FROM ({BASE}) WHERE bal < 0"),
    "dml_insert_ignore_two_keys": (["CREATE TABLE k (id BIGINT PRIMARY KEY, code VARCHAR(30) UNIQUE)", "INSERT INTO k SELECT c_custkey, c_name FROM customer", "INSERT IGNORE INTO k SELECT c_custkey + 1000000, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, CONCAT(c_name, '!') FROM customer", "SELECT * FROM k"],
                                   "SELECT c_custkey AS id, c_name AS code FROM customer UNION ALL SELECT c_custkey + 1000000, c_name || '!' FROM customer"),
    "dml_upsert_batch_duplicates": (["CREATE TABLE seen (id BIGINT PRIMARY KEY, v BIGINT)", "INSERT INTO seen SELECT c_custkey, 100 FROM customer WHERE c_acctbal > 0", "INSERT INTO seen SELECT o_custkey, 0 FROM orders ON DUPLICATE KEY UPDATE v = v + 1", "SELECT * FROM seen"],
                                    "WITH n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(c.c_custkey, n.id) AS id, CASE WHEN c.c_custkey IS NULL THEN n.n - 1 ELSE 100 + coalesce(n.n, 0) END AS v FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c FULL JOIN n ON n.id = c.c_custkey"),
    "dml_fk_set_default": (["CREATE TABLE nat (id INT PRIMARY KEY, name VARCHAR(30))", "INSERT INTO nat SELECT n_nationkey, n_name FROM nation", "CREATE TABLE people (id BIGINT PRIMARY KEY, nat INT DEFAULT 0, FOREIGN KEY (nat) REFERENCES nat(id) ON DELETE SET DEFAULT)", "INSERT INTO people SELECT c_custkey, c_nationkey FROM customer", "DELETE FROM nat WHERE id > 9", "SELECT id, nat FROM people"],
                           "SELECT c_custkey AS id, CASE WHEN c_nationkey > 9 THEN 0 ELSE c_nationkey END AS nat FROM customer"),
    "dml_update": ([CUSTOMERS, FILL, "UPDATE cust SET bal = bal * 2, seg = CONCAT(seg, '!') WHERE bal > 5000 AND seg != 'BUILDING'", "SELECT * FROM cust"],
                   f"SELECT id, name, CASE WHEN bal > 5000 AND seg != 'BUILDING' THEN seg || '!' ELSE seg END AS seg, CASE WHEN bal > 5000 AND seg != 'BUILDING' THEN bal * 2 ELSE bal END AS bal FROM ({BASE})"),
    "dml_update_subquery": ([CUSTOMERS, FILL, "UPDATE cust SET seg = 'RICH' WHERE bal > (SELECT AVG(bal) FROM cust)", "SELECT id, seg FROM cust"],
                            f"SELECT id, CASE WHEN bal > (SELECT avg(bal) FROM ({BASE})) THEN 'RICH' ELSE seg END AS seg FROM ({BASE})"),
    "dml_update_join": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), FILL, FILL_ORDERS, "UPDATE ord o JOIN cust c ON o.cust = c.id SET o.total = o.total + 1, c.bal = 0 WHERE c.seg = 'BUILDING'", "SELECT o.id, o.total, c.bal FROM ord o JOIN cust c ON o.cust = c.id"],
                        "SELECT o_orderkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN o_totalprice + 1 ELSE o_totalprice END AS total, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS bal FROM orders JOIN customer ON o_custkey = c_custkey"),
    "dml_delete": ([CUSTOMERS, FILL, "DELETE FROM cust WHERE seg = 'BUILDING' OR bal < 0", "SELECT * FROM cust"], f"SELECT * FROM ({BASE}) WHERE NOT (seg = 'BUILDING' OR bal < 0)"),
    "dml_delete_subquery": ([CUSTOMERS, FILL, "DELETE FROM cust WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "SELECT id FROM cust"],
                            "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "dml_delete_join": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), FILL, FILL_ORDERS, "DELETE o FROM ord o JOIN cust c ON o.cust = c.id WHERE c.bal < 1000", "SELECT id, cust FROM ord"],
                        "SELECT o_orderkey AS id, o_custkey AS cust FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal < 1000"),
    "dml_fk_cascade": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), FILL, FILL_ORDERS, "DELETE FROM cust WHERE id < 50", "SELECT count(*) AS n, min(cust) AS low FROM ord"],
                       "SELECT count(*) AS n, min(o_custkey) AS low FROM orders WHERE o_custkey >= 50"),
    "dml_fk_set_null": ([CUSTOMERS, ORDERS.format(delete="SET NULL"), FILL, FILL_ORDERS, "DELETE FROM cust WHERE id < 50", "SELECT id, cust FROM ord"],
                        "SELECT o_orderkey AS id, CASE WHEN o_custkey >= 50 THEN o_custkey END AS cust FROM orders"),
    "dml_fk_update_cascade": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), FILL, FILL_ORDERS, "UPDATE cust SET id = id + 1000000 WHERE seg = 'BUILDING'", "SELECT o.id, o.cust FROM ord o JOIN cust c ON o.cust = c.id"],
                              "SELECT o_orderkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey + 1000000 ELSE o_custkey END AS cust FROM orders JOIN customer ON o_custkey = c_custkey"),
    "dml_merge": ([CUSTOMERS, FILL, "CREATE TABLE upd (id BIGINT PRIMARY KEY, bal DOUBLE)", "INSERT INTO upd SELECT c_custkey * 3, CASE WHEN c_custkey < 20 THEN 0.0 ELSE c_acctbal END FROM customer",
                   "MERGE INTO cust USING upd ON cust.id = upd.id WHEN MATCHED AND upd.bal = 0.0 THEN DELETE WHEN MATCHED THEN UPDATE SET bal = upd.bal WHEN NOT MATCHED THEN INSERT (id, name, bal) VALUES (upd.id, 'new', upd.bal)", "SELECT id, name, bal FROM cust"],
                  "WITH u AS (SELECT c_custkey * 3 AS id, CASE WHEN c_custkey < 20 THEN 0.0 ELSE c_acctbal END AS bal FROM customer) SELECT c_custkey AS id, c_name AS name, coalesce(u.bal, c_acctbal) AS bal FROM customer LEFT JOIN u ON u.id = c_custkey WHERE u.bal IS NULL OR u.bal != 0 UNION ALL SELECT id, 'new', bal FROM u WHERE id NOT IN (SELECT c_custkey FROM customer)"),
    "dml_truncate": ([CUSTOMERS, FILL, "TRUNCATE TABLE cust", "SELECT count(*) AS n FROM cust"], "SELECT 0 AS n"),
    "ddl_alter": ([CUSTOMERS, FILL, "ALTER TABLE cust ADD COLUMN note VARCHAR(20) DEFAULT 'none'", "ALTER TABLE cust RENAME COLUMN seg TO segment", "ALTER TABLE cust DROP COLUMN bal", "UPDATE cust SET note = 'low' WHERE id < 10", "ALTER TABLE cust RENAME TO clients", "SELECT * FROM clients"],
                  "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey < 10 THEN 'low' ELSE 'none' END AS note FROM customer"),
    "ddl_modify": ([CUSTOMERS, FILL, "ALTER TABLE cust MODIFY COLUMN bal DECIMAL(12,1)", "ALTER TABLE cust MODIFY COLUMN id VARCHAR(20)", "SELECT id, CAST(bal AS DOUBLE) AS bal FROM cust"], f"SELECT CAST(id AS VARCHAR) AS id, CAST(CAST(bal AS DECIMAL(12,1)) AS DOUBLE) AS bal FROM ({BASE})"),
    "ddl_drop_table": (["CREATE TABLE a (x INT)", "CREATE TABLE b (x INT)", "DROP TABLE a", "DROP TABLE IF EXISTS nothing", "SHOW TABLES"], "SELECT 'b' AS table_name"),
    "ddl_index": ([CUSTOMERS, "CREATE INDEX ix ON cust (seg, bal)", "CREATE INDEX hx ON cust (name) USING HASH", "CREATE INDEX gone ON cust (bal)", "DROP INDEX gone", "SHOW INDEX FROM cust"],
                  "SELECT * FROM (VALUES ('main', 'cust', 'PRIMARY', 'id', 1, 0, 'BTREE'), ('main', 'cust', 'ix', 'seg', 1, 1, 'BTREE'), ('main', 'cust', 'ix', 'bal', 2, 1, 'BTREE'), ('main', 'cust', 'hx', 'name', 1, 1, 'HASH')) v(table_schema, table_name, index_name, column_name, seq_in_index, non_unique, index_type)"),
    "show_create_table": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), "SHOW CREATE TABLE ord"],
                          "SELECT 'ord' AS table_name, 'CREATE TABLE ord (' || chr(10) || '  id BIGINT,' || chr(10) || '  cust BIGINT,' || chr(10) || '  total DOUBLE,' || chr(10) || '  PRIMARY KEY (id),' || chr(10) || '  CONSTRAINT fk_c FOREIGN KEY (cust) REFERENCES cust(id) ON DELETE CASCADE ON UPDATE CASCADE' || chr(10) || ')' AS create_table"),
    "show_create_view": ([CUSTOMERS, "CREATE VIEW rich AS SELECT id FROM cust WHERE bal > 5000", "SHOW CREATE VIEW rich"], "SELECT 'rich' AS view_name, 'CREATE VIEW rich AS SELECT id FROM cust WHERE bal > 5000' AS create_view"),
    "show_status": ([CUSTOMERS, FILL, "BEGIN", "SHOW LOCKS"], "SELECT * FROM (VALUES ('manifest', 2), ('open_transaction', 1)) v(item, value)"),
    "checkpoint": ([CUSTOMERS, FILL, "CHECKPOINT"], "SELECT 2 AS rows_affected"),
    "users_grants": ([CUSTOMERS, "CREATE USER 'ann'@'%' IDENTIFIED BY 'x'", "CREATE ROLE reader", "GRANT SELECT, INSERT ON main.cust TO 'ann'@'%' WITH GRANT OPTION", "GRANT ROLE reader TO 'ann'@'%'", "REVOKE INSERT ON main.cust FROM 'ann'@'%'", "SHOW GRANTS FOR 'ann'@'%'"],
                     "SELECT * FROM (VALUES ('ann', 'GRANT SELECT ON main.cust WITH GRANT OPTION'), ('ann', 'GRANT ROLE reader')) v(grantee, \"grant\")"),
    "txn_isolation_level": (["SET ISOLATION LEVEL REPEATABLE READ", "BEGIN", "SHOW ISOLATION LEVEL"], "SELECT 'REPEATABLE READ' AS isolation_level"),
    "txn_release": ([CUSTOMERS, FILL, "BEGIN", "DELETE FROM cust WHERE bal < 0", "SAVEPOINT a", "DELETE FROM cust", "ROLLBACK TO SAVEPOINT a", "RELEASE SAVEPOINT a", "COMMIT", "SELECT count(*) AS n FROM cust"], f"SELECT count(*) AS n FROM ({BASE}) WHERE bal >= 0"),
    "view_scan": ([CUSTOMERS, FILL, "CREATE VIEW rich AS SELECT id, name, bal FROM cust WHERE bal > 5000", "SELECT count(*) AS n, max(id) AS top FROM rich"], f"SELECT count(*) AS n, max(id) AS top FROM ({BASE}) WHERE bal > 5000"),
    "view_update": ([CUSTOMERS, FILL, "CREATE VIEW rich AS SELECT id, name, bal FROM cust WHERE bal > 5000", "UPDATE rich SET bal = 1 WHERE id < 100", "SELECT id, bal FROM cust"],
                    f"SELECT id, CASE WHEN bal > 5000 AND id < 100 THEN 1 ELSE bal END AS bal FROM ({BASE})"),
    "synonym_scan": ([CUSTOMERS, FILL, "CREATE SYNONYM people FOR cust", "SELECT id, name FROM people WHERE id < 5"], f"SELECT id, name FROM ({BASE}) WHERE id < 5"),
    "txn_rollback": ([CUSTOMERS, FILL, "BEGIN", "DELETE FROM cust", "ROLLBACK", "SELECT count(*) AS n FROM cust"], "SELECT count(*) AS n FROM customer"),
    "txn_savepoint": ([CUSTOMERS, FILL, "BEGIN", "DELETE FROM cust WHERE id > 100", "SAVEPOINT s1", "UPDATE cust SET bal = 0", "ROLLBACK TO SAVEPOINT s1", "UPDATE cust SET seg = 'T' WHERE id = 1", "COMMIT", "SELECT * FROM cust"],
                      f"SELECT id, name, CASE WHEN id = 1 THEN 'T' ELSE seg END AS seg, bal FROM ({BASE}) WHERE id <= 100"),
    "udf_scalar": ([CUSTOMERS, FILL, "CREATE FUNCTION taxed(amount, rate) RETURNS DOUBLE RETURN amount * (1 + rate)", "SELECT id, ROUND(taxed(bal, 0.5), 4) AS t FROM cust"], f"SELECT id, ROUND(bal * 1.5, 4) AS t FROM ({BASE})"),
    "proc_loop": (["CREATE PROCEDURE chain(IN start_at INT, IN most INT) BEGIN DECLARE x INT DEFAULT start_at; DECLARE steps INT DEFAULT 0; DECLARE evens INT DEFAULT 0; walk: LOOP IF x = 1 OR steps >= most THEN LEAVE walk; END IF; SET steps = steps + 1; IF MOD(x, 2) = 1 THEN SET x = 3 * x + 1; ITERATE walk; END IF; SET evens = evens + 1; SET x = CAST(x / 2 AS INT); END LOOP; SELECT steps AS steps, evens AS halved, x AS reached; END", "CALL chain(6, 100)"],
                  "SELECT 8 AS steps, 6 AS halved, 1 AS reached"),
    "proc_while_repeat": (["CREATE PROCEDURE f(IN n INT) BEGIN DECLARE i INT DEFAULT 1; DECLARE t INT DEFAULT 1; WHILE i <= n DO SET t = t * i; SET i = i + 1; END WHILE; REPEAT SET t = t - 100; UNTIL t < 0 END REPEAT; IF t < -90 THEN SELECT 'far' AS r, t AS v; ELSEIF t < 0 THEN SELECT 'near' AS r, t AS v; ELSE SELECT 'no' AS r, t AS v; END IF; END", "CALL f(6)"],
                          "SELECT 'near' AS r, -80 AS v"),
    "trigger_after": ([CUSTOMERS, "CREATE TABLE log (n INT)", "INSERT INTO log VALUES (0)", "CREATE TRIGGER tr AFTER INSERT ON cust FOR EACH ROW UPDATE log SET n = n + 1", FILL, "INSERT INTO cust (id, name) VALUES (900000, 'x')", "SELECT n FROM log"], "SELECT 2 AS n"),
    "trigger_before": ([CUSTOMERS, FILL, "CREATE TABLE log (n BIGINT)", "CREATE TRIGGER tr BEFORE DELETE ON cust FOR EACH ROW INSERT INTO log SELECT COUNT(*) FROM cust", "DELETE FROM cust WHERE bal < 0", "SELECT n, (SELECT COUNT(*) FROM cust) AS now FROM log"],
                       f"SELECT count(*) AS n, count(*) FILTER (WHERE bal >= 0) AS now FROM ({BASE})"),
    "prepared_stmt": ([CUSTOMERS, FILL, "PREPARE q FROM 'SELECT id, bal FROM cust WHERE id BETWEEN ? AND ? AND seg != ?'", "SET @a = 5", "SET @b = 40", "SET @s = 'BUILDING'", "EXECUTE q USING @a, @b, @s"], f"SELECT id, bal FROM ({BASE}) WHERE id BETWEEN 5 AND 40 AND seg != 'BUILDING'"),
    "session_variable": (["SET @x = 6 * 7", "SELECT @x AS x, @x + 1 AS y"], "SELECT 42 AS x, 43 AS y"),
    "cte_recursive_union": (["CREATE TABLE edge (a INT, b INT)", "INSERT INTO edge VALUES (1, 2), (2, 3), (3, 1), (3, 4), (5, 6)", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT b FROM edge JOIN r ON a = n) SELECT n FROM r"],
                            "SELECT * FROM (VALUES (1), (2), (3), (4)) v(n)"),
    "cte_insert": ([CUSTOMERS, "INSERT INTO cust WITH big AS (SELECT * FROM customer WHERE c_acctbal > 9000) SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM big", "SELECT * FROM cust"], f"SELECT * FROM ({BASE}) WHERE bal > 9000"),
    "info_schema_columns": ([CUSTOMERS, "SELECT column_name, ordinal_position, data_type, is_nullable, column_key FROM information_schema.columns WHERE table_name = 'cust'"],
                            "SELECT * FROM (VALUES ('id', 1, 'bigint', 'NO', 'PRI'), ('name', 2, 'varchar(50)', 'NO', ''), ('seg', 3, 'varchar(20)', 'YES', ''), ('bal', 4, 'double', 'YES', '')) v(column_name, ordinal_position, data_type, is_nullable, column_key)"),
    "info_schema_constraints": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), "SELECT table_name, constraint_name, constraint_type FROM information_schema.table_constraints"],
                                "SELECT * FROM (VALUES ('cust', 'PRIMARY', 'PRIMARY KEY'), ('ord', 'PRIMARY', 'PRIMARY KEY'), ('ord', 'fk_c', 'FOREIGN KEY')) v(table_name, constraint_name, constraint_type)"),
    "info_schema_schemata": (["CREATE DATABASE other", "SELECT schema_name FROM information_schema.schemata"], "SELECT * FROM (VALUES ('main'), ('other')) v(schema_name)"),
    "info_schema_tables": ([CUSTOMERS, FILL, "CREATE VIEW v AS SELECT id FROM cust", "SELECT * FROM information_schema.tables"], "SELECT 'main' AS table_schema, 'cust' AS table_name, 'BASE TABLE' AS table_type, count(*) AS table_rows FROM customer UNION ALL SELECT 'main', 'v', 'VIEW', NULL"),
    "info_schema_keys": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), "SELECT table_name, constraint_name, column_name, referenced_table_name, referenced_column_name FROM information_schema.key_column_usage"],
                         "SELECT * FROM (VALUES ('cust', 'PRIMARY', 'id', NULL, NULL), ('ord', 'PRIMARY', 'id', NULL, NULL), ('ord', 'fk_c', 'cust', 'cust', 'id')) v(table_name, constraint_name, column_name, referenced_table_name, referenced_column_name)"),
    "info_schema_statistics": ([CUSTOMERS, "CREATE INDEX ix ON cust (seg)", "SELECT table_name, index_name, column_name, non_unique FROM information_schema.statistics"], "SELECT * FROM (VALUES ('cust', 'PRIMARY', 'id', 0), ('cust', 'ix', 'seg', 1)) v(table_name, index_name, column_name, non_unique)"),
    "info_schema_views": ([CUSTOMERS, "CREATE VIEW v AS SELECT id FROM cust", "SELECT * FROM information_schema.views"], "SELECT 'main' AS table_schema, 'v' AS table_name, 'SELECT id FROM cust' AS view_definition"),
    "info_schema_character_sets": (["SELECT * FROM information_schema.character_sets"], "SELECT 'utf8mb4' AS character_set_name, 'utf8mb4_bin' AS default_collate_name, 4 AS maxlen"),
    "info_schema_collations": (["SELECT * FROM information_schema.collations"], "SELECT 'utf8mb4_bin' AS collation_name, 'utf8mb4' AS character_set_name"),
    "info_schema_engines": (["SELECT * FROM information_schema.engines"], "SELECT 'PARQUET' AS engine, 'DEFAULT' AS support, 'YES' AS transactions"),
    "show_tables": ([CUSTOMERS, ORDERS.format(delete="CASCADE"), "SHOW TABLES"], "SELECT * FROM (VALUES ('cust'), ('ord')) v(table_name)"),
    "describe_table": ([CUSTOMERS, "DESCRIBE cust"], """SELECT * FROM (VALUES ('id', 'bigint', 'NO', 'PRI', NULL, ''), ('name', 'varchar(50)', 'NO', '', NULL, ''), ('seg', 'varchar(20)', 'YES', '', NULL, ''), ('bal', 'double', 'YES', '', '0.0', '')) v("Field", "Type", "Null", "Key", "Default", "Extra")"""),
    "databases_use": (["CREATE DATABASE other", "USE other", "CREATE TABLE t (a INT)", "INSERT INTO t VALUES (1), (2)", "USE main", "SELECT SUM(a) AS s FROM other.t"], "SELECT CAST(3 AS BIGINT) AS s"),
    "analyze_table": ([CUSTOMERS, FILL, "ANALYZE TABLE cust"],
                      f"WITH b AS ({BASE}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, {', '.join(f'CAST(quantile_disc({c}, {p / 100}) AS DOUBLE) AS p{p}' if c in ('id', 'bal') else f'CAST(NULL AS DOUBLE) AS p{p}' for p in (25, 50, 75))} FROM b" for c in ("id", "name", "seg", "bal"))),
}


def _script(statements: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = open_session(spark, sf_dir)
        for statement in statements[:-1]:
            session.sql(statement)
        return session.sql(statements[-1])

    return run


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export a query as CSV and import it into a table again."""
    session = open_session(spark, sf_dir)
    path = f"{session.store.root}/export"
    admin.export_csv(session, "SELECT c_custkey AS id, CONCAT(c_name, ', \"x\"') AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer", path)
    session.sql(CUSTOMERS)
    admin.import_csv(session, path, "cust")
    return session.sql("SELECT * FROM cust")


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN ANALYZE tells: the kinds of operators in the plan, and the rows that came of it."""
    lines = open_session(spark, sf_dir).sql("EXPLAIN ANALYZE SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
    return lines.agg(
        F.max(F.col("plan").contains("Aggregate")).alias("aggregates"),
        F.max(F.col("plan").contains("Relation")).alias("scans"),
        F.max(F.regexp_extract("plan", "actual rows=([0-9]+)", 1)).alias("actual_rows"),
    )


def sql_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back a database up as SQL and run the text in another warehouse."""
    session = open_session(spark, sf_dir)
    for statement in (CUSTOMERS, FILL, "CREATE VIEW rich AS SELECT id, plus(bal) AS more FROM people WHERE bal > 5000", "CREATE SYNONYM people FOR cust", "CREATE FUNCTION plus(x) RETURNS DOUBLE RETURN x + 1", "CREATE INDEX ix ON cust (seg)"):
        session.sql(statement)
    session.sql("BACKUP DATABASE main INTO 'dump'")
    folder = f"{session.store.root}/backups/dump"
    again = open_session(spark, sf_dir)
    admin.restore(again, folder)
    return again.sql("SELECT c.*, r.more FROM cust c LEFT JOIN rich r ON c.id = r.id")


def concurrent_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view made in a transaction outlives what another session publishes meanwhile."""
    one = open_session(spark, sf_dir)
    for statement in (CUSTOMERS, FILL, "BEGIN", "CREATE VIEW rich AS SELECT id FROM cust WHERE bal > 5000"):
        one.sql(statement)
    two = Session(spark, one.store.root)
    two.sql("CREATE TABLE other (a INT)")
    one.sql("COMMIT")
    return two.sql("SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM other) AS m FROM rich")


def vacuum_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VACUUM leaves alone what an open transaction has written."""
    one = open_session(spark, sf_dir)
    for statement in (CUSTOMERS, "BEGIN", FILL):
        one.sql(statement)
    Session(spark, one.store.root).sql("VACUUM RETAIN 0 HOURS")
    one.sql("COMMIT")
    return one.sql("SELECT * FROM cust")


def clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether COMMIT fails after another session changed a table that was only read: plainly, FOR UPDATE, or as SERIALIZABLE."""
    one = open_session(spark, sf_dir)
    one.run("CREATE TABLE a (v INT); INSERT INTO a VALUES (1); CREATE TABLE b (v INT)")
    two, found = Session(spark, one.store.root), []
    for name, level, read in (("plain", "READ COMMITTED", "SELECT v FROM a"), ("for update", "READ COMMITTED", "SELECT v FROM a FOR UPDATE"), ("serializable", "SERIALIZABLE", "SELECT v FROM a")):
        one.sql(f"SET ISOLATION LEVEL {level}")
        one.sql("BEGIN")
        one.sql(read)
        one.sql("INSERT INTO b VALUES (1)")
        two.sql("UPDATE a SET v = v + 1")
        try:
            one.sql("COMMIT")
            found.append((name, "kept"))
        except Conflict:
            found.append((name, "conflict"))
    return one.frame_of(found, "mode string, outcome string")


FUNCTIONS = {
    "csv_round_trip": (csv_round_trip, "SELECT c_custkey AS id, c_name || ', \"x\"' AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer"),
    "explain_analyze": (explain_plan, "SELECT true AS aggregates, true AS scans, CAST(count(DISTINCT c_mktsegment) AS VARCHAR) AS actual_rows FROM customer"),
    "sql_dump": (sql_dump, f"SELECT *, CASE WHEN bal > 5000 THEN bal + 1 END AS more FROM ({BASE})"),
    "txn_concurrent_view": (concurrent_view, f"SELECT count(*) AS n, 0 AS m FROM ({BASE}) WHERE bal > 5000"),
    "vacuum_keeps_open": (vacuum_open, BASE),
    "txn_clashes": (clashes, "SELECT * FROM (VALUES ('plain', 'kept'), ('for update', 'conflict'), ('serializable', 'conflict')) v(mode, outcome)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _script(statements) for name, (statements, _) in SCRIPTS.items()} | {name: f for name, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: twin for name, (_, twin) in SCRIPTS.items()} | {name: twin for name, (_, twin) in FUNCTIONS.items()}
