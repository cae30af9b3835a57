"""Golden tests on a small staff database; expected rows follow by hand from the inserted ones."""

import glob
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest

from sparrowsql.functions.dialect import SqlError
from sparrowsql.operators import dml
from sparrowsql.operators.constraints import Violation
from sparrowsql.plans import admin, statements
from sparrowsql.plans import session as session_module
from sparrowsql.plans.session import Session
from sparrowsql.sources import dump
from sparrowsql.sources.store import Conflict

SETUP = """
CREATE TABLE dept (id INT AUTO INCREMENT, code VARCHAR(5) NOT NULL, budget DECIMAL(12,2) DEFAULT 0.00 CHECK (budget >= 0),
  kind ENUM('eng','ops'), perks SET('gym','cafe'), PRIMARY KEY (id), UNIQUE KEY uq_code (code));
CREATE TABLE emp (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, salary DECIMAL(10,2), boss INT, dept INT,
  CONSTRAINT fk_d FOREIGN KEY (dept) REFERENCES dept(id) ON DELETE SET NULL ON UPDATE CASCADE);
CREATE TABLE proj (id INT PRIMARY KEY, lead INT NOT NULL, dept INT,
  CONSTRAINT fk_l FOREIGN KEY (lead) REFERENCES emp(id) ON DELETE CASCADE, FOREIGN KEY (dept) REFERENCES dept(id) ON DELETE RESTRICT);
INSERT INTO dept (code, budget, kind, perks) VALUES ('A', 100, 'eng', 'gym,cafe'), ('B', 50, 'ops', NULL), ('C', 0, 'ops', 'cafe');
INSERT INTO emp VALUES (1, 'Ann', 120, NULL, 1), (2, 'Bob', 80, 1, 1), (3, 'Cy', 90, 1, 2), (4, 'Di', 70, 2, NULL);
INSERT INTO proj VALUES (1, 2, 1), (2, 3, 1), (3, 2, NULL);
"""


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/wh")
    s.run(SETUP)
    return s


def rows(session, sql):
    return sorted(tuple(r) for r in session.sql(sql).collect())


def test_constraints_reject_and_leave_no_trace(session):
    for bad in (
        "INSERT INTO dept (code, kind) VALUES ('D', 'sales')",
        "INSERT INTO dept (code, perks) VALUES ('D', 'gym,sauna')",
        "INSERT INTO dept (code, budget) VALUES ('D', -1)",
        "INSERT INTO dept (code) VALUES (NULL)",
        "INSERT INTO dept (code) VALUES ('D'), ('D')",
        "INSERT INTO dept (code) VALUES ('A')",
        "INSERT INTO emp VALUES (9, 'X', 1, NULL, 77)",
        "UPDATE dept SET budget = -5 WHERE code = 'A'",
        "UPDATE dept SET code = 'A'",
        "UPDATE emp SET dept = 77 WHERE id = 1",
        "DELETE FROM dept WHERE code = 'A'",
    ):
        with pytest.raises(Violation):
            session.sql(bad)
    assert rows(session, "SELECT id, code FROM dept") == [(1, "A"), (2, "B"), (3, "C")]
    assert rows(session, "SELECT count(*) AS n FROM emp") == [(4,)]


def test_foreign_key_actions(session):
    session.sql("DELETE FROM emp WHERE id = 2")  # its projects go as well
    assert rows(session, "SELECT id FROM proj") == [(2,)]
    session.sql("DELETE FROM dept WHERE code = 'B'")
    assert rows(session, "SELECT id, dept FROM emp") == [(1, 1), (3, None), (4, None)]
    session.sql("UPDATE dept SET id = 10 WHERE code = 'C'")
    assert rows(session, "SELECT id FROM dept") == [(1,), (10,)]


def test_insert_variants(session):
    assert rows(session, "INSERT INTO dept (code) VALUES ('Z') RETURNING id, code, budget")[0][:2] == (4, "Z")
    session.sql("INSERT IGNORE INTO dept (code, budget) VALUES ('A', 7), ('Q', 8), ('Q', 9)")
    assert [c for _, c in rows(session, "SELECT id, code FROM dept")] == ["A", "B", "C", "Z", "Q"]
    session.sql("INSERT INTO dept (code, budget) VALUES ('A', 7), ('W', 8) ON DUPLICATE KEY UPDATE budget = budget + 1")
    assert dict(rows(session, "SELECT code, CAST(budget AS INT) FROM dept WHERE code IN ('A', 'W')")) == {"A": 101, "W": 8}


def test_update_delete_returning_and_joins(session):
    assert rows(session, "UPDATE emp SET salary = salary + 1 WHERE id = 1 RETURNING id, salary") == [(1, 121)]
    session.sql("UPDATE emp e, dept d SET e.salary = e.salary + 10, d.budget = d.budget + 1 WHERE e.dept = d.id AND d.code = 'A'")
    assert rows(session, "SELECT id, CAST(salary AS INT) FROM emp") == [(1, 131), (2, 90), (3, 90), (4, 70)]
    assert rows(session, "SELECT CAST(budget AS INT) FROM dept WHERE code = 'A'") == [(101,)]
    session.sql("DELETE proj FROM proj JOIN emp ON proj.lead = emp.id WHERE emp.name = 'Bob'")
    assert rows(session, "SELECT id FROM proj") == [(2,)]
    session.sql("DELETE FROM emp WHERE EXISTS (SELECT 1 FROM proj p WHERE p.lead = emp.id)")
    assert rows(session, "SELECT id FROM emp") == [(1,), (2,), (4,)]
    assert rows(session, "SELECT count(*) AS n FROM proj") == [(0,)]


def test_merge(session):
    session.run("CREATE TABLE up (code VARCHAR(5) PRIMARY KEY, budget DECIMAL(12,2)); INSERT INTO up VALUES ('B', 60), ('C', 0), ('N', 5);")
    session.sql(
        "MERGE INTO dept USING up ON dept.code = up.code WHEN MATCHED AND up.budget = 0 THEN DELETE"
        " WHEN MATCHED THEN UPDATE SET budget = up.budget WHEN NOT MATCHED THEN INSERT (code, budget) VALUES (up.code, up.budget)"
    )
    assert rows(session, "SELECT code, CAST(budget AS INT) FROM dept") == [("A", 100), ("B", 60), ("N", 5)]


def test_transactions(session, spark):
    other = Session(spark, session.store.root)
    session.sql("BEGIN")
    session.sql("UPDATE emp SET salary = 0")
    assert rows(other, "SELECT count(*) AS n FROM emp WHERE salary = 0") == [(0,)]
    session.sql("SAVEPOINT a")
    session.sql("DELETE FROM proj")
    session.sql("ROLLBACK TO SAVEPOINT a")
    session.sql("COMMIT")
    assert rows(other, "SELECT count(*) AS n FROM emp WHERE salary = 0") == [(4,)]
    assert rows(other, "SELECT count(*) AS n FROM proj") == [(3,)]


def test_writers_that_clash(session, spark):
    other = Session(spark, session.store.root)
    session.sql("BEGIN")
    session.sql("UPDATE emp SET salary = 1")
    other.sql("UPDATE emp SET salary = 2")
    with pytest.raises(Conflict):
        session.sql("COMMIT")
    assert rows(other, "SELECT DISTINCT CAST(salary AS INT) FROM emp") == [(2,)]
    session.sql("BEGIN")
    session.sql("UPDATE proj SET dept = NULL")
    other.sql("UPDATE emp SET salary = 3")  # another table: no clash
    session.sql("COMMIT")
    assert rows(other, "SELECT DISTINCT CAST(salary AS INT) FROM emp") == [(3,)]
    assert rows(other, "SELECT count(*) AS n FROM proj WHERE dept IS NULL") == [(3,)]


def test_read_committed_and_repeatable_read(session, spark):
    other = Session(spark, session.store.root)
    for level, change, seen in (
        ("READ COMMITTED", "DELETE FROM emp WHERE id = 4", 3),
        ("REPEATABLE READ", "INSERT INTO emp VALUES (50, 'New', 1, NULL, NULL)", 3),
    ):
        session.sql(f"SET ISOLATION LEVEL {level}")
        session.sql("BEGIN")
        rows(session, "SELECT count(*) AS n FROM emp")
        other.sql(change)
        assert rows(session, "SELECT count(*) AS n FROM emp") == [(seen,)]
        session.sql("COMMIT")
    assert rows(session, "SELECT count(*) AS n FROM emp") == [(4,)]


def test_with_before_insert(session):
    session.sql("WITH b AS (SELECT id + 10 AS id, name FROM emp WHERE id < 3) INSERT INTO emp (id, name) SELECT id, name FROM b")
    assert rows(session, "SELECT id, name FROM emp WHERE id > 10") == [(11, "Ann"), (12, "Bob")]


def test_serializable_checks_what_was_read(session, spark):
    other = Session(spark, session.store.root)
    session.sql("SET ISOLATION LEVEL SERIALIZABLE")
    session.sql("BEGIN")
    rows(session, "SELECT * FROM emp")
    session.sql("UPDATE proj SET dept = NULL")
    other.sql("UPDATE emp SET salary = 2")
    with pytest.raises(Conflict):
        session.sql("COMMIT")


def test_recursion_windows_and_json(session):
    tree = "WITH RECURSIVE t AS (SELECT id, 0 AS d FROM emp WHERE boss IS NULL UNION ALL SELECT e.id, t.d + 1 FROM emp e JOIN t ON e.boss = t.id) SELECT id, d FROM t"
    assert rows(session, tree) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(session, "SELECT id, NTILE(3) OVER (ORDER BY id) AS b FROM emp") == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert rows(session, """SELECT JSON_EXTRACT('{"s": "x"}', '$.s') AS a, '{"s": "x"}'->>'$.s' AS b""") == [('"x"', "x")]


def test_views_synonyms_and_functions(session):
    session.run("CREATE VIEW v AS SELECT id, name, salary FROM emp WHERE salary > 75; CREATE SYNONYM s FOR v; CREATE FUNCTION tw(x) RETURNS INT RETURN x * 2;")
    assert rows(session, "SELECT name, CAST(tw(salary) AS INT) AS t FROM s") == [("Ann", 240), ("Bob", 160), ("Cy", 180)]
    session.sql("UPDATE v SET name = 'Z' WHERE id > 2")
    assert rows(session, "SELECT id FROM emp WHERE name = 'Z'") == [(3,)]
    session.sql("DELETE FROM v WHERE id = 3")
    assert rows(session, "SELECT id FROM emp") == [(1,), (2,), (4,)]
    with pytest.raises(SqlError):
        session.sql("DROP VIEW nothing")


def test_routines_triggers_and_prepared(session):
    session.run(
        "CREATE PROCEDURE g(IN p INT) BEGIN DECLARE r VARCHAR(9) DEFAULT 'low'; IF p >= 100 THEN SET r = 'high'; ELSEIF p >= 80 THEN SET r = 'mid'; END IF; SELECT r AS grade; END;"
        "CREATE TRIGGER tr AFTER DELETE ON proj FOR EACH ROW UPDATE dept SET budget = budget + 1 WHERE id = 1;"
    )
    assert [rows(session, f"CALL g({n})")[0][0] for n in (120, 85, 3)] == ["high", "mid", "low"]
    session.sql("DELETE FROM proj WHERE id < 3")
    assert rows(session, "SELECT CAST(budget AS INT) FROM dept WHERE id = 1") == [(101,)]
    session.run("PREPARE q FROM 'SELECT name FROM emp WHERE id = ? OR name = ?'; SET @i = 3; SET @n = 'Di';")
    assert rows(session, "EXECUTE q USING @i, @n") == [("Cy",), ("Di",)]
    session.sql("DEALLOCATE PREPARE q")
    with pytest.raises(SqlError):
        session.sql("EXECUTE q USING @i, @n")


def test_users_and_vacuum(session):
    session.run("CREATE USER 'u'@'%' IDENTIFIED BY 'pw'; GRANT SELECT, UPDATE ON main.emp TO 'u'@'%'; REVOKE UPDATE ON main.emp FROM 'u'@'%'; CREATE ROLE r; GRANT ROLE r TO 'u'@'%';")
    assert [g for _, g in rows(session, "SHOW GRANTS FOR 'u'@'%'")] == ["GRANT ROLE r", "GRANT SELECT ON main.emp"]
    session.sql("UPDATE emp SET salary = 1")
    assert session.sql("VACUUM RETAIN 0 HOURS").first()[0] > 0
    assert rows(session, "SELECT count(*) AS n FROM emp") == [(4,)]


def test_dump_restores(session, spark, tmp_path):
    session.sql("INSERT INTO emp VALUES (5, 'O''Neil', NULL, NULL, 1)")
    session.sql(f"BACKUP DATABASE main INTO '{tmp_path}/dump'")
    fresh = Session(spark, f"file://{tmp_path}/again")
    for folder in sorted(p for p in (tmp_path / "dump").iterdir()):
        fresh.run("\n".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    for t in ("dept", "emp", "proj"):
        assert rows(fresh, f"SELECT * FROM {t}") == rows(session, f"SELECT * FROM {t}")


def test_dump_restores_a_table_as_one_change(spark, sf, monkeypatch):
    """However many INSERTs a dump has, a table's rows are added and checked once."""
    seen, insert = [], dml.insert
    monkeypatch.setattr(dump, "ROWS", 10)
    monkeypatch.setattr(dml, "insert", lambda *a, **b: seen.append(a[2]) or insert(*a, **b))
    assert statements.sql_dump(spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count() > 100
    assert seen == ["cust", "cust"]  # the table's own rows, and those of the dump


def test_dump_keeps_odd_values(spark, tmp_path, monkeypatch):
    """The same rows come back from restore and from the statements run one by one."""
    monkeypatch.setattr(dump, "ROWS", 4)
    texts = ["", "NULL", "'", "''", "\\", "a\\'b", "\\'", "x\ny\r\nz", "\n", "'\n'", "), (1, 'a');", "INSERT INTO t (id) VALUES (1);\n", "CHAR(10)", "', CHAR(10), '", "é\u2028漢😀\t", None]
    numbers = [0.1, -2.5, 1e300, -1.5e-7, float("nan"), float("inf"), float("-inf"), 12345678.9, None]
    source = [(i, v, numbers[i % len(numbers)], numbers[i % len(numbers)], i % 2 == 0, f"2024-02-{i % 28 + 1:02d}", f"2024-02-01 10:00:00.{i:06d}", f"-{i}.50") for i, v in enumerate(texts)]
    frame = spark.createDataFrame(source, "id long, s string, d double, f double, b boolean, day string, at string, m string")
    frame = frame.selectExpr("CASE WHEN id = 0 THEN -9223372036854775808 ELSE id END", "s", "d", "CAST(f AS FLOAT)", "b", "CAST(day AS DATE)", "CAST(at AS TIMESTAMP_NTZ)", "m")
    s = Session(spark, f"file://{tmp_path}/wh", {"source": frame})
    s.run("CREATE TABLE t (id BIGINT PRIMARY KEY, s TEXT, d DOUBLE, f FLOAT, b BOOLEAN, day DATE, at DATETIME, m DECIMAL(8,2)); INSERT INTO t SELECT * FROM source; CREATE TABLE nothing (a INT); BACKUP DATABASE main INTO 'dump'")
    restored, run = Session(spark, f"file://{tmp_path}/restored"), Session(spark, f"file://{tmp_path}/run")
    admin.restore(restored, f"{s.store.root}/backups/dump")
    for folder in sorted((tmp_path / "wh" / "backups" / "dump").iterdir()):
        run.run("\n".join(p.read_bytes().decode() for p in sorted(folder.glob("part-*"))))
    kept = sorted(map(repr, s.sql("SELECT * FROM t").collect()))
    assert len(kept) == len(texts)
    for again in (restored, run):
        assert sorted(map(repr, again.sql("SELECT * FROM t").collect())) == kept
        assert rows(again, "SELECT count(*) AS n FROM nothing") == [(0,)]


def test_dump_restores_checked(session, spark, tmp_path):
    """Keys and foreign keys are checked, numbers go on, and a line that backup didn't write is an error."""
    session.sql(f"BACKUP DATABASE main INTO '{tmp_path}/dump'")
    fresh = Session(spark, f"file://{tmp_path}/again")
    admin.restore(fresh, f"{tmp_path}/dump")
    for t in ("dept", "emp", "proj"):
        assert rows(fresh, f"SELECT * FROM {t}") == rows(session, f"SELECT * FROM {t}")
    fresh.sql("INSERT INTO dept (code) VALUES ('D')")
    assert rows(fresh, "SELECT id FROM dept WHERE code = 'D'") == [(4,)]
    part = next(p for p in (tmp_path / "dump" / "1-rows-0001-emp").glob("part-*") if p.stat().st_size)
    text = part.read_text()
    part.with_name(f".{part.name}.crc").unlink()
    for old, new in (("(4, ", "(1, "), (", 2, NULL)", ", 2, 77)")):
        assert old in text
        part.write_text(text.replace(old, new))
        with pytest.raises(Violation):
            admin.restore(Session(spark, f"file://{tmp_path}/bad-{new[1:3].strip()}"), f"{tmp_path}/dump")
    head = "INSERT INTO t (a, b) VALUES "
    assert dump._values(f"{head}(1, 'x'), (NULL, CONCAT('a', CHAR(10), ''));", head, 2) == [["1", None], ["x", "a\n"]]
    for bad in ("(1, 'x')", "(1, 'x'), ", "(1);", "(1, 2, 3);", "(1, 'x", "(1, 'x'), (2, NOW());", "(1, 'x'); DROP TABLE t;", ""):
        with pytest.raises(SqlError):
            dump._values(head + bad, head, 2)
    with pytest.raises(SqlError):
        dump._values("DELETE FROM t;", head, 2)


def test_csv(session, tmp_path):
    (tmp_path / "in.csv").write_text('id,name,salary\n7,"a, ""b""",5\n8,c,x\n')
    assert admin.import_csv(session, f"file://{tmp_path}/in.csv", "emp") == (1, 1)
    assert rows(session, "SELECT name FROM emp WHERE id = 7") == [('a, "b"',)]


def test_vacuum_keeps_what_others_hold(session, spark):
    """An open transaction's rows, and versions that readers may hold, outlive VACUUM."""
    other = Session(spark, session.store.root)
    session.sql("BEGIN")
    session.sql("INSERT INTO emp VALUES (60, 'Held', 1, NULL, NULL)")
    frame = other.sql("SELECT count(*) AS n FROM emp")
    other.sql("VACUUM RETAIN 0 HOURS")
    session.sql("COMMIT")
    assert rows(session, "SELECT name FROM emp WHERE id = 60") == [("Held",)]
    session.sql("UPDATE emp SET salary = 1")
    other.sql("VACUUM")  # within RETAIN hours old versions stay
    assert frame.first()[0] == 4
    assert other.sql("VACUUM RETAIN 0 HOURS").first()[0] > 0
    assert rows(other, "SELECT count(*) AS n FROM emp") == [(5,)]
    assert rows(Session(spark, session.store.root), "SELECT count(*) AS n FROM proj") == [(3,)]


def test_repeatable_read_survives_vacuum(session, spark):
    other = Session(spark, session.store.root)
    session.sql("SET ISOLATION LEVEL REPEATABLE READ")
    session.sql("BEGIN")
    other.sql("UPDATE emp SET salary = 7")
    other.sql("VACUUM RETAIN 0 HOURS")
    assert rows(session, "SELECT CAST(salary AS INT) FROM emp") == [(70,), (80,), (90,), (120,)]
    session.sql("ROLLBACK")


def test_commit_keeps_every_kind_of_entry(session, spark):
    other = Session(spark, session.store.root)
    session.sql("BEGIN")
    session.run(
        "CREATE VIEW v AS SELECT id FROM emp; CREATE SYNONYM syn FOR emp; CREATE FUNCTION f(x) RETURNS INT RETURN x + 1; CREATE PROCEDURE p() BEGIN SELECT 1 AS one; END;"
        "CREATE INDEX ix ON emp (name); CREATE USER u1; CREATE ROLE r1; GRANT ROLE r1 TO u1; CREATE DATABASE d2; CREATE TRIGGER tg AFTER DELETE ON emp FOR EACH ROW UPDATE dept SET budget = 0;"
    )
    other.run("CREATE TABLE t2 (a INT); CREATE VIEW w AS SELECT id FROM dept; CREATE USER u2; CREATE DATABASE d3; GRANT SELECT ON main.emp TO u2;")
    session.sql("COMMIT")
    for s in (session, other, Session(spark, session.store.root)):
        assert rows(s, "SELECT count(*) AS n FROM v") == [(4,)] and rows(s, "SELECT count(*) AS n FROM w") == [(3,)]
        assert rows(s, "SELECT f(id) AS x FROM syn WHERE id = 1") == [(2,)] and rows(s, "CALL p()") == [(1,)]
        assert {r[0] for r in rows(s, "SHOW DATABASES")} >= {"d2", "d3"}
        assert {r[0] for r in rows(s, "SHOW GRANTS")} == {"u1", "u2"} and [r[0] for r in rows(s, "SHOW TRIGGERS")] == ["tg"]
        assert "ix" in {r[2] for r in rows(s, "SHOW INDEX FROM emp")}


def test_entries_that_both_change_clash(session, spark):
    other = Session(spark, session.store.root)
    session.sql("BEGIN")
    session.sql("CREATE VIEW v AS SELECT id FROM emp")
    other.sql("CREATE VIEW v AS SELECT id FROM dept")
    with pytest.raises(Conflict):
        session.sql("COMMIT")
    other.sql("CREATE DATABASE d")
    session.sql("BEGIN")
    session.sql("DROP DATABASE d")
    other.run("USE d; CREATE TABLE t (a INT);")
    with pytest.raises(Conflict):
        session.sql("COMMIT")


def test_savepoint_after_others_published(session, spark):
    other = Session(spark, session.store.root)
    session.run("BEGIN; UPDATE dept SET budget = 1; SAVEPOINT a;")
    other.sql("DELETE FROM proj")
    assert rows(session, "SELECT count(*) AS n FROM proj") == [(0,)]
    session.run("ROLLBACK TO SAVEPOINT a; RELEASE SAVEPOINT a; COMMIT;")
    assert rows(other, "SELECT count(*) AS n FROM proj") == [(0,)]
    assert rows(other, "SELECT DISTINCT CAST(budget AS INT) FROM dept") == [(1,)]


def test_rows_read_for_update_are_checked_at_commit(session, spark):
    other = Session(spark, session.store.root)
    for mode, clash in (("FOR UPDATE", True), ("FOR SHARE", True), ("", False)):
        session.sql("BEGIN")
        rows(session, f"SELECT salary FROM emp WHERE id = 1 {mode}")
        session.sql("UPDATE dept SET budget = budget + 1")
        other.sql("UPDATE emp SET salary = salary + 1 WHERE id = 1")
        if clash:
            with pytest.raises(Conflict):
                session.sql("COMMIT")
        else:
            session.sql("COMMIT")
    assert rows(other, "SELECT CAST(salary AS INT) FROM emp WHERE id = 1") == [(123,)]
    assert rows(other, "SELECT CAST(budget AS INT) FROM dept WHERE code = 'A'") == [(101,)]


def test_manifests_are_whole_or_not_there(session):
    files = session.store.files
    assert files.create("manifests/99999990.json", "{}") and not files.create("manifests/99999990.json", "other")
    assert files.read("manifests/99999990.json") == "{}" and files.names("aside") == []


def test_insert_ignore_with_two_keys(session):
    session.run("CREATE TABLE k (id INT PRIMARY KEY, code VARCHAR(9) UNIQUE, v INT); INSERT INTO k VALUES (1, 'A', 0);")
    session.sql("INSERT IGNORE INTO k VALUES (10, 'A', 1), (10, 'N', 2), (11, 'N', 3), (11, 'M', 4), (12, NULL, 5), (13, NULL, 6), (12, 'Z', 7)")
    assert rows(session, "SELECT id, v FROM k") == [(1, 0), (10, 2), (11, 4), (12, 5), (13, 6)]


def test_upsert_goes_row_by_row(session):
    session.run("CREATE TABLE k (id INT PRIMARY KEY, code VARCHAR(9) UNIQUE, v INT); INSERT INTO k VALUES (1, 'A', 0), (2, 'B', 0);")
    session.sql("INSERT INTO k VALUES (1, 'X', 9), (3, 'C', 5), (9, 'A', 9), (3, 'D', 9), (3, 'C', 9), (2, 'A', 9), (4, 'E', 1) ON DUPLICATE KEY UPDATE v = v * 2 + 1")
    assert rows(session, "SELECT id, code, v FROM k") == [(1, "A", 3), (2, "B", 1), (3, "C", 23), (4, "E", 1)]


def test_merge_deletes_and_updates_at_once(session):
    """A row that takes the values a deleted row had stays."""
    session.run("CREATE TABLE m (id INT, v INT); INSERT INTO m VALUES (1, 10), (2, 20); CREATE TABLE u (id INT, op VARCHAR(3), nid INT, nv INT); INSERT INTO u VALUES (1, 'del', 0, 0), (2, 'upd', 1, 10);")
    session.sql("MERGE INTO m USING u ON m.id = u.id WHEN MATCHED AND u.op = 'del' THEN DELETE WHEN MATCHED THEN UPDATE SET id = u.nid, v = u.nv")
    assert rows(session, "SELECT id, v FROM m") == [(1, 10)]


def test_before_triggers_and_set_default(session):
    session.run(
        "CREATE TABLE log (n INT); INSERT INTO log VALUES (0);"
        "CREATE TRIGGER b BEFORE UPDATE ON emp FOR EACH ROW UPDATE log SET n = (SELECT CAST(SUM(salary) AS INT) FROM emp);"
        "CREATE TABLE par (id INT PRIMARY KEY); INSERT INTO par VALUES (1), (2);"
        "CREATE TABLE kid (id INT PRIMARY KEY, p INT DEFAULT 2, FOREIGN KEY (p) REFERENCES par(id) ON DELETE SET DEFAULT ON UPDATE SET DEFAULT); INSERT INTO kid VALUES (1, 1), (2, 2);"
    )
    session.sql("UPDATE emp SET salary = 0")
    assert rows(session, "SELECT n FROM log") == [(360,)]
    session.sql("DELETE FROM par WHERE id = 1")
    assert rows(session, "SELECT id, p FROM kid") == [(1, 2), (2, 2)]


def test_indexes_lay_the_table_out(session, spark):
    session.frames["numbers"] = spark.range(0, 20_000, 1, 4).selectExpr("(id * 7919) % 20000 AS id", "concat('c', id) AS code", "CAST(id AS INT) AS v")
    session.run("CREATE TABLE big (id BIGINT, code VARCHAR(20), v INT); INSERT INTO big SELECT id, code, v FROM numbers; CREATE INDEX ix ON big (ID); CREATE INDEX hx ON big (code) USING HASH;")
    path = f"{session.store.root}/{session.store.catalog['databases']['main']['tables']['big']['segments'][0]}".removeprefix("file://")
    spans = sorted((s.min, s.max) for f in glob.glob(f"{path}/*.parquet") for s in [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert rows(session, "SELECT v FROM big WHERE id = 7919 * 3") == [] and rows(session, "SELECT v FROM big WHERE id = 3757") == [(3,)]
    assert rows(session, "SELECT v FROM big WHERE code = 'c17'") == [(17,)]
    session.sql("INSERT INTO big VALUES (1, 'new', 0)")
    assert rows(session, "SELECT count(*) AS n FROM big") == [(20_001,)]
    with pytest.raises(SqlError):
        session.sql("CREATE INDEX bad ON big (nothing)")


def test_sessions_that_publish_at_once(session, spark):
    """Each of several threads changes a table of its own; every commit is kept."""

    def work(i):
        own = Session(spark, session.store.root)
        own.sql(f"CREATE TABLE t{i} (a INT)")
        for k in range(3):
            own.sql(f"INSERT INTO t{i} VALUES ({k})")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    assert [rows(session, f"SELECT COUNT(*) AS n, SUM(a) AS s FROM t{i}") for i in range(4)] == [[(3, 3)]] * 4
    assert session.store.files.names("leases") == [] and session.store.files.names("aside") == []


def test_vacuum_runs_by_itself(session, monkeypatch):
    monkeypatch.setattr(session_module, "AUTO_VACUUM", 3)
    asked = []
    monkeypatch.setattr(session.store, "vacuum", lambda: asked.append(session.store.staged) or 0)
    session._changes = 0
    session.run("BEGIN; UPDATE emp SET salary = 1; UPDATE emp SET salary = 2; UPDATE emp SET salary = 3; COMMIT;")
    assert asked == []
    session.sql("UPDATE emp SET salary = 4")
    assert asked == [None]


def test_changes_write_only_the_segments_they_touch(session):
    session.run("CREATE TABLE s (id INT PRIMARY KEY, v INT); INSERT INTO s VALUES (1, 1), (2, 2); INSERT INTO s VALUES (3, 3), (4, 4); INSERT INTO s VALUES (5, 5);")
    names = lambda: session.store.catalog["databases"]["main"]["tables"]["s"]["segments"]
    a, b, c = names()
    session.sql("UPDATE s SET v = 30 WHERE id = 3")
    assert names()[:2] == [a, c] and b not in names()
    session.sql("DELETE FROM s WHERE id = 1")
    assert c in names() and a not in names() and len(names()) == 3
    session.sql("UPDATE s SET v = 50 WHERE v > (SELECT AVG(v) FROM s) AND id = 3")
    assert c in names()
    session.sql("DELETE FROM s WHERE id IN (SELECT MAX(id) FROM s)")
    assert c not in names()
    before = names()
    assert session.sql("UPDATE s SET v = 0 WHERE id = 99").first()[0] == session.sql("DELETE FROM s WHERE id = 99").first()[0] == 0
    assert names() == before and rows(session, "SELECT id, v FROM s") == [(2, 2), (3, 50), (4, 4)]
    with pytest.raises(Violation):
        session.sql("UPDATE s SET id = 2 WHERE id = 3")  # the key stands in another segment
    session.run("CREATE TABLE u (id INT, op VARCHAR(3)); INSERT INTO u VALUES (2, 'del'), (4, 'upd'), (7, 'new');")
    session.sql("MERGE INTO s USING u ON s.id = u.id WHEN MATCHED AND u.op = 'del' THEN DELETE WHEN MATCHED THEN UPDATE SET v = 40 WHEN NOT MATCHED THEN INSERT (id, v) VALUES (u.id, 70)")
    assert rows(session, "SELECT id, v FROM s") == [(3, 50), (4, 40), (7, 70)]
    session.run("INSERT INTO s VALUES (8, 8), (9, 9); UPDATE s SET v = 41 WHERE id = 4; DELETE FROM u; INSERT INTO u VALUES (8, 'del'), (9, 'upd');")
    session.sql("MERGE INTO s USING u ON s.id = u.id WHEN MATCHED AND u.op = 'del' THEN DELETE WHEN MATCHED THEN UPDATE SET v = 90")
    assert rows(session, "SELECT id, v FROM s") == [(3, 50), (4, 41), (7, 70), (9, 90)]
