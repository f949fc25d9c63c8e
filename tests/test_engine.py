"""Statements of the dialect on small literal tables."""

import pytest

from skein.plans.dialect import extensions, query
from skein.plans.engine import ConstraintError, Engine
from skein.plans.tokens import render, tokenize


@pytest.fixture
def run(spark, tmp_path):
    ticks = iter(range(1000, 10**6, 10))
    e = Engine(spark, folders=(str(tmp_path),), clock=lambda: next(ticks))

    def execute(sql, args=None):
        return [tuple(r) for r in e.execute(sql, args).collect()]

    execute.engine = e
    return execute


@pytest.fixture
def t(run):
    run("CREATE TABLE t (id INT, dept INT, salary INT)")
    run("INSERT INTO t VALUES (1,1,100), (2,1,200), (3,1,300), (4,2,150), (5,2,250), (6,3,350)")
    return run


def test_nulls(run):
    run("CREATE TABLE n (id INT, val INT)")
    run("INSERT INTO n (id, val) VALUES (1,10), (2,NULL), (3,30), (4,NULL), (5,50)")
    assert run("SELECT count(*), count(val), min(val), max(val), count(DISTINCT val), sum(val), avg(val) FROM n") == [(5, 3, 10, 50, 3, 90, 30.0)]
    assert run("SELECT count(val) FROM n WHERE id > 2") == [(2,)]
    assert run("SELECT count(*) FROM n WHERE val <> 10") == [(2,)]
    assert run("SELECT id FROM n WHERE id NOT IN (SELECT val FROM n)") == []


def test_case_having_distinct(t):
    assert sum(r[0] for r in t("SELECT CASE WHEN salary > 200 THEN 1 ELSE 0 END FROM t")) == 3
    assert t("SELECT dept, count(*) FROM t GROUP BY dept HAVING count(*) > 2") == [(1, 3)]
    assert t("SELECT dept FROM t GROUP BY dept HAVING sum(salary) > 400") == [(1,)]
    assert len(t("SELECT DISTINCT dept FROM t")) == 3
    assert len(t("SELECT id FROM t WHERE dept = 1 UNION ALL SELECT id FROM t WHERE dept = 3")) == 4


def test_constraints(run):
    run("CREATE TABLE parent (id INT PRIMARY KEY, kind ENUM('a', 'b'))")
    run("CREATE TABLE child (id INT, parent_id INT REFERENCES parent(id) ON DELETE SET NULL, v INT DEFAULT 3 CHECK (v > 0))")
    run("INSERT INTO parent VALUES (1, 'a'), (2, 'b')")
    run("INSERT INTO child (id, parent_id) VALUES (1, 1), (2, NULL)")
    assert run("SELECT id, v FROM child ORDER BY id") == [(1, 3), (2, 3)]
    for bad in ("INSERT INTO parent VALUES (1, 'a')", "INSERT INTO parent VALUES (NULL, 'a')", "INSERT INTO parent VALUES (9, 'c')", "INSERT INTO child VALUES (3, 9, 1)", "INSERT INTO child VALUES (3, 1, -1)"):
        with pytest.raises(ConstraintError):
            run(bad)
    run("DELETE FROM parent WHERE id = 1")
    assert run("SELECT id, parent_id FROM child ORDER BY id") == [(1, None), (2, None)]
    run("CREATE TABLE strict (p INT REFERENCES parent(id))")
    run("INSERT INTO strict VALUES (2)")
    with pytest.raises(ConstraintError):
        run("DELETE FROM parent WHERE id = 2")


def test_changes(t):
    assert t("UPDATE t SET salary = salary + 1 WHERE dept = 2 RETURNING id") in ([(4,), (5,)], [(5,), (4,)])
    assert t("DELETE FROM t WHERE salary > 300") == [(1,)]
    t("INSERT INTO t SELECT id + 10, dept, NULL FROM t WHERE dept = 2")
    assert t("SELECT count(*), count(salary) FROM t") == [(7, 5)]
    t("CREATE TABLE u (id INT PRIMARY KEY, v INT)")
    t("INSERT INTO u VALUES (1, 1)")
    t("INSERT INTO u VALUES (1, 5), (2, 6) ON CONFLICT (id) DO NOTHING")
    t("INSERT INTO u VALUES (2, 9) ON CONFLICT (id) DO UPDATE SET v = excluded.v * 2")
    assert t("SELECT * FROM u ORDER BY id") == [(1, 1), (2, 18)]


def test_merge(run):
    run("CREATE TABLE target (id INT, val INT)")
    run("INSERT INTO target VALUES (1, 10), (2, 20)")
    assert run("MERGE INTO target USING (VALUES (2, 99), (3, 30)) AS s(id, val) ON target.id = s.id WHEN MATCHED THEN UPDATE SET val = s.val WHEN NOT MATCHED THEN INSERT (id, val) VALUES (s.id, s.val)") == [(2,)]
    assert run("SELECT id, val FROM target ORDER BY id") == [(1, 10), (2, 99), (3, 30)]
    run("MERGE INTO target AS t USING (VALUES (1, 0)) AS s(id, val) ON t.id = s.id WHEN MATCHED AND s.val = 0 THEN DELETE WHEN NOT MATCHED BY SOURCE THEN UPDATE SET val = 0")
    assert run("SELECT id, val FROM target ORDER BY id") == [(2, 0), (3, 0)]


def test_merge_changes_a_row_once(run):
    run("CREATE TABLE target (id INT, s VARCHAR(20))")
    run("INSERT INTO target VALUES (1, 'a'), (1, 'a')")
    with pytest.raises(ConstraintError):
        run("MERGE INTO target USING (VALUES (1, 5), (1, 6)) AS x(id, v) ON target.id = x.id WHEN MATCHED THEN UPDATE SET s = 'see__a'")
    assert run("SELECT s FROM target") == [("a",), ("a",)]
    assert run("MERGE INTO target USING (VALUES (1, 5)) AS x(id, v) ON target.id = x.id WHEN MATCHED THEN UPDATE SET s = 'see__a'") == [(2,)]
    assert run("SELECT s FROM target") == [("see__a",), ("see__a",)]
    run("CREATE TABLE u (id INT PRIMARY KEY, v INT)")
    run("INSERT INTO u VALUES (1, 1)")
    run("INSERT INTO u VALUES (2, 1), (2, 3) ON CONFLICT (id) DO NOTHING")
    assert run("SELECT count(*) FROM u") == [(2,)]
    with pytest.raises(Exception, match="same id"):
        run("INSERT INTO u VALUES (1, 1), (1, 3) ON CONFLICT (id) DO UPDATE SET v = excluded.v")


def test_recursion(run):
    run("CREATE TABLE employees (id INT, manager_id INT, name VARCHAR(50))")
    run("INSERT INTO employees VALUES (1,0,'CEO'), (2,1,'VP Eng'), (3,1,'VP Sales'), (4,2,'Dev Lead'), (5,2,'QA Lead')")
    tree = "WITH RECURSIVE h (id, depth) AS (SELECT id, 0 FROM employees WHERE manager_id = 0 UNION ALL SELECT e.id, h.depth + 1 FROM employees e JOIN h ON e.manager_id = h.id) SELECT depth, count(*) FROM h GROUP BY depth ORDER BY depth"
    assert run(tree) == [(0, 1), (1, 2), (2, 2)]
    assert run(tree + " OPTION (MAXRECURSION 1)") == [(0, 1), (1, 2)]
    cycle = "WITH RECURSIVE c AS (SELECT 1 AS x UNION ALL SELECT 3 - x FROM c) SELECT count(DISTINCT x) FROM c"
    assert run(cycle) == [(2,)]


def test_views_procedures_transactions(t):
    t("CREATE VIEW v AS SELECT id FROM t WHERE dept = 1")
    t("INSERT INTO t VALUES (7, 1, 5)")
    assert t("SELECT count(*) FROM v") == [(4,)]
    t("DROP VIEW v")
    with pytest.raises(Exception, match="v"):
        t("SELECT * FROM v")
    t("CREATE PROCEDURE add_one AS INSERT INTO t (id) VALUES (@1)")
    t("EXEC add_one 99")
    with pytest.raises(ValueError):
        t("EXEC add_one id")
    assert t("SELECT dept FROM t WHERE id = 99") == [(None,)]
    t("BEGIN")
    t("DELETE FROM t")
    t("SAVEPOINT s")
    t("INSERT INTO t VALUES (1, 1, 1)")
    t("ROLLBACK TO SAVEPOINT s")
    assert t("SELECT count(*) FROM t") == [(0,)]
    t("ROLLBACK")
    assert t("SELECT count(*) FROM t") == [(8,)]


def test_versions(run):
    run("CREATE TABLE h (id INT, v INT) WITH (SYSTEM_VERSIONING = ON)")
    run("INSERT INTO h VALUES (1, 100), (2, 200)")  # at 1000
    run("UPDATE h SET v = 150 WHERE id = 1")  # at 1010
    assert run("SELECT * FROM h FOR SYSTEM_TIME AS OF 1005 ORDER BY id") == [(1, 100), (2, 200)]
    assert run("SELECT * FROM h FOR SYSTEM_TIME AS OF 18446744073709551615 ORDER BY id") == [(1, 150), (2, 200)]
    assert run("SELECT count(*) FROM h FOR SYSTEM_TIME ALL") == [(3,)]
    assert run("SELECT count(*) FROM h FOR SYSTEM_TIME BETWEEN 1011 AND 2000") == [(2,)]


def test_files(t, tmp_path):
    t(f"COPY t TO '{tmp_path}/out'")
    t(f"COPY t FROM '{tmp_path}/out'")
    assert t("SELECT count(*) FROM t") == [(12,)]
    t(f"BACKUP TO '{tmp_path}/save'")
    t("DELETE FROM t")
    t(f"RESTORE FROM '{tmp_path}/save'")
    assert t("SELECT count(*) FROM t") == [(12,)]
    with pytest.raises(PermissionError):
        t(f"COPY t TO '{tmp_path}/../x'")


def test_scalars(run):
    assert run("SELECT 1 / 0, 7 % 3, -7 % 3, CAST('x' AS INT), IIF(NULL, 1, 2), TRY_CONVERT(INT, '8'), 'it''s' || '!', SUBSTR('müde', 2, 2)") == [(None, 1, -1, None, 2, 8, "it's!", "üd")]
    assert run("SELECT JSON_VALUE('{\"a\":[1,{\"b\":\"x\"}]}', '$.a[1].b'), JSON_QUERY('{\"a\":[1]}', '$.a'), ISJSON('{invalid'), JSON_PATH_EXISTS('{\"a\":null}', '$.a'), json_modify('{\"a\":1}', '$.a', 'y')") == [("x", "[1]", False, True, '{"a":"y"}')]
    assert run("SELECT $2 - $1, $1", [1, 5]) == [(4, 1)]
    assert run("SELECT ?, ?", [1, "?"]) == [(1, "?")]
    assert run("SELECT ?", ["x'; DROP TABLE t"]) == [("x'; DROP TABLE t",)]


def test_pivot_windows(t):
    assert t("SELECT * FROM (SELECT dept, id % 2 AS odd, salary FROM t) AS x PIVOT (SUM(salary) FOR odd IN (0, 1)) ORDER BY dept") == [(1, 200, 400), (2, 150, 250), (3, 350, None)]
    assert t("SELECT id, RANK() OVER (PARTITION BY dept ORDER BY salary DESC) AS r FROM t ORDER BY id")[:3] == [(1, 3), (2, 2), (3, 1)]


def test_rewrites_leave_literals_alone():
    sql = "SELECT 'FETCH FIRST 1 ROWS ONLY IIF(' AS a, \"TIER\" FROM t -- LIMIT 3"
    assert render(query(tokenize(sql))) == "SELECT 'FETCH FIRST 1 ROWS ONLY IIF(' AS a, `TIER` FROM t"


def test_extensions():
    tokens, o = extensions(tokenize("SELECT AVG(p) APPROXIMATE WITHIN 0.01 CONFIDENCE 0.99 FROM s TIER CXL CONSISTENCY STRONG USING HYPERLOGLOG MEMORY BUDGET 10 ENERGY BUDGET 5 JOULES"))
    assert render(tokens) == "SELECT AVG(p) FROM s"
    assert (o.approximate, o.tier, o.consistency, o.method, o.memory_budget, o.energy_budget) == ((0.01, 0.99), "CXL", "STRONG", "HYPERLOGLOG", 10, 5)
    tokens, o = extensions(tokenize("SELECT a FROM x JOIN y USING (id)"))
    assert o.method is None and "USING" in render(tokens)


def test_similar(run):
    run("CREATE TABLE bits (id INT, b BIGINT)")
    run("INSERT INTO bits VALUES (1, 255), (2, 254), (3, 0)")
    assert run("SELECT id FROM bits SIMILAR TO b x'FF' WITHIN HAMMING DISTANCE 1 ORDER BY id") == [(1,), (2,)]


def test_definitions(run):
    run("CREATE TABLE all_types (a INT, b BIGINT, c SMALLINT, d TINYINT, e FLOAT, f DOUBLE, g REAL, h DECIMAL(10,2), i BOOLEAN, j VARCHAR(9), k TEXT, l DATE, m TIMESTAMP, n JSON, o ARRAY, p UUID, q BYTEA, r NUMERIC, s BIT)")
    run("ALTER TABLE all_types ADD COLUMN z INT")
    run("ALTER TABLE all_types DROP COLUMN a")
    assert "z" in run.engine.table("all_types").df.columns and "a" not in run.engine.table("all_types").df.columns
    run("CREATE TABLE IF NOT EXISTS all_types (x INT)")
    run("CREATE SCHEMA HR")
    run("CREATE TABLE HR.Employees (id INT)")
    run("INSERT INTO HR.Employees VALUES (1)")
    assert run("SELECT count(*) FROM HR.Employees") == [(1,)]
    run("CREATE INDEX i ON all_types (b)")
    run("DROP INDEX i")
    run("DROP TABLE IF EXISTS nothing")
    with pytest.raises(KeyError):
        run("DROP TABLE nothing")
    with pytest.raises(ValueError):
        run("FROBNICATE")


def test_functions_types_context(run):
    run("CREATE FUNCTION twice(@x INT, y INT) RETURNS INT AS BEGIN RETURN @x * 2 + y END")
    assert run("SELECT twice(4, 1)") == [(9,)]
    run("CREATE TYPE pairs AS TABLE (a INT, b VARCHAR(5))")
    run.engine.table_value("pairs", "p", [(1, "x"), (2, None)])
    assert run("SELECT a, b FROM p ORDER BY a") == [(1, "x"), (2, None)]
    run.engine.register_function("shout", lambda x: x and x.upper(), "string")
    assert run("SELECT shout('a')") == [("A",)]
    run("SET user_name = 'o''hara'")
    assert run("SELECT SESSION_CONTEXT('user_name'), SESSION_CONTEXT('none')") == [("o'hara", None)]


def test_materialized_views_and_utilities(t):
    t("CREATE MATERIALIZED VIEW m AS SELECT dept, COUNT(*) AS n FROM t GROUP BY dept")
    t("DELETE FROM t WHERE dept = 1")
    assert len(t("SELECT * FROM m")) == 3
    t("REFRESH MATERIALIZED VIEW m")
    assert len(t("SELECT * FROM m")) == 2
    t("DROP MATERIALIZED VIEW m")
    t("VACUUM")
    assert ("t",) in t("SHOW TABLES") and t("ANALYZE SELECT * FROM t")[0][0] == 3
    assert any("Filter" in line for (line,) in t("EXPLAIN SELECT id FROM t WHERE salary > 1"))
    assert t("SELECT COUNT(DISTINCT id) AS n FROM t USING HYPERLOGLOG") == [(3,)]
    assert t("SELECT AVG(salary) AS a APPROXIMATE WITHIN 1 CONFIDENCE 0.9 FROM t")[0][0] == 250.0
