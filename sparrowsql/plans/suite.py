"""The relational queries, in the dialect, each with its DuckDB twin ("" when the text serves both)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparrowsql.operators import ordered
from sparrowsql.plans import flagship, statements
from sparrowsql.sources.tables import query

D = "CAST(o_totalprice AS DECIMAL(18,2))"
TREE = """VALUES (1, 0, 'root'), (2, 1, 'left'), (3, 1, 'right'), (4, 2, 'left.left'), (5, 4, 'deep'), (6, 3, 'right.left')"""

QUERIES: dict[str, tuple[str, str]] = {
    # scans and predicates
    "scan_filter_project": ("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'", ""),
    "scan_point": ("SELECT * FROM customer WHERE c_custkey = 7", ""),
    "scan_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300", ""),
    "scan_composite": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey = 10 AND l_linenumber = 1", ""),
    "scan_prefix": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'", ""),
    "scan_covering": ("SELECT o_custkey FROM orders WHERE o_custkey BETWEEN 5 AND 40", ""),
    "dual_expression": ("SELECT 1 + 2 * 3 AS n, UPPER('a') AS u, (4 + 6) / 4 AS q", "SELECT 1 + 2 * 3 AS n, upper('a') AS u, (4 + 6) / 4 AS q"),
    "pred_compare": ("SELECT n_nationkey FROM nation WHERE n_nationkey != 3 AND n_regionkey <= 2 AND n_regionkey >= 1", ""),
    "pred_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey < 100", ""),
    "pred_not_in": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 2)", ""),
    "pred_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000", ""),
    "pred_like": ("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%E%' AND NOT p_name LIKE 'a_%'", ""),
    "pred_regexp": ("SELECT c_custkey FROM customer WHERE c_name REGEXP '[0-9]*7$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-9]*7$')"),
    "pred_is_null": ("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL AND o_custkey IS NOT NULL", ""),
    "pred_not_or": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 200000)", ""),
    "pred_column_to_column": ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = l_suppkey", ""),
    "pred_null_logic": ("SELECT count(*) AS n FROM orders WHERE NOT (NULLIF(o_orderstatus, 'F') = 'O')", ""),
    "pred_not_like_between": ("SELECT n_nationkey FROM nation WHERE n_name NOT LIKE 'A%' AND n_nationkey NOT BETWEEN 5 AND 9", ""),
    # projection
    "project_arithmetic": ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net FROM lineitem", ""),
    "project_comparison": ("SELECT o_orderkey, o_totalprice > 250000 AS big FROM orders", "SELECT o_orderkey, CAST(o_totalprice > 250000 AS INT) AS big FROM orders"),
    "project_star_join": ("SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", ""),
    "case_when": ("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS grade, IF(o_orderstatus = 'F', 'done', 'open') AS state FROM orders",
                  "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS grade, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state FROM orders"),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", ""),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000", ""),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey", ""),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey", ""),
    "join_full": ("SELECT s.s_suppkey, c.c_custkey FROM (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s FULL OUTER JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON s.s_suppkey = c.c_custkey", ""),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", ""),
    "join_natural": ("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b", ""),
    "join_using": ("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey > 1) b USING (k)", ""),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", ""),
    "join_range": ("SELECT r.r_regionkey, count(*) AS n FROM region r JOIN nation n ON n.n_nationkey >= r.r_regionkey * 5 AND n.n_nationkey < r.r_regionkey * 5 + 7 GROUP BY r.r_regionkey", ""),
    "join_semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", ""),
    "join_anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", ""),
    "join_self": ("SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1 WHERE a.c_nationkey = b.c_nationkey", ""),
    "join_three_way": ("SELECT r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", ""),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'", ""),
    "join_null_keys": ("SELECT count(*) AS n FROM (SELECT NULLIF(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 1) AS k FROM region) b ON a.k = b.k", ""),
    # aggregation
    "agg_global": (f"SELECT COUNT(*) AS n, CAST(SUM({D}) AS DOUBLE) AS total, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, ROUND(AVG(o_totalprice), 4) AS mean FROM orders",
                   f"SELECT COUNT(*) AS n, CAST(SUM({D}) AS DOUBLE) AS total, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, ROUND(AVG(o_totalprice), 4) AS mean FROM orders"),
    "agg_group": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty, ROUND(AVG(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus", ""),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14 AND MAX(o_totalprice) > 1000", ""),
    "agg_having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 15", ""),
    "agg_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderstatus) AS states, SUM(DISTINCT o_custkey) AS total, ROUND(AVG(DISTINCT o_custkey), 4) AS mean FROM orders",
                     "SELECT COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderstatus) AS states, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS total, ROUND(AVG(DISTINCT o_custkey), 4) AS mean FROM orders"),
    "agg_count_null": ("SELECT COUNT(*) AS every_row, COUNT(NULLIF(o_orderstatus, 'F')) AS some FROM orders", ""),
    "agg_stddev_variance": ("SELECT o_orderstatus, ROUND(STDDEV(o_totalprice), 2) AS sd, ROUND(VARIANCE(o_totalprice) / 1000000, 2) AS var FROM orders GROUP BY o_orderstatus",
                            "SELECT o_orderstatus, ROUND(stddev_pop(o_totalprice), 2) AS sd, ROUND(var_pop(o_totalprice) / 1000000, 2) AS var FROM orders GROUP BY o_orderstatus"),
    "agg_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name SEPARATOR ', ') AS names FROM nation GROUP BY n_regionkey",
                         "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_min_max_text": ("SELECT c_mktsegment, MIN(c_name) AS low, MAX(c_name) AS high FROM customer GROUP BY c_mktsegment", ""),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_custkey) AS a FROM orders WHERE o_orderkey < 0"),
    "agg_null_group": ("SELECT NULLIF(o_orderstatus, 'F') AS state, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'F')", ""),
    "agg_order_by": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 5", ""),
    # windows
    "win_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders", ""),
    "win_rank_dense": ("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part", ""),
    "win_lag_lead": ("SELECT o_orderkey, LAG(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM orders", ""),
    "win_first_last_nth": ("SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER w1 AS f, LAST_VALUE(o_totalprice) OVER w1 AS l, NTH_VALUE(o_totalprice, 2) OVER w1 AS s FROM orders WINDOW w1 AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", ""),
    "win_ntile": ("SELECT c_custkey, NTILE(7) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bucket FROM customer", ""),
    "win_percent_cume": ("SELECT s_suppkey, ROUND(PERCENT_RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd FROM supplier", ""),
    "win_running_sum": ("SELECT o_orderkey, SUM(FLOOR(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM orders",
                        "SELECT o_orderkey, CAST(SUM(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM orders"),
    "win_moving_avg": ("SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 3) AS mean FROM orders", ""),
    "win_partition_total": ("SELECT n_nationkey, COUNT(*) OVER (PARTITION BY n_regionkey) AS n, MAX(n_name) OVER (PARTITION BY n_regionkey) AS top, MIN(n_nationkey) OVER (PARTITION BY n_regionkey) AS low FROM nation", ""),
    "win_range_peers": ("SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto FROM part", ""),
    # order, limit, sets
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", ""),
    "topk_ascending": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 500 ORDER BY o_totalprice, o_orderkey LIMIT 5", ""),
    "limit_offset": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 25", ""),
    "fetch_first": ("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey FETCH FIRST 4 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 4"),
    "order_nulls": ("SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation ORDER BY k, n_nationkey LIMIT 22", "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation ORDER BY k NULLS LAST, n_nationkey LIMIT 22"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", ""),
    "union_all": ("SELECT n_name AS label, 'nation' AS entity FROM nation UNION ALL SELECT r_name, 'region' FROM region", ""),
    "intersect_distinct": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier", ""),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", ""),
    "except_distinct": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier", ""),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", ""),
    "set_order_limit": ("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 12 OFFSET 3", ""),
    "set_chained": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", ""),
    "set_chained_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier UNION ALL SELECT r_regionkey FROM region ORDER BY k LIMIT 40", ""),
    # CTEs, derived tables, subqueries
    "cte_simple": ("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000) SELECT c_name, o_totalprice FROM big JOIN customer ON o_custkey = c_custkey", ""),
    "cte_multi": ("WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT b.c_mktsegment, SUM(a.n) AS n FROM b LEFT JOIN a ON a.o_custkey = b.c_custkey GROUP BY b.c_mktsegment",
                  "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT b.c_mktsegment, CAST(SUM(a.n) AS BIGINT) AS n FROM b LEFT JOIN a ON a.o_custkey = b.c_custkey GROUP BY b.c_mktsegment"),
    "cte_recursive": (f"WITH RECURSIVE nodes AS (SELECT col1 AS id, col2 AS parent, col3 AS name FROM ({TREE})), tree AS (SELECT id, name, 0 AS depth FROM nodes WHERE parent = 0 UNION ALL SELECT n.id, n.name, t.depth + 1 FROM nodes n JOIN tree t ON n.parent = t.id) SELECT id, name, depth FROM tree",
                      f"WITH RECURSIVE nodes(id, parent, name) AS ({TREE}), tree AS (SELECT id, name, 0 AS depth FROM nodes WHERE parent = 0 UNION ALL SELECT n.id, n.name, t.depth + 1 FROM nodes n JOIN tree t ON n.parent = t.id) SELECT id, name, depth FROM tree"),
    "cte_recursive_series": ("WITH RECURSIVE s AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS square FROM s", ""),
    "derived_table": ("SELECT state, mean FROM (SELECT o_orderstatus AS state, ROUND(AVG(o_totalprice), 3) AS mean FROM orders GROUP BY o_orderstatus) AS sub WHERE mean > 1000", ""),
    "subq_scalar_where": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)", ""),
    "subq_scalar_select": ("SELECT r_name, (SELECT MAX(n_nationkey) FROM nation) AS top FROM region", ""),
    "subq_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 440000)", ""),
    "subq_not_in": ("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", ""),
    "subq_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", ""),
    # scalar functions
    "fn_string": ("SELECT c_custkey, UPPER(c_mktsegment) AS u, LOWER(c_name) AS l, LENGTH(c_name) AS n, CHAR_LENGTH(c_name) AS cn, CONCAT(c_name, '-', c_mktsegment) AS c, SUBSTR(c_name, 3, 4) AS s, REPLACE(c_name, '#', '/') AS r, REVERSE(c_name) AS v, INSTR(c_name, '#') AS i, ASCII(c_mktsegment) AS a, REPEAT('ab', 2) AS p, SPACE(2) AS sp, BIT_LENGTH(c_name) AS b FROM customer",
                  "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, CAST(strlen(c_name) AS INT) AS n, CAST(length(c_name) AS INT) AS cn, c_name || '-' || c_mktsegment AS c, substr(c_name, 3, 4) AS s, replace(c_name, '#', '/') AS r, reverse(c_name) AS v, CAST(instr(c_name, '#') AS INT) AS i, ascii(c_mktsegment) AS a, repeat('ab', 2) AS p, repeat(' ', 2) AS sp, CAST(bit_length(c_name) AS INT) AS b FROM customer"),
    "fn_pad_trim": ("SELECT n_nationkey, LPAD(CAST(n_nationkey AS VARCHAR(5)), 5, '0') AS lp, RPAD(n_name, 12, '.') AS rp, TRIM('  a ') AS t, LTRIM('  a ') AS lt, RTRIM('  a ') AS rt, LEFT(n_name, 3) AS lf, RIGHT(n_name, 2) AS rg, LOCATE('A', n_name, 2) AS lo FROM nation",
                    "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS lp, rpad(n_name, 12, '.') AS rp, trim('  a ') AS t, ltrim('  a ') AS lt, rtrim('  a ') AS rt, left(n_name, 3) AS lf, right(n_name, 2) AS rg, CAST(CASE WHEN instr(substr(n_name, 2), 'A') = 0 THEN 0 ELSE instr(substr(n_name, 2), 'A') + 1 END AS INT) AS lo FROM nation"),
    "fn_regexp": ("SELECT c_custkey, REGEXP_LIKE(c_name, '^C.*9$') AS k, REGEXP_REPLACE(c_name, '[0-9]+', 'N') AS r, REGEXP_MATCH(c_name, '[1-9][0-9]*') AS m FROM customer",
                  "SELECT c_custkey, regexp_matches(c_name, '^C.*9$') AS k, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS r, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS m FROM customer"),
    "fn_math": ("SELECT p_partkey, ROUND(p_retailprice / 7, 2) AS r, ABS(-p_size) AS a, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, MOD(p_size, 7) AS m, ROUND(SQRT(p_size), 6) AS s, POW(p_size, 2) AS p, ROUND(LOG(p_size), 6) AS ln, ROUND(LOG(p_size, 3), 6) AS l3, ROUND(LOG2(p_size), 6) AS l2, ROUND(LOG10(p_size), 6) AS l10, ROUND(EXP(p_size / 50), 6) AS e, ROUND(SIN(p_size), 6) AS si, ROUND(PI(), 6) AS pi, TRUNCATE(p_retailprice, 1) AS t, GREATEST(p_size, 25) AS g, LEAST(p_size, 25) AS le FROM part",
                "SELECT p_partkey, ROUND(p_retailprice / 7, 2) AS r, ABS(-p_size) AS a, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, p_size % 7 AS m, ROUND(SQRT(p_size), 6) AS s, POW(p_size, 2) AS p, ROUND(LN(p_size), 6) AS ln, ROUND(LOG(3, p_size), 6) AS l3, ROUND(LOG2(p_size), 6) AS l2, ROUND(LOG10(p_size), 6) AS l10, ROUND(EXP(p_size / 50), 6) AS e, ROUND(SIN(p_size), 6) AS si, ROUND(PI(), 6) AS pi, sign(p_retailprice) * floor(abs(p_retailprice) * pow(10, 1)) / pow(10, 1) AS t, GREATEST(p_size, 25) AS g, LEAST(p_size, 25) AS le FROM part"),
    "fn_math_more": ("SELECT MOD(17, 0) AS m0, 1 / 0 AS d0, SIGN(-3) AS s, ROUND(COS(1), 6) AS c, ROUND(TAN(1), 6) AS t, ROUND(-2.5, 0) AS r, ROUND(1234.567, 1) AS r1",
                     "SELECT CAST(NULL AS INT) AS m0, CAST(NULL AS DOUBLE) AS d0, CAST(sign(-3) AS DOUBLE) AS s, ROUND(COS(1), 6) AS c, ROUND(TAN(1), 6) AS t, ROUND(-2.5, 0) AS r, ROUND(1234.567, 1) AS r1"),
    "fn_date_parts": ("SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DAYOFWEEK(o_orderdate) AS dw, DAYOFYEAR(o_orderdate) AS dy, WEEKDAY(o_orderdate) AS wd, HOUR(o_orderdate) AS h, LAST_DAY(o_orderdate) AS ld, DATE_FORMAT(o_orderdate, '%Y/%m-%d') AS f FROM orders",
                      "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dw, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(isodow(o_orderdate) - 1 AS INT) AS wd, CAST(hour(o_orderdate) AS INT) AS h, CAST(last_day(o_orderdate) AS DATE) AS ld, strftime(o_orderdate, '%Y/%m-%d') AS f FROM orders"),
    "fn_date_arith": ("SELECT o_orderkey, DATEDIFF('1999-01-01', o_orderdate) AS days, DATE_ADD(CAST(o_orderdate AS DATE), INTERVAL 1 MONTH) AS later, DATE_SUB(CAST(o_orderdate AS DATE), INTERVAL 2 YEAR) AS earlier, DATE_ADD(CAST(o_orderdate AS DATE), INTERVAL 10 DAY) AS ten, TIMESTAMPDIFF(MONTH, o_orderdate, '1999-01-01') AS months, TIMESTAMPDIFF(YEAR, o_orderdate, '1999-01-01') AS years, UNIX_TIMESTAMP(o_orderdate) AS u FROM orders",
                      "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INT) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 YEAR AS DATE) AS earlier, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS ten, CAST(date_diff('month', o_orderdate, TIMESTAMP '1999-01-01') AS INT) AS months, date_sub('year', o_orderdate, TIMESTAMP '1999-01-01') AS years, CAST(epoch(o_orderdate) AS BIGINT) AS u FROM orders"),
    "fn_null": ("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, IFNULL(NULLIF(n_regionkey, 2), -2) AS i, NULLIF(n_name, 'CHINA') AS n, ISNULL(NULLIF(n_regionkey, 3)) AS z FROM nation",
                "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, COALESCE(NULLIF(n_regionkey, 2), -2) AS i, NULLIF(n_name, 'CHINA') AS n, CAST(NULLIF(n_regionkey, 3) IS NULL AS INT) AS z FROM nation"),
    "fn_cast": ("SELECT CAST('12' AS INT) AS i, CAST('x' AS INT) AS bad, CAST('1.5' AS DOUBLE) AS d, CONVERT('7', SIGNED) AS s, CAST('2024-02-03' AS DATE) AS dt, CAST(12.345 AS DECIMAL(6,2)) AS de, CAST(1 AS BOOLEAN) AS b, CAST(5 AS TEXT) AS t",
                "SELECT TRY_CAST('12' AS INT) AS i, TRY_CAST('x' AS INT) AS bad, CAST('1.5' AS DOUBLE) AS d, CAST('7' AS BIGINT) AS s, CAST('2024-02-03' AS DATE) AS dt, CAST(12.345 AS DECIMAL(6,2)) AS de, CAST(1 AS BOOLEAN) AS b, CAST(5 AS VARCHAR) AS t"),
    "fn_json": ("SELECT event_id, props->>'$.k' AS k, JSON_VALUE(props, '$.k') AS v, props->'$.k' AS raw, JSON_UNQUOTE(JSON_EXTRACT(props, '$.k')) AS u FROM events",
                "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS v, CAST(json_extract(props, '$.k') AS VARCHAR) AS raw, json_extract_string(props, '$.k') AS u FROM events"),
    "fn_json_extract": ("""SELECT JSON_EXTRACT('{"s":"x","a":[1,2],"o":{"p":true}}', '$.s') AS s, JSON_EXTRACT('{"a":[1,2]}', '$.a[1]') AS n, JSON_EXTRACT('{"o":{"p":true}}', '$.o.p') AS b, JSON_EXTRACT('{"o":1}', '$.zz') AS z""",
                        """SELECT CAST(json_extract('{"s":"x","a":[1,2],"o":{"p":true}}', '$.s') AS VARCHAR) AS s, CAST(json_extract('{"a":[1,2]}', '$.a[1]') AS VARCHAR) AS n, CAST(json_extract('{"o":{"p":true}}', '$.o.p') AS VARCHAR) AS b, CAST(json_extract('{"o":1}', '$.zz') AS VARCHAR) AS z"""),
    "fn_hash_hex": ("SELECT n_nationkey, MD5(n_name) AS m, HEX(n_nationkey) AS h, HEX(n_name) AS hn, UNHEX('616263') AS u, CHAR(72, 105) AS c, FORMAT(n_nationkey * 1234.5, 2) AS f FROM nation",
                    "SELECT n_nationkey, md5(n_name) AS m, to_hex(n_nationkey) AS h, hex(n_name) AS hn, 'abc' AS u, 'Hi' AS c, format('{:,.2f}', n_nationkey * 1234.5::DOUBLE) AS f FROM nation"),
    "fn_conditional": ("SELECT o_orderkey, IF(o_totalprice > 200000, 'above', 'below') AS side, GREATEST(1, 5, 3) AS g, LEAST(4, 2, 9) AS l FROM orders",
                       "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'above' ELSE 'below' END AS side, GREATEST(1, 5, 3) AS g, LEAST(4, 2, 9) AS l FROM orders"),
    "fn_time_parts": ("SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, FROM_UNIXTIME(UNIX_TIMESTAMP(ts)) AS u FROM events",
                      "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s, strftime(ts, '%Y-%m-%d %H:%M:%S') AS u FROM events"),
    "fn_session_info": ("SELECT DATABASE() AS d, SCHEMA() AS s, USER() AS u, CURRENT_USER() AS c, SESSION_USER() AS e, SYSTEM_USER() AS y, LENGTH(VERSION()) > 0 AS v",
                        "SELECT 'main' AS d, 'main' AS s, 'root@localhost' AS u, 'root@localhost' AS c, 'root@localhost' AS e, 'root@localhost' AS y, 1 AS v"),
    "fn_clock": ("SELECT LENGTH(CURTIME()) AS n, LENGTH(CURRENT_TIME) AS c, CURRENT_TIMESTAMP <= LOCALTIME AS t, DATEDIFF(CURRENT_DATE, CURDATE()) AS d, FROM_UNIXTIME(86400) AS u", "SELECT 8 AS n, 8 AS c, 1 AS t, 0 AS d, '1970-01-02 00:00:00' AS u"),
    "fn_regexp_substr": ("SELECT c_custkey, REGEXP_SUBSTR(c_name, '[1-9][0-9]*') AS m FROM customer", "SELECT c_custkey, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS m FROM customer"),
    "fn_session": ("SELECT RAND() >= 0 AS r, LENGTH(UUID()) AS n, YEAR(NOW()) > 2000 AS y, DATEDIFF(CURDATE(), CURDATE()) AS d", "SELECT 1 AS r, 36 AS n, 1 AS y, 0 AS d"),
    # analytics shapes
    "revenue_by_year": ("SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY YEAR(o_orderdate)",
                        "SELECT CAST(year(o_orderdate) AS INT) AS y, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"),
    "group_benchmark": ("SELECT l_suppkey, COUNT(*) AS n, SUM(l_quantity) AS s, ROUND(AVG(l_quantity), 4) AS a FROM lineitem GROUP BY l_suppkey", ""),
}


def _plain(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, sf_dir, sql)


def ntile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NTILE over a whole table in one order."""
    return ordered.ntile(query(spark, sf_dir, "SELECT c_custkey, c_acctbal FROM customer"), ["c_acctbal", "c_custkey"], 7).select("c_custkey", "bucket")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {"revenue_by_segment": flagship.run}
    found |= {name: _plain(sql) for name, (sql, _) in QUERIES.items()} | {"win_ntile_global": ntile_global}
    return found | statements.queries()


def oracle_sql() -> dict[str, str]:
    found = {"revenue_by_segment": flagship.SQL}
    found |= {name: twin or sql for name, (sql, twin) in QUERIES.items()}
    found["win_ntile_global"] = "SELECT c_custkey, NTILE(7) OVER (ORDER BY c_acctbal, c_custkey) AS bucket FROM customer"
    return found | statements.oracle_sql()
