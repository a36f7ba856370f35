"""The registered queries: one or more per inventory id, each with its DuckDB twin.

A query is SQL in the dialect, run by an engine over whole tables, or a DataFrame function of ``quern.operators``. Names
begin with the inventory ids that they cover. Sums and means of doubles are rounded, since their order differs, and
integer results are cast alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quern.engine import Engine

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Adds a query function, and its DuckDB text if SQL can express it."""

    def add(fn):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn

    return add


@lru_cache(maxsize=8)
def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine for all queries of a session over one folder; they create nothing in it but views of its tables."""
    return Engine(spark, sf_dir)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Adds a query of the dialect; ``oracle`` is its DuckDB text where that differs."""
    register(name, text if oracle is None else oracle)(lambda spark, sf_dir: engine(spark, sf_dir).sql(text))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quern.plans import frames  # noqa: F401  registers the DataFrame queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quern.plans import frames  # noqa: F401

    return dict(_ORACLE)


# 2.1 scans, 2.2 projection and predicates -------------------------------------------------------------------------

sql("sc1_sc3_scan_columns", "SELECT o_orderkey, o_totalprice FROM orders")
sql("sc2_p15_quoted_names", 'SELECT "r_regionkey" AS "Key", R_NAME AS name FROM "region"')
sql("sc5_pushed_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.03")
sql("p1_p2_star_and_expressions", "SELECT n.*, n_nationkey * 2 + 1 AS odd FROM nation n")
sql("p1_default_names", "SELECT n_name, n_nationkey + 1 FROM nation", "SELECT n_name, n_nationkey + 1 AS col1 FROM nation")
sql("p4_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("p5_p6_p7_filter", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE NOT (l_tax <= 0.02 OR l_quantity <> 7) AND l_returnflag = 'R'")
sql("p8_is_null", "SELECT o_orderkey, c_custkey IS NULL AS lost FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE c_custkey IS NULL OR c_name IS NOT NULL")
sql("p9_in_list", "SELECT p_partkey, p_size NOT IN (1, 2, 3) AS big FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')")
sql("p9_in_list_nulls", "SELECT n_nationkey, n_nationkey IN (1, NULL) AS maybe FROM nation")
sql("p10_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_retailprice NOT BETWEEN 950 AND 1000")
sql("p11_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_name NOT LIKE 'red%' AND p_brand LIKE 'Brand#_'")
sql("p11_like_backslash", r"SELECT r_name, 'a\b' LIKE 'a\_' AS hit, 'a\b' LIKE '_\b' AS hit2 FROM region")
sql("p12_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
sql("p13_cast", "SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t, o_orderkey::INT AS i, CAST(CAST(o_orderdate AS DATE) AS TEXT) AS d, o_custkey::DOUBLE / 2 AS half FROM orders")
sql("p14_literals", "SELECT r_regionkey, 'it''s' AS s, 1.5e0 AS f, 42 AS i, TRUE AS t, FALSE AS n, NULL::INT AS z FROM region -- a comment\n /* another */")
sql("p16_no_from", "SELECT 1 AS one, 'x' AS x")

# 2.3 joins --------------------------------------------------------------------------------------------------------

sql("j1_inner_keys", "SELECT o_orderkey, c_name, n_name FROM orders INNER JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
sql("j2_inner_residual", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate AND l_quantity > 40")
sql("j3_left", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey")
sql("j4_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
sql("j5_full", "SELECT s_suppkey, p_partkey FROM supplier FULL OUTER JOIN part ON s_suppkey = p_size + 40")
sql("j6_left_pushed_filter", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
sql("j7_left_cross_residual", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > n_regionkey * 2000")
sql("j8_left_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
sql("j9_left_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("j10_semi_residual", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
sql("j11_right_semi", "SELECT r_name FROM nation RIGHT SEMI JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 20", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20)")
sql("j12_right_anti", "SELECT r_name FROM nation RIGHT ANTI JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 22", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 22)")
sql("j13_cross", "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
sql("j13_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql("j14_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
sql("j15_scalar_side", "SELECT p_partkey, round(p_retailprice - m, 4) AS above FROM part, (SELECT avg(p_retailprice) AS m FROM part) t")
sql("j16_using", "SELECT n_regionkey, count(*) AS n FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey) GROUP BY n_regionkey")
sql("j17_nested_tree", "SELECT n_name, r_name, s_name FROM supplier JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey")
sql("j18_self_join", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql("j19_subquery_in_on", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 20)")

# 2.4 subqueries and CTEs ------------------------------------------------------------------------------------------

sql("q1_q3_cte", "WITH big (k, total) AS (SELECT l_orderkey, sum(l_quantity) FROM lineitem GROUP BY l_orderkey), most AS (SELECT max(total) AS m FROM big) SELECT k, total FROM big, most WHERE total >= m * 0.9")
sql("q2_recursive", "WITH RECURSIVE up (i, total) AS (SELECT 1, 1 UNION ALL SELECT i + 1, total + i + 1 FROM up WHERE i < 20) SELECT i, total FROM up")
sql("q4_derived_renames", "SELECT d.a, d.b FROM (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) AS d (a, b)")
sql("q5_exists_not_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9990)")
sql("q6_exists_having", "SELECT n_name FROM nation WHERE EXISTS (SELECT s_nationkey FROM supplier WHERE s_nationkey = n_nationkey GROUP BY s_nationkey HAVING count(*) > 3)")
sql("q7_exists_or_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
sql("q8_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AND p_size NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("q8_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)")
sql("q9_mark_join", "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN 'rich' ELSE 'poor' END AS kind FROM nation WHERE n_regionkey = 0 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
sql("q10_correlated_in", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey > n_nationkey * 4)")
sql("q11_scalar", "SELECT o_orderkey, (SELECT count(*) FROM region) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
sql("q11_scalar_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT 1.5 * count(*) / count(DISTINCT o_custkey) FROM orders)")
sql("q12_correlated_scalar", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity < (SELECT 0.3 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
sql("q13_non_equality", "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey > n.n_nationkey AND s.s_acctbal < 0)")
sql("q14_correlated_count", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7000) AS n FROM nation")

# 2.5 aggregation --------------------------------------------------------------------------------------------------

sql("a1_count", "SELECT count(*) AS n, count(c) AS k FROM (SELECT nullif(o_orderstatus, 'P') AS c FROM orders) t")
sql("a2_a3_a4_sum_avg_min_max", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_linestatus) AS hi, CAST(max(l_linenumber) AS BIGINT) AS m FROM lineitem GROUP BY l_returnflag")
sql("a5_stddev", "SELECT o_orderpriority, round(stddev_samp(o_totalprice), 3) AS sd, round(stddev_samp(o_custkey), 6) AS sk FROM orders GROUP BY o_orderpriority")
sql("a6_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
sql("a7_distinct_mixed", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, round(sum(l_tax), 4) AS t, count(*) AS k FROM lineitem GROUP BY l_returnflag")
sql("a8_distinct_more", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 6) AS a, count(DISTINCT p_brand) AS b, count(DISTINCT p_size + 1) AS c FROM part")
sql("a9_group_by_alias", "SELECT EXTRACT(YEAR FROM o_orderdate) * 1 AS y, count(*) AS n FROM orders GROUP BY y", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY y")
sql("a10_constant_key", "SELECT 'x' AS k, n_regionkey, count(*) AS n FROM nation GROUP BY k, n_regionkey")
sql("a11_global", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem")
sql("a11_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
sql("a12_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 5 AND avg(l_quantity) > 25")
sql("a13_a18_rollup", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, CAST(grouping(l_linestatus) AS BIGINT) AS h, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("a14_cube", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
sql("a15_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
sql("a16_several_groupings", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey), CUBE (n_nationkey)")
sql("a17_duplicate_sets", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (n_regionkey), ())")
sql("a19_sets_distinct", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("a20_high_cardinality", "SELECT l_orderkey, l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_orderkey, l_partkey")
sql("a9_null_keys", "SELECT k, count(*) AS n FROM (SELECT nullif(n_regionkey, 2) AS k FROM nation) t GROUP BY k")

# 2.6 windows ------------------------------------------------------------------------------------------------------

sql("w1_w6_w7_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders")
sql("w2_w4_partition_sum_avg", "SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS s, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS a FROM supplier")
sql("w3_w8_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
sql("w5_running_max", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders")
sql("w9_w10_range_peers", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) AS BIGINT) AS s FROM lineitem")
sql("w11_w12_frames", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS BIGINT) AS c, min(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders")
sql("w13_ordered_avg", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 7) AS a, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders")
sql("w14_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders")
sql("w15_more_functions", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, lead(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, CAST(ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS t FROM orders")
sql("w_over_aggregate", "SELECT n_regionkey, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
sql("w18_order_by_window", "SELECT s_suppkey, CAST(rank() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS r FROM supplier ORDER BY r LIMIT 10")

# 2.7 sort, limit, top-k -------------------------------------------------------------------------------------------

sql("o1_order", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
sql("o2_o3_null_order", "SELECT k, n FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS n FROM nation) t ORDER BY k DESC, n LIMIT 7", "SELECT k, n FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS n FROM nation) t ORDER BY k DESC NULLS FIRST, n LIMIT 7")
sql("o3_null_order_asc", "SELECT k, n FROM (SELECT nullif(n_regionkey, 0) AS k, n_nationkey AS n FROM nation) t ORDER BY k, n LIMIT 7", "SELECT k, n FROM (SELECT nullif(n_regionkey, 0) AS k, n_nationkey AS n FROM nation) t ORDER BY k ASC NULLS LAST, n LIMIT 7")
sql("o4_order_by_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 12")
sql("o5_o6_order_by_aggregate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, sum(o_totalprice) DESC, o_custkey LIMIT 10")
sql("o8_limit_offset", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 15")
sql("o9_offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
sql("o10_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")

# 2.8 set operations -----------------------------------------------------------------------------------------------

sql("u1_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT s_nationkey FROM supplier")
sql("u2_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
sql("u3_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
sql("u3_intersect_null", "SELECT nullif(n_regionkey, 2) AS k FROM nation INTERSECT SELECT nullif(r_regionkey, 2) FROM region")
sql("u4_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("u5_all_forms", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey FROM supplier UNION ALL (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region)")
sql("u6_precedence", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
sql("u7_coercion", "SELECT CAST(k AS DOUBLE) AS k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_acctbal FROM supplier) t")

# 2.10 scalar functions --------------------------------------------------------------------------------------------

sql("f1_f4_arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber * 3 - 7 AS a, -l_linenumber AS b, +l_linenumber AS c, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS d FROM lineitem")
sql("f2_f3_divide_modulo", "SELECT o_orderkey, o_custkey / 7 AS q, o_custkey % 7 AS m, (0 - o_custkey) % 7 AS neg FROM orders")
sql("f5_f6_f7_abs_round_sqrt", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, round(c_acctbal) AS z, round(sqrt(abs(c_acctbal)), 8) AS q FROM customer")
sql("f8_concat", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS TEXT) AS s, n_name || NULL AS z FROM nation")
sql("f10_f11_substring", "SELECT p_partkey, substring(p_name FROM 2 FOR 3) AS a, substr(p_name, 0, 4) AS b, substr(p_name, -3, 2) AS c, substring(p_name, 5) AS d FROM part", "SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, 1, 4) AS b, substr(p_name, 1, 2) AS c, substr(p_name, 5) AS d FROM part")
sql("f12_strlen", "SELECT doc_id, strlen(text) AS n FROM documents")
sql("f13_regexp_replace", r"SELECT page_id, regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS host, regexp_replace(url, 'h', '<\&>') AS one, regexp_replace(url, '([a-z]+)\.(com|net|org)', '\2$\1') AS two FROM pages", r"SELECT page_id, regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS host, regexp_replace(url, 'h', '<\0>') AS one, regexp_replace(url, '([a-z]+)\.(com|net|org)', '\2$\1') AS two FROM pages")
sql("f14_compare_strings", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_name < b.n_name")
sql("f15_f16_dates", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= '1997-01-01' AND CAST(o_orderdate AS DATE) < DATE '1997-03-01'")
sql("f17_f18_intervals", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS TEXT) AS p, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL '3' month AS DATE) AS TEXT) AS m, CAST(CAST(CAST(o_orderdate AS DATE) + 60 days AS DATE) AS TEXT) AS d FROM orders", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS TEXT) AS p, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL '3' month AS DATE) AS TEXT) AS m, CAST(CAST(CAST(o_orderdate AS DATE) + 60 AS DATE) AS TEXT) AS d FROM orders")
sql("f19_extract_year", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y FROM orders")
sql("f20_casts", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(CAST(o_orderdate AS DATE) AS TEXT) AS d, CAST(CAST(o_custkey AS TEXT) AS BIGINT) AS k FROM orders")
sql("f21_f22_coalesce", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), n_nationkey + 100) AS c, ifnull(nullif(n_regionkey, 2), -1) AS i FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), n_nationkey + 100) AS c, ifnull(nullif(n_regionkey, 2), -1) AS i FROM nation")
sql("f23_upper", "SELECT p_partkey, upper(p_name) AS u FROM part")

# benchmark-shaped queries over the columns at hand ----------------------------------------------------------------

Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= timestamp '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
sql("tpch_q1", Q1)
sql(
    "tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < timestamp '1998-03-15 00:00:00' AND l_shipdate > timestamp '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
sql(
    "tpch_q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""",
)
sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= timestamp '1997-01-01 00:00:00' AND l_shipdate < timestamp '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql(
    "tpch_q9",
    """SELECT nation, o_year, round(sum(amount), 4) AS sum_profit FROM (SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS amount
FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%') AS profit
GROUP BY nation, o_year""",
)
sql(
    "tpch_q10",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders GROUP BY c_count")
sql("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= timestamp '1997-09-01 00:00:00'", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= timestamp '1997-09-01 00:00:00'")
sql(
    "tpch_q15",
    """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
)
sql("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
sql("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice")
sql("tpch_q19", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)")
sql("tpch_q22", "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_nationkey")
sql("clicks_by_type", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events WHERE event_type <> '' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
sql("clicks_top_users", "SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10")
sql("ds_year_share", "SELECT n_name, y, rev, round(rev / sum(rev) OVER (PARTITION BY n_name), 8) AS share FROM (SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum(o_totalprice), 2) AS rev FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name, y) t", "SELECT n_name, y, rev, round(rev / sum(rev) OVER (PARTITION BY n_name), 8) AS share FROM (SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum(o_totalprice), 2) AS rev FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name, y) t")

# more of the dialect ------------------------------------------------------------------------------------------------

sql(
    "f9_string_plus",
    "SELECT n_nationkey, n_name + '-' + CAST(n_regionkey AS TEXT) AS s, 'x' + n_name AS t, n_name + r_name AS u, n_nationkey + 1 AS v FROM nation JOIN region ON n_regionkey = r_regionkey",
    "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS TEXT) AS s, 'x' || n_name AS t, n_name || r_name AS u, n_nationkey + 1 AS v FROM nation JOIN region ON n_regionkey = r_regionkey",
)
sql("p11_like_computed", r"SELECT p_partkey, 'a\b' LIKE concat('a\', '_') AS hit, p_name LIKE '%' || substr(p_type, 1, 1) || '%' AS has, p_brand LIKE p_brand AS own, '~^!#@|\x' LIKE '~^!#@|\_' AS signs FROM part")
sql("p14_file_like_texts", "SELECT n_nationkey FROM nation WHERE n_name IN ('a', 'b.parquet', 'NATION_3') OR n_name = 'c.parquet'")
sql("o7_order_by_place", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey ORDER BY 2 DESC, 1 LIMIT 3")
sql("w15_named_window", "SELECT n_nationkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(sum(n_nationkey) OVER w AS BIGINT) AS s FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
sql("f22_nvl", "SELECT n_nationkey, nvl(nullif(n_regionkey, 1), 9) AS a FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), 9) AS a FROM nation")
sql("a10_group_by_text_and_place", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 'x', 1")

# decimals: results are cast, since engines differ in how many digits they keep
_PRICES = "(SELECT l_orderkey, l_suppkey, l_returnflag, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS off FROM lineitem) t"
sql("a2_a3_a4_decimal", f"SELECT l_returnflag, CAST(sum(price) AS DECIMAL(22,2))::DOUBLE AS s, abs(CAST(avg(price) AS DOUBLE) - CAST(sum(price) AS DOUBLE) / count(price)) < 0.001 AS m, CAST(min(price) AS DOUBLE) AS lo, CAST(max(price) AS DOUBLE) AS hi, count(DISTINCT off) AS d FROM {_PRICES} GROUP BY l_returnflag")
sql("f1_f3_decimal", f"SELECT l_orderkey, l_linenumber, CAST(price * (1 - off) AS DOUBLE) AS net, CAST(price - off AS DOUBLE) AS less, CAST(-price AS DOUBLE) AS neg, CAST(price % CAST(7.5 AS DECIMAL(4,2)) AS DOUBLE) AS m, round(CAST(price AS DOUBLE) / 3, 6) AS third FROM {_PRICES}")
sql("w2_w3_w4_decimal", f"SELECT l_orderkey, l_linenumber, CAST(sum(price) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS DOUBLE) AS run, CAST(max(price) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS top, abs(CAST(avg(price) OVER (PARTITION BY l_orderkey) AS DOUBLE) - CAST(sum(price) OVER (PARTITION BY l_orderkey) AS DOUBLE) / count(*) OVER (PARTITION BY l_orderkey)) < 0.001 AS m FROM {_PRICES}")
sql("u7_decimal_coercion", "SELECT CAST(x AS DOUBLE) AS x FROM (SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS x FROM orders UNION ALL SELECT o_custkey FROM orders UNION ALL SELECT CAST(0.125 AS DECIMAL(6,3))) t")
sql("j1_p6_decimal_keys", f"SELECT t.l_orderkey, CAST(price AS DOUBLE) AS p FROM {_PRICES} JOIN (SELECT CAST(max(l_extendedprice) AS DECIMAL(14,4)) AS top FROM lineitem) m ON price = top OR price > 90000.5 AND off IN (0.01, 0.02) AND price BETWEEN 90000 AND 95000.25")
sql("p13_decimal_casts", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS TEXT) AS t, CAST(CAST('12.345' AS DECIMAL(8,2)) AS DOUBLE) AS d, CAST(CAST(o_custkey AS DECIMAL(10,1)) AS BIGINT) AS i FROM orders")

# rewrites on any query
sql("r17_affine_sql", "SELECT l_returnflag, " + ", ".join(f"CAST(sum(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(30)) + ", CAST(sum(3 * l_linenumber) AS BIGINT) AS t, CAST(sum(7 - l_linenumber) AS BIGINT) AS u FROM lineitem GROUP BY l_returnflag")
sql("r18_narrow_sql", "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, 2 * user_id AS c, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2, 2 * user_id")
sql("q8_not_in_large", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderstatus = 'F'")
sql("q8_not_in_with_nulls", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 1) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey = 2) AND n_regionkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey > 3) AND n_nationkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 90)")

# the rest of the benchmark's shapes; what the tables lack is made from what they have
_PARTSUPP = "partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, count(*) AS ps_availqty, min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"
sql(
    "tpch_q2",
    f"""WITH {_PARTSUPP} SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 25 AND p_type LIKE '%O%' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
AND ps_supplycost = (SELECT min(ps_supplycost) FROM partsupp, supplier, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE') ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
sql("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= timestamp '1997-07-01 00:00:00' AND o_orderdate < timestamp '1997-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority")
sql(
    "tpch_q7",
    """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
AND ((n1.n_regionkey = 1 AND n2.n_regionkey = 2) OR (n1.n_regionkey = 2 AND n2.n_regionkey = 1))) AS shipping GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
)
sql(
    "tpch_q8",
    """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type LIKE '%O%') AS all_nations GROUP BY o_year ORDER BY o_year""",
)
sql(
    "tpch_q11",
    f"""WITH {_PARTSUPP} SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS value FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2
GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2) ORDER BY value DESC, ps_partkey""",
)
sql("tpch_q12", "SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= timestamp '1997-01-01 00:00:00' GROUP BY l_returnflag ORDER BY l_returnflag")
sql(
    "tpch_q16",
    f"""WITH {_PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#3' AND p_type NOT LIKE 'PROMO%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
)
sql(
    "tpch_q20",
    f"""WITH {_PARTSUPP} SELECT s_name, s_nationkey FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'r%')
AND ps_availqty < (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= timestamp '1997-01-01 00:00:00')) AND s_nationkey = n_nationkey AND n_regionkey < 3 ORDER BY s_name""",
)
sql(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate)
AND s_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
