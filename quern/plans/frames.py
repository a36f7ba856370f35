"""Registered queries that use the DataFrame operators, rewrites and user-defined functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import scalar
from quern.operators import relational as R
from quern.plans import rewrites
from quern.plans.suite import register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("df_j1_salted_join", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def salted(spark, sf_dir):
    left = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    right = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return R.salted_join(left, right, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@register("df_j11_right_semi", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)")
def right_semi(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").filter("n_nationkey < 3")
    return R.join(nation, read(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")], "right_semi")


@register("df_j15_checked_broadcast", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def broadcast(spark, sf_dir):
    customer = R.checked_broadcast(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    return read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@register("df_j_null_safe", "SELECT a.k AS x, b.k AS y FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def null_safe(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select(F.nullif("n_regionkey", F.lit(1)).alias("x"))
    b = read(spark, sf_dir, "region").select(F.nullif("r_regionkey", F.lit(1)).alias("y"))
    return R.join(a, b, [("x", "y")], null_safe=True)


@register("df_a15_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus))")
def sets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return R.grouping_sets(orders, [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus"]], n=F.count(F.lit(1)), s=F.round(F.sum("o_totalprice"), 2))


@register("df_w3_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS s, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS r FROM orders")
def running(spark, sf_dir):
    window = R.running(["o_custkey"], [F.asc_nulls_last("o_orderdate")])
    rank = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("o_orderdate"))).cast("bigint")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(window), 2).alias("s"), rank.alias("r"))


@register("df_o10_top", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 9 OFFSET 3")
def top(spark, sf_dir):
    return R.top(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 9, "-c_acctbal", "c_custkey", offset=3)


@register("df_u_sets", "SELECT k FROM ((SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier) t")
def set_operations(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"))
    rest = R.set_operation("except", nation, read(spark, sf_dir, "region").select("r_regionkey"), keep_all=True)
    return R.set_operation("intersect", rest, read(spark, sf_dir, "supplier").select("s_nationkey"))


@register("df_f_functions", r"SELECT page_id, strlen(html) AS n, substr(url, 1, 7) AS p, regexp_replace(url, '/+', '|') AS u FROM pages")
def functions(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    url = F.col("url")
    return pages.select("page_id", scalar.strlen(F.col("html")).alias("n"), scalar.substr(url, -1, 7).alias("p"), scalar.replace_first(url, "/+", "|").alias("u"))


@register("r17_affine_sums", "SELECT l_returnflag, " + ", ".join(f"CAST(sum(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(30)) + " FROM lineitem GROUP BY l_returnflag")
def affine(spark, sf_dir):
    return rewrites.affine_sums(read(spark, sf_dir, "lineitem"), ["l_returnflag"], {f"s{k}": (1, "l_linenumber", k) for k in range(30)})


@register("r18_narrow_keys", "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, 2 * user_id AS c, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2, 2 * user_id")
def narrow(spark, sf_dir):
    return rewrites.narrowed_groups(read(spark, sf_dir, "events"), "user_id", {"a": (1, -1), "b": (1, -2), "c": (2, 0)}, n=F.count(F.lit(1)))


@register("r21_shared_cte", "WITH t AS (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) SELECT k, q FROM t WHERE q = (SELECT max(q) FROM t) OR q = (SELECT min(q) FROM t)")
def shared(spark, sf_dir):
    totals = rewrites.shared(read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q")), uses=2)
    ends = totals.agg(F.max("q").alias("hi"), F.min("q").alias("lo"))
    return totals.join(F.broadcast(ends), (F.col("q") == F.col("hi")) | (F.col("q") == F.col("lo"))).select("k", "q")


@register("r9_join_order", "SELECT n_name, r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def ordered_joins(spark, sf_dir):
    tables = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    return rewrites.join_in_order(tables, links).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@register("sc6_statistics", "SELECT 'n_nationkey' AS \"column\", count(*) AS n_rows, count(*) - count(n_nationkey) AS n_nulls, CAST(min(n_nationkey) AS TEXT) AS least, CAST(max(n_nationkey) AS TEXT) AS most FROM nation UNION ALL SELECT 'n_name', count(*), count(*) - count(n_name), min(n_name), max(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(*) - count(n_regionkey), CAST(min(n_regionkey) AS TEXT), CAST(max(n_regionkey) AS TEXT) FROM nation")
def statistics(spark, sf_dir):
    return Engine(spark, sf_dir).catalog.statistics("nation").drop("n_distinct")


@register("sc11_describe", "SELECT 'r_regionkey' AS name, 'int' AS kind UNION ALL SELECT 'r_name', 'string'")
def describe(spark, sf_dir):
    return spark.createDataFrame(Engine(spark, sf_dir).catalog.describe("region"), "name string, kind string")


@register("sc12_explain", "SELECT true AS pushed, true AS pruned, false AS broadcast")
def explain(spark, sf_dir):
    """What the text of plans says: a pushed filter, the columns read, and that NOT IN broadcasts no subquery unseen."""
    engine = Engine(spark, sf_dir)
    (row,) = engine.sql("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 20").collect()
    anti = engine.explain("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
    found = ("GreaterThan(n_nationkey,20)" in row[0], "ReadSchema: struct<n_nationkey:int,n_name:string>" in row[0], "NAAJ" in anti or "isNullAware" in anti or "null-aware" in anti.lower())
    return spark.createDataFrame([found], "pushed boolean, pruned boolean, broadcast boolean")


MODULE = """
CREATE MODULE shapes LANGUAGE python AS $$
def boxed(w, h):
    return w * h, 2 * (w + h)

def tag_int(x):
    return f"i{x}"

def tag_text(x):
    return "t" + x

def tag_two(x, y):
    return f"{x}-{y}"
$$;
CREATE FUNCTION boxed(DOUBLE, DOUBLE) RETURNS (DOUBLE, DOUBLE) SET MODULE TO shapes;
CREATE FUNCTION tag(BIGINT) RETURNS TEXT SET MODULE TO shapes SET SYMBOL TO tag_int;
CREATE FUNCTION tag(TEXT) RETURNS TEXT SET MODULE TO shapes SET SYMBOL TO tag_text;
CREATE FUNCTION tag(BIGINT, TEXT) RETURNS TEXT SET MODULE TO shapes SET SYMBOL TO tag_two;
"""


@register("x1_x5_functions", "SELECT s_suppkey, 'i' || s_suppkey AS a, 't' || s_name AS b, s_suppkey || '-' || s_name AS c, CASE WHEN s_suppkey <> 3 THEN 'i' || s_suppkey END AS d FROM supplier WHERE 'i' || s_nationkey <> 'i4'")
def user_functions(spark, sf_dir):
    text = "SELECT s_suppkey, tag(s_suppkey) AS a, tag(s_name) AS b, tag(s_suppkey, s_name) AS c, tag(nullif(s_suppkey, 3)) AS d FROM supplier WHERE tag(CAST(s_nationkey AS BIGINT)) <> 'i4'"
    return Engine(spark, sf_dir).sql(MODULE + text)


@register("x4_p3_struct_columns", "SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS area, 2 * (l_quantity + l_tax) AS edge FROM lineitem")
def struct_columns(spark, sf_dir):
    return Engine(spark, sf_dir).sql(MODULE + "SELECT l_orderkey, l_linenumber, boxed(l_quantity, l_tax) AS (area, edge) FROM lineitem")


@register(
    "sexpr_top_join",
    "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY n_name ORDER BY n DESC, n_name LIMIT 7",
)
def sexpr_top_join(spark, sf_dir):
    text = """(rel project (rel top-sort (rel aggregate (rel join (rel join
        (rel filter (rel source "orders") (: (> o_totalprice (: 1000.0 f64)) u8))
        (rel source "customer") ((o_custkey c_custkey)) (inner))
        (rel source "nation" "n1") ((c_nationkey n_nationkey)) (inner))
        (keys n_name) (agg n count) (agg total sum o_totalprice))
        (n desc nulls-default) (n_name asc nulls-default) (limit 7))
        (n_name n_name) (n n) (total (call round total 2)))"""
    return Engine(spark, sf_dir).sexpr(text)


@register("sexpr_window_union", "SELECT k, CAST(rank() OVER (PARTITION BY p ORDER BY k DESC) AS BIGINT) AS r, CAST(sum(k) OVER (PARTITION BY p ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (SELECT n_nationkey AS k, n_regionkey AS p FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_nationkey) UNION ALL SELECT s_suppkey + 100, s_nationkey FROM supplier) t")
def sexpr_window_union(spark, sf_dir):
    text = """(query (cte 0 (rel union-all
        (rel project (rel join (rel source "nation") (rel source "region") ((n_nationkey r_regionkey)) (left_anti)) (k (cast n_nationkey i64)) (p n_regionkey))
        (rel project (rel source "supplier") (k (+ s_suppkey 100)) (p s_nationkey))))
      (main (rel project (rel window (rel window (rel cte-ref 0) (partition p) (order (k desc nulls-default)) (fn r rank))
        (partition p) (order (k asc nulls-default)) (frame rows (start unbounded-preceding) (end current-row)) (fn s sum k)) (k k) (r r) (s s))))"""
    return Engine(spark, sf_dir).sexpr(text)
