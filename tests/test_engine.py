"""The dialect, catalog, modules, sinks, rewrites and command line; small fixtures with known rows."""

import io
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern import cli
from quern.engine import Engine
from quern.operators import relational as R
from quern.plans import join_order, rewrites, suite
from quern.plans.dialect import dialect, rewrite
from quern.plans.tokens import DialectError, from_items, statements, text_of, tokenize
from quern.sources import sinks

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SMALL)


def view(engine, name, shape, rows):
    engine.spark.createDataFrame(rows, shape).createOrReplaceTempView(name)


def got(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select a from t order by a", "select a from t order by a NULLS LAST"),
        ("select a from t order by a desc, b limit 3", "select a from t order by a desc NULLS FIRST, b NULLS LAST limit 3"),
        ("select a from t order by a desc nulls last", "select a from t order by a desc nulls last"),
        ("select sum(x) over (partition by y order by z) s from t", "select sum(x) over (partition by y order by z NULLS LAST) s from t"),
        ("select a + 1, b, t.*, count(*) n, 'x' as s, 2 from t", "select a + 1 AS col0, b, t.*, count(*) n, 'x' as s, 2 AS col5 from t"),
        ("select substr(a, 0, 2) x, 'it''s' y from t", "select substring(a, greatest(0, 1), greatest(2, 0)) x, 'it\\'s' y from t"),
        ("select distinct(a), (t.b), (a + 1), (select 1 as x) from t order by a", "select distinct(a), (t.b), (a + 1) AS col2, (select 1 as x) AS col3 from t order by a NULLS LAST"),
        ("select x::text as y, cast(z as float) as w from t", "select x::STRING as y, cast(z as DOUBLE) as w from t"),
        ("select d + 60 days as x from t where a like 'b%'", "select d + INTERVAL '60' days as x from t where a like 'b%'"),
        ("select a from x right semi join y on k = l", "select a from y LEFT semi join x on k = l"),
        ("select a -- order by\n from 'f/x.parquet' /* order by a */", "select a\nfrom parquet.`f/x.parquet`"),
    ],
)
def test_rewrites(text, want):
    assert " ".join(dialect(text).split()) == " ".join(want.split())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"select a like 'x\_' as p, a like b || '\' as q, a not like c escape '!' as r from t", r"select a like 'x\\\\_' as p, a like replace(b || '\\', '\\', '\\\\') as q, a not like c escape '!' as r from t"),
        ("select 1 as x from a.b, c where d in ('e', 'f.parquet')", "select 1 as x from `a.b`, c where d in ('e', 'f.parquet')"),
        ("select extract(year from d) as y, substring(s from 2 for 3) as z from t", "select extract(year from d) as y, substring(s, greatest(2, 1), greatest(3, 0)) as z from t"),
        ("select 'a' + b as x, c + 1 as y, date '2020-01-01' + 3 as z from t", "select 'a' || b as x, c + 1 as y, date '2020-01-01' + 3 as z from t"),
        ("select sum(i + 2) as s, sum(3 * t.i) as u, sum(d + 1) as v, sum(distinct i + 1) as w from t group by i, i - 1, 2 * i, d + 1", "select (sum(CAST(i AS BIGINT)) + 2 * count(i)) as s, (3 * sum(CAST(t.i AS BIGINT))) as u, sum(d + 1) as v, sum(distinct i + 1) as w from t group by i, d + 1"),
    ],
)
def test_rewrites_by_types(text, want):
    assert " ".join(rewrite(tokenize(text), {}, {"i": "int", "d": "double"}).split()) == " ".join(want.split())


def test_table_names_in_from():
    items = lambda text: [text_of(tokens[a:b]) for tokens in [tokenize(text)] for a, b in from_items(tokens)]
    assert items("select a, b from x, y z join w on f(a, b) = 1, (select c, d from v) q where e in (1, 2) and g is distinct from h") == ["x", "y", "w", "v"]
    assert items("with t(a) as (select 1) select extract(day from a), trim(both from b) from t left join (m.n cross join o) using (k) union select c from p order by q, r") == ["t", "m.n", "o", "p"]
    assert items("select a from range(3) r, lateral (select 1) l, \"Q\"") == ['"Q"']


def test_renamed_columns_keep_their_types(engine):
    view(engine, "prices", "o_custkey double", [(1.5,), (2.5,)])
    assert got(engine, "select sum(o_custkey + 1) as s from (select o_totalprice * 0 + 0.5 as o_custkey from orders where o_orderkey < 5) t") == got(engine, "select sum(x + 1) as s from (select o_totalprice * 0 + 0.5 as x from orders where o_orderkey < 5) t")
    assert got(engine, "with c(o_custkey) as (select 0.25e0 from orders where o_orderkey = 1) select sum(o_custkey + 1) as s from c") == [(1.25,)]


def test_dotted_names_are_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.nation.parquet"))
    found = Engine(spark, str(tmp_path))
    assert [tuple(r) for r in found.sql('select sum(id) as s from a.nation union all select max(x.id) from a."nation" x').collect()] == [(3,), (2,)]


def test_not_in_as_an_anti_join(engine):
    view(engine, "n1", "a int, b int", [(1, 1), (2, 2), (None, 3)])
    view(engine, "n2", "c int", [(2,), (3,)])
    view(engine, "n3", "c int", [(2,), (None,)])
    view(engine, "n4", "c int", [])
    for table, want in (("n2", [(1,)]), ("n3", []), ("n4", [(1,), (2,), (3,)])):
        for text in (f"select b from n1 where a not in (select c from {table})", f"select b from n1 x where b > 0 and x.a not in (select c from {table} where c is null or c > 0) and b < 9"):
            assert sorted(got(engine, text)) == want
        assert "NAAJ" not in engine.explain(f"select b from n1 where a not in (select c from {table})")
    assert sorted(got(engine, "select b from n1 where a not in (select c from n2) or b = 3")) == [(1,), (3,)]


def test_small_tables_come_first(engine):
    engine.sql("select 1 as x from nation, region")
    text = rewrite(tokenize("select l_orderkey from lineitem l, orders, region where l_orderkey = o_orderkey"), {}, {}, {"lineitem": 3, "orders": 2, "region": 1}.get)
    assert text == "select l_orderkey from region, orders, lineitem l where l_orderkey = o_orderkey"
    for kept in ("select * from lineitem, region", "select l.* from lineitem l, region", "select 1 as x from lineitem, (select 2 as y) t", "select count(*) as n from lineitem, unknown"):
        assert rewrite(tokenize(kept), {}, {}, {"lineitem": 3, "region": 1}.get) == kept


def joined(spark, name):
    """First letters of the columns of the tables of a registered query, in the order in which it joins them."""
    df = suite.queries()[name](spark, "/root/testdata/sf0.1")
    return re.findall(r"Relation \[(\w)_", df._jdf.queryExecution().optimizedPlan().toString())


def test_tpch_q7_does_not_multiply_suppliers_by_customers(spark):
    order = joined(spark, "tpch_q7")
    assert sorted(order) == ["c", "l", "n", "n", "o", "s"]
    assert order.index("l") < max(order.index("s"), order.index("c"))


def test_tpch_q5_does_not_multiply_suppliers_by_customers(spark):
    order = joined(spark, "tpch_q5")
    assert sorted(order) == ["c", "l", "n", "o", "r", "s"]
    assert order.index("l") < max(order.index("s"), order.index("c"))
    assert order[:3] == ["r", "n", "s"]  # the region's filter comes early


def test_join_order_by_estimated_rows():
    given = join_order.Conditions([((0, "g"), (1, "g")), ((0, "k"), (2, "a")), ((1, "k"), (2, "b"))], [])
    counts = [(1000, {"k": 1000, "g": 2}), (1000, {"k": 1000, "g": 2}), (5000, {"a": 1000, "b": 1000})]
    assert join_order.order([1, 2, 3], given, counts) == [0, 2, 1]
    assert join_order.order([1, 2, 3], given, [(1000, {"k": 1000, "g": 1000}), (1000, {"k": 1000, "g": 1000}), (5000, {"a": 1000, "b": 1000})]) == [0, 1, 2]
    chain = join_order.Conditions([((k, "x"), (k + 1, "y")) for k in range(13)], [(frozenset((12,)), 0.001)])
    assert sorted(join_order.order([9] * 14, chain, [(100, {"x": 10, "y": 100})] * 14)) == list(range(14))


def test_conditions_of_a_join():
    text = "(a.k = b.k AND (x BETWEEN 1 AND 2)) AND \"Z\" = 'AND' AND (a.k = 1 OR b.k = 2) AND CASE WHEN x = 1 AND y = 2 THEN y = 3 ELSE y = z END AND y = z + 1 AND k IN (SELECT k FROM b WHERE x = y) AND x = q"
    found = join_order.conditions(tokenize(text), ["a", "b"], [["k", "x", "z"], ["k", "y"]])
    assert found.equal == [((0, "k"), (1, "k"))]
    assert [sorted(tables) for tables, _ in found.other] == [[0], [0], [0, 1], [0, 1], [0, 1], [0]]
    assert [share == 0.1 for _, share in found.other] == [False, True, False, False, False, True]
    whole = join_order.conditions(tokenize("a.k = b.k AND x = 1 OR y = 2"), ["a", "b"], [["k", "x", "z"], ["k", "y"]])
    assert (whole.equal, [sorted(tables) for tables, _ in whole.other]) == ([], [[0, 1]])


def test_counts_of_tables(spark, tmp_path):
    spark.sql("SELECT id AS k, CAST(if(id % 2 = 0, id % 5, NULL) AS INT) AS G, CAST(id % 7 AS STRING) AS t, CAST(NULL AS INT) AS n FROM range(1000)").write.parquet(str(tmp_path / "some.parquet"))
    spark.sql("SELECT id AS a FROM range(0)").write.parquet(str(tmp_path / "none.parquet"))
    spark.sql("SELECT id AS b FROM range(9)").write.option("parquet.column.statistics.enabled", "false").parquet(str(tmp_path / "plain.parquet"))
    engine = Engine(spark, str(tmp_path))
    engine.sql("SELECT 1 AS x FROM some, none, plain")
    counts = engine.catalog.counts
    assert counts({"some": {"k", "g"}, "none": {"a"}}) == {"some": (1000, {"k": 1000, "g": 5}), "none": (0, {})}
    assert counts({"some": {"t"}})["some"][1]["t"] == 7
    assert counts({"some": {"n"}, "plain": {"b"}}) == {"some": (1000, {"k": 1000, "g": 5, "t": 7}), "plain": (9, {"b": 9})}
    assert got(engine, "SELECT count(k) FROM some, none, plain WHERE k = a AND b = k") == [(0,)]
    assert got(engine, "SELECT count(s.t) FROM plain, some s, some u WHERE s.t = u.t AND b = s.k AND u.n IS NULL") == got(engine, "SELECT count(s.t) FROM plain JOIN some s ON b = s.k JOIN some u ON s.t = u.t WHERE u.n IS NULL")


def test_windows_are_no_filters(engine):
    with pytest.raises(AnalysisException):
        engine.sql("select n_name from nation where rank() over (order by n_name) = 1")


def test_row_groups_are_split_and_pruned(engine, tmp_path):
    engine.spark.range(100_000).repartition(1).write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(str(tmp_path / "g.parquet"))
    found = Engine(engine.spark, str(tmp_path))
    found.spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    df = found.sql("select id from g where id >= 99990")
    assert df.rdd.getNumPartitions() > 1 and df.count() == 10


def test_tokens():
    assert [text_of(s) for s in statements("select ';' ; create module m language python as $$ a; b $$;")] == ["select ';'", "create module m language python as $$ a; b $$"]
    with pytest.raises(DialectError):
        tokenize("select 'open")


def test_fixture_rows(engine):
    view(engine, "l", "lk long, lv long", [(1, 10), (2, 20), (1, 30)])
    view(engine, "r", "rk long, rv long", [(1, 100), (1, 200), (3, 300)])
    assert sorted(got(engine, "select * from l join r on lk = rk")) == [(1, 10, 1, 100), (1, 10, 1, 200), (1, 30, 1, 100), (1, 30, 1, 200)]
    view(engine, "a1", "a long", [(1,), (2,), (None,), (None,)])
    view(engine, "a2", "a long", [(2,), (3,), (None,), (None,)])
    assert set(got(engine, "select a from a1 intersect select a from a2")) == {(2,), (None,)}
    assert set(got(engine, "select a from a1 except select a from a2")) == {(1,)}
    view(engine, "t", "a long, b long", [(1, 10), (1, 20), (2, 10)])
    found = got(engine, "select grouping(a) as g, grouping(b) as h, count(*) as n from t group by rollup(a, b)")
    assert sorted(found) == [(0, 0, 1)] * 3 + [(0, 1, 1), (0, 1, 2), (1, 1, 3)]
    view(engine, "w", "k long, o long, v long", [(2, 1, 20), (1, 2, 7), (1, 1, 5), (2, 3, 4), (1, 3, 11), (2, 2, 6)])
    found = got(engine, "select k, o, sum(v) over (partition by k order by o rows between unbounded preceding and current row) s from w")
    assert [s for _, _, s in sorted(found)] == [5, 12, 23, 20, 26, 30]


def test_null_orders_and_pseudo_rows(engine):
    view(engine, "n", "a long", [(1,), (None,), (2,)])
    assert got(engine, "select a from n order by a") == [(1,), (2,), (None,)]
    assert got(engine, "select a from n order by a desc") == [(None,), (2,), (1,)]
    assert got(engine, "select stddev_samp(a) as s from n where a = 1") == [(None,)]
    assert got(engine, "select count(*) as n from n where a > 5") == [(0,)]


def test_regexp_replace_takes_the_first_match(engine):
    assert got(engine, r"select regexp_replace('aXbX', 'X', '<\&1>') as a, regexp_replace('k=v', '(\w)=(\w)', '\2$\1') as b, regexp_replace('none', 'z', 'y') as c, regexp_replace('abab', '(ab)\1', '[\1]') as d") == [("a<X1>bX", "v$k", "none", "[ab]")]
    with pytest.raises(DialectError):
        engine.sql("select regexp_replace('a', 'b' || 'c', 'd') as x")


MODULE = "create or replace module m language python as $$\ndef pair(x):\n    return x, x + 1\ndef one(x):\n    return x * 10\ndef two(x, y):\n    return x + y\n$$;"


def test_modules(engine):
    setup = MODULE + "create or replace function pair(bigint) returns (bigint, bigint) set module to m; create or replace function f(bigint) returns bigint set module to m set symbol to one; create or replace function f(bigint, bigint) returns bigint set module to m set symbol to two;"
    assert got(engine, setup + "select pair(n_nationkey::bigint) as (x, y), f(3::bigint) as a, f(3::bigint, 4::bigint) as b, f(null::bigint) as z from nation where f(n_nationkey::bigint) = 20") == [(2, 3, 30, 7, None)]
    assert engine.sql("select pair(1::bigint)").columns == ["field1", "field2"]
    with pytest.raises(DialectError, match="returns 2 columns"):
        engine.sql("select pair(1::bigint) as (x, y, z)")


def test_overloads_by_type(spark):
    engine = Engine(spark, SMALL)
    engine.run("""create module kinds language python as $$
def whole(x): return x + 1
def text(x): return x + "!"
def both(x, y): return f"{x}{y}"
def turned(x, y): return y, x
$$;
create function g(bigint) returns bigint set module to kinds set symbol to whole;
create function g(text) returns text set module to kinds set symbol to text;
create function g(bigint, text) returns text set module to kinds set symbol to both;
create function g(text, bigint) returns (bigint, text) set module to kinds set symbol to turned""")
    text = "select g(s_suppkey) as a, g(s_name) as b, g(s_suppkey, 'x') as c, g(g(s_suppkey)) as d, g(coalesce(s_name, '')) as e, g(7) as f, g(s_name || '') as h from supplier where s_suppkey = 1"
    with pytest.raises(DialectError, match="cast them"):
        engine.sql(text)
    name = got(engine, "select s_name as n from supplier where s_suppkey = 1")[0][0]
    assert got(engine, text.replace("s_name || ''", "(s_name || '')::text")) == [(2, name + "!", "1x", 3, name + "!", 8, name + "!")]
    assert got(engine, "select g(s_name, s_suppkey) as (k, n) from supplier where g(s_suppkey) = 2") == [(1, name)]
    with pytest.raises(DialectError, match="no g with 3"):
        engine.sql("select g(1, 2, 3) as x")


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("create module rusty language rust as $$ x $$", "unsupported language"),
        ("create function g(int) returns int set module to nowhere", "no module"),
        ("create module m9 language python as $$ $$; create module m9 language python as $$ $$", "exists"),
        ("create module m8 language python as $$ $$; create function h(int) returns int set module to m8; create function h(int) returns int set module to m8", "exists"),
        ("create table t (a int)", "only modules"),
        ("create function k(blob) returns int set module to m8", "unknown type"),
    ],
)
def test_module_errors(engine, text, said):
    with pytest.raises(DialectError, match=said):
        engine.run(text)


def test_a_broken_module_fails_on_first_use_only(engine):
    engine.run("create or replace module broken language python as $$ def ( $$; create or replace function bad(int) returns int set module to broken")
    with pytest.raises(Exception, match="SyntaxError|module>"):
        engine.sql("select bad(1) as x").collect()


def test_plans_push_down_and_prune(engine):
    said = engine.explain("select l_orderkey from lineitem where l_quantity > 49")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in said
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in said
    assert "TakeOrderedAndProject" in engine.explain("select l_orderkey from lineitem order by l_tax, l_orderkey limit 5")
    assert "LeftSemi" in engine.explain("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")


def test_sinks_and_command_line(engine):
    out = io.StringIO()
    assert sinks.console(engine.sql("select r_regionkey, r_name from region where r_regionkey < 2 order by 1"), out) == 2
    assert out.getvalue().splitlines() == [" r_regionkey |  r_name", "-------------+---------", "           0 | AFRICA", "           1 | AMERICA", "(2 rows)"]
    out = io.StringIO()
    cli.run(engine, "select 'a,b' as x, null as y; select 1 as z", "csv", out=out)
    assert out.getvalue() == 'x,y\n"a,b",\nz\n1\n'
    out = io.StringIO()
    cli.run(engine, "\\d region", out=out)
    cli.run(engine, "explain select 1 as x", out=out)
    cli.run(engine, "select n_name from nation", "null", timing=True, out=out)
    assert "r_name string" in out.getvalue() and "Physical Plan" in out.getvalue() and "Time: " in out.getvalue()


def test_csv_files(engine, tmp_path):
    sinks.csv_files(engine.sql("select * from region"), str(tmp_path / "r"), "|")
    assert engine.spark.read.option("sep", "|").option("header", True).csv(str(tmp_path / "r")).count() == 5


def test_right_joins_and_salt(spark):
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(5, 15).withColumnRenamed("id", "j")
    assert sorted(r[0] for r in R.join(a, b, [("k", "j")], "right_anti").collect()) == [10, 11, 12, 13, 14]
    hot = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    side = spark.createDataFrame([(1, "x"), (950, "y"), (5000, "z")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, R.salted_join(hot, side, "k", 8, how).collect())) == sorted(map(str, hot.join(side, "k", how).collect()))
    with pytest.raises(ValueError, match="cannot be right"):
        R.salted_join(hot, side, "k", 8, "right")


def test_rewrites_hold_with_nulls(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, None), (None, 7)], "k int, x int")
    want = {tuple(r) for r in df.groupBy("k").agg(F.sum(F.expr("3 * x + 2")), F.sum(F.expr("x - 1"))).collect()}
    assert {tuple(r) for r in rewrites.affine_sums(df, ["k"], {"a": (3, "x", 2), "b": (1, "x", -1)}).collect()} == want
    nation = spark.read.parquet(f"{SMALL}/nation.parquet")
    assert not rewrites.shared(nation.select("n_name"), uses=1).is_cached
    assert not rewrites.shared(nation.select("n_name"), uses=2, most_bytes=1).is_cached
    kept = rewrites.shared(nation, uses=2)
    assert kept.is_cached
    kept.unpersist()


def test_statistics(engine):
    found = {r["column"]: r for r in engine.catalog.statistics("orders").collect()}
    assert found["o_orderkey"]["n_rows"] == 1500 and found["o_orderkey"]["n_nulls"] == 0 and found["o_orderstatus"]["n_distinct"] == 3


def test_sexpr(engine):
    text = """(rel sort (rel aggregate (rel filter (rel source "nation" "n")
        (: (&& (call like n_name "NATION_1%") (!= |n.n_nationkey| (: 1 i64))) u8)) (keys n_regionkey) (agg n count)) (n_regionkey asc nulls-default))"""
    want = got(engine, "select n_regionkey, count(*) as n from nation where n_name like 'NATION_1%' and n_nationkey <> 1 group by n_regionkey order by n_regionkey")
    assert [tuple(r) for r in engine.sexpr(text).collect()] == want
    nested = '(rel project (rel join (rel source "region") (rel source "nation") ((r_regionkey n_regionkey)) (inner) (> n_nationkey 20)) (k n_nationkey) (s (if (== r_name "ASIA") 1 0)) (t (call substring r_name 0 2)))'
    assert engine.sexpr(nested).count() == 4
    renamed = engine.sexpr('(rel project (rel source "region") (u (call shout r_name)))', {"shout": "upper"})
    assert renamed.count() == 5
    assert engine.sexpr('(rel limit (rel source "orders") (limit 3) (offset 2))').count() == 3
    for bad in ("(rel nothing)", "(rel filter (rel source \"nation\") (call nope 1))", "(rel source", "(query (cte 0 (rel source \"nation\")))"):
        with pytest.raises(DialectError):
            engine.sexpr(bad)
