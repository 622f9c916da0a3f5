"""Relational queries: predicates, aggregates, windows, ordering, set operations, recursion and ETL steps."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from kestrelite.functions import text as X
from kestrelite.operators import relational as R
from kestrelite.operators import search
from kestrelite.plans.language import Engine
from kestrelite.plans.schema import Registry

from . import query, table
from .vectors import COS, T32, TW, Q


@query("p1_projection", "select c_custkey, c_name from customer")
def p1(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name")


@query("p2_p4_predicates", "select c_custkey from customer where (c_acctbal > 5000 and c_mktsegment = 'BUILDING') or c_nationkey <= 2 or c_acctbal <> c_acctbal")
def p2(s, d):
    return table(s, d, "customer").where(R.any_of([R.all_of([R.compare("c_acctbal", ">", 5000), R.compare("c_mktsegment", "=", "BUILDING")]), R.compare("c_nationkey", "<=", 2)])).select("c_custkey")


@query("p3_like", "select p_partkey, contains(p_name, 'red') as is_red, contains(lower(p_name), 'widget') as is_widget from part")
def p3(s, d):
    return table(s, d, "part").select("p_partkey", R.compare("p_name", "LIKE", "red").alias("is_red"), R.compare("p_name", "ILIKE", "WIDGET").alias("is_widget"))


@query("p5_payload_filter", "select p_partkey from part where p_size > 10 and not p_brand = 'Brand#2' and (p_type = 'ECONOMY' or p_retailprice < 920)")
def p5(s, d):
    return table(s, d, "part").where(R.payload_filter([R.compare("p_size", ">", 10)], [R.compare("p_brand", "=", "Brand#2")], [R.compare("p_type", "=", "ECONOMY"), R.compare("p_retailprice", "<", 920)])).select("p_partkey")


@query("p6_conditions", "select event_id from events where event_type in ('click', 'error') and try_cast(json_extract_string(props, '$.k') as double) between 10 and 40")
def p6(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.where(R.match_any("event_type", ["click", "error"]) & R.in_range("k", 10, 40)).select("event_id")


@query("p7_etl_filters", "select p_partkey, p_brand is distinct from 'Brand#2' as ne, starts_with(p_name, 'red') as sw, ends_with(p_name, 'ring') as ew, contains(p_type, 'ECO') as ct from part")
def p7(s, d):
    return table(s, d, "part").select("p_partkey", R.etl_filter("p_brand", "not_equal", "Brand#2").alias("ne"), R.etl_filter("p_name", "starts_with", "red").alias("sw"), R.etl_filter("p_name", "ends_with", "ring").alias("ew"), R.etl_filter("p_type", "contains", "ECO").alias("ct"))


@query("p8_p14_tolerance", "select s_suppkey, abs(s_acctbal - 73.0) < 2.220446049250313e-16 as same, abs(s_acctbal - 73.0000001) < 1e-6 as close from supplier")
def p8(s, d):
    return table(s, d, "supplier").select("s_suppkey", R.same_number(F.col("s_acctbal"), F.lit(73.0), 2.220446049250313e-16).alias("same"), R.same_number(F.col("s_acctbal"), F.lit(73.0000001)).alias("close"))


@query("p9_p12_pattern_query", f"select vec_id as id, round({T32}, 6) as score from embeddings where label = 3 and {T32} <= 1.4 order by {T32}, vec_id limit 8")
def p9(s, d):
    e = Engine(s)
    e.register("Doc", table(s, d, "embeddings"), "vec_id", "embedding")
    r = e.run("MATCH (n:Doc {label: 3}) WHERE TOROIDALDISTANCE(n.embedding, 1.4) RETURN n.id, score LIMIT 8", Q, 32)
    return r.select("id", F.round("score", 6).alias("score"))


@query("p15_fields", "select p_partkey, p_name as title, p_size * 2 as doubled, 'x' as mark from part")
def p15(s, d):
    steps = [lambda x: x.withColumn("doubled", F.col("p_size") * 2), lambda x: x.withColumn("mark", F.lit("x")), lambda x: x.drop("p_brand", "p_type", "p_size", "p_retailprice"), lambda x: x.withColumnRenamed("p_name", "title")]
    return R.pipeline(table(s, d, "part"), steps)


@query("j1_etl_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def j1(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("a1_a4_aggregates", "select count(*) as n, round(coalesce(sum(l_extendedprice), 0), 2) as total, round(avg(l_quantity), 6) as mean, min(l_discount) as low, max(l_tax) as high from lineitem")
def a1(s, d):
    r = R.aggregate(table(s, d, "lineitem"), {"n": ("count", "*"), "total": ("sum", "l_extendedprice"), "mean": ("avg", "l_quantity"), "low": ("min", "l_discount"), "high": ("max", "l_tax")})
    return r.select("n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "low", "high")


@query("a5_language_aggregate", "select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean from lineitem where l_quantity > 10 group by l_returnflag")
def a5(s, d):
    e = Engine(s)
    e.register("Line", table(s, d, "lineitem"), "l_orderkey")
    return e.run("MATCH (n:Line) WHERE n.l_quantity > 10 RETURN n.l_returnflag, COUNT(*) AS n, AVG(n.l_quantity) AS mean GROUP BY l_returnflag").select("l_returnflag", "n", F.round("mean", 6).alias("mean"))


@query("a6_a7_group_having", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by 1, 2 having count(*) > 100")
def a6(s, d):
    rows = table(s, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    r = R.aggregate(rows, {"n": ("count", "*"), "revenue": ("sum", "net")}, ["l_returnflag", "l_linestatus"], F.col("n") > 100)
    return r.withColumn("revenue", F.round("revenue", 2))


@query("a8_reduce", "select 'sum' as op, round(sum(c_acctbal), 2)::varchar as value from customer union all select 'concat', (select string_agg(r_name, ',' order by r_regionkey) from region)")
def a8(s, d):
    a = R.reduce_field(table(s, d, "customer"), "sum", "c_acctbal", "c_custkey").select(F.lit("sum").alias("op"), X.number(F.round("value", 2)).alias("value"))
    return a.union(R.reduce_field(table(s, d, "region"), "concat", "r_name", "r_regionkey").select(F.lit("concat").alias("op"), "value"))


@query("a9_group_sizes", "select coalesce(o_orderpriority, '') as group_key, count(*) as group_size from orders group by 1")
def a9(s, d):
    return R.group_sizes(table(s, d, "orders"), "o_orderpriority")


@query("a13_subquery", "select count(*) as n, round(avg(o_totalprice), 4) as mean from orders where o_totalprice > (select avg(o_totalprice) from orders) and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def a13(s, d):
    o = table(s, d, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    k = table(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(F.broadcast(mean), F.col("o_totalprice") > F.col("m")).join(k, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("a_cube_distinct", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers from lineitem group by cube (l_returnflag, l_linestatus)")
def a_cube(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


_W = {"w1_row_number": ("row_number", None, "row_number()"), "w2_rank": ("rank", None, "rank()"), "w3_dense_rank": ("dense_rank", None, "dense_rank()"), "w4_lag": ("lag", "o_totalprice", "lag(o_totalprice)"), "w5_lead": ("lead", "o_totalprice", "lead(o_totalprice)"), "w6_first_value": ("first_value", "o_totalprice", "first_value(o_totalprice)"), "w7_last_value": ("last_value", "o_totalprice", "last_value(o_totalprice)"), "w8_sum": ("sum", "o_totalprice", "sum(o_totalprice)"), "w9_avg": ("avg", "o_totalprice", "avg(o_totalprice)"), "w10_count": ("count", None, "count(*)")}


def _window(name: str, fn: str, field: str | None, sql: str) -> None:
    rank = "rank" in fn
    order = "o_orderdate" if rank else "o_orderdate, o_orderkey"
    over = f"(partition by o_custkey order by {order})" if fn in ("row_number", "rank", "dense_rank", "lag", "lead") else f"(partition by o_custkey order by {order} rows between unbounded preceding and unbounded following)" if "value" in fn else "(partition by o_custkey)"
    value = f"{sql} over {over}"
    value = f"round({value}, 5)" if fn in ("sum", "avg") else value

    @query(name, f"select o_orderkey, {value} as v from orders")
    def w(s, d):
        cols = [F.col("o_orderdate")] if rank else [F.col("o_orderdate"), F.col("o_orderkey")]
        r = R.window(table(s, d, "orders"), fn, field, ["o_custkey"], cols, "v")
        return r.select("o_orderkey", F.round("v", 5).alias("v") if fn in ("sum", "avg") else F.col("v").cast("long").alias("v") if field is None else F.col("v"))


for _n, (_f, _c, _s) in _W.items():
    _window(_n, _f, _c, _s)


@query("t1_order_by", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def t1(s, d):
    return R.order_by(table(s, d, "orders"), "o_totalprice", True, "o_orderkey", 25).select("o_orderkey", "o_totalprice")


@query("t3_limit_default", "select o_orderkey from orders order by o_totalprice, o_orderkey limit 10")
def t3(s, d):
    return R.order_by(table(s, d, "orders"), "o_totalprice", False, "o_orderkey").select("o_orderkey")


@query("t8_paging", "select c_custkey, c_name from customer order by c_custkey limit 20 offset 40")
def t8(s, d):
    return R.page(table(s, d, "customer"), "c_custkey", 20, 40).select("c_custkey", "c_name")


@query("u3_set_operations", "select 'union' as op, count(*) as n from (select s_nationkey as k from supplier union select c_nationkey from customer) union all select 'intersect', count(*) from (select s_nationkey from supplier intersect select c_nationkey from customer) union all select 'except', count(*) from (select c_nationkey from customer except select s_nationkey from supplier)")
def u3(s, d):
    a, b = table(s, d, "supplier").select(F.col("s_nationkey").alias("k")), table(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.subtract(a)}
    made = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(o).alias("op"), "n") for o, x in parts.items()]
    return functools.reduce(lambda x, y: x.union(y), made)


@query("u4_new_rows", "select o_orderkey from orders where o_orderdate >= timestamp '1998-01-01' except all select o_orderkey from orders where o_orderstatus = 'F'")
def u4(s, d):
    o = table(s, d, "orders")
    return o.where("o_orderdate >= timestamp_ntz '1998-01-01'").select("o_orderkey").exceptAll(o.where("o_orderstatus = 'F'").select("o_orderkey"))


@query("c1_cte", "with big as (select o_custkey, sum(o_totalprice) as total from orders group by 1) select c_mktsegment, round(sum(total), 2) as total from big join customer on c_custkey = o_custkey group by 1")
def c1(s, d):
    table(s, d, "orders").createOrReplaceTempView("c1_orders")
    table(s, d, "customer").createOrReplaceTempView("c1_customer")
    return s.sql("with big as (select o_custkey, sum(o_totalprice) as total from c1_orders group by 1) select c_mktsegment, round(sum(total), 2) as total from big join c1_customer on c_custkey = o_custkey group by 1")


@query("c2_c3_recursive", "with recursive r(id) as (select 0::bigint union select (id * 3 + k) % 1500 from r, (values (1), (2)) t(k)) select id from r where exists (select 1 from customer where c_custkey = id)")
def c2(s, d):
    start = s.createDataFrame([(0,)], "id long")
    step = lambda x: x.select(F.explode(F.array((F.col("id") * 3 + 1) % 1500, (F.col("id") * 3 + 2) % 1500)).alias("id"))
    return R.recursive(start, step, "id", 50).join(table(s, d, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi")


@query("c10_explain")
def c10(s, d):
    e = Engine(s)
    e.register("Doc", table(s, d, "embeddings"), "vec_id", "embedding")
    return e.run("EXPLAIN MATCH (n:Doc {label: 3}) WHERE TOROIDALDISTANCE(n.embedding, 1.4) RETURN n.id LIMIT 8")


@query("c13_command", f"select vec_id, round({TW}, 6) as score from embeddings where {TW} <= 1.2")
def c13(s, d):
    e = Engine(s)
    e.register("embeddings", table(s, d, "embeddings"), "vec_id", "embedding")
    v = ", ".join(str(x) for x in Q)
    return e.command(f'toroidal_search("embeddings", [{v}], 1.2, d32)').select("vec_id", F.round("score", 6).alias("score"))


@query("tpch_q1", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '2000-09-02' group by 1, 2")
def tpch_q1(s, d):
    r = table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02'").groupBy("l_returnflag", "l_linestatus")
    return r.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("p10_p11_similar_to", f"select vec_id as id, round({COS}, 6) as score from embeddings where {COS} >= 0.05 order by {COS} desc, vec_id limit 20")
def p10(s, d):
    e = Engine(s)
    e.register("Doc", table(s, d, "embeddings"), "vec_id", "embedding")
    r = e.run("MATCH (n:Doc) WHERE cosine_similarity(n.embedding, $q) > 0.05 RETURN n.id, score LIMIT 20", Q)
    return r.select("id", F.round("score", 6).alias("score"))


@query("c11_c12_hints", "select c_custkey as id, c_name from customer where c_acctbal > 9000 order by c_custkey limit 10")
def c11(s, d):
    e = Engine(s)
    e.register("Customer", table(s, d, "customer"), "c_custkey")
    return e.run("DISTRIBUTED MATCH (n:Customer) WHERE n.c_acctbal > 9000 RETURN n.id, n.c_name ORDER BY c_custkey LIMIT 10 USING AVX2")


@query("c4_c5_schema_registry")
def c4(s, d):
    r = Registry()
    r.create_space("sales")
    r.use("sales")
    r.execute("CREATE NODE TYPE Customer (c_custkey INT PRIMARY KEY, c_name TEXT NOT NULL, c_acctbal FLOAT)")
    r.execute("CREATE NODE TYPE Orders (o_orderkey INT PRIMARY KEY, placed TIMESTAMP)")
    r.execute("CREATE EDGE TYPE Placed (from Customer, to Orders, weight FLOAT)")
    rows = [(k, n) for k, names in r.execute("SHOW SCHEMA").items() for n in names]
    return s.createDataFrame(rows, "kind string, name string")


@query("c6_views", "select c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1")
def c6(s, d):
    table(s, d, "customer").createOrReplaceTempView("c6_customer")
    return s.sql("select c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from c6_customer group by 1")


@query("p13_p14_expressions", "select p_partkey, abs(p_retailprice - p_size * 100) < 1e-6 as same, p_retailprice > 950 and p_size <> 10 as both from part")
def p13(s, d):
    return table(s, d, "part").select("p_partkey", R.same_number(F.col("p_retailprice"), F.col("p_size") * 100).alias("same"), (R.compare("p_retailprice", ">", 950) & R.compare("p_size", "<>", 10)).alias("both"))


@query("t5_t6_stream_order", "select event_id, value from events order by value desc, event_id limit 30")
def t5(s, d):
    return R.order_by(table(s, d, "events"), "value", True, "event_id", 30).select("event_id", "value")


@query("t9_similar_then_limit", f"select vec_id from embeddings order by {T32}, vec_id limit 7")
def t9(s, d):
    return search.top(search.prefix_search(table(s, d, "embeddings"), Q, 32, 99.0), "vec_id", 7).select("vec_id")


@query("r18_r19_pipeline", "select event_type, count(*) as n, round(sum(value * 2), 3) as total from events where value > 1 group by 1")
def r18(s, d):
    steps = [lambda x: x.where(R.etl_filter("value", "gt", 1)), lambda x: x.withColumn("value", F.col("value") * 2), lambda x: x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))]
    return R.pipeline(table(s, d, "events"), steps)


@query("a7_having_language", "select c_nationkey, count(*)::bigint as n, round(avg(c_acctbal), 4) as mean from customer where c_acctbal > 0 group by 1 having count(*) > 3 order by n desc, c_nationkey limit 5")
def a7_language(s, d):
    e = Engine(s)
    e.register("Customer", table(s, d, "customer"), "c_custkey")
    r = e.run("MATCH (n:Customer) WHERE n.c_acctbal > 0 RETURN n.c_nationkey, COUNT(*) AS n, AVG(n.c_acctbal) AS mean GROUP BY n.c_nationkey HAVING COUNT(*) > 3")
    return r.select("c_nationkey", "n", F.round("mean", 4).alias("mean")).orderBy(F.desc("n"), "c_nationkey").limit(5)


ORDERED = "MATCH (c:Customer)-[:BOUGHT]->(s:Supplier {s_nationkey: 3}) WHERE c.c_acctbal > 5000"


def order_engine(s, d):
    """Customers and suppliers with an edge for each supplier that a customer has bought from."""
    e = Engine(s)
    e.register("Customer", table(s, d, "customer"), "c_custkey")
    e.register("Supplier", table(s, d, "supplier"), "s_suppkey")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    e.edges = o.join(table(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst")), "l_orderkey").select("src", "dst", F.lit("BOUGHT").alias("relation_type"), F.lit(1.0).alias("weight")).distinct()
    return e


@query("j3_language_pattern", "select distinct o_custkey as c_id, l_suppkey as s_id, s_name as s_s_name from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join customer on c_custkey = o_custkey where s_nationkey = 3 and c_acctbal > 5000")
def j3_language(s, d):
    return order_engine(s, d).run(f"{ORDERED} RETURN c.id, s.id, s.s_name LIMIT 100000000")


@query("j3_language_grouped", "select s_suppkey as s_id, count(distinct o_custkey)::bigint as buyers from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join customer on c_custkey = o_custkey where s_nationkey = 3 and c_acctbal > 5000 group by 1 having count(distinct o_custkey) >= 2")
def j3_language_grouped(s, d):
    return order_engine(s, d).run(f"{ORDERED} RETURN s.id, COUNT(*) AS buyers GROUP BY s.id HAVING buyers >= 2")


@query("s6_repeated_new_rows", "select r_regionkey, r_name from region union all select 77, 'NEW'")
def s6_repeated(s, d):
    return R.insert_if_absent(table(s, d, "region").select("r_regionkey", "r_name"), s.createDataFrame([(1, "OLD"), (77, "NEW"), (77, "NEW")], "r_regionkey int, r_name string"), "r_regionkey")


@query("s7_overwrite", "select r_regionkey, case r_regionkey when 1 then 'CHANGED' else r_name end as r_name from region")
def s7_overwrite(s, d):
    return R.overwrite(table(s, d, "region").select("r_regionkey", "r_name"), s.createDataFrame([(1, "CHANGED"), (88, "ABSENT")], "r_regionkey int, r_name string"), "r_regionkey")


@query("t1_order_by_text", "select c_custkey, c_name from customer order by c_name desc, c_custkey limit 10")
def t1_text(s, d):
    return R.order_by(table(s, d, "customer"), "c_name", True, "c_custkey").select("c_custkey", "c_name")
