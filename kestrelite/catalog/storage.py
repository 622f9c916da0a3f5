"""Scans, ingestion, export and mutation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kestrelite.operators import relational as R
from kestrelite.operators.graph import cut
from kestrelite.plans.schema import Transaction
from kestrelite.sources import files

from . import query, table


def folder(s) -> str:
    cut(s.range(1))  # sets the session's checkpoint folder where it has none
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query("s1_s3_scan", "select c_custkey, c_name, c_acctbal from customer")
def s1(s, d):
    return table(s, d, "customer").orderBy("c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("s2_lookup", "select * from orders where o_orderkey = 42")
def s2(s, d):
    return table(s, d, "orders").where("o_orderkey = 42")


@query("s4_range_scan", "select o_orderkey from orders where o_orderkey >= 100 and o_orderkey < 200")
def s4(s, d):
    return table(s, d, "orders").where("o_orderkey >= 100 and o_orderkey < 200").select("o_orderkey")


@query("s5_snapshot", "select count(*) as n, round(sum(s_acctbal), 2) as total from supplier")
def s5(s, d):
    root = folder(s)
    rows = table(s, d, "supplier")
    files.snapshot(rows, root, 1)
    files.snapshot(rows.where("s_suppkey < 10"), root, 2)
    return files.read_snapshot(s, root, 1).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("s6_insert_if_absent", "select r_regionkey, r_name from region union all select 9, 'NEW'")
def s6(s, d):
    new = s.createDataFrame([(1, "CLASH"), (9, "NEW")], "r_regionkey int, r_name string")
    return R.insert_if_absent(table(s, d, "region").select("r_regionkey", "r_name"), new, "r_regionkey")


@query("s7_update", "select r_regionkey, case r_regionkey when 1 then 'CHANGED' else r_name end as r_name from region")
def s7(s, d):
    return R.upsert(table(s, d, "region").select("r_regionkey", "r_name"), s.createDataFrame([(1, "CHANGED")], "r_regionkey int, r_name string"), "r_regionkey")


@query("s8_s9_c7_transaction", "select 'node' as kind, n_nationkey::bigint as id from nation where n_nationkey <> 3 union all select 'node', 99 union all select 'edge', n_nationkey::bigint from nation where n_nationkey <> 3 and n_regionkey <> 3 union all select 'edge', 99")
def s8(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    e = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    t = Transaction(n, e)
    t.create(s.createDataFrame([(99,)], "id long"))
    t.connect(s.createDataFrame([(99, 0)], "src long, dst long"))
    t.delete(s.createDataFrame([(3,)], "id long"))
    mark = t.savepoint()
    t.delete(s.createDataFrame([(4,)], "id long"))
    t.restore(mark)
    nodes, edges = t.commit()
    return nodes.select(F.lit("node").alias("kind"), "id").union(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("id")))


@query("s10_s19_csv_round_trip", "select s_suppkey::varchar as s_suppkey, s_name, s_acctbal::varchar as s_acctbal from supplier")
def s10(s, d):
    path = folder(s)
    files.export(table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "csv")
    return files.ingest(s, path, "text/csv")


@query("s11_s20_json_round_trip", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def s11(s, d):
    path = folder(s)
    files.export(table(s, d, "nation"), path, "json")
    return files.ingest(s, path, "application/json").select("n_nationkey", "n_name", "n_regionkey")


@query("s12_chunks")
def s12(s, d):
    return files.chunks(table(s, d, "documents").select("doc_id", "text"))


@query("s14_binary_ingest")
def s14(s, d):
    return files.ingest(s, f"{d}/region.parquet", "image/png").select("text")


@query("s16_preview", "select doc_id, substring(text, 1, 100) as preview from documents order by doc_id limit 10")
def s16(s, d):
    return files.preview(table(s, d, "documents"), "doc_id", "text")


@query("s18_load_counters", "select count(*) as processed, count(*) filter (value <= 5) as filtered, count(*) - count(*) filter (value <= 5) as loaded from events")
def s18(s, d):
    low = F.count(F.when(F.col("value") <= 5, 1))
    return table(s, d, "events").agg(F.count(F.lit(1)).alias("processed"), low.alias("filtered"), (F.count(F.lit(1)) - low).alias("loaded"))


@query("s21_s26_parquet_backup", "select p_partkey, p_name from part")
def s21(s, d):
    path = folder(s)
    files.backup(table(s, d, "part").select("p_partkey", "p_name"), path)
    return files.restore(s, path)


@query("s22_schema_info", "select 'o_orderkey' as field, count(o_orderkey) as filled from orders union all select 'o_custkey', count(o_custkey) from orders union all select 'o_orderstatus', count(o_orderstatus) from orders union all select 'o_totalprice', count(o_totalprice) from orders union all select 'o_orderdate', count(o_orderdate) from orders union all select 'o_orderpriority', count(o_orderpriority) from orders")
def s22(s, d):
    return files.schema_info(table(s, d, "orders")).select("field", "filled")


@query("s24_bi_shapes", "select event_id, coalesce(event_type, 'unknown') as label, [value, (epoch_us(ts) // 1000)::double] as point from events")
def s24(s, d):
    return table(s, d, "events").select("event_id", F.coalesce("event_type", F.lit("unknown")).alias("label"), F.array(F.col("value"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double")).alias("point"))


@query("s25_graphml", "select value from (select 1 as p, '<node id=\"' || n_nationkey || '\"/>' as value from nation union all select 2, '<edge source=\"' || n_nationkey || '\" target=\"' || n_regionkey || '\"/>' from nation)")
def s25(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    e = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return files.graphml(n, e)


@query("json_properties", "select event_id, json_extract_string(props, '$.k')::bigint as k, contains(props, '6') as has_six from events")
def json_properties(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.contains("props", F.lit("6")).alias("has_six"))
