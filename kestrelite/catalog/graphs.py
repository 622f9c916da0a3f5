"""Graph queries: users linked by successive events, nations linked along regions, and the order graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelite.operators import graph as G
from kestrelite.plans.language import Engine

from . import query, table

#: Nations: each to the next key, and to the next of its region.
NEDGE = "ne as (select * from (select n_nationkey::bigint as src, (lead(n_nationkey) over (order by n_nationkey))::bigint as dst, 'NEXT' as relation_type, (1 + n_regionkey)::double as weight from nation union all select n_nationkey::bigint, (lead(n_nationkey) over (partition by n_regionkey order by n_nationkey))::bigint, 'REGION', 2.5 from nation) where dst is not null)"
NN = "nn as (select n_nationkey::bigint as id, n_regionkey from nation)"
#: Users: each to the user of the next event of the same type.
UEDGE = "ue as (select distinct src, dst from (select user_id as src, lead(user_id) over (partition by event_type order by ts, event_id) as dst from events) where dst is not null and src <> dst)"
UN = "un as (select distinct user_id as id from events)"


def nations(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    lead = lambda w: F.lead("id").over(w)
    a = n.select(F.col("id").alias("src"), lead(Window.orderBy("id")).alias("dst"), F.lit("NEXT").alias("relation_type"), (1 + F.col("n_regionkey")).cast("double").alias("weight"))
    b = n.select(F.col("id").alias("src"), lead(Window.partitionBy("n_regionkey").orderBy("id")).alias("dst"), F.lit("REGION").alias("relation_type"), F.lit(2.5).alias("weight"))
    return n, a.union(b).where("dst is not null")


def users(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "events")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    edges = e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null and src <> dst").distinct()
    return e.select(F.col("user_id").alias("id")).distinct(), edges


@query("j2_neighbors", f"with {NN}, {NEDGE} select id, n_regionkey from nn where id in (select dst from ne where src = 3)")
def j2(s, d):
    n, e = nations(s, d)
    return G.neighbors(e, n, 3)


for _dir, _where in (("out", "x.id = src and y.id = dst"), ("in", "x.id = dst and y.id = src"), ("both", "(x.id = src and y.id = dst or x.id = dst and y.id = src)")):

    @query(f"j3_pattern_{_dir}", f"with {NN}, {NEDGE} select distinct x.id as a_id, y.id as b_id from nn x, nn y, ne where {_where} and relation_type = 'REGION' and x.n_regionkey <= 2" if _dir == "both" else f"with {NN}, {NEDGE} select x.id as a_id, y.id as b_id from nn x, nn y, ne where {_where} and relation_type = 'REGION' and x.n_regionkey <= 2")
    def j3(s, d, direction=_dir):
        n, e = nations(s, d)
        rel = e.where("relation_type = 'REGION'") if direction == "both" else e
        return G.pattern(n.where("n_regionkey <= 2"), rel, n, None if direction == "both" else "REGION", direction)


def reach(edges: str, start: str, n: int) -> str:
    return f"r(id, depth) as ({start} union select dst, depth + 1 from r join {edges} on src = r.id where depth < {n})"


@query("j4_connected_to", f"with recursive {NN}, {NEDGE}, e as (select * from ne where relation_type = 'REGION'), {reach('e', 'select 1::bigint, 0', 3)} select id, 2.0::double as score from r group by id having min(depth) between 1 and 3")
def j4(s, d):
    n, e = nations(s, d)
    return G.connected_to(e, n.where("id = 1"), "REGION", 1, 3)


def nation_engine(s: SparkSession, d: str) -> Engine:
    e = Engine(s)
    n, e.edges = nations(s, d)
    e.register("Nation", n)
    return e


@query("j4_language", f"with recursive {NN}, {NEDGE}, e as (select src, dst from ne where relation_type = 'REGION'), r(source, id, depth) as (select id, id, 0 from nn union select source, dst, depth + 1 from r join e on src = r.id where depth < 3) select distinct id, 2.5::double as score from (select source, id, min(depth) as m from r group by all) where m between 2 and 3 and id in (select id from nn where n_regionkey = 2)")
def j4_language(s, d):
    return nation_engine(s, d).run('MATCH (n:Nation) WHERE CONNECTEDTO(n, "NEXT", "REGION", n_regionkey, 2) WITHIN 2 TO 3 HOPS RETURN n.id, score')


for _arrow, _far in (("-[:NEXT*1..3]->", "select src, dst from ne where relation_type = 'NEXT'"), ("<-[:NEXT*1..3]-", "select dst as src, src as dst from ne where relation_type = 'NEXT'"), ("-[:NEXT*1..3]-", "select src, dst from ne where relation_type = 'NEXT' union select dst, src from ne where relation_type = 'NEXT'")):
    _name = {"->": "out", "<-": "in"}.get(_arrow[-2:] if _arrow[0] == "-" else _arrow[:2], "both")

    @query(f"j19_language_{_name}", f"with recursive {NN}, {NEDGE}, e as ({_far}), r(source, id, depth) as (select id, id, 0 from nn where n_regionkey = 1 union select source, dst, depth + 1 from r join e on src = r.id where depth < 3) select distinct source as a_id, r.id as b_id from r where r.id <> source")
    def j19_language(s, d, arrow=_arrow):
        return nation_engine(s, d).run(f"MATCH (a:Nation {{n_regionkey: 1}}){arrow}(b:Nation) RETURN a.id, b.id LIMIT 100000")


@query("j7_bfs_levels", f"with recursive {UEDGE}, {reach('ue', 'select 1::bigint, 0', 3)} select id, min(depth) as depth from r group by id having min(depth) >= 1")
def j7(s, d):
    _, e = users(s, d)
    return G.bfs(e, s.createDataFrame([(1,)], "id long"), 3, 1)


@query("j9_graph_search", f"with recursive {NN}, {NEDGE}, {reach('ne', 'select 0::bigint, 0', 6)} select id, min(depth) as depth from r group by id")
def j9(s, d):
    return G.bfs(nations(s, d)[1], s.createDataFrame([(0,)], "id long"), 6)


PATHS = "p(id, cost, path) as (select 0::bigint, 0.0::double, [0::bigint] union all select dst, cost + weight, list_append(path, dst) from p join ne on src = p.id where len(path) < {n})"


@query("j10_dijkstra", f"with recursive {NEDGE}, b(id, cost) as (select 0::bigint, 0.0::double union select dst, cost + weight from b join ne on src = b.id where cost < 80) select id, min(cost) as cost from b group by id")
def j10(s, d):
    return G.shortest_paths(nations(s, d)[1], 0).select("id", "cost")


@query("j11_j12_simple_paths", f"with recursive {NEDGE}, {PATHS.format(n=8)} select distinct path from p where id = 10")
def j11(s, d):
    return G.simple_paths(nations(s, d)[1], 0, 10, 8).distinct()


@query("j13_path_length", f"with recursive {NEDGE}, {PATHS.format(n=6)}, q as (select distinct path from p where id = 10), w as (select src, dst, min(weight) as weight from ne group by all), u as (select array_to_string(path, '-') as path_id, path, unnest(range(1, len(path))) as i from q) select path_id, sum(weight) as length from u join w on src = path[i] and dst = path[i + 1] group by path_id")
def j13(s, d):
    e = nations(s, d)[1]
    p = G.simple_paths(e, 0, 10, 6).distinct().select(F.array_join("path", "-").alias("path_id"), "path")
    return G.path_length(p, e)


@query("j15_all_shortest_paths", f"with recursive {NEDGE}, {PATHS.format(n=8)}, q as (select distinct path from p where id = 12) select path from q where len(path) = (select min(len(path)) from q)")
def j15(s, d):
    return G.all_shortest_paths(nations(s, d)[1], 0, 12).distinct()


@query("j16_list_edges", f"with {NEDGE} select src || '-' || dst as edge_id, relation_type, weight from ne where src = 5")
def j16(s, d):
    return nations(s, d)[1].where("src = 5").select(F.concat_ws("-", "src", "dst").alias("edge_id"), "relation_type", "weight")


@query("j17_induced", f"with {NN}, {NEDGE}, k as (select id from nn where n_regionkey in (0, 2)) select src, dst, relation_type, weight from ne where src in (select id from k) and dst in (select id from k)")
def j17(s, d):
    n, e = nations(s, d)
    return G.induced(e, n.where("n_regionkey in (0, 2)")).select("src", "dst", "relation_type", "weight")


@query("j18_inter_level", f"with {NN}, {NEDGE} select src, dst, a.n_regionkey as src_level, b.n_regionkey as dst_level, a.n_regionkey <> b.n_regionkey as inter_level from ne join nn a on a.id = src join nn b on b.id = dst")
def j18(s, d):
    n, e = nations(s, d)
    lv = lambda x: n.select(F.col("id").alias(x), F.col("n_regionkey").alias(f"{x}_level"))
    r = e.join(lv("src"), "src").join(lv("dst"), "dst")
    return r.select("src", "dst", "src_level", "dst_level", (F.col("src_level") != F.col("dst_level")).alias("inter_level"))


@query("j5_hybrid", f"""with {NN}, {NEDGE}, near as (select distinct src as start, dst as id from ne), cl as (select a.id as start, b.id, abs(a.id - b.id) / 100.0 as dist from nn a join nn b on a.id <> b.id and a.n_regionkey = b.n_regionkey),
f as (select coalesce(n.start, c.start) as start, coalesce(n.id, c.id) as id, case when n.id is not null then 1 else 2 end as branch, case when n.id is not null and c.id is not null then 0.7 * dist when n.id is not null then 0.5 else dist end as score from near n full join cl c on n.start = c.start and n.id = c.id)
select id, round(score, 6)::double as score from (select *, row_number() over (partition by id order by start, branch) as k from f) where k = 1 order by score, id limit 12""")
def j5(s, d):
    n, e = nations(s, d)
    x, y = n.select(F.col("id").alias("start"), F.col("n_regionkey").alias("r")), n.select("id", F.col("n_regionkey").alias("r"))
    close = x.join(y, "r").where("start <> id").select("start", "id", (F.abs(F.col("start") - F.col("id")) / 100.0).alias("dist"))
    return G.hybrid_graph_vector(e, close, n, 12).select("id", F.round("score", 6).alias("score"))


@query("g1_degree_centrality", f"with {UN}, {UEDGE} select id, round(count(src) / ((select count(*) from un) - 1.0), 6) as centrality from un left join ue on src = id group by id")
def g1(s, d):
    n, e = users(s, d)
    return G.degree_centrality(n, e).select("id", F.round("centrality", 6).alias("centrality"))


DIST = f"with recursive {NN}, {NEDGE}, r(source, id, depth) as (select id, id, 0 from nn union select r.source, dst, depth + 1 from r join ne on src = r.id where depth < 24), dd as (select source, id, min(depth) as dist from r group by all)"


@query("g2_betweenness", DIST + """, e as (select distinct src, dst from ne), sp(source, id, path) as (select id, id, [id] from nn union all select sp.source, dst, list_append(path, dst) from sp join e on src = sp.id join dd on dd.source = sp.source and dd.id = dst and dist = len(path)),
c as (select source, id as target, count(*) as n from sp where source <> id group by all), t as (select sp.source, sp.id as target, u.v, count(*) as k from sp, unnest(path[2:len(path) - 1]) u(v) group by all)
select nn.id, round(coalesce(sum(k / n), 0) / (24.0 * 23), 6) as betweenness from nn left join (select v, k, n from t join c using (source, target)) x on x.v = nn.id group by nn.id""")
def g2(s, d):
    n, e = nations(s, d)
    return G.betweenness(n.select("id"), e).select("id", F.round("betweenness", 6).alias("betweenness"))


@query("g4_closeness", DIST + " select nn.id, round(coalesce(x.c, 0), 6) as closeness from nn left join (select source, count(*) / sum(dist) as c from dd where id <> source group by source) x on x.source = nn.id")
def g4(s, d):
    n, e = nations(s, d)
    return G.closeness(e, n).select("id", F.round("closeness", 6).alias("closeness"))


@query("j14_distance", DIST + " select source, id, dist from dd where source = 2")
def j14(s, d):
    n, e = nations(s, d)
    return G.all_distances(e, n.where("id = 2")).select("source", "id", "dist")


def _ranks(rounds: int) -> str:
    sql = f"with {UN}, {UEDGE}, deg as (select src, count(*) as deg from ue group by src), k0 as (select id, 1.0 / (select count(*) from un) as rank from un)"
    for k in range(rounds):
        sql += f", k{k + 1} as materialized (select un.id, 0.15 / (select count(*) from un) + 0.85 * coalesce(x.v, 0) as rank from un left join (select dst, sum(rank / deg) as v from ue join k{k} on src = k{k}.id join deg using (src) group by dst) x on x.dst = un.id)"
    return sql + f" select id, round(rank, 7) as rank from k{rounds}"


@query("g7_pagerank", _ranks(6))
def g7(s, d):
    n, e = users(s, d)
    return G.pagerank(n, e, rounds=6).select("id", F.round("rank", 7).alias("rank"))


@query("g5_g6_eigenvector")
def g5(s, d):
    n, e = users(s, d)
    return G.eigenvector(n, e, 12, 1e-6)


@query("g8_g9_communities")
def g8(s, d):
    n, e = nations(s, d)
    return G.majority_communities(n, e.where("relation_type = 'REGION'"), 10)


RCOMP = f"with recursive {NN}, {NEDGE}, e as (select src, dst from ne where relation_type = 'REGION' union select dst, src from ne where relation_type = 'REGION'), r(id, c) as (select id, id from nn union select dst, c from r join e on src = r.id)"


@query("g10_components", RCOMP + " select id, min(c) as component from r group by id")
def g10(s, d):
    n, e = nations(s, d)
    return G.components(n, e.where("relation_type = 'REGION'"))


@query("g11_betti0", RCOMP + " select count(distinct component) as betti0 from (select id, min(c) as component from r group by id)")
def g11(s, d):
    n, e = nations(s, d)
    return G.components(n, e.where("relation_type = 'REGION'")).agg(F.countDistinct("component").alias("betti0"))


@query("a12_g12_totals", f"with recursive {UN}, {UEDGE}, ub as (select src, dst from ue union select dst, src from ue), ul(id, c) as (select id, id from un where id = (select min(id) from un) union select dst, c from ul join ub on src = ul.id), ur as (select id, c from ul union all select id, id as c from un where id not in (select id from ul)) select (select count(*) from un) as nodes, (select count(*) from ue) as edges, (select count(distinct c)::integer from (select id, min(c) as c from ur group by id)) as components, round((select count(*) from ue) / (select count(*) from un), 6) as average_degree, round((select count(*) from ue) / ((select count(*) from un) * ((select count(*) from un) - 1) / 2.0), 6) as density")
def a12(s, d):
    n, e = users(s, d)
    return G.totals(n, e).select("nodes", "edges", F.col("components").cast("int").alias("components"), F.round("average_degree", 6).alias("average_degree"), F.round("density", 6).alias("density"))


@query("g12_path_metrics", f"with recursive {NN}, {NEDGE}, e as (select src, dst from ne union select dst, src from ne), r(source, id, depth) as (select id, id, 0 from nn where id < 10 union select r.source, dst, depth + 1 from r join e on src = r.id where depth < 24), dd as (select source, id, min(depth) as dist from r group by all) select max(dist) as diameter, round(avg(dist), 6) as average_path from dd where dist > 0")
def g12(s, d):
    n, e = nations(s, d)
    return G.path_metrics(n.select("id"), e, 10).select("diameter", F.round("average_path", 6).alias("average_path"))


TRI = f"with {UEDGE}, b as (select src, dst from ue union select dst, src from ue), dg as (select src as id, count(*) as degree from b group by 1), tr as (select x.src as id, count(*) / 2 as t from b x join b y on y.src = x.dst join b z on z.src = y.dst and z.dst = x.src group by 1)"


@query("g13_clustering", TRI + " select round(avg(coalesce(t, 0) / (degree * (degree - 1) / 2.0)), 6) as average, round(sum(coalesce(t, 0)) / sum(degree * (degree - 1) / 2.0), 6) as global from dg left join tr using (id) where degree >= 2")
def g13(s, d):
    r = G.clustering(users(s, d)[1])
    return r.select(F.round("average", 6).alias("average"), F.round("global", 6).alias("global"))


@query("g14_triangles", TRI + " select id, coalesce(t, 0)::bigint as triangles, degree from dg left join tr using (id)")
def g14(s, d):
    return G.triangles(users(s, d)[1])


@query("g15_layouts", f"with {NN} select id, round(cos(2 * pi() * id / 100), 6) as cx, round(sin(2 * pi() * id / 100), 6) as cy, (id % 5)::double as hy, ((row_number() over (order by id) - 1) % 5)::double as gx, floor((row_number() over (order by id) - 1) / 5.0)::double as gy from nn")
def g15(s, d):
    n = nations(s, d)[0].select("id")
    a = G.layout(n, "circular").select("id", F.round("x", 6).alias("cx"), F.round("y", 6).alias("cy"))
    return a.join(G.layout(n, "hierarchical").select("id", F.col("y").alias("hy")), "id").join(G.layout(n, "grid").select("id", F.col("x").alias("gx"), F.col("y").cast("double").alias("gy")), "id")


@query("g16_styles", f"with {UN}, {UEDGE}, c as (select id, count(src) as deg from un left join ue on src = id group by id) select id, 'Node_' || id as label, case when deg > 50 then 'red' when deg > 20 then 'orange' else 'blue' end as color, least(50, 10 + deg)::bigint as size from c")
def g16(s, d):
    n, e = users(s, d)
    c = n.join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    color = F.when(F.col("deg") > 50, "red").when(F.col("deg") > 20, "orange").otherwise("blue")
    return c.select("id", F.concat(F.lit("Node_"), F.col("id")).alias("label"), color.alias("color"), F.least(F.lit(50), 10 + F.col("deg")).cast("long").alias("size"))


@query("g17_analytics_in_return", RCOMP.replace("with recursive", f"with recursive {UN},") + " select nn.id, n_name as name, min(c) as community from nn join nation on n_nationkey = nn.id join r on r.id = nn.id group by all")
def g17(s, d):
    n, e = nations(s, d)
    names = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return names.join(G.components(n, e.where("relation_type = 'REGION'")), "id").select("id", "name", F.col("component").alias("community"))


@query("j3_order_graph", "select c_custkey as a_id, l_suppkey as b_id, count(*) as n from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' group by all")
def j3_order_graph(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(s, d, "region").where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    o = c.join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return o.groupBy(F.col("c_custkey").alias("a_id"), F.col("l_suppkey").alias("b_id")).agg(F.count(F.lit(1)).alias("n"))


@query("j8_magic_set", f"with recursive {NN}, {NEDGE}, {reach('ne', 'select 7::bigint, 0', 4)} select id, min(depth) as depth from r group by id")
def j8(s, d):
    return G.bfs(nations(s, d)[1], s.createDataFrame([(7,)], "id long"), 4)


@query("j6_j19_variable_length", f"with recursive {NEDGE}, e as (select * from ne where relation_type = 'NEXT'), {reach('e', 'select 4::bigint, 0', 3)} select id from r group by id having min(depth) between 1 and 3")
def j19(s, d):
    n, e = nations(s, d)
    return G.bfs(e, n.where("id = 4"), 3, 1, "NEXT").select("id")


@query("g18_similar_and_paths", f"with recursive {NEDGE}, b(id, cost) as (select 3::bigint, 0.0::double union select dst, cost + weight from b join ne on src = b.id where cost < 80) select id, min(cost) as cost from b group by id having min(cost) <= 12")
def g18(s, d):
    return G.shortest_paths(nations(s, d)[1], 3).where("cost <= 12").select("id", "cost")
