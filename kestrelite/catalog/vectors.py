"""Vector, text-search and topology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrelite.functions import text as X
from kestrelite.functions import vector as V
from kestrelite.operators import relational, search, topology

from . import query, table

Q = [((i * 37 + 11) % 100) / 250 - 0.2 for i in range(64)]
QS = "[" + ", ".join(f"{v!r}" for v in Q) + "]::DOUBLE[]"
E = "embedding::DOUBLE[]"
WORDS = "the house ention reaux"


def zipped(a: str, b: str, term: str) -> str:
    return f"list_sum([{term} for z in list_zip({a}, {b})])"


def torus(a: str, b: str) -> str:
    return f"sqrt({zipped(a, b, 'pow(least(abs(z[1] - z[2]), 1 - abs(z[1] - z[2])), 2)')})"


DOT = zipped(E, QS, "z[1] * z[2]")
NORM = f"sqrt(list_sum([x * x for x in {E}]))"
QNORM = f"sqrt(list_sum([x * x for x in {QS}]))"
COS = f"({DOT} / ({NORM} * {QNORM}))"
EUC = f"sqrt({zipped(E, QS, 'pow(z[1] - z[2], 2)')})"
MAN = zipped(E, QS, "abs(z[1] - z[2])")
T32 = torus(f"({E})[1:32]", f"({QS})[1:32]")


def q():
    return V.vector(Q)


def emb():
    return F.col("embedding")


def vecs(s, d):
    return table(s, d, "embeddings")


@query("k_distances", f"select vec_id, round({torus(E, QS)}, 6) as torus, round({COS}, 6) as cosine, round({EUC}, 6) as euclidean, round(pow({EUC}, 2), 6) as squared, round({MAN}, 6) as manhattan, round({DOT}, 6) as dot, round({NORM}, 6) as magnitude, round(1 / (1 + {torus(E, QS)}), 6) as torus_cosine from embeddings")
def k_distances(s, d):
    r = lambda c, n: F.round(c, 6).alias(n)
    return vecs(s, d).select("vec_id", r(V.torus_distance(emb(), q()), "torus"), r(V.cosine(emb(), q()), "cosine"), r(V.euclidean(emb(), q()), "euclidean"), r(V.squared_euclidean(emb(), q()), "squared"), r(V.manhattan(emb(), q()), "manhattan"), r(V.dot(emb(), q()), "dot"), r(V.magnitude(emb()), "magnitude"), r(V.torus_cosine(emb(), q()), "torus_cosine"))


STRICT = f"sqrt(list_sum([pow(least(m, 1 - m), 2) for m in [(z[1] - z[2]) - floor(z[1] - z[2]) for z in list_zip({E}, {QS})]]))"


@query("k1b_torus_strict", f"select vec_id, round({STRICT}, 6) as d from embeddings")
def k1b_torus_strict(s, d):
    return vecs(s, d).select("vec_id", F.round(V.torus_distance_strict(emb(), q()), 6).alias("d"))


def total(f: str) -> str:
    return f"round(list_sum({f}), 5)"


@query("k6_arithmetic", f"select vec_id, {total(f'[z[1] + z[2] for z in list_zip({E}, {QS})]')} as a, {total(f'[z[1] - z[2] for z in list_zip({E}, {QS})]')} as s, {total(f'[z[1] * z[2] for z in list_zip({E}, {QS})]')} as m, {total(f'[z[1] / (z[2] + 5) for z in list_zip({E}, {QS})]')} as d from embeddings")
def k6_arithmetic(s, d):
    t = lambda v, n: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias(n)
    return vecs(s, d).select("vec_id", t(V.add(emb(), q()), "a"), t(V.subtract(emb(), q()), "s"), t(V.multiply(emb(), q()), "m"), t(V.divide(emb(), V.vector([x + 5 for x in Q])), "d"))


@query("k7_unary", f"select vec_id, {total(f'[x * 2.5 for x in {E}]')} as scaled, {total(f'[-x for x in {E}]')} as negated, {total(f'[abs(x) for x in {E}]')} as absolute, {total(f'[greatest(-0.1, least(0.1, x)) for x in {E}]')} as clamped from embeddings")
def k7_unary(s, d):
    t = lambda v, n: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias(n)
    return vecs(s, d).select("vec_id", t(V.scale(emb(), 2.5), "scaled"), t(V.negate(emb()), "negated"), t(V.absolute(emb()), "absolute"), t(V.clamp(emb(), -0.1, 0.1), "clamped"))


@query("k8_normalize", f"select vec_id, [round(x / {NORM}, 6) for x in ({E})[1:4]] as head from embeddings")
def k8_normalize(s, d):
    return vecs(s, d).select("vec_id", F.transform(F.slice(V.normalize(emb()), 1, 4), lambda x: V.rounded(x, 6)).alias("head"))


@query("k9_pad", f"select vec_id, len(list_concat({E}, [0.0 for i in range(96)])[1:96]) as n, round(list_sum(({E})[1:16]), 5) as head from embeddings")
def k9_pad(s, d):
    return vecs(s, d).select("vec_id", F.size(V.pad_or_truncate(emb(), 96)).cast("long").alias("n"), F.round(F.aggregate(V.pad_or_truncate(emb(), 16), F.lit(0.0), lambda a, x: a + x), 5).alias("head"))


@query("k10_level", "select vec_id, (select min_by(l, struct_pack(o := abs(l - (vec_id * 7) % 2000), l := l)) from (values (384), (768), (1024), (1536)) t(l)) as level from embeddings")
def k10_level(s, d):
    return vecs(s, d).select("vec_id", V.nearest_level((F.col("vec_id") * 7) % 2000).alias("level"))


@query("v1_prefix_search", f"select vec_id, round({T32}, 6) as score from embeddings where len(embedding) >= 32 and {T32} <= 0.9")
def v1_prefix_search(s, d):
    return search.prefix_search(vecs(s, d), Q, 32, 0.9).select("vec_id", F.round("score", 6).alias("score"))


WRAPPED = "[" + ", ".join(f"{v % 1.0!r}" for v in Q) + "]::DOUBLE[]"
TW = torus(f"({E})[1:32]", f"({WRAPPED})[1:32]")


@query("v2_wrapped_search", f"select vec_id, round({TW}, 6) as score from embeddings where {TW} <= 1.2")
def v2_wrapped_search(s, d):
    return search.wrapped_search(vecs(s, d), Q, 32, 1.2).select("vec_id", F.round("score", 6).alias("score"))


@query("v3_topk_search", f"select vec_id, round({T32}, 6) as score from embeddings where {T32} <= 1.5 order by {T32}, vec_id limit 10")
def v3_topk_search(s, d):
    return search.top(search.prefix_search(vecs(s, d), Q, 32, 1.5), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("v4_text_to_vector")
def v4_text_to_vector(s, d):
    docs = search.hash_embedding(table(s, d, "documents").select("doc_id", "text"), 64)
    return search.top(search.prefix_search(docs, Q, 64, 3.0).withColumn("similarity", 1 - F.col("score")), "doc_id").select("doc_id", "similarity")


@query("e1_hash_embedding")
def e1_hash_embedding(s, d):
    return search.hash_embedding(table(s, d, "documents").select("doc_id", "text"), 16).select("doc_id", "embedding")


@query("v5_similar_to", f"select vec_id, round({COS}, 6) as score from embeddings where {COS} >= 0.1")
def v5_similar_to(s, d):
    return search.within(vecs(s, d), Q, 0.1, "cosine").select("vec_id", F.round("score", 6).alias("score"))


for _m, _e, _o in (("cosine", COS, "desc"), ("euclidean", EUC, "asc"), ("manhattan", MAN, "asc")):

    @query(f"v6_nearest_{_m}", f"select vec_id, round({_e}, 6) as score from embeddings order by {_e} {_o}, vec_id limit 15")
    def v6(s, d, m=_m):
        return search.nearest(vecs(s, d), Q, 15, m).select("vec_id", F.round("score", 6).alias("score"))


@query("v7_range_search", f"select vec_id, round({EUC}, 6) as score from embeddings where {EUC} <= 1.3")
def v7_range_search(s, d):
    return search.within(vecs(s, d), Q, 1.3).select("vec_id", F.round("score", 6).alias("score"))


@query("v10_lsh_nearest")
def v10_lsh(s, d):
    return search.lsh_nearest(vecs(s, d), Q, 10)


@query("v11_ivf_nearest")
def v11_ivf(s, d):
    return search.ivf_nearest(vecs(s, d), Q, 10)


@query("v12_filtered_nearest", f"select vec_id, label, round({COS}, 6) as score from embeddings where label in (1, 3, 5) and not label = 5 order by {COS} desc, vec_id limit 10")
def v12_filtered(s, d):
    keep = relational.payload_filter(must=[relational.match_any("label", [1, 3, 5])], must_not=[relational.compare("label", "=", 5)])
    return search.nearest(vecs(s, d), Q, 10, "cosine", where=keep).select("vec_id", "label", F.round("score", 6).alias("score"))


HYB = f"with v as (select vec_id, label, {COS} as s from embeddings order by s desc, vec_id limit 100) select vec_id, round(0.7 * (case when s < 0 then 1 + s else s end) + 0.3 * (label / 10.0), 6) as score from v order by 0.7 * (case when s < 0 then 1 + s else s end) + 0.3 * (label / 10.0) desc, vec_id limit 10"


@query("v13_hybrid_index", HYB)
def v13_hybrid(s, d):
    f = vecs(s, d).select("vec_id", (F.col("label") / 10.0).alias("centrality"))
    return search.hybrid(vecs(s, d), Q, f, 10).select("vec_id", F.round("score", 6).alias("score"))


LO, HI = f"list_min({E})", f"list_max({E})"
QUANT = f"[cast(floor((x - {LO}) / ({HI} - {LO}) * 255) as integer) for x in {E}]"


@query("v15_scalar_quantization", f"select vec_id, list_sum({QUANT}) as total, round({LO}, 6) as lo, round({HI}, 6) as hi, round(list_sum([{LO} + x / 255.0 * ({HI} - {LO}) for x in {QUANT}]), 4) as restored from embeddings")
def v15_scalar(s, d):
    rows = vecs(s, d).withColumn("qz", V.quantize_scalar(emb()))
    z = F.col("qz")
    return rows.select("vec_id", F.aggregate(z["data"], F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.round(z["min"], 6).alias("lo"), F.round(z["max"], 6).alias("hi"), F.round(F.aggregate(V.dequantize_scalar(z), F.lit(0.0), lambda a, x: a + x), 4).alias("restored"))


@query("v16_binary_quantization", f"select vec_id, list_sum([case when (z[1] > 0) <> (z[2] > 0) then 1 else 0 end for z in list_zip({E}, {QS})]) as hamming from embeddings")
def v16_binary(s, d):
    return vecs(s, d).select("vec_id", V.hamming(V.quantize_binary(emb()), V.quantize_binary(q())).cast("long").alias("hamming"))


@query("v17_product_quantization", f"select vec_id, [round(list_min(({E})[k * 16 + 1:k * 16 + 16]), 6) for k in range(4)] as lows from embeddings")
def v17_product(s, d):
    return vecs(s, d).select("vec_id", F.transform(V.quantize_product(emb(), 4, 64), lambda p: F.round(p["min"], 6)).alias("lows"))


@query("v18_asymmetric_distance", f"with z as (select vec_id, [{LO} + x / 255.0 * ({HI} - {LO}) for x in {QUANT}] as r from embeddings) select vec_id, round(1 - {zipped('r', QS, 'z[1] * z[2]')} / (sqrt(list_sum([x * x for x in r])) * {QNORM}), 5) as distance from z")
def v18_asymmetric(s, d):
    return vecs(s, d).select("vec_id", F.round(1 - V.cosine(V.dequantize_scalar(V.quantize_scalar(emb())), q()), 5).alias("distance"))


@query("v19_pca_projection")
def v19_pca(s, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vecs(s, d).select("vec_id", array_to_vector(emb().cast("array<double>")).alias("v"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))


@query("v20_context_modulation", f"select vec_id, round({COS} * (1 + greatest(-0.5, least(0.5, case label when 1 then 0.4 when 2 then -0.9 else 0 end))), 6) as score from embeddings")
def v20_modulate(s, d):
    scored = vecs(s, d).withColumn("score", V.cosine(emb(), q()))
    return search.modulate(scored, {"1": 0.4, "2": -0.9}).select("vec_id", F.round("score", 6).alias("score"))


@query("v21_hot_nodes", "with c as (select user_id, count(*) as n from events group by 1), s as (select *, 0.95 * (1 - pow(0.95, n)) / 0.05 as x from c) select user_id, n, round(x, 6) as score, x > 3 as hot, round(least(x / 100, 1), 6) as probability from s")
def v21_hot(s, d):
    r = search.hot_nodes(table(s, d, "events"), "user_id")
    return r.select("user_id", "n", F.round("score", 6).alias("score"), "hot", F.round("probability", 6).alias("probability"))


@query("u2_widened_search", f"with w as (select vec_id, {T32} as s from embeddings where {T32} <= 1.2) select vec_id, round(s, 6) as score from w where s <= 0.8 or (select count(*) from w where s <= 0.8) < 10")
def u2_widened(s, d):
    return search.widened(vecs(s, d), Q, 32, 0.8).select("vec_id", F.round("score", 6).alias("score"))


TOK = "[t for t in string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') if strlen(t) > 1]"


@query("f1_tokenizer", f"select doc_id, len({TOK}) as n, coalesce(list_sum([length(t) for t in {TOK}]), 0) as chars from documents")
def f1_tokenizer(s, d):
    t = X.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("f2_index", f"with p as (select doc_id, unnest({TOK}) as term from documents) select term, count(*) as occurrences, count(distinct doc_id) as docs from p group by term")
def f2_index(s, d):
    return search.postings(table(s, d, "documents")).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("docs"))


BM = f"""with t as (select doc_id, {TOK} as t from documents), st as (select count(*) as n, avg(len(t)) as a from t),
tf as (select doc_id, len(t) as dl, w.term, len([x for x in t if x = w.term]) as tf from t, (values ('the'), ('house'), ('ention'), ('reaux')) w(term)),
df as (select term, sum(tf) as odf, count(*) as ddf from tf where tf > 0 group by term),
oc as (select doc_id, sum(ln((n - odf + 0.5) / (odf + 0.5) + 1) * tf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * least(dl, 255) / a))) as s from tf join df using (term), st where tf > 0 group by doc_id),
ok as (select doc_id, sum(ln((n - ddf + 0.5) / (ddf + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) as s from tf join df using (term), st where tf > 0 group by doc_id) """


@query("f3_bm25", BM + "select doc_id, round(s, 5) as score from oc where not isnan(s)")
def f3_bm25(s, d):
    return search.bm25(table(s, d, "documents"), WORDS).where("not isnan(score)").select("doc_id", F.round("score", 5).alias("score"))


@query("f3_bm25_okapi", BM + "select doc_id, round(s, 5) as score from ok order by s desc, doc_id limit 20")
def f3_okapi(s, d):
    return search.bm25(table(s, d, "documents"), WORDS, 20, variant="okapi").select("doc_id", F.round("score", 5).alias("score"))


U1 = BM + f", a as (select doc_id as id, row_number() over (order by round(s, 9) desc, doc_id) as r from ok qualify r <= 50), v as (select vec_id as id, row_number() over (order by {COS} desc, vec_id) as r from embeddings qualify r <= 50) select id, round(sum(1 / (60.0 + r)), 6) as score from (select * from a union all select * from v) group by id"


@query("u1_f4_rank_fusion", U1)
def u1_fusion(s, d):
    text = search.bm25(table(s, d, "documents"), WORDS, variant="okapi").select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    near = vecs(s, d).select(F.col("vec_id").alias("id"), V.cosine(emb(), q()).alias("score"))
    fused = search.fuse([search.ranked(text, "id", False, 50), search.ranked(near, "id", False, 50)], "id")
    return fused.select("id", F.round("score", 6).alias("score"))


@query("f5_contains", "select doc_id, contains(text, 'the') as has, contains(lower(text), 'the') as any_case from documents")
def f5_contains(s, d):
    return table(s, d, "documents").select("doc_id", X.contains(F.col("text"), "the").alias("has"), X.contains_any_case(F.col("text"), "THE").alias("any_case"))


# ---- topology

POINT = f"[x - floor(x) for x in ({E})[1:4]]"
PTS = f"pts as (select vec_id as id, {POINT} as v from embeddings)"
PAIRS = PTS + f", pr as (select a.id as a, b.id as b, {torus('a.v', 'b.v')} as dist from pts a join pts b on a.id <> b.id), near as (select * from pr where dist <= 0.06)"


def points(s, d):
    return vecs(s, d).select(F.col("vec_id").alias("id"), V.wrap(F.slice(emb(), 1, 4)).alias("vec"))


@query("o1_homotopy", f"select vec_id, [case when z[2] - z[1] > 0.5 then 1 when z[2] - z[1] < -0.5 then -1 else 0 end for z in list_zip([x - floor(x) for x in {E}], {WRAPPED})] as wrap, list_sum([abs(case when z[2] - z[1] > 0.5 then 1 when z[2] - z[1] < -0.5 then -1 else 0 end) for z in list_zip([x - floor(x) for x in {E}], {WRAPPED})]) as cost from embeddings")
def o1_homotopy(s, d):
    w = V.homotopy_wrap(V.wrap(emb()), V.vector([x % 1.0 for x in Q]))
    return vecs(s, d).select("vec_id", w.alias("wrap"), V.homotopy_cost(w).cast("long").alias("cost"))


@query("o2_distance_class", f"select id, round({torus('v', '[0.9, 0.1, 0.5, 0.05]')}, 6) as dist, case when list_bool_or([abs(z[2] - z[1]) > 0.5 for z in list_zip(v, [0.9, 0.1, 0.5, 0.05])]) then 'wrapped' else 'direct' end as kind from (with {PTS} select * from pts)")
def o2_class(s, d):
    at = V.vector([0.9, 0.1, 0.5, 0.05])
    return points(s, d).select("id", F.round(V.torus_distance(F.col("vec"), at), 6).alias("dist"), V.homotopy_class(F.col("vec"), at)["kind"].alias("kind"))


@query("o5_apply_homotopy", f"with {PTS} select id, [round((x + 0.5) - floor(x + 0.5), 6) for x in v] as moved from pts")
def o5_apply(s, d):
    return points(s, d).select("id", F.transform(V.apply_homotopy(F.col("vec"), None), lambda x: F.round(x, 6)).alias("moved"))


@query("o12_close_pairs", f"with {PAIRS} select a, b, round(dist, 6) as dist from near")
def o12_pairs(s, d):
    return topology.close_pairs(points(s, d), 0.06, axes=4).select("a", "b", F.round("dist", 6).alias("dist"))


@query("o7_centrality", f"with {PAIRS} select id, round(coalesce(c, 0), 6) as centrality from pts left join (select a, avg(1 / (1 + dist)) as c from near group by a) on a = id")
def o7_centrality(s, d):
    return topology.centrality(points(s, d), 0.06).select("id", F.round("centrality", 6).alias("centrality"))


RICCI = PAIRS + """, m as (select n.a, n.b, avg(case when x.b = y.b then 0 else p.dist end) as m from near n join near x on x.a = n.a and x.b <> n.b join near y on y.a = n.b and y.b <> n.a left join pr p on p.a = x.b and p.b = y.b group by n.a, n.b),
rc as (select near.a, near.b, case when dist = 0 then 1 when m is null then 0 else 1 - m / dist end as ricci from near left join m using (a, b)) """


@query("o6_ricci", f"with {RICCI} select a, b, round(ricci, 5) as ricci from rc")
def o6_ricci(s, d):
    p = points(s, d)
    return topology.ricci(p, None, 0.06).select("a", "b", F.round("ricci", 5).alias("ricci"))


@query("o11_features", f"with {RICCI} select id, round(coalesce(c, 0), 5) as centrality, round(coalesce(k, 0), 5) as curvature from pts left join (select a, avg(1 / (1 + dist)) as c from near group by a) x on x.a = id left join (select a, avg(ricci) as k from rc group by a) y on y.a = id")
def o11_features(s, d):
    return topology.features(points(s, d), 0.06).select("id", F.round("centrality", 5).alias("centrality"), F.round("curvature", 5).alias("curvature"))


@query("o9_curvature_flow")
def o9_flow(s, d):
    p = points(s, d)
    return topology.flow(p, topology.ricci(p, None, 0.06), rounds=2)


@query("a10_vector_mean", f"with p as (select label, generate_subscripts(embedding, 1) as pos, unnest({E}) as x from embeddings), m as (select label, pos, avg(x) as x from p group by 1, 2) select label, list(round(x, 6) order by pos) as vector from m group by label")
def a10_mean(s, d):
    r = relational.vector_aggregate(vecs(s, d), "embedding", "avg", ["label"])
    return r.select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))
