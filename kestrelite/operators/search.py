"""Vector and text search as DataFrame functions: thresholds, top-k, fusion, BM25, approximate indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelite.functions import text as X
from kestrelite.functions import vector as V

METRICS = {"cosine": (V.cosine, False), "euclidean": (V.euclidean, True), "manhattan": (V.manhattan, True), "torus": (V.torus_distance, True)}


def prefix_search(nodes: DataFrame, query: list[float], dim: int, threshold: float, vec: str = "embedding") -> DataFrame:
    """Rows whose first ``dim`` coordinates lie within ``threshold`` of the query on the torus; column ``score``."""
    q = V.pad_or_truncate(V.vector(query), dim)
    near = nodes.where(F.size(vec) >= dim).withColumn("score", V.torus_distance(F.slice(vec, 1, dim), q))
    return near.where(F.col("score") <= threshold)


def wrapped_search(nodes: DataFrame, query: list[float], dim: int = 1536, threshold: float = 0.3, vec: str = "embedding") -> DataFrame:
    """``prefix_search`` after taking the query modulo 1."""
    return prefix_search(nodes, [q % 1.0 for q in query], dim, threshold, vec)


def top(df: DataFrame, key: str, k: int = 10, ascending: bool = True, by: str = "score") -> DataFrame:
    """The k best by score, ties by key: one TakeOrdered, no global sort."""
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), key).limit(k)


def nearest(nodes: DataFrame, query: list[float], k: int, metric: str = "cosine", vec: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """Exact k nearest; a payload filter is applied before the ranking, so k rows come back where there are k."""
    f, ascending = METRICS[metric]
    rows = nodes if where is None else nodes.where(where)
    return top(rows.withColumn("score", f(F.col(vec), V.vector(query))), key, k, ascending)


def within(nodes: DataFrame, query: list[float], radius: float, metric: str = "euclidean", vec: str = "embedding") -> DataFrame:
    """All rows at most ``radius`` away (or, for cosine, at least that similar)."""
    f, ascending = METRICS[metric]
    rows = nodes.withColumn("score", f(F.col(vec), V.vector(query)))
    return rows.where(F.col("score") <= radius if ascending else F.col("score") >= radius)


def widened(nodes: DataFrame, query: list[float], dim: int, threshold: float, least: int = 10, vec: str = "embedding") -> DataFrame:
    """Hits within the threshold, or within 1.5 times it if they are fewer than ``least``; one scan."""
    wide = prefix_search(nodes, query, dim, 1.5 * threshold, vec)
    n = wide.agg(F.count(F.when(F.col("score") <= threshold, 1)).alias("__n"))
    return wide.crossJoin(F.broadcast(n)).where((F.col("score") <= threshold) | (F.col("__n") < least)).drop("__n")


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank from 1)."""
    every = lists[0].select(key, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(df: DataFrame, key: str, ascending: bool, k: int) -> DataFrame:
    """Ranks of the k best: numbered after the top-k, so the unpartitioned window sees k rows only."""
    best = top(df, key, k, ascending)
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, F.col(key))))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl): term counts of each document with its length in tokens."""
    t = docs.select(key, X.tokens(F.col(text)).alias("t"))
    return t.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: str, k: int | None = None, key: str = "doc_id", text: str = "text", variant: str = "occurrence", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of all documents that hold a query token.

    ``occurrence``: df counts occurrences, lengths are cut at 255 and each occurrence adds the same; ``okapi``: document
    frequency and saturating tf. Only query terms are exploded, so nothing but their postings is shuffled.
    """
    toks = F.filter(F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 1)
    t = docs.select(key, X.tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.filter("t", lambda x: F.array_contains(toks, x)).alias("hit"))
    stats = docs.select(F.size(X.tokens(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"))
    tf = t.where(F.size("hit") > 0).select(key, "dl", F.explode("hit").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg((F.sum("tf") if variant == "occurrence" else F.count(F.lit(1))).alias("df"))
    asked = docs.sparkSession.range(1).select(F.explode(toks).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    rows = tf.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").crossJoin(F.broadcast(stats))
    avg = F.when(F.col("avg") <= 1e-6, 100.0).otherwise(F.col("avg"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    if variant == "occurrence":
        part = F.col("tf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.least("dl", F.lit(255)) / avg))
    else:
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    scored = rows.groupBy(key).agg(F.sum(F.col("times") * idf * part).alias("score"))
    return scored if k is None else top(scored, key, k, ascending=False)


def modulate(scored: DataFrame, weights: dict[str, float], label: str = "label") -> DataFrame:
    """Score times 1 plus the summed context weights of the row's label, weights in [-1, 1], their sum in [-0.5, 0.5]."""
    boost = F.lit(0.0)
    for name, w in weights.items():
        boost = boost + F.when(F.col(label).cast("string") == name, max(-1.0, min(1.0, w))).otherwise(0.0)
    return scored.withColumn("score", F.col("score") * (1 + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), boost))))


def decay(weights: DataFrame, rate: float) -> DataFrame:
    """Context weights one step on; those that fade to 0.001 are dropped."""
    return weights.withColumn("weight", F.col("weight") * (1 - rate)).where(F.abs("weight") > 0.001)


def hot_nodes(accesses: DataFrame, key: str, decay_: float = 0.05, threshold: float = 3.0) -> DataFrame:
    """Access scores after n accesses, s <- (s + 1)(1 - decay), in closed form; hot above the threshold."""
    q = 1 - decay_
    n = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    s = n.withColumn("score", F.lit(q) * (1 - F.pow(F.lit(q), F.col("n"))) / (1 - q))
    return s.select(key, "n", "score", (F.col("score") > threshold).alias("hot"), F.least(F.col("score") / 100, F.lit(1.0)).alias("probability"))


def hybrid(nodes: DataFrame, query: list[float], features: DataFrame, k: int, rerank: int = 100, key: str = "vec_id") -> DataFrame:
    """0.7 vector + 0.3 topological score over the ``rerank`` nearest; negative scores s count as 1 + s."""
    best = nearest(nodes, query, rerank, "cosine", key=key)
    fix = lambda c: F.when(c < 0, 1 + c).otherwise(c)
    joined = best.join(features, key, "left")
    return top(joined.withColumn("score", 0.7 * fix(F.col("score")) + 0.3 * fix(F.coalesce("centrality", F.lit(0.0)))), key, k, ascending=False)


def lsh_nearest(nodes: DataFrame, query: list[float], k: int, key: str = "vec_id", vec: str = "embedding", tables: int = 12, bucket: float = 1.0, seed: int = 7) -> DataFrame:
    """Approximate k nearest by random projection buckets, re-ranked exactly (Euclidean)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = nodes.withColumn("v", array_to_vector(F.col(vec).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows.limit(1))
    hits = model.approxNearestNeighbors(rows, Vectors.dense(query), k)
    return hits.select(key, F.col("distCol").alias("score"))


def ivf_nearest(nodes: DataFrame, query: list[float], k: int, lists: int = 16, probes: int = 12, key: str = "vec_id", vec: str = "embedding", seed: int = 7, sample: int = 100_000) -> DataFrame:
    """Inverted lists by k-means (fitted on at most ``sample`` rows, every row indexed); the nearest ``probes`` are ranked exactly."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = nodes.withColumn("v", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=lists, seed=seed, maxIter=20, featuresCol="v", predictionCol="list").fit(rows.orderBy(F.xxhash64(key)).limit(sample))
    centres = np.array(model.clusterCenters())
    near = np.argsort(((centres - np.array(query)) ** 2).sum(axis=1), kind="stable")[:probes]
    return nearest(model.transform(rows).where(F.col("list").isin([int(i) for i in near])), query, k, "euclidean", vec, key).select(key, "score")


def recommend_index(rows: int, dim: int, filtered: bool = False) -> str:
    """Which search to use: exact while a scan is cheap or a filter is selective, lists beyond."""
    if rows < 10_000 or filtered:
        return "exact"
    return "lsh" if dim <= 128 else "ivf"


#: Texts that a Python worker gets at a time, and words that it remembers.
TEXTS, WORDS = 500, 300_000


def hash_embedding(texts: DataFrame, dim: int = 64, text: str = "text", prefix: str = "passage: ") -> DataFrame:
    """A deterministic pseudo-embedding of each text (column ``embedding``), in vectorised Python.

    A worker gets ``TEXTS`` texts at a time, as they may be long, and forgets its words when they are many.
    """
    conf = texts.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, TEXTS) if rows > 0 else TEXTS))

    @F.pandas_udf("array<float>")
    def embed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        i = np.arange(dim)
        waves = (np.arange(1000)[:, None] + 31 * i) % 1000 / 1000
        known: dict[str, int] = {}

        def number(w: str) -> int:
            if w not in known:
                if len(known) >= WORDS:
                    known.clear()
                h = 0
                for b in w.encode():
                    h = (31 * h + b) & 0xFFFFFFFF
                known[w] = h % 30000 + 1000
            return known[w]

        for col in columns:
            out = []
            for t in col.fillna(""):
                n, times = np.unique([number(w) for w in (prefix + t).lower().split()], return_counts=True)
                v = (times * np.sin(n / 1000)) @ waves[17 * n % 1000] * np.cos(i / 100)
                m = np.linalg.norm(v)
                out.append((v / m if m > 0 else v).astype(np.float32))
            yield pd.Series(out)

    return texts.withColumn("embedding", embed(F.col(text)))
