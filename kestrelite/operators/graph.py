"""Property-graph traversal and analytics over an edge table (src, dst[, relation_type, weight]).

Loops run on the driver, one join per level; each level's table is checkpointed to the shared folder, so plans stay short
and a lost executor costs no earlier level. Frontiers are anti-joined with what is already reached.
"""

from __future__ import annotations

import itertools
import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in ``spark.checkpoint.dir``; a temporary folder only on a local master that has none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="kestrelite-graph-"))
    return df.checkpoint()


def typed(edges: DataFrame, relation: str | None) -> DataFrame:
    return edges if relation is None else edges.where(F.col("relation_type") == relation)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, distinct, without loops."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbors(edges: DataFrame, nodes: DataFrame, key: int, node: str = "id") -> DataFrame:
    """Nodes one out-edge away from ``key``; dangling targets drop out."""
    out = edges.where(F.col("src") == key).select(F.col("dst").alias(node))
    return nodes.join(out.distinct(), node, "left_semi")


def pattern(a: DataFrame, edges: DataFrame, b: DataFrame, relation: str | None = None, direction: str = "out", node: str = "id") -> DataFrame:
    """(a)-[:R]->(b), <-[:R]- or -[:R]-: pairs (a_id, b_id)."""
    e = typed(edges, relation).select("src", "dst")
    if direction == "in":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        e = undirected(e)
    e = e.join(a.select(F.col(node).alias("src")), "src", "left_semi").join(b.select(F.col(node).alias("dst")), "dst", "left_semi")
    return e.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"))


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int, min_hops: int = 0, relation: str | None = None) -> DataFrame:
    """(id, depth): the least depth of each node within reach of any start (column id)."""
    e = typed(edges, relation).select("src", "dst").distinct()
    seen = frontier = cut(starts.select(F.col("id"), F.lit(0).alias("depth")).distinct())
    for d in range(1, max_hops + 1):
        step = frontier.join(e, frontier["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.union(frontier)
    return seen.where(F.col("depth") >= min_hops)


def within_hops(edges: DataFrame, starts: DataFrame, min_hops: int, max_hops: int, relation: str | None = None) -> DataFrame:
    """(id): nodes whose hop distance from some other start lies between the two; each start is told apart."""
    d = all_distances(typed(edges, relation), starts, max_hops).where("id <> source")
    return d.where(F.col("dist").between(max(min_hops, 1), max_hops)).select("id").distinct()


def connected_to(edges: DataFrame, starts: DataFrame, relation: str, m: int, n: int) -> DataFrame:
    """(id, score): nodes between m and n hops over edges of the type; score (m + n) / 2."""
    return bfs(edges, starts, n, m, relation).select("id", F.lit((m + n) / 2).alias("score"))


def hybrid_graph_vector(edges: DataFrame, close: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """Neighbour and close: 0.7 * distance; neighbour only: 0.5; close only: distance; the first found per node counts.

    ``close``: (start, id, dist). Order of finding: start, neighbours before others, then id.
    """
    near = edges.select(F.col("src").alias("start"), F.col("dst").alias("id")).distinct().join(starts.select(F.col("id").alias("start")), "start", "left_semi")
    both = near.withColumn("n", F.lit(1)).join(close, ["start", "id"], "full_outer")
    score = F.when(F.col("n").isNotNull() & F.col("dist").isNotNull(), 0.7 * F.col("dist")).when(F.col("n").isNotNull(), F.lit(0.5)).otherwise(F.col("dist"))
    found = both.select("id", F.struct("start", F.coalesce("n", F.lit(2)).alias("branch")).alias("o"), score.alias("score"))
    return found.groupBy("id").agg(F.min_by("score", "o").alias("score")).orderBy("score", "id").limit(limit)


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """(id, cost, path): least cost from ``source`` with non-negative weights, by relaxation until nothing improves."""
    spark = edges.sparkSession
    best = cut(spark.createDataFrame([(source, 0.0, [source])], "id long, cost double, path array<long>"))
    changed = best
    while True:
        # a path that comes back to a node is never cheaper, so paths stay simple and the rounds end
        step = changed.join(edges, (F.col("id") == F.col("src")) & ~F.array_contains("path", F.col("dst").cast("long"))).select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array(F.col("dst").cast("long"))).alias("path"))
        step = step.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("s")).select("id", "s.*")
        old = best.select("id", F.col("cost").alias("old"))
        better = cut(step.join(old, "id", "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old"))).drop("old"))
        if better.limit(1).count() == 0:
            break
        best, changed = cut(better.unionByName(best.join(better, "id", "left_anti"))), better
    return best


def simple_paths(edges: DataFrame, source: int, target: int, max_nodes: int) -> DataFrame:
    """All paths (column path) of at most ``max_nodes`` nodes without repeats."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    live = spark.createDataFrame([([source],)], "path array<long>")
    done = live.where(F.lit(source == target))
    for _ in range(max_nodes - 1):
        live = live.where(F.element_at("path", -1) != target).join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array(F.col("dst").cast("long"))).alias("path"))
        live = cut(live)
        done = done.union(live.where(F.element_at("path", -1) == target))
    return done


def all_shortest_paths(edges: DataFrame, source: int, target: int) -> DataFrame:
    """Every path (column path) of least hops: distances from the source, then back from the target along them."""
    e = edges.select("src", "dst").distinct()
    starts = edges.sparkSession.createDataFrame([(source,)], "id long")
    far = cut(all_distances(edges, starts).select("id", "dist"))
    steps = far.where(F.col("id") == target).select("dist").first()
    paths = edges.sparkSession.createDataFrame([([target],)] if steps else [], "path array<long>")
    for d in range(steps[0] if steps else 0, 0, -1):
        before = e.join(far.where(F.col("dist") == d - 1).select(F.col("id").alias("src")), "src")
        paths = cut(paths.join(before, F.element_at("path", 1) == F.col("dst")).select(F.concat(F.array(F.col("src").cast("long")), "path").alias("path")))
    return paths


def path_length(paths: DataFrame, edges: DataFrame, key: str = "path_id") -> DataFrame:
    """Summed weight of the least edge of each step."""
    w = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    steps = paths.select(key, F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as src, path[i] as dst))")).alias("s")).select(key, "s.*")
    return steps.join(w, ["src", "dst"]).groupBy(key).agg(F.sum("weight").alias("length"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (column id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


# ---- analytics


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-degree over N - 1; 0 in a graph of one node."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("id").join(d, "id", "left").crossJoin(F.broadcast(n)).select("id", F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).alias("centrality"))


def all_distances(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, id, dist, sigma): hop distances and numbers of shortest paths from each source, level by level to the end."""
    e = edges.select("src", "dst").distinct()
    seen = level = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1).cast("double").alias("sigma")))
    for d in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        step = level.join(e, level["id"] == e["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        level = cut(step.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(d).alias("dist"), "sigma"))
        if level.limit(1).count() == 0:
            break
        seen = cut(seen.union(level))
    return seen


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Reachable nodes over their summed distance; 0 where nothing is reachable."""
    d = all_distances(edges, sources).where("id <> source").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("s"))
    return sources.select("id").join(d, "id", "left").select("id", F.coalesce(F.col("n") / F.col("s"), F.lit(0.0)).alias("closeness"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of shortest paths through each node, over ordered pairs, divided by (n-1)(n-2); level-by-level back sums."""
    d = cut(all_distances(edges, nodes))
    e = edges.select("src", "dst").distinct()
    top = d.agg(F.max("dist")).first()[0] or 0
    delta = None
    for level in range(top, 0, -1):
        w = d.where(F.col("dist") == level)
        w = w.withColumn("delta", F.lit(0.0)) if delta is None else w.join(delta, ["source", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        v = d.where(F.col("dist") == level - 1).select("source", F.col("id").alias("v"), F.col("sigma").alias("sv"))
        back = w.join(e, w["id"] == e["dst"]).select("source", F.col("src").alias("v"), "sigma", "delta").join(v, ["source", "v"])
        got = cut(back.groupBy("source", F.col("v").alias("id")).agg(F.sum(F.col("sv") / F.col("sigma") * (1 + F.col("delta"))).alias("delta")))
        delta = got if delta is None else delta.unionByName(got)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    through = nodes.select("id") if delta is None else delta.where("id <> source").groupBy("id").agg(F.sum("delta").alias("b"))
    through = through if "b" in through.columns else through.withColumn("b", F.lit(0.0))
    return nodes.select("id").join(through, "id", "left").crossJoin(F.broadcast(n)).select("id", F.when(F.col("n") <= 2, 0.0).otherwise(F.coalesce("b", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).alias("betweenness"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(1-d)/n + d * sum of rank / out-degree; the rank of nodes without out-edges leaks, as in the defining formula."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    e = cut(edges.select("src", "dst").join(out, "src"))
    n = nodes.count()
    rank = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        got = e.join(rank, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("in"))
        rank = nodes.select("id").join(got, "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if k % 3 == 2:
            rank = cut(rank)
    return rank


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float = 0.0, start: float | None = None) -> DataFrame:
    """Power iteration along out-edges, scaled to length 1 each round; stops early under the tolerance."""
    n = nodes.count()
    x = cut(nodes.select("id", F.lit(start or 1.0 / max(n, 1)).alias("x")))
    e = cut(edges.select("src", "dst"))
    for _ in range(rounds):
        got = e.join(x, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("y"))
        got = cut(x.join(got, "id", "left").select("id", "x", F.coalesce("y", F.lit(0.0)).alias("y")))
        norm = got.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 0.0
        if norm < 1e-12:
            return got.select("id", F.lit(0.0).alias("centrality"))
        step = got.agg(F.max(F.abs(F.col("y") / norm - F.col("x")))).first()[0]
        x = cut(got.select("id", (F.col("y") / norm).alias("x")))
        if step < tolerance:
            break
    return x.withColumnRenamed("x", "centrality")


def majority_communities(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Synchronous majority vote of neighbours' labels, the smallest label on a tie. No modularity is optimised."""
    both = cut(undirected(edges))
    label = cut(nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = both.join(label, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        won = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("won"))
        new = cut(label.join(won, "id", "left").select("id", F.coalesce("won", "label").alias("label"), F.col("label").alias("old")))
        label = new.drop("old")
        if new.where("label <> old").limit(1).count() == 0:
            break
    return label


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest node of each undirected component, by minimum labels with pointer jumping."""
    both = cut(undirected(edges))
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        low = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("now"))
        jump = label.select(F.col("id").alias("now"), F.col("component").alias("jump"))
        new = cut(low.join(jump, "now", "left").select("id", "old", F.least("now", F.coalesce("jump", "now")).alias("component")))
        label = new.select("id", "component")
        if new.where("component <> old").limit(1).count() == 0:
            return label


#: Edges that one task of the triangle count should get; and wedges that it has in memory at once.
TASK_EDGES, WEDGES = 1_000_000, 1 << 20


def _count_triangles(a: np.ndarray, b: np.ndarray, same: np.ndarray, mixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given edges and their triangles; where ``mixed``, not those whose edges are all marked ``same``."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(ids)
    order = np.argsort(np.bincount(at, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # each edge points to its end of larger degree, so that a hub starts few wedges
    ends = rank[at].reshape(2, -1)
    code = ends.min(axis=0) * n + ends.max(axis=0)
    by = np.argsort(code)
    code, same = code[by], same[by]
    u, v = np.divmod(code, n)
    later = np.searchsorted(u, u, side="right") - np.arange(len(u)) - 1
    seen = np.zeros(1 << 24, bool)  # most wedges are open, which a table of hashes tells sooner than a search
    slot = lambda c: (c * -7046029254386353131) >> 40 & 0xFFFFFF
    seen[slot(code)] = True
    count, total = np.zeros(n, np.int64), np.concatenate([[0], np.cumsum(later)])
    i = 0
    while i < len(u):
        j = max(i + 1, int(np.searchsorted(total, total[i] + WEDGES, side="right")) - 1)
        e = np.repeat(np.arange(i, j), later[i:j])
        f = e + 1 + np.arange(len(e)) - (total[e] - total[i])
        want = v[e] * n + v[f]
        k = np.flatnonzero(seen[slot(want)])
        e, f, want = e[k], f[k], want[k]
        found = code[np.minimum(np.searchsorted(code, want), len(code) - 1)] == want
        if mixed:
            found &= ~(same[e] & same[f])
        e, f = e[found], f[found]
        for x in (u[e], v[e], v[f]):
            count += np.bincount(x, minlength=n)
        i = j
    met = np.flatnonzero(count)
    return ids[order[met]], count[met]


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles, degree) on the undirected graph.

    Nodes fall into classes by a hash, and a task gets the edges among three classes, in which it finds the triangles that
    have a node in each. An edge goes to as many tasks as there are classes; the wedges, far more, stay inside the tasks.
    """
    both = cut(undirected(edges))
    deg = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    once = both.where("src < dst")
    classes = max(6, math.ceil(math.sqrt(6 * once.count() / TASK_EDGES)))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(classes)).cast("int")
    third = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    sent = once.select(F.col("src").alias("a"), F.col("dst").alias("b"), of("src").alias("p"), of("dst").alias("q")).select("a", "b", "p", "q", third.alias("r"))
    task = F.array_sort(F.array("p", "q", "r"))
    sent = sent.select("a", "b", (F.col("p") == F.col("q")).alias("same"), ((task[0] * classes + task[1]) * classes + task[2]).alias("task"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        k, z = divmod(key[0].as_py(), classes)
        mixed = len({*divmod(k, classes), z}) == 2
        a, b, same = (rows.column(c).to_numpy() for c in ("a", "b", "same"))
        ids, count = _count_triangles(a, b, same, mixed)
        return pa.table({"id": pa.array(ids, rows.column("a").type), "n": pa.array(count, pa.int64())})

    own = sent.groupBy("task").applyInArrow(run, f"id {both.schema['src'].dataType.simpleString()}, n long").groupBy("id").agg(F.sum("n").alias("triangles"))
    return deg.join(own, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"), "degree")


def clustering(edges: DataFrame) -> DataFrame:
    """Mean over nodes of two neighbours or more of triangles over possible pairs; and the global ratio."""
    t = triangles(edges).where("degree >= 2").withColumn("pairs", F.col("degree") * (F.col("degree") - 1) / 2)
    return t.agg(F.coalesce(F.avg(F.col("triangles") / F.col("pairs")), F.lit(0.0)).alias("average"), F.coalesce(F.sum("triangles") / F.sum("pairs"), F.lit(0.0)).alias("global"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, E/N, density and components in one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    c = components(nodes, edges).agg(F.countDistinct("component").alias("components"))
    return n.crossJoin(e).crossJoin(c).select("nodes", "edges", "components", (F.col("edges") / F.col("nodes")).alias("average_degree"), (F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2)).alias("density"))


def path_metrics(nodes: DataFrame, edges: DataFrame, sources: int = 50) -> DataFrame:
    """Diameter and mean path length from the ``sources`` smallest nodes of the undirected graph."""
    d = all_distances(undirected(edges), nodes.orderBy("id").limit(sources)).where("dist > 0")
    return d.agg(F.max("dist").alias("diameter"), F.avg("dist").alias("average_path"))


def layout(nodes: DataFrame, kind: str, vec: str | None = None) -> DataFrame:
    """(id, x, y) by a closed form: circular, grid, hierarchical, vector or hash."""
    row = F.row_number().over(Window.orderBy("id")) - 1 if kind == "grid" else None
    side = F.ceil(F.sqrt(F.lit(nodes.count()))) if kind == "grid" else None
    angle = 2 * 3.141592653589793 * F.col("id") / 100
    at: dict[str, tuple[Column, Column]] = {
        "circular": (F.cos(angle), F.sin(angle)),
        "hierarchical": ((F.col("id") % 100).cast("double"), (F.col("id") % 5).cast("double")),
        "hash": (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0, F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(1000)) / 1000.0),
    }
    if kind == "grid":
        at["grid"] = ((row % side).cast("double"), F.floor(row / side).cast("double"))
    if vec:
        at["vector"] = (F.element_at(vec, 1).cast("double"), F.element_at(vec, 2).cast("double"))
    x, y = at[kind]
    return nodes.select("id", x.alias("x"), y.alias("y"))
