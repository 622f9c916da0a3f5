"""Near-duplicate documents: chosen-path set similarity join over minwise tokens, confirmed on full shingle sets.

1. One pass gives each document the size of its shingle set, a 128-bit key of the set and ``TREES * DEPTH`` minwise tokens.
   Documents with equal sets form a class and go on as one representative, so copies cost nothing further.
2. In each of ``TREES`` independent trees, representatives branch by their minwise token for the path. A node of at most
   ``LEAF`` members is a leaf; a larger one branches again by the next token. Every larger node also links its members to
   its smallest member, so that big groups of variants stay connected without all their pairs.
3. Leaves are compared exhaustively on the minwise tokens. Pairs whose estimate is at least ``LEAST`` are candidates: first
   a spanning forest of each leaf is confirmed on the full sets, then whatever candidates still lie between components.
4. Nodes that are still large at the last level, and hold several components, give the pairs between their components.

Recall: a pair of similarity s meets in a tree with probability s**d, d the level of its leaf, so at s = 0.8 ten trees
miss it with probability 0.2**10 for leaves at level 1 and 0.36**10 at level 2 (under 4e-5); a real pair's estimate from
40 tokens falls under ``LEAST`` with probability below 6e-6. Links are never accepted without the full sets.

Defined cases: null or blank texts have no shingles and link with nothing; texts of fewer words than a shingle have one
shingle, the whole sequence; rows that share an id are one document (their sets' links are joined); rows with a null id
are left alone: their component is null and they are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, join_small, written
from .components import components

TREES, DEPTH, LEAF, LEAST = 10, 4, 24, 0.5
#: Rows of id lists up to which they are broadcast (16 bytes each); beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Copies from which a class is joined apart from the others, as its rows would all meet in one task.
HOT = 20_000

#: Bytes of a text that are hashed at once; more only where a single word is longer.
PIECE = 1 << 15
_WHITE = b" \t\n\r\x0b\x0c"
#: Values of bytes in words: 1 to 256, A-Z as a-z; 0 for white space.
_VALUE = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8).astype(np.uint64) + np.uint64(1)
_VALUE[list(_WHITE)] = 0
_BASE = 0x9E3779B97F4A7C15
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D], dtype=np.uint64)
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def powers(n: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base of word hashes, and of its inverse, modulo 2**64."""
    both = (np.full(n, p % (1 << 64), np.uint64) for p in (_BASE, pow(_BASE, -1, 1 << 64)))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(p[1:])]) for p in both)


def word_hashes(raw: bytes, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """64-bit hashes of the words of a piece of text in their order: polynomials of the bytes from prefix sums, mixed."""
    if len(raw) > len(tables[0]):
        tables = powers(len(raw))
    v = _VALUE[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(raw) + 2, bool)
    np.not_equal(v, 0, out=inside[1:-1])
    ends = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = ends[::2], ends[1::2]
    v *= tables[0][: len(raw)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
    h = (total[hi] - total[lo]) * tables[1][lo]
    h ^= h >> np.uint64(32)
    h *= _M[4]
    h ^= h >> np.uint64(29)
    return h


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces of ``PIECE`` bytes or less, cut at white space; longer only to the end of a word."""
    i = 0
    while i < len(raw):
        j = i + PIECE
        if j < len(raw):
            j = max(raw.rfind(c, i, j) for c in _WHITE)
            if j <= i:
                j = min((k for c in _WHITE if (k := raw.find(c, i + 1)) > 0), default=len(raw))
        yield raw[i:j]
        i = j


def shingle_set(text: str | None, words: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; A-Z lower-cased, split at ASCII white space."""
    found = [word_hashes(p, tables) for p in _pieces((text or "").encode())]
    h = found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint64)
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - words + 1
    s = h[:n] * _M[0]
    for k in range(1, words):
        s += h[k : k + n] * np.uint64(int(_M[k % len(_M)]) * (2 * (k // len(_M)) + 1) % (1 << 64))
    s ^= s >> np.uint64(29)
    s.sort()
    first = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=first[1:])
    return s[first]


def minwise(s: np.ndarray) -> np.ndarray:
    """The set's ``TREES * DEPTH`` minwise tokens, 32 bits of each."""
    low = np.full(len(_A), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            size, key, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words, tables)
                size.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tokens.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(tokens, pa.binary())], names=["id", "n", "key", "tokens"])

    return run


def least(percent: int) -> float:
    """The estimate that makes a pair a candidate; ``LEAST`` at 80."""
    return LEAST * percent / 80


def _leaf_pairs(percent: int):
    """All pairs of each leaf whose estimate reaches ``least(percent)``; ``first`` marks a maximum spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for members in batch.column(0).to_pylist():
                members.sort(key=lambda m: m["id"])
                ids, n = [m["id"] for m in members], np.array([m["n"] for m in members])
                t = np.frombuffer(b"".join(m["tokens"] for m in members), np.uint32).reshape(len(members), -1)
                i, j = np.triu_indices(len(members), 1)
                alike = (t[i] == t[j]).mean(axis=1)
                ok = (alike >= least(percent)) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                root = list(range(len(members)))

                def find(x: int, root: list[int] = root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for k in np.argsort(-alike, kind="stable"):
                    if ok[k] and ids[i[k]] != ids[j[k]]:
                        a, b = find(i[k]), find(j[k])
                        root[max(a, b)] = min(a, b)
                        out[0].append(ids[i[k]])
                        out[1].append(ids[j[k]])
                        out[2].append(a != b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["a", "b", "first"])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            a, b, last, keep = batch.column(0), batch.column(1), (None, None), []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x != last[0]:
                    last = (x, shingle_set(x, words, tables))
                s, t = last[1], shingle_set(y, words, tables)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (id, text) with an id of ``ids``."""
    ids = ids.distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    texts = written(_needed(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))), "texts")
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    arrow_batches(docs.sparkSession)
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long")
    return written(found, "links")


def _nodes(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves (node, id), star pairs (a, b) of larger nodes, and (node, id) of those still large at the last level."""
    words = F.transform(F.sequence(F.lit(0), F.lit(TREES * DEPTH - 1)), lambda i: F.substring(F.col("tokens"), i * 4 + 1, F.lit(4)))
    rows = reps.select("id", words.alias("w")).select("id", "w", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    path = F.xxhash64("tree")
    keys = []
    for d in range(DEPTH):
        path = F.xxhash64(path, F.element_at("w", F.col("tree") * DEPTH + d + 1))
        keys.append(path.alias(f"k{d}"))
    rows = rows.select("id", *keys)
    leaves, stars, large = [], [], None
    for d in range(DEPTH):
        sizes = rows.groupBy(f"k{d}").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
        met = written(rows.join(sizes, f"k{d}"), f"level{d}")
        leaves.append(met.where(F.col("size") <= LEAF).select(F.xxhash64(F.lit(d), f"k{d}").alias("node"), "id"))
        large = met.where(F.col("size") > LEAF)
        stars.append(large.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")))
        rows = large.select("id", *[f"k{e}" for e in range(d + 1, DEPTH)])
        if not large.limit(1).count():
            break
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    return union(leaves), union(stars).distinct(), large.select(F.xxhash64(F.lit(DEPTH), f"k{d}").alias("node"), "id")


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components so far."""
    pairs = pairs.join(comps.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    pairs = pairs.join(comps.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _large_pairs(large: DataFrame, reps: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs between the components that meet in a node still large at the last level; most nodes hold only one."""
    own = large.join(comps, "id", "left").select("node", "id", F.coalesce("component", "id").alias("c"))
    mixed = own.groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("node")
    own = own.join(mixed, "node", "left_semi").join(reps.select("id", "n"), "id")
    x, y = own.toDF(*[f"{c}1" for c in own.columns]), own.toDF(*[f"{c}2" for c in own.columns])
    near = (F.col("id1") < F.col("id2")) & (F.col("c1") != F.col("c2")) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return x.join(y, F.col("node1") == F.col("node2")).where(near).select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id, kept. Links: Jaccard of at least ``percent`` hundredths.

    The number of trees is set for 80 or more; below, links stay right and fewer of them are found. Ids are integers.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = written(docs.mapInArrow(_sketch(words), "id long, n long, key binary, tokens binary"), "sketches")
    known = rows.where("id is not null and key is not null")
    classes = written(known.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")), "classes")
    leaves, stars, large = _nodes(classes)
    members = leaves.join(classes.select("id", F.struct("id", "n", "tokens").alias("m")), "id").groupBy("node").agg(F.collect_list("m").alias("m"))
    pairs = members.select("m").mapInArrow(_leaf_pairs(percent), "a long, b long, first boolean")
    pairs = written(pairs.groupBy("a", "b").agg(F.max("first").alias("first")), "candidates")
    links = confirm(docs, pairs.where("first").select("a", "b").union(stars), words, percent)
    # Rows that share an id are one document: their classes are linked.
    shared = known.select("id", "key").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    shared = known.join(shared, "id", "left_semi").select(F.col("id").alias("a"), "key").join(classes.select("key", F.col("id").alias("b")), "key").select("a", "b")
    links = links.union(shared)
    comps = components(links)
    for more in (lambda: _between(pairs.where("not first"), comps), lambda: _large_pairs(large, classes, comps, percent)):
        rest = written(more(), "rest")
        if rest.limit(1).count():
            links = links.union(confirm(docs, rest, words, percent))
            comps = components(links)
    by_class = classes.join(comps, "id", "left").select("key", F.coalesce("component", "id").alias("component"), "copies")
    hot = by_class.where(F.col("copies") > HOT).select("key", F.col("component").alias("hot"))
    rows = join_small(rows.select("id", "n", "key"), hot, ["key"])
    rest = rows.where("hot is null").drop("hot").join(by_class.where(F.col("copies") <= HOT), "key", "left").select("id", "n", "component")
    rows = rest.union(rows.where("hot is not null").select("id", "n", F.col("hot").alias("component")))
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one per group stays, the smallest id; rows that repeat an id go but for one."""
    judged = written(near_duplicates(docs, words, percent), "judged")
    gone = judged.where("not kept").select("doc_id").distinct()
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    repeated = written(judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)
