"""Benchmark decontamination: latent semantic retrieval, confirmed by longest common subsequence and answer.

1. One pass over every document's passages (32 words) counts passage frequencies of hashed words and sketches the
   passages' co-occurrence matrix with a random test matrix: a randomised SVD whose partial sums have a fixed size and
   are added up in a tree. No further pass is needed, since the idf scales rows of the sketch and of the test matrix alike.
2. Words are mapped to their rows of the idf-weighted basis (``RANK`` numbers each). Overlapping windows of every whole text
   are sums of those rows; the benchmark items are the stated query set, and windows within cosine ``COSINE`` of an item
   of whose words ``OVERLAP`` are the item's are candidates. Items are taken in blocks of ``MAX_ITEMS``, each of which is
   one more pass over the texts with the same basis; the hits of all blocks are united.
3. A candidate is confirmed in its surroundings: the longest common subsequence of words must cover ``COVER`` of the item,
   and the item's answer (its last quarter) must be covered by ``ANSWER``.

Defined cases: null and empty texts give no passage and no hit, null and empty items are never hit; repeated documents
and items each report; only the named columns are read; empty tables give an empty result. Words are lower-cased in
ASCII and split at ASCII punctuation and white space.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, written

#: The first SKIP directions hold what all texts of a language share; they are left out.
BITS, RANK, SKIP, OVERSAMPLE = 14, 64, 8, 8
PASSAGE, STRIDE = 32, 16
COSINE, OVERLAP, COVER, ANSWER = 0.25, 0.4, 0.7, 0.5
BANDS, FAN_IN = 32, 32
#: Items of a block of the benchmark, which every task of its pass holds (2 ** BITS bytes each), and cosines held at a time.
MAX_ITEMS, AT_ONCE = 10_000, 1 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(6).standard_normal((1 << BITS, SKIP + RANK + OVERSAMPLE)).astype(np.float32)


def _numbers(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words by text, all words' feature numbers in a row, and each text's count."""
    split = [words_of(t) for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    h = np.fromiter(map(zlib.crc32, itertools.chain.from_iterable(split)), np.uint32, int(count.sum()))
    return split, (h * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.intp), count


def _starts(count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's blocks of ``step`` words start, and the text of each block."""
    blocks = (count + step - 1) // step
    text = np.repeat(np.arange(len(count)), blocks)
    first = np.cumsum(blocks) - blocks
    offset = np.cumsum(count) - count
    return offset[text] + (np.arange(len(text)) - first[text]) * step, text


def _sums(rows: np.ndarray, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Sum of ``rows`` over each block of at most ``step`` words; the last row of ``rows`` is zero and fills short blocks."""
    out = np.empty((len(starts), rows.shape[1]), np.float32)
    for b in range(0, len(starts), 8192):
        lo, hi = starts[b : b + 8192], ends[b : b + 8192]
        own = out[b : b + 8192]
        own[:] = 0
        for k in range(step):
            at = lo + k
            own += rows.take(np.where(at < hi, numbers.take(np.minimum(at, len(numbers) - 1)), len(rows) - 1), axis=0)
    return out


def _with_zero(rows: np.ndarray) -> np.ndarray:
    return np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def _ends(starts: np.ndarray, text: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
    return np.minimum(starts + step, np.cumsum(count)[text])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the sums over its passages of (their matrix)' (their matrix) times the test matrix, and frequencies."""
    omega, d = _with_zero(_test_matrix()), 1 << BITS
    z, df, passages = np.zeros((omega.shape[1], d)), np.zeros(d), 0
    for batch in batches:
        _, numbers, count = _numbers(batch.column(0).to_pylist())
        starts, text = _starts(count, PASSAGE)
        ends = _ends(starts, text, count, PASSAGE)
        passages += len(starts)
        for b in range(0, len(starts), 8192):
            lo, hi = starts[b : b + 8192], ends[b : b + 8192]
            y = np.ascontiguousarray(_sums(omega, numbers, lo, hi, PASSAGE).T)
            own = numbers[lo[0] : hi[-1]]
            block = np.repeat(np.arange(len(lo)), hi - lo)
            for k in range(len(y)):
                z[k] += np.bincount(own, y[k].take(block), d)
            pairs = np.sort(own * len(lo) + block)
            df += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] // len(lo), minlength=d)
    if passages:
        z = np.vstack([z, df]).T
        part, size = TaskContext.get().partitionId(), d // BANDS
        rows = [np.ascontiguousarray(z[k * size : (k + 1) * size]).tobytes() for k in range(BANDS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BANDS), pa.int32()), pa.array([part] * BANDS, pa.int64()), pa.array([passages] * BANDS, pa.int64()), pa.array(rows, pa.binary())], names=["band", "part", "n", "z"])


def _add_up(table: pa.Table) -> pa.Table:
    z = sum(np.frombuffer(b.as_py()) for b in table.column("z"))
    n = sum(table.column("n").to_pylist())
    return pa.table({"band": table.column("band").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "n": pa.array([n], pa.int64()), "z": pa.array([z.tobytes()], pa.binary())})


def basis(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The idf-weighted basis: for each hashed word its ``RANK`` coordinates (features times rank floats, a fixed size)."""
    arrow_batches(docs.sparkSession)
    parts = written(docs.select(text).mapInArrow(_sketch, "band int, part long, n long, z binary"), "sketch")
    left = parts.agg(F.max("part")).first()[0]
    if left is None:
        return np.zeros((1 << BITS, RANK), np.float32)
    while True:
        parts = parts.groupBy("band", F.floor(F.col("part") / FAN_IN)).applyInArrow(_add_up, "band int, part long, n long, z binary")
        if left < FAN_IN:
            break
        parts, left = written(parts, "sketch"), left // FAN_IN
    bands = sorted(parts.collect(), key=lambda r: r["band"])  # BANDS rows of a fixed size
    z = np.concatenate([np.frombuffer(r["z"]).reshape(-1, SKIP + RANK + OVERSAMPLE + 1) for r in bands])
    # above 0 also for a word of every passage, or a table of one passage would span nothing
    idf = np.maximum(np.log((1.0 + bands[0]["n"]) / (1.0 + z[:, -1])), 1e-3)[:, None]
    omega, z = _test_matrix().astype(float), z[:, :-1]
    core = omega.T @ z
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    ok = values > values[-1] * 1e-10
    f = (idf * z) @ (vectors[:, ok] / np.sqrt(values[ok]))
    u, size, _ = np.linalg.svd(f, full_matrices=False)
    # few passages span few directions: all but an eighth of them are kept
    skip = min(SKIP, int((size > 1e-9 * max(float(size.max(initial=0.0)), 1e-300)).sum()) // 8)
    u = u[:, skip : skip + RANK]
    out = np.zeros((1 << BITS, RANK), np.float32)
    out[:, : u.shape[1]] = idf * idf * u  # once for the item or window, once for the basis
    return out


def common_words(item_bits: dict[bytes, int], words: list[bytes]) -> int:
    """The set of item positions (a bit mask) left unmatched by a longest common subsequence; bit-parallel."""
    v = -1
    for w in words:
        m = item_bits.get(w)
        if m:
            v = (v + (v & m)) | (v & ~m)
    return v


class Items:
    """The benchmark, ready for matching."""

    def __init__(self, rows: Sequence[tuple[int, str]], base: np.ndarray) -> None:
        rows = [(i, t) for i, t in rows if words_of(t)]
        split, numbers, count = _numbers([t for _, t in rows])
        offset = np.cumsum(count) - count
        self.ids, self.words = [i for i, _ in rows], split
        self.vectors = _unit(_sums(base, numbers, offset, offset + count, int(count.max(initial=1))))
        self.sets = [frozenset(w) for w in split]
        self.holds = np.zeros((len(rows), 1 << BITS), bool)
        self.holds[np.repeat(np.arange(len(rows)), count), numbers] = True
        self.least = np.minimum(np.array([len(x) for x in self.sets]), PASSAGE) * OVERLAP
        self.bits: list[dict[bytes, int]] = []
        for w in split:
            own: dict[bytes, int] = {}
            for k, x in enumerate(w):
                own[x] = own.get(x, 0) | 1 << k
            self.bits.append(own)

    def check(self, k: int, words: list[bytes], lo: int, hi: int) -> tuple[float, float] | None:
        """Cover of item ``k`` and of its answer around ``words[lo:hi]``, if both are enough."""
        m, own = len(self.words[k]), self.sets[k]
        around = words[max(0, lo - m) : hi + m]
        if len(own.intersection(around)) < COVER * len(own):
            return None
        full = (1 << m) - 1
        cover = (~common_words(self.bits[k], around) & full).bit_count() / m
        if cover < COVER:
            return None
        tail = max(3, m // 4)
        answer = {w: b >> max(0, m - tail) for w, b in self.bits[k].items() if b >> max(0, m - tail)}
        answered = (~common_words(answer, around) & ((1 << min(tail, m)) - 1)).bit_count() / min(tail, m)
        return (cover, answered) if answered >= ANSWER else None


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item it holds: key, item_id, cosine, cover, answer_cover."""
    spark = docs.sparkSession
    base = spark.sparkContext.broadcast(basis(docs, text))
    arrow_batches(spark)
    asked = benchmark.select(item, item_text).where(F.col(item_text).isNotNull())
    rows = ((r[0], r[1]) for r in asked.toLocalIterator())
    item_kind = benchmark.schema[item].dataType.simpleString()
    found = [_block_hits(docs, base, block, key, text, item_kind) for block in itertools.batched(rows, MAX_ITEMS)]
    return functools.reduce(DataFrame.unionAll, found or [_block_hits(docs, base, (), key, text, item_kind)])


def _block_hits(docs: DataFrame, base: Broadcast, rows: tuple[tuple, ...], key: str, text: str, item_kind: str) -> DataFrame:
    """The hits of one block of items (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _with_zero(base.value)
        index = Items(shared.value, own)
        step = max(1, min(4096, AT_ONCE // max(1, len(index.ids))))
        for batch in batches:
            found: list[tuple] = []
            split, numbers, count = _numbers(batch.column(1).to_pylist())
            if len(numbers) and index.ids:
                starts, text_of = _starts(count, STRIDE)
                window = _sums(own, numbers, starts, _ends(starts, text_of, count, STRIDE), STRIDE)
                same = np.flatnonzero(text_of[1:] == text_of[:-1])
                window[same] += window[same + 1]
                window = _unit(window)
                offset = np.cumsum(count) - count
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for lo in range(0, len(window), step):
                    alike = window[lo : lo + step] @ index.vectors.T
                    at, item_of = np.divmod(np.flatnonzero((alike >= COSINE).ravel()), len(index.ids))
                    # of the candidates, those whose words are the item's often enough
                    places = np.minimum(starts[lo + at][:, None] + np.arange(PASSAGE), len(numbers) - 1)
                    enough = index.holds[item_of[:, None], numbers[places]].sum(axis=1) >= index.least[item_of]
                    for b, k in zip(at[enough].tolist(), item_of[enough].tolist()):
                        t = int(text_of[lo + b])
                        if (t, k) not in best:
                            first = int(starts[lo + b] - offset[t])
                            if ok := index.check(k, split[t], first, first + PASSAGE):
                                best[t, k] = (float(alike[b, k]), *ok)
                keys = batch.column(0)
                found = [(keys[t].as_py(), index.ids[k], *v) for (t, k), v in sorted(best.items())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (keys.type, None, pa.float64(), pa.float64(), pa.float64()))], names=[key, "item_id", "cosine", "cover", "answer_cover"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, item_id {item_kind}, cosine double, cover double, answer_cover double")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id are told apart by their texts."""
    known = F.concat(F.lit("id "), F.col("doc_id").cast("string"))
    keyed = docs.withColumn("__row", F.coalesce(known, F.concat(F.lit("text "), F.sha2("text", 256))))
    gone = written(hits(keyed, benchmark, "__row").select("__row").distinct(), "contaminated")
    small = gone.limit(1_000_001).count() <= 1_000_000
    return keyed.join(F.broadcast(gone) if small else gone, "__row", "left_anti").drop("__row")
