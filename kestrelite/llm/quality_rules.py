"""Quality rules: robust multivariate outliers by minimum covariance determinant, with DataFrame functions only.

Every text gives a vector of transformed statistics. For each (lang, source) a deterministic MCD is fitted from three starts:
medians with absolute deviations, the covariance of tanh-transformed robust scores, and that of their spatial signs. Each start
takes its own concentration steps, side by side in the same passes: the share ``H`` of rows nearest to the current centre gives
the next mean and covariance. The start whose covariance ends with the least determinant is the cell's estimate, and rows
beyond the cut-off on its Mahalanobis distance go.

Defined cases: a null or blank text has zero statistics and fails the base rule; null lang and null source are values of
their own; the rows of cells under ``MIN_CELL`` rows are pooled by language, those of pools under it are pooled once more, and
are kept where that is too small as well; repeated rows each count; columns of the input never clash, as only the named ones
are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, join_small, let, written

#: Transformed statistics, in the order of the estimates. FLOOR: the least standard deviation of each, as most are 0 in clean text.
STATS = ("word_len", "symbols", "repeats", "capitals", "variety")
FLOOR = (0.25, 0.08, 0.12, 0.08, 0.03)
#: Share of a cell that the estimate rests on, rows a cell needs, concentration steps, the chi-square tail of the cut-off,
#: and starts.
H, MIN_CELL, STEPS, TAIL, STARTS = 0.75, 60, 4, 1e-9, 3
SYMBOLS = r"[#*$%&|<>]"
P = len(STATS)
NAMES = {"n_words": "m.n_words", "word_chars": "m.chars.n", "n_symbols": "m.n_symbols", "n_dup_lines": "m.lines.dup", "n_repeat_words": "m.hashes.n"}


def _chi2_tail(x: float, k: int) -> float:
    """P(chi-square with ``k`` degrees of freedom > x), by the recurrence over k that starts at 1 or 2."""
    z = max(x, 0.0) / 2
    tail, a = (math.erfc(math.sqrt(z)), 0.5) if k % 2 else (math.exp(-z), 1.0)
    while a < k / 2:
        tail += math.exp(a * math.log(z) - z - math.lgamma(a + 1)) if z else 0.0
        a += 1
    return tail


def chi2_cutoff(tail: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_tail(mid, k) > tail else (lo, mid)
    return hi


def _repeated(hashed: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, from the words' hashes.

    Windows are told apart by a 64-bit hash; only texts in which two hashes agree reach the sorting branch.
    """

    def covered(hashes: Column) -> Column:
        def in_order(pairs: Column) -> Column:
            same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
            starts = F.array_sort(F.filter(F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]).otherwise(-1)), lambda i: i >= 0))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
            step = lambda a, i: F.struct((a["n"] + i + 8 - F.greatest(i, a["e"])).alias("n"), (i + 8).alias("e"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, in_order))

    # Hashes of 2, then 4, then 8 words in a row: each step joins a list with itself, shifted.
    join = lambda h, k: F.zip_with(h, F.slice(h, k + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    windows = let(join(hashed, 1), lambda h2: let(join(h2, 2), lambda h4: F.slice(join(h4, 4), 1, F.size(h4) - 7)))
    return F.when(F.size(hashed) < 9, 0).otherwise(let(windows, covered))


def measures(text: Column) -> Column:
    """The base figures of one text and what the vector needs, as one struct; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        of_words = let(F.array_join(words, ""), lambda x: F.struct(F.length(x).alias("n"), F.regexp_count(x, F.lit(r"\p{Lu}")).alias("upper")))
        of_hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(_repeated(h).alias("n"), F.size(F.array_distinct(h)).alias("distinct")))
        of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        return F.struct(F.size(words).alias("n_words"), of_words.alias("chars"), F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), of_lines.alias("lines"), of_hashes.alias("hashes"))

    return let(F.array_remove(F.split(text, SPACE), ""), of)


def _vector(m: Column) -> list[Column]:
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    return [
        m["chars"]["n"] / n,
        F.sqrt(m["n_symbols"] / n),
        F.sqrt(F.greatest(m["hashes"]["n"] / n, m["lines"]["dup"] / F.greatest(m["lines"]["n"], F.lit(1)))),
        F.sqrt(m["chars"]["upper"] / F.greatest(m["chars"]["n"], F.lit(1))),
        # Herdan's measure, less what it owes to length
        F.log(F.greatest(m["hashes"]["distinct"], F.lit(1)).cast("double")) / F.greatest(F.log(n), F.lit(1.0)) + 0.02 * F.log(n),
    ]


def _distance(est: str) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor in struct column ``est``."""
    y: list[Column] = []
    for i in range(P):
        r = F.col(f"x{i}") - F.col(f"{est}.m{i}")
        for j in range(i):
            r = r - F.col(f"{est}.l{i}_{j}") * y[j]
        y.append(r / F.col(f"{est}.l{i}_{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(cells: DataFrame, scale: float, starts: int) -> DataFrame:
    """From means ``m`` and raw second moments ``s`` of each start: ``est0..``, each a mean, a Cholesky factor and log determinant.

    The factor is that of the scaled covariance plus the floors.
    """
    for t in range(starts):
        for i in range(P):
            row: list[Column] = []
            for j in range(i + 1):
                c = scale * (F.col(f"s{t}_{i}_{j}") - F.col(f"m{t}_{i}") * F.col(f"m{t}_{j}"))
                if i == j:
                    c = F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2
                for k in range(j):
                    c = c - row[k] * (row[k] if i == j else F.col(f"l{t}_{j}_{k}"))
                row.append(F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{t}_{j}_{j}"))
            cells = cells.withColumns({f"l{t}_{i}_{j}": c for j, c in enumerate(row)})
    parts = []
    for t in range(starts):
        of = [F.col(f"m{t}_{i}").alias(f"m{i}") for i in range(P)] + [F.col(f"l{t}_{i}_{j}").alias(f"l{i}_{j}") for i in range(P) for j in range(i + 1)]
        logs = [2 * F.log(F.col(f"l{t}_{i}_{i}")) for i in range(P)]
        parts.append(F.struct(*of, sum(logs[1:], logs[0]).alias("det")).alias(f"est{t}"))
    return cells.select("cell", *parts)


def _moments(rows: DataFrame, inside: list[Column], values: list[list[Column]]) -> DataFrame:
    """Means and raw second moments of ``values[t]`` over the rows ``inside[t]``, for each start t and cell.

    Plain sums, so partial aggregation keeps a hot cell off one task.
    """
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums, out = [], []
    for t, (near, x) in enumerate(zip(inside, values)):
        n = F.count(F.when(near, 1)).alias(f"n{t}")
        sums += [n, *[F.sum(F.when(near, x[i])).alias(f"m{t}_{i}") for i in range(P)], *[F.sum(F.when(near, x[i] * x[j])).alias(f"s{t}_{i}_{j}") for i, j in pairs]]
        out += [(F.col(c) / F.col(f"n{t}")).alias(c) for c in [f"m{t}_{i}" for i in range(P)] + [f"s{t}_{i}_{j}" for i, j in pairs]]
    return rows.groupBy("cell").agg(*sums).select("cell", *out)


def estimates(vectors: DataFrame, cells: int) -> DataFrame:
    """(cell, est, start): the MCD estimate of each ``cell`` of a table (cell, x0..). Aggregates only, so no cell is gathered."""
    scale = H / (1 - _chi2_tail(chi2_cutoff(1 - H, P), P + 2))  # consistency at the normal distribution
    med = checkpointed(vectors.groupBy("cell").agg(*[F.percentile_approx(f"x{i}", 0.5, 2000).alias(f"c{i}") for i in range(P)]))
    dev = join_small(vectors, med, ["cell"], rows=cells)
    mad = dev.groupBy("cell").agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, 2000).alias(f"a{i}") for i in range(P)])
    mad = checkpointed(join_small(mad, med, ["cell"], rows=cells).select("cell", *[f"c{i}" for i in range(P)], *[(1.4826 * F.col(f"a{i}") + FLOOR[i]).alias(f"d{i}") for i in range(P)]))
    # robust scores; their tanh and their spatial sign have covariances that outliers hardly move
    scored = join_small(vectors, mad, ["cell"], rows=cells)
    z = [(F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}") for i in range(P)]
    scored = scored.select("cell", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))), F.lit(1e-9))
    every = F.lit(True)
    first = _moments(scored, [every, every], [[F.tanh(F.col(f"z{i}")) for i in range(P)], [F.col(f"z{i}") / norm for i in range(P)]])
    first = join_small(first, mad, ["cell"], rows=cells)
    made: list[Column] = []
    for t in range(STARTS):
        var = lambda i: F.greatest(F.col(f"s{t - 1}_{i}_{i}") - F.col(f"m{t - 1}_{i}") * F.col(f"m{t - 1}_{i}"), F.lit(1e-9))  # noqa: E731, B023
        for i in range(P):
            made.append(F.col(f"c{i}").alias(f"m{t}_{i}"))
            for j in range(i + 1):
                unit = F.lit(1.0) if i == j else F.lit(0.0) if t == 0 else (F.col(f"s{t - 1}_{i}_{j}") - F.col(f"m{t - 1}_{i}") * F.col(f"m{t - 1}_{j}")) / F.sqrt(var(i) * var(j))
                made.append((unit * F.col(f"d{i}") * F.col(f"d{j}") / scale + F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{t}_{i}_{j}"))
    est = checkpointed(_factor(checkpointed(first.select("cell", *made)), scale, STARTS))
    for _ in range(STEPS):
        at = join_small(vectors, est, ["cell"], rows=cells)
        at = at.select("cell", *[f"x{i}" for i in range(P)], *[_distance(f"est{t}").alias(f"d2_{t}") for t in range(STARTS)])
        cut = checkpointed(at.groupBy("cell").agg(*[F.percentile_approx(f"d2_{t}", H, 2000).alias(f"cut{t}") for t in range(STARTS)]))
        near = join_small(at, cut, ["cell"], rows=cells)
        x = [F.col(f"x{i}") for i in range(P)]
        est = checkpointed(_factor(_moments(near, [F.col(f"d2_{t}") <= F.col(f"cut{t}") for t in range(STARTS)], [x] * STARTS), scale, STARTS))
    least = F.array_min(F.array(*[F.struct(F.col(f"est{t}.det").alias("det"), F.lit(t).alias("start")) for t in range(STARTS)]))["start"]
    pick = F.element_at(F.array(*[F.col(f"est{t}") for t in range(STARTS)]), F.col("start") + 1)
    return est.withColumn("start", least).select("cell", "start", pick.alias("est"))


def judge(docs: DataFrame, columns: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``columns`` of ``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept``."""
    keep = docs.columns if columns is None else columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), measures(F.col(text)).alias("m"))
    base = (F.col("m.n_words") < 20) | (100 * F.col("m.hashes.n") > 30 * F.col("m.n_words"))
    key = lambda k, *c: F.xxhash64(F.lit(k), *[F.coalesce(x.cast("string"), F.lit("\0")) for x in c])
    levels = [key(0, F.col("lang"), F.col("source")), key(1, F.col("lang"))]
    docs = written(docs, "quality")  # written before anything refers to a field of m, or each reference would measure anew
    # A cell too small to estimate joins the pool of its language, then that of the whole table: this depends on counts only.
    sizes = checkpointed(docs.where(~base).groupBy(levels[0].alias("k0"), levels[1].alias("k1")).agg(F.count(F.lit(1)).alias("n0")))
    cells = sizes.count()
    small = sizes.where(F.col("n0") < MIN_CELL)
    pools = small.groupBy("k1").agg(F.sum("n0").alias("n1"))
    rest = pools.where(F.col("n1") < MIN_CELL).agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n2")).first()["n2"]
    last = F.when(F.lit(rest >= MIN_CELL), key(2))
    use = join_small(sizes, pools, ["k1"], rows=cells)
    use = checkpointed(use.select("k0", F.when(F.col("n0") >= MIN_CELL, F.col("k0")).when(F.col("n1") >= MIN_CELL, F.col("k1")).otherwise(last).alias("cell")))
    docs = join_small(docs.withColumn("k0", levels[0]).withColumn("base_failed", base), use, ["k0"], rows=cells)
    docs = docs.select("row", "m", "base_failed", "cell", *[x.alias(f"x{i}") for i, x in enumerate(_vector(F.col("m")))])
    vectors = written(docs.where("not base_failed and cell is not null").select("cell", *[f"x{i}" for i in range(P)]), "quality-fit")
    judged = join_small(docs, estimates(vectors, cells), ["cell"], rows=cells).withColumn("d2", _distance("est"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_cutoff(TAIL, P), F.lit(True))
    return judged.select("row.*", *[F.col(c).cast("long").alias(n) for n, c in NAMES.items()], "base_failed", F.sqrt("d2").alias("distance"), kept.alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    return judge(inner, ["doc"]).where("kept").select("doc.*")
