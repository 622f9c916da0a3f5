"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are counted into cells (source, language, topic). The cells' tokens are raked in turn until each marginal holds
its target share; a cell's ratio of raked to present tokens is the probability with which each of its documents stays. No cell
can give more than it has, so each step of the fit is bounded by the cell's tokens, and the budget is, by default, nearly all
that the scarcest marginal value allows: the sample's marginals then are the targets. The draw is a hash of the id, so it repeats.

Targets: by default every marginal is pulled half-way (in logarithm) from its present shares to equal shares, which lifts
small languages and curbs a source with a third of all tokens, but no value to more than ``BOOST`` times its share; or give
shares by value. The topic is the register of a
text: ``code`` and ``table`` by their characters, ``long`` from ``LONG`` words, else ``prose``; or name a column.

Defined cases: null source, lang or topic are values of their own; null and empty texts have no tokens and always stay out
of the marginals, but are sampled with their cell; a null id draws as the text ``null``; repeated rows draw alike; marginals whose values
are missing in the table are skipped; an empty table gives an empty result. Only named columns are read for the weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_small, written

LONG, ROUNDS, DAMP = 2000, 60, 0.5
#: Most that a default target lifts a share, and the part of the scarcest value's tokens that a sample asks for.
BOOST, SLACK = 2.0, 0.95
#: Cells up to which raking runs on the driver (about 100 bytes each); beyond it, the same rounds run as joins.
DRIVER_CELLS = 200_000
AXES = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """Words of a text, split at ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def topic(text: Column, n: Column) -> Column:
    """The register of a text, from counts of its characters."""
    text = F.coalesce(text, F.lit(""))
    many = lambda pattern, share: F.regexp_count(text, F.lit(pattern)) > share * F.greatest(n, F.lit(1))
    return F.when(many(r"\|", 0.2), "table").when(many(r"[#$%&*{}<>;=]", 0.3), "code").when(n >= LONG, "long").otherwise("prose")


def default_targets(shares: dict) -> dict:
    """Half-way in logarithm from the present shares to equal ones, at most ``BOOST`` times the present share."""
    have = {v: s for v, s in shares.items() if s > 0}
    lo, hi = 0.0, BOOST / min((s**DAMP / s for s in have.values()), default=1.0)
    for _ in range(100):  # the level at which the bounded shares add up to 1
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * s**DAMP, BOOST * s) for s in have.values()) < 1 else (lo, mid)
    return {v: min(hi * s**DAMP, BOOST * s) for v, s in have.items()}


def budget_for(shares: list[dict], targets: list[dict]) -> float:
    """The share of all tokens that a sample can hold, as the scarcest value of any marginal allows."""
    scarce = [have.get(v, 0.0) / t for have, target in zip(shares, targets) for v, t in target.items() if t > 0 and have.get(v, 0.0) > 0]
    return SLACK * min(1.0, *scarce, 1.0)


def rake(cells: list[tuple[tuple, float]], targets: list[dict], budget: float | None = None, rounds: int | None = None) -> np.ndarray:
    """The cells' raked tokens; ``cells`` holds ((value per axis), tokens), ``targets`` shares by value per axis.

    With a ``budget`` (share of all tokens) the fit is bounded: no cell is given more tokens than it has.
    """
    n = np.array([x for _, x in cells], float)
    total = n.sum() * (1.0 if budget is None else budget)
    w = n * (1.0 if budget is None else budget)
    codes, wanted = [], []
    for a, target in enumerate(targets):
        values = {v: k for k, v in enumerate(dict.fromkeys(c[a] for c, _ in cells))}
        codes.append(np.array([values[c[a]] for c, _ in cells], np.int64))
        share = np.array([target.get(v, 0.0) for v in values])
        wanted.append(share / max(share.sum(), 1e-300))
    for _ in range((ROUNDS if rounds is None else rounds) if total > 0 else 0):
        for code, share in zip(codes, wanted):
            have = np.bincount(code, w, len(share))
            w *= np.where(have > 0, share * total / np.maximum(have, 1e-300), 0.0)[code]
            if budget is not None:
                w = np.minimum(w, n)
    return w


def _rake_joined(cells: DataFrame, targets: list[dict], budget: float) -> DataFrame:
    """The same bounded rounds on a cell table past the driver's bound: each step is an aggregate and a join."""
    total = float(cells.agg(F.sum("n")).first()[0] or 0) * budget
    cells = cells.withColumn("w", F.col("n") * F.lit(budget))
    for k in range(ROUNDS * len(targets)):
        axis, target = AXES[k % len(targets)], targets[k % len(targets)]
        share = cells.sparkSession.createDataFrame([(v, float(s)) for v, s in target.items()], f"{axis} string, share double")
        have = join_small(cells.groupBy(axis).agg(F.sum("w").alias("have")), share, [axis])
        factor = have.select(axis, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("have")).otherwise(0.0).alias("f"))
        cells = join_small(cells, factor, [axis]).withColumn("w", F.least(F.col("w") * F.col("f"), F.col("n").cast("double"))).drop("f")
        if k % len(targets) == len(targets) - 1:
            cells = written(cells, "raked")
    return cells


def weigh(docs: DataFrame, budget: float | None = None, targets: dict[str, dict] | None = None, columns: list[str] | None = None, topic_column: str | None = None, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """``columns`` of ``docs`` with ``n_tokens, topic, probability, kept``.

    ``budget``: the share of all tokens that the sample aims at, by default what the scarcest value allows. Past that, cells that
    would need repeats are taken whole and the marginals fall short of the targets.
    """
    keep = docs.columns if columns is None else columns
    n = tokens(F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), n.alias("n"), F.col(key).cast("string").alias("id"), (F.col(topic_column).cast("string") if topic_column else F.lit(None)).alias("given"), F.col(text).alias("text"))
    rows = rows.withColumn("topic", F.col("given") if topic_column else topic(F.col("text"), F.col("n"))).drop("given", "text")
    rows = written(rows, "mixing-rows")
    cells = written(rows.groupBy(*AXES).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "cells")
    size = cells.limit(DRIVER_CELLS + 1).count()
    wanted, shares = [], []
    for axis in AXES:
        have = {r[0]: float(r[1] or 0) for r in cells.groupBy(axis).agg(F.sum("n")).collect()}
        whole = sum(have.values()) or 1.0
        shares.append({v: x / whole for v, x in have.items()})
        given = {v: float(x) for v, x in targets[axis].items() if v in have} if targets and axis in targets else default_targets(shares[-1])
        sum_ = sum(given.values()) or 1.0
        wanted.append({v: x / sum_ for v, x in given.items()})
    budget = budget_for(shares, wanted) if budget is None else budget
    if size <= DRIVER_CELLS:
        got = [((r["source"], r["lang"], r["topic"]), float(r["n"] or 0)) for r in cells.orderBy(*AXES).collect()]
        ratio = rake(got, wanted, budget) / np.maximum(np.array([x for _, x in got]), 1e-300)
        # a cell without tokens weighs nothing; its documents are sampled at the budget
        cells = docs.sparkSession.createDataFrame([(*c, float(min(1.0, r)) if n else float(min(1.0, budget))) for (c, n), r in zip(got, ratio)], "source string, lang string, topic string, probability double")
    else:
        cells = _rake_joined(cells, wanted, budget)
        cells = written(cells.select(*AXES, F.when(F.col("n") > 0, F.least(F.col("w") / F.col("n"), F.lit(1.0))).otherwise(F.lit(min(1.0, budget))).alias("probability")), "weights")
    rows = join_small(rows, cells.select(*AXES, "probability"), list(AXES), rows=size)
    draw = (F.xxhash64(F.lit(seed), F.coalesce("id", F.lit("null"))).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")
    return rows.select("row.*", F.col("n").alias("n_tokens"), F.col("topic"), "probability", (draw < F.col("probability")).alias("kept"))


def keep(docs: DataFrame, budget: float | None = None) -> DataFrame:
    """The sampled rows of ``docs``."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[F.col(c) for c in ("doc_id", "text", "source", "lang")])
    return weigh(inner, budget, columns=["doc"]).where("kept").select("doc.*")
