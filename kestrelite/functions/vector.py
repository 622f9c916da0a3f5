"""Vector expressions over ``array<float|double>`` columns, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default prefix lengths of multi-resolution vectors.
LEVELS = (384, 768, 1024, 1536)


def vector(values: list[float]) -> Column:
    """A literal vector: one parsed constant, folded by the optimizer, so long vectors keep plans small."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _same(a: Column, b: Column) -> tuple[Column, Column]:
    """Both cut to the common length, as distances read only what both have."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(_d(a), 1, n), F.slice(_d(b), 1, n)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(*_same(a, b), f)


def torus_distance(a: Column, b: Column) -> Column:
    """Euclidean distance on the unit torus: each coordinate counts the shorter way round."""

    def term(x: Column, y: Column) -> Column:
        d = F.abs(x - y)
        m = F.least(d, 1.0 - d)
        return m * m

    return F.sqrt(_sum(_pairs(a, b, term)))


def torus_distance_strict(a: Column, b: Column) -> Column:
    """The same with differences taken modulo 1; unequal lengths are an error."""

    def term(x: Column, y: Column) -> Column:
        d = F.pmod(x - y, F.lit(1.0))
        m = F.least(d, 1.0 - d)
        return m * m

    ok = F.size(a) == F.size(b)
    return F.when(ok, F.sqrt(_sum(_pairs(a, b, term)))).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is (almost) zero."""
    n = magnitude(a) * magnitude(b)
    return F.when(n < 1e-10, 0.0).otherwise(dot(a, b) / n)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def add(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x / y)


def scale(a: Column, k: float) -> Column:
    return F.transform(_d(a), lambda x: x * F.lit(float(k)))


def negate(a: Column) -> Column:
    return F.transform(_d(a), lambda x: -x)


def absolute(a: Column) -> Column:
    return F.transform(_d(a), lambda x: F.abs(x))


def clamp(a: Column, lo: float, hi: float) -> Column:
    return F.transform(_d(a), lambda x: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = magnitude(a)
    return F.when(n > 0, F.zip_with(_d(a), F.array_repeat(n, F.size(a)), lambda x, m: x / m)).otherwise(_d(a))


def rounded(x: Column, digits: int) -> Column:
    """SQL's round of doubles: the scaled value to the nearest whole one, halves away from 0; a negative value keeps its sign at 0."""
    y = F.abs(x) * float(10**digits)
    whole = F.floor(y).cast("double")
    return F.when(y < 2.0**52, F.signum(x) * ((whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / float(10**digits))).otherwise(x)


def wrap(a: Column) -> Column:
    """Coordinates modulo 1."""
    return F.transform(_d(a), lambda x: F.pmod(x, F.lit(1.0)))


def pad_or_truncate(a: Column, n: int) -> Column:
    return F.slice(F.concat(_d(a), F.array_repeat(F.lit(0.0), n)), 1, n)


def nearest_level(size: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """The level nearest to ``size``; the smaller on a tie."""
    return F.array_min(F.array(*[F.struct(F.abs(size - n).alias("off"), F.lit(n).alias("level")) for n in levels]))["level"]


def torus_cosine(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + torus_distance(a, b))


# ---- quantization


def quantize_scalar(a: Column) -> Column:
    """struct(data, min, max): bytes 0 to 255, truncated; all 0 if the range is at most 1e-6."""
    v = _d(a)
    lo, hi = F.array_min(v), F.array_max(v)
    each = F.zip_with(v, F.array_repeat(F.struct(lo.alias("lo"), (hi - lo).alias("r")), F.size(v)), lambda x, s: F.when(s["r"] <= 1e-6, 0).otherwise(F.floor((x - s["lo"]) / s["r"] * 255)).cast("int"))
    return F.struct(each.alias("data"), lo.alias("min"), hi.alias("max"))


def dequantize_scalar(q: Column) -> Column:
    return F.zip_with(q["data"], F.array_repeat(F.struct(q["min"].alias("lo"), (q["max"] - q["min"]).alias("r")), F.size(q["data"])), lambda x, s: s["lo"] + x / 255.0 * s["r"])


def quantize_binary(a: Column) -> Column:
    """Sign bits as 0 and 1."""
    return F.transform(_d(a), lambda x: F.when(x > 0, 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def quantize_product(a: Column, parts: int, dim: int) -> Column:
    """One scalar quantization for each of ``parts`` equal subvectors of a vector of ``dim``."""
    step = dim // parts
    return F.array(*[quantize_scalar(F.slice(a, k * step + 1, step)) for k in range(parts)])


# ---- homotopy on the torus


def homotopy_wrap(a: Column, b: Column) -> Column:
    """Per coordinate +1, 0 or -1: how the short way from a to b goes round."""
    return _pairs(a, b, lambda x, y: F.when(y - x > 0.5, 1).when(y - x < -0.5, -1).otherwise(0))


def homotopy_class(a: Column, b: Column) -> Column:
    w = homotopy_wrap(a, b)
    return F.struct(F.when(F.forall(w, lambda x: x == 0), "direct").otherwise("wrapped").alias("kind"), w.alias("wrap"))


def homotopy_cost(wrap_: Column) -> Column:
    return F.aggregate(wrap_, F.lit(0), lambda s, x: s + F.abs(x))


def apply_homotopy(a: Column, wrap_: Column | None) -> Column:
    """Shift by the wrap numbers, or by one half where the class is nontrivial (None), modulo 1."""
    if wrap_ is None:
        return F.transform(_d(a), lambda x: F.pmod(x + 0.5, F.lit(1.0)))
    return F.zip_with(_d(a), wrap_, lambda x, w: F.pmod(x + w, F.lit(1.0)))
