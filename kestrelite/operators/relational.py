"""Predicates, grouped aggregates, windows, ordering and set operations with the engine's null and type rules."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def compare(field: str, op: str, value) -> Column:
    """A comparison that is false, never null, where the field is missing. LIKE and ILIKE look for a substring."""
    c = F.col(field)
    if op.upper() == "LIKE":
        return F.coalesce(F.contains(c, F.lit(value)), F.lit(False))
    if op.upper() == "ILIKE":
        return F.coalesce(F.contains(F.lower(c), F.lit(str(value).lower())), F.lit(False))
    return F.coalesce(_OPS[op](c, F.lit(value)), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def payload_filter(must: list[Column] = (), must_not: list[Column] = (), should: list[Column] = ()) -> Column:
    """All of ``must``, none of ``must_not`` and, if there are any, one of ``should``."""
    return all_of([*must]) & ~any_of([*must_not]) & (any_of([*should]) if should else F.lit(True))


def match_any(field: str, values: list) -> Column:
    return F.coalesce(F.col(field).isin(values), F.lit(False))


def in_range(field: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive, either end optional; text counts as its number, and what is no number is outside."""
    n = F.expr(f"try_cast(`{field}` as double)")
    ends = [n >= low] * (low is not None) + [n <= high] * (high is not None)
    return F.coalesce(all_of([n.isNotNull(), *ends]), F.lit(False))


def etl_filter(field: str, op: str, value) -> Column:
    """Pipeline filters: a missing field differs from any value and meets no other condition."""
    c, v = F.col(field), F.lit(value)
    kinds = {"equal": c == v, "not_equal": ~c.eqNullSafe(v), "gt": c > v, "lt": c < v, "ge": c >= v, "le": c <= v, "contains": F.contains(c.cast("string"), v.cast("string")), "starts_with": F.startswith(c.cast("string"), v.cast("string")), "ends_with": F.endswith(c.cast("string"), v.cast("string"))}
    return F.coalesce(kinds[op], F.lit(False))


def same_number(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) < tolerance


def aggregate(df: DataFrame, aggs: dict[str, tuple[str, str]], keys: list[str] = (), having: Column | None = None) -> DataFrame:
    """``aggs``: alias -> (count | sum | avg | min | max, field or *). SUM of nothing is 0; nulls are a group of their own."""

    def one(name: str, field: str) -> Column:
        if name == "count":
            return F.count(F.lit(1) if field == "*" else F.col(field))
        return {"sum": F.coalesce(F.sum(field), F.lit(0.0)), "avg": F.avg(field), "min": F.min(field), "max": F.max(field)}[name]

    out = [one(n, f).alias(a) for a, (n, f) in aggs.items()]
    found = df.groupBy(*keys).agg(*out) if keys else df.agg(*out)
    return found if having is None else found.where(having)


def reduce_field(df: DataFrame, op: str, field: str, key: str) -> DataFrame:
    """One row: sum, avg, min, max, count or the values joined by commas in key order; no row for avg, min, max of nothing."""
    if op == "concat":
        return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(field).cast("string").alias("v")))), lambda s: s["v"]), ",").alias("value"))
    found = aggregate(df, {"value": (op, "*" if op == "count" else field)})
    return found.where("value is not null") if op in ("avg", "min", "max") else found


def group_sizes(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("")).alias("group_key")).agg(F.count(F.lit(1)).alias("group_size"))


def vector_aggregate(df: DataFrame, vec: str, how: str = "avg", keys: list[str] = ()) -> DataFrame:
    """Element-wise sum or mean of vectors: one partial sum per coordinate before the shuffle."""
    at = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    each = at.groupBy(*keys, "pos").agg((F.sum if how == "sum" else F.avg)(F.col("x").cast("double")).alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")
    return each.groupBy(*keys).agg(packed) if keys else each.agg(packed)


def window(df: DataFrame, function: str, field: str | None, partition: list[str], order: list[Column], alias: str) -> DataFrame:
    """ROW_NUMBER, RANK, DENSE_RANK, LAG, LEAD, FIRST_VALUE, LAST_VALUE and whole-partition SUM, AVG, COUNT."""
    ordered, whole = Window.partitionBy(*partition).orderBy(*order), Window.partitionBy(*partition)
    frame = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {
        "row_number": lambda: F.row_number().over(ordered), "rank": lambda: F.rank().over(ordered), "dense_rank": lambda: F.dense_rank().over(ordered),
        "lag": lambda: F.lag(field, 1).over(ordered), "lead": lambda: F.lead(field, 1).over(ordered),
        "first_value": lambda: F.first(field).over(frame), "last_value": lambda: F.last(field).over(frame),
        "sum": lambda: F.sum(field).over(whole), "avg": lambda: F.avg(field).over(whole), "count": lambda: F.count(F.lit(1)).over(whole),
    }
    return df.withColumn(alias, made[function]())


def order_by(df: DataFrame, field: str, descending: bool, key: str, limit: int | None = 10) -> DataFrame:
    """One field by its own type, missing values last, ties by key; text that is all numbers sorts by number first."""
    c = F.col(f"`{field}`")
    order = [F.expr(f"try_cast(`{field}` as double)"), c] if dict(df.dtypes)[field] == "string" else [c]
    out = df.orderBy(*[x.desc_nulls_last() if descending else x.asc_nulls_last() for x in order], key)
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, key: str, limit: int = 10, offset: int = 0) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def insert_if_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose id the table lacks; of rows that repeat an id, one is inserted."""
    new = new.dropDuplicates([key])
    return table.unionByName(new.join(table.select(key), key, "left_anti"))


def overwrite(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of those with their id; ids that the table lacks are left out."""
    return upsert(table, new.join(table.select(key), key, "left_semi").select(*table.columns), key)


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def recursive(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, max_depth: int) -> DataFrame:
    """Union of rounds until nothing new appears: each round sees only the last one's new rows."""
    from .graph import cut

    seen = fresh = cut(start.dropDuplicates([key]))
    for _ in range(max_depth):
        fresh = cut(step(fresh).dropDuplicates([key]).join(seen, key, "left_anti"))
        if fresh.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(fresh)
    if step(fresh).join(seen, key, "left_anti").limit(1).count():
        raise ValueError(f"the recursion is deeper than {max_depth}")
    return seen


def pipeline(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """An ETL pipeline: transformations in order."""
    return functools.reduce(lambda d, s: d.transform(s), steps, df)
