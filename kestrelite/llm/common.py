"""Helpers shared by the training-data operators: shared-folder tables, size-checked joins, Arrow scans."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Character class of the ASCII white space that separates words, as a Java and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a small side up to which it is broadcast; beyond, the join is shuffled and salted.
BROADCAST_ROWS = 50_000
#: Rows of one Arrow batch handed to Python: bounds a worker's memory where texts are long.
ARROW_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by rows; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only for an unset local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        global _LOCAL
        _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="kestrelite-")
        found = f"file://{_LOCAL}"
    return found.rstrip("/")


_LOCAL: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/kestrelite/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any shared store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: nothing is left to clean with
            return


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder; for small tables that a loop passes on."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back, so lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/kestrelite/" in path:
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let the driver's garbage go now, so that the shuffle files of finished jobs are deleted before a large step."""
    gc.collect()
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Let the executors' garbage go: one full collection in each slot that is free, after which a heap gives unused memory back.

    A heap that an earlier step has grown otherwise stays as large beside the Python workers and buffers of the next.
    """
    slots = spark.sparkContext.defaultParallelism
    collect = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, slots, 1, slots).select(collect.alias("done")).write.format("noop").mode("overwrite").save()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression: a lambda over a one-element array, which no optimizer rule inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 16, rows: int | None = None) -> DataFrame:
    """Null-safe join of ``big`` with a table that is unique on ``keys``: broadcast if counted small, else salted.

    ``rows``: a bound on the small side's rows that is known already. Past the bound the small side is repeated ``salts`` times, so one key with a third of all rows is spread.
    """
    small = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [big[k].eqNullSafe(small[f"__{k}"]) for k in keys]
    drop = [f"__{k}" for k in keys]
    if (small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how).drop(*drop)
    small = small.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    big = big.withColumn("__salt_l", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    on = [big[k].eqNullSafe(small[f"__{k}"]) for k in keys] + [big["__salt_l"] == small["__salt_r"]]
    return big.join(small, on, how).drop(*drop, "__salt_l", "__salt_r")


def arrow_map(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, *state) -> DataFrame:
    """Map each row tuple of ``df`` through ``fn(row, *state)``, which yields output rows, by Arrow batches."""
    spark = df.sparkSession
    arrow_batches(spark)
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = [r for row in zip(*columns) for r in fn(row, *state)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
