"""Reading, ingesting, exporting, snapshots and backups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ingest(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Dispatch on a MIME-like kind: csv, json, text, image or any other file."""
    if "csv" in kind:
        return spark.read.csv(path, header=True, **options)
    if "json" in kind:
        return spark.read.json(path, multiLine=not json_lines(spark, path), **options)
    if kind.startswith("text") or "plain" in kind:
        return chunks(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), 512)
    label = "Image: " if kind.startswith("image") else "Binary file: "
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.concat(F.lit(label), name, F.lit(" ("), F.col("length").cast("string"), F.lit(" bytes)")).alias("text"))


def json_lines(spark: SparkSession, path: str) -> bool:
    """Whether a file holds one object a line: its first line that is not blank is a whole object."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not first:
        return True
    try:
        return isinstance(json.loads(first[0][0]), dict)
    except ValueError:
        return False


def chunks(df: DataFrame, size: int = 512, text: str = "text") -> DataFrame:
    """Greedy packing of words into chunks of at most ``size`` bytes, words joined by one space."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a, w):
        fits = (F.octet_length(a["open"]) + F.octet_length(w) + 1 <= size) | (a["open"] == "")
        longer = F.struct(a["done"].alias("done"), F.when(a["open"] == "", w).otherwise(F.concat(a["open"], F.lit(" "), w)).alias("open"))
        closed = F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), w.alias("open"))
        return F.when(fits, longer).otherwise(closed)

    packed = F.aggregate(words, empty, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(packed).alias("chunk", text))


def preview(df: DataFrame, key: str, text: str, rows: int = 10, chars: int = 100) -> DataFrame:
    return df.orderBy(key).limit(rows).select(key, F.substring(text, 1, chars).alias("preview"))


def export(df: DataFrame, path: str, kind: str) -> None:
    if kind == "csv":
        df.write.csv(path, header=True, quoteAll=True, emptyValue="")
    elif kind == "json":
        df.write.json(path)
    else:
        df.write.parquet(path)


def graphml(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML lines in document order (column value)."""
    n = nodes_.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.lit(0).cast("long").alias("k2"), F.format_string('<node id="%d"/>', "id").alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").alias("k"), F.col("dst").alias("k2"), F.format_string('<edge source="%d" target="%d"/>', "src", "dst").alias("value"))
    return n.union(e).orderBy("part", "k", "k2").select("value")


def schema_info(df: DataFrame) -> DataFrame:
    """(field, type, filled): declared type and non-null count of each column."""
    spark = df.sparkSession
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    stacked = ", ".join(f"'{c}', '{t}', `{c}`" for c, t in df.dtypes)
    return counts.select(F.expr(f"stack({len(df.columns)}, {stacked}) as (field, type, filled)")) if df.columns else spark.createDataFrame([], "field string, type string, filled long")


def snapshot(df: DataFrame, root: str, version: int) -> str:
    """An immutable point-in-time copy; writing a version twice is an error."""
    path = f"{root}/v{version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: int, oldest: int = 0) -> DataFrame:
    if version < oldest:
        raise ValueError(f"snapshot {version} has expired; the oldest kept is {oldest}")
    return spark.read.parquet(f"{root}/v{version:08d}")


def backup(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
