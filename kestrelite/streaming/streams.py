"""Event windows as functions that serve batch and Structured Streaming alike, and stream plumbing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _windowed(events: DataFrame, w: Column, keys: list[str], value: str) -> DataFrame:
    out = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def late(events: DataFrame, ts: str = "ts", lateness: str = "60 seconds") -> DataFrame:
    if not events.isStreaming:
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)  # a watermark takes no zoneless time


def tumbling(events: DataFrame, size: str, keys: list[str] = (), value: str = "value", ts: str = "ts") -> DataFrame:
    return _windowed(late(events, ts), F.window(ts, size), [*keys], value)


def sliding(events: DataFrame, size: str, slide: str, keys: list[str] = (), value: str = "value", ts: str = "ts") -> DataFrame:
    return _windowed(late(events, ts), F.window(ts, size, slide), [*keys], value)


def session(events: DataFrame, gap: str, keys: list[str], value: str = "value", ts: str = "ts") -> DataFrame:
    return _windowed(late(events, ts), F.session_window(ts, gap), [*keys], value)


def look_back(events: DataFrame, now: str, length: str, ts: str = "ts") -> DataFrame:
    """Records in [now - length, now]; ``now`` is explicit, so results repeat."""
    end = F.lit(now).cast(events.schema[ts].dataType)
    return events.where((F.col(ts) >= end - F.expr(f"interval {length}")) & (F.col(ts) <= end))


def retained(events: DataFrame, retention: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Batch twin of retention: records at most ``retention`` older than the newest."""
    newest = events.agg(F.max(ts).alias("__newest"))
    return events.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("__newest") - F.expr(f"interval {retention}")).drop("__newest")


def watermark(events: DataFrame, ts: str = "ts", lateness: str = "60 seconds") -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("records"), F.max(ts).alias("newest"), (F.max(ts) - F.expr(f"interval {lateness}")).alias("watermark"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """CDC rows (op, key, before, after) between two versions."""
    pack = lambda d: F.to_json(F.struct(*[c for c in d.columns if c != key]))
    a, b = old.select(key, pack(old).alias("before")), new.select(key, pack(new).alias("after"))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(op.alias("op"), key, "before", "after")


def enrich(events: DataFrame, vec: str) -> DataFrame:
    """The stream processor's step: unit vectors, their former norm and a mark."""
    from kestrelite.functions import vector as V

    return events.withColumn("vector_norm", V.magnitude(F.col(vec))).withColumn(vec, V.normalize(F.col(vec))).withColumn("processed_by_topology", F.lit(True))


class Streams:
    """Registered streams, subscriptions and triggers of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.sources: dict[str, DataFrame] = {}
        self.running: dict[str, tuple[Callable[[], StreamingQuery], StreamingQuery | None]] = {}

    def register(self, name: str, path: str, schema, kind: str = "parquet") -> DataFrame:
        self.sources[name] = self.spark.readStream.format(kind).schema(schema).load(path)
        return self.sources[name]

    def subscribe(self, name: str, source: DataFrame, condition: Column | None, emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
        """Call ``emit`` with each micro-batch's matching rows; nothing is emitted for empty batches."""

        def batch(df: DataFrame, n: int) -> None:
            hit = df if condition is None else df.where(condition)
            if hit.limit(1).count():
                emit(hit, n)

        start = lambda: source.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
        self.running[name] = (start, start())
        return self.running[name][1]

    def pause(self, name: str) -> None:
        start, query = self.running[name]
        if query:
            query.stop()
        self.running[name] = (start, None)

    def resume(self, name: str) -> StreamingQuery:
        start, query = self.running[name]
        if query is None or not query.isActive:
            query = start()
        self.running[name] = (start, query)
        return query

    def unsubscribe(self, name: str) -> None:
        self.pause(name)
        del self.running[name]

    def trigger(self, name: str, source: DataFrame, condition: Column, topic: str, table: str, checkpoint: str) -> StreamingQuery:
        """Rows (trigger, topic, payload) for matching changes, appended to a Parquet folder."""

        def emit(df: DataFrame, _: int) -> None:
            df.select(F.lit(name).alias("trigger"), F.lit(topic).alias("topic"), F.to_json(F.struct(*df.columns)).alias("payload")).write.mode("append").parquet(table)

        return self.subscribe(name, source, condition, emit, checkpoint)

    def stats(self, name: str) -> dict | None:
        query = self.running[name][1]
        return query.lastProgress if query else None


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what is available now into Parquet and return the rows."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
