"""Event-window queries: batch twins that the SQL checks, and the same functions run by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrelite.functions import vector as V
from kestrelite.streaming import streams as S

from . import query, table
from .storage import folder
from .vectors import NORM, E

_OUT = 'round(sum(value), 3) as total'


def out(df, *keys):
    return df.select(F.col("start"), F.col("end").alias("stop"), *keys, "n", F.round("total", 3).alias("total"))


@query("r5_tumbling", f"select time_bucket(interval '15 minutes', ts) as start, time_bucket(interval '15 minutes', ts) + interval '15 minutes' as stop, count(*) as n, {_OUT} from events group by 1, 2")
def r5(s, d):
    return out(S.tumbling(table(s, d, "events"), "15 minutes"))


@query("r6_sliding", f"select b - k * interval '30 minutes' as start, b - k * interval '30 minutes' + interval '60 minutes' as stop, event_type, count(*) as n, {_OUT} from (select *, time_bucket(interval '30 minutes', ts) as b from events), (values (0), (1)) t(k) group by all")
def r6(s, d):
    return out(S.sliding(table(s, d, "events"), "60 minutes", "30 minutes", ["event_type"]), "event_type")


@query("r7_session", f"with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select min(ts) as start, max(ts) + interval '30 minutes' as stop, user_id, count(*) as n, {_OUT} from k group by user_id, sid")
def r7(s, d):
    return out(S.session(table(s, d, "events"), "30 minutes", ["user_id"]), "user_id")


@query("r8_look_back", "select event_type, count(*) as n from events where ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-12 00:00:00' and value > 5 group by 1 having count(*) > 3")
def r8(s, d):
    r = S.look_back(table(s, d, "events"), "2024-01-12 00:00:00", "2 days").where("value > 5").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return r.where("n > 3")


@query("r4_retention", "select event_id from events where ts >= (select max(ts) from events) - interval '6 hours'")
def r4(s, d):
    return S.retained(table(s, d, "events"), "6 hours").select("event_id")


@query("r3_r11_watermark", "select count(*) as records, max(ts) as newest, max(ts) - interval '60 seconds' as watermark from events")
def r3(s, d):
    return S.watermark(table(s, d, "events"))


@query("r10_changes", "select case when status = 'P' then 'delete' when status = 'O' then 'insert' else 'update' end as op, o_orderkey from (select o_orderkey, o_orderstatus as status from orders)")
def r10(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.lit("X"))
    return S.changes(o.where("o_orderstatus <> 'O'"), new, "o_orderkey").select("op", "o_orderkey")


@query("r16_r17_enrich", f"select vec_id, round({NORM}, 6) as vector_norm, true as processed_by_topology, round(list_sum([x / {NORM} for x in {E}]), 5) as total from embeddings")
def r16(s, d):
    r = S.enrich(table(s, d, "embeddings"), "embedding")
    return r.select("vec_id", F.round("vector_norm", 6).alias("vector_norm"), "processed_by_topology", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("r17_pad", f"select vec_id, len(({E})[1:32]) as n from embeddings")
def r17(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size(V.pad_or_truncate(F.col("embedding"), 32)).cast("long").alias("n"))


def _streamed(s, d):
    """The events file as a stream: the schema comes from the batch reader."""
    root = folder(s)
    return s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d), root


@query("r2_r9_streaming_tumbling", f"with m as (select max(ts) - interval '60 seconds' as w from events) select time_bucket(interval '15 minutes', ts) as start, time_bucket(interval '15 minutes', ts) + interval '15 minutes' as stop, count(*) as n, {_OUT} from events, m group by 1, 2, w having time_bucket(interval '15 minutes', max(ts)) + interval '15 minutes' <= w")
def r2(s, d):
    stream, root = _streamed(s, d)
    done = out(S.run_to_end(S.tumbling(stream, "15 minutes"), f"{root}/out", f"{root}/checkpoint"))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("r13_r15_trigger", "select 'large' as trigger, 'alerts' as topic, event_id from events where value > 20")
def r15(s, d):
    stream, root = _streamed(s, d)
    own = S.Streams(s)
    own.trigger("large", stream.select("event_id", "value"), F.col("value") > 20, "alerts", f"{root}/fired", f"{root}/checkpoint").awaitTermination()
    return s.read.schema("trigger string, topic string, payload string").parquet(f"{root}/fired").select("trigger", "topic", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))
