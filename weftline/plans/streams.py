"""Queries of streams, completion, event time and event-log analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.lineage import cut, new_folder
from weftline.operators import select as S
from weftline.operators import tracelog as G
from weftline.sources import ranges as B
from weftline.streaming import streams as T
from weftline.tables import load


def _updates(events):
    return events.select(F.pmod("user_id", F.lit(64)).alias("k"), "event_id")


def item_stream(spark, sf_dir):
    """Items routed to their destinations by a stream, with counts."""
    d = T.stream_table(spark, f"{sf_dir}/events.parquet").select(F.pmod("user_id", F.lit(16)).alias("dst"), "event_id")
    return T.run_to_end(d.groupBy("dst").agg(F.count("*").alias("items"), F.sum("event_id").alias("total")), "complete")


def aggregate_stream(spark, sf_dir):
    """Xor updates per key, as a stream."""
    return T.run_to_end(T.keyed_updates(_updates(T.stream_table(spark, f"{sf_dir}/events.parquet")), "k", "event_id"), "complete")


def aggregate_batch(spark, sf_dir):
    return T.keyed_updates(_updates(load(spark, sf_dir, "events")), "k", "event_id")


def tumbling_windows(spark, sf_dir):
    d = T.windowed(load(spark, sf_dir, "events"), "ts", "1 day", "event_type")
    return d.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


def chunk_items(spark, sf_dir):
    """Texts cut into chunks of 256 and put together again."""
    d = load(spark, sf_dir, "benchmark").select("item_id", "text")
    back = T.reassembled(T.chunked(d, "item_id", "text", 256), "item_id")
    return back.select("item_id", F.md5("data").alias("digest"), F.char_length("data").alias("n"))


def ranged_io(spark, sf_dir):
    """Texts written by a session at offsets that follow each other, and read back by ranges."""
    d = load(spark, sf_dir, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    d = cut(S.ordered_ranks(d, ["item_id"], "rank"))
    place = Window.orderBy("block")
    blocks = d.groupBy(F.floor(F.col("rank") / 1024).alias("block")).agg(F.sum(F.length("data")).alias("size"))
    first = blocks.select("block", (F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("first"))
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("block", F.floor(F.col("rank") / 1024)).join(first, "block").withColumn("offset", F.col("first") + F.sum(F.length("data")).over(inside) - F.length("data"))
    d = cut(d.select("item_id", "offset", "data"))
    parts = B.write_session(d, new_folder(spark))
    back = B.read_session(parts, d.select("offset", F.length("data").alias("length")).where("length > 0"))
    return d.select("item_id", "offset").where(F.length("data") > 0).join(back, "offset").select("item_id", F.md5("data").alias("digest"), F.length("data").alias("n_bytes"))


def completion(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(8)).alias("pe")).agg(F.count_if(F.col("event_type") == "view").alias("p"), F.count_if(F.col("event_type") == "click").alias("c"), F.lit(True).alias("done"))
    return T.completion(e, "p", "c", "done")


def quiescence(spark, sf_dir):
    """Counting phases over unlike states: nothing changed, something created in between, something not yet processed."""
    e = load(spark, sf_dir, "events")
    view = (F.col("event_type") == "view").cast("long")
    whole = e.select(F.lit(1).alias("created"), F.lit(1).alias("processed"))
    early = e.where("event_type <> 'view'").select(F.lit(1).alias("created"), F.lit(1).alias("processed"))
    open_ = e.select(F.lit(1).alias("created"), (1 - view).alias("processed"))
    rows = [("unchanged", T.quiescent(whole, whole)), ("grown", T.quiescent(early, whole)), ("waiting", T.quiescent(open_, open_))]
    return spark.createDataFrame(rows, "phase string, quiescent boolean")


def event_time_fold(spark, sf_dir):
    """Each user's events folded in time order: s -> s / 2 + v."""
    d = load(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(50)).alias("obj"), "ts", "value")
    r = T.event_time_fold(d, "obj", "ts", "value", lambda s, v: s / 2 + v)
    return r.select("obj", "events", F.round("state", 6).alias("state"))


def event_time_stream(spark, sf_dir):
    """The same fold as a stream: an object is put out once the watermark has passed its last event."""
    d = T.stream_table(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("obj"), "ts", "value")
    r = T.run_to_end(T.event_time_fold(d, "obj", "ts", "value", lambda s, v: s / 2 + v))
    return r.select("obj", "events", F.round("state", 6).alias("state"))


def optimistic_fold(spark, sf_dir):
    """Events taken in order of their ids, rolled back where time goes back."""
    d = load(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(50)).alias("obj"), "ts", "event_id", "value")
    r = T.optimistic_fold(d, "obj", "ts", "event_id", "value", lambda s, v: s / 2 + v)
    return r.select("obj", "events", "rollbacks", "undone", F.round("state", 6).alias("state"))


def commit_before(spark, sf_dir):
    """Events older than the least last time of all objects are committed."""
    e = load(spark, sf_dir, "events")
    last = e.groupBy("event_type").agg(F.max("ts").alias("t"))
    gvt = last.agg(F.min("t").alias("gvt"))
    return e.join(F.broadcast(gvt), F.col("ts") < F.col("gvt"), "left").groupBy("event_type").agg(F.count("gvt").alias("committed"), F.count_if(F.col("gvt").isNull()).alias("waiting"))


def sequential_events(spark, sf_dir):
    """Place of each event in time order of its object."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("place"))


def elapse(spark, sf_dir):
    """Virtual time of each object after its events, in whole units."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "events").select("event_id", F.sum(F.floor(F.abs("value")).cast("long")).over(w).alias("ovt"))


def overlap_join(spark, sf_dir):
    """An overlap is done once all kinds have arrived; a case takes the first."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.min(F.struct("ts", "event_id", "event_type")).alias("first"), F.max("event_id").alias("last"))
    return e.select("user_id", (F.col("kinds") >= 3).alias("overlap_done"), F.col("first.event_type").alias("case_taken"))


def _log(spark, sf_dir):
    """Executions with begin and end in milliseconds."""
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pe"), F.col("event_type").alias("ep"), F.floor(ms).cast("long").alias("begin"), (F.floor(ms) + F.floor(F.abs("value")) % 5000 + 1).cast("long").alias("end"))


def utilization(spark, sf_dir):
    d = G.utilization(_log(spark, sf_dir), 1000)
    return d.groupBy("ep").agg(F.count("*").alias("bins"), F.sum("busy").alias("busy"), F.max("busy").alias("most"))


def entry_summary(spark, sf_dir):
    d = _log(spark, sf_dir).select("ep", (F.col("end") - F.col("begin")).alias("t"))
    return G.entry_summary(d, "ep", "t", 500, 450)


def phase_table(spark, sf_dir):
    d = _log(spark, sf_dir).withColumn("phase", F.col("event_id") % 4).withColumn("t", F.col("end") - F.col("begin"))
    return d.groupBy("phase", "ep").agg(F.count("*").alias("n"), F.sum("t").alias("total"), F.max("t").alias("longest"))


def counters(spark, sf_dir):
    d = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return d.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "total", "lo", "hi")))


def begin_end_pairs(spark, sf_dir):
    """Clicks begin and purchases end: nesting depth per user, and matched durations."""
    d = load(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select("user_id", "event_id", F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("d"))
    return G.nesting(d, ["user_id"], "event_id", "d").groupBy("user_id").agg(F.max("depth").alias("deepest"), F.min("depth").alias("least"))


def outlier_processors(spark, sf_dir):
    """The users farthest from the mean of their cluster of activity."""
    d = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    m = d.agg(F.avg("n").alias("mn"), F.avg("v").alias("mv"), F.stddev_pop("n").alias("sn"), F.stddev_pop("v").alias("sv"))
    dist = F.pow((F.col("n") - F.col("mn")) / F.col("sn"), 2) + F.pow((F.col("v") - F.col("mv")) / F.col("sv"), 2)
    return d.join(F.broadcast(m)).select("user_id", F.round(dist, 6).alias("distance")).orderBy(F.desc("distance"), "user_id").limit(10)


def simulation_stats(spark, sf_dir):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = load(spark, sf_dir, "events").select("event_type", t.alias("t"))
    return e.agg(F.count("*").alias("dos"), F.count_if(F.col("event_type") == "purchase").alias("commits"), F.max("t").alias("max_t"), F.min("t").alias("min_t"))


_LOG = "SELECT event_id, user_id AS pe, event_type AS ep, floor(epoch_us(ts) / 1000.0::DOUBLE)::BIGINT AS b, (floor(epoch_us(ts) / 1000.0::DOUBLE) + floor(abs(value)) % 5000 + 1)::BIGINT AS e FROM events"
SPECS = {
    "item_stream": (item_stream, "SELECT user_id % 16 AS dst, count(*) AS items, sum(event_id)::BIGINT AS total FROM events GROUP BY 1"),
    "aggregate_stream": (aggregate_stream, "SELECT user_id % 64 AS k, bit_xor(event_id) AS x, count(*) AS n FROM events GROUP BY 1"),
    "aggregate_batch": (aggregate_batch, "SELECT user_id % 64 AS k, bit_xor(event_id) AS x, count(*) AS n FROM events GROUP BY 1"),
    "tumbling_windows": (tumbling_windows, "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "chunk_items": (chunk_items, "SELECT item_id, md5(text) AS digest, length(text)::INTEGER AS n FROM benchmark"),
    "completion": (completion, "SELECT (count(*) FILTER (event_type = 'view'))::BIGINT AS produced, (count(*) FILTER (event_type = 'click'))::BIGINT AS consumed, true AS all_done, count(*) FILTER (event_type = 'view') = count(*) FILTER (event_type = 'click') AS complete FROM events"),
    "ranged_io": (ranged_io, "SELECT item_id, md5(text) AS digest, octet_length(encode(text)) AS n_bytes FROM benchmark WHERE text <> ''"),
    "quiescence": (quiescence, "WITH c AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'view') AS m FROM events) SELECT 'unchanged' AS phase, n = n AS quiescent FROM c UNION ALL SELECT 'grown', m = n FROM c UNION ALL SELECT 'waiting', n = m FROM c"),
    "event_time_fold": (event_time_fold, "SELECT user_id % 50 AS obj, count(*) AS events, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, value)), lambda s, v: s / 2 + v), 6) AS state FROM events GROUP BY 1"),
    "event_time_stream": (
        event_time_stream,
        "WITH m AS (SELECT epoch_ms(max(ts)) - 3600000 AS w FROM events), f AS (SELECT user_id AS obj, count(*) AS events, max(epoch_ms(ts)) AS last, list_reduce(list_prepend(0.0::DOUBLE, list(value::DOUBLE ORDER BY ts, value)), lambda s, v: s / 2 + v) AS state FROM events GROUP BY 1) SELECT obj, events, round(state, 6) AS state FROM f, m WHERE last + 1 < w",
    ),
    "optimistic_fold": (
        optimistic_fold,
        "WITH e AS (SELECT user_id % 50 AS obj, ts, event_id, value::DOUBLE AS v FROM events), u AS (SELECT a.obj, count(DISTINCT a.event_id) AS rollbacks, count(*) AS undone FROM e a JOIN e b ON a.obj = b.obj AND b.event_id < a.event_id AND b.ts > a.ts GROUP BY 1), f AS (SELECT obj, count(*) AS events, list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY ts, event_id)), lambda s, x: s / 2 + x) AS state FROM e GROUP BY 1) SELECT obj, events, coalesce(rollbacks, 0)::BIGINT AS rollbacks, coalesce(undone, 0)::BIGINT AS undone, round(state, 6) AS state FROM f LEFT JOIN u USING (obj)",
    ),
    "commit_before": (commit_before, "WITH g AS (SELECT min(t) AS gvt FROM (SELECT max(ts) AS t FROM events GROUP BY event_type)) SELECT event_type, count(*) FILTER (ts < gvt) AS committed, count(*) FILTER (ts >= gvt) AS waiting FROM events, g GROUP BY 1"),
    "sequential_events": (sequential_events, "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events"),
    "elapse": (elapse, "SELECT event_id, (sum(floor(abs(value))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS ovt FROM events"),
    "overlap_join": (overlap_join, "SELECT user_id, count(DISTINCT event_type) >= 3 AS overlap_done, arg_min(event_type, (ts, event_id)) AS case_taken FROM events GROUP BY 1"),
    "utilization": (utilization, f"WITH l AS ({_LOG}), x AS (SELECT ep, b, e, unnest(range(b // 1000, (e - 1) // 1000 + 1)) AS bin FROM l), y AS (SELECT ep, bin, sum(least(e, (bin + 1) * 1000) - greatest(b, bin * 1000))::BIGINT AS busy FROM x GROUP BY 1, 2) SELECT ep, count(*) AS bins, sum(busy)::BIGINT AS busy, max(busy) AS most FROM y GROUP BY 1"),
    "entry_summary": (entry_summary, f"WITH l AS (SELECT ep, e - b AS t FROM ({_LOG})) SELECT ep, sum(t)::BIGINT AS total, max(t) AS longest, count(*) AS n, " + ", ".join(f"count(*) FILTER (t > {500 + 450 * k}" + (f" AND t <= {500 + 450 * (k + 1)}" if k < 9 else "") + f") AS bin_{k}" for k in range(10)) + " FROM l GROUP BY 1"),
    "phase_table": (phase_table, f"SELECT event_id % 4 AS phase, ep, count(*) AS n, sum(e - b)::BIGINT AS total, max(e - b) AS longest FROM ({_LOG}) GROUP BY 1, 2"),
    "counters": (counters, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(sum(value), 6) AS total, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY 1"),
    "begin_end_pairs": (begin_end_pairs, "SELECT user_id, max(d)::BIGINT AS deepest, min(d)::BIGINT AS least FROM (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1"),
    "outlier_processors": (outlier_processors, "WITH d AS (SELECT user_id, count(*)::DOUBLE AS n, sum(value) AS v FROM events GROUP BY 1), m AS (SELECT avg(n) AS mn, avg(v) AS mv, stddev_pop(n) AS sn, stddev_pop(v) AS sv FROM d) SELECT user_id, round(((n - mn) / sn) ** 2 + ((v - mv) / sv) ** 2, 6) AS distance FROM d, m ORDER BY distance DESC, user_id LIMIT 10"),
    "simulation_stats": (simulation_stats, "SELECT count(*) AS dos, count(*) FILTER (event_type = 'purchase') AS commits, floor(max(epoch(ts)))::BIGINT AS max_t, floor(min(epoch(ts)))::BIGINT AS min_t FROM events"),
}
