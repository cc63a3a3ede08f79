"""Keyed streams, completion and event-time processing with Structured Streaming.

Every stream here has a batch twin, to which it is held in the tests and
queries. Event time follows Spark's watermark, which is the greatest time seen
less a delay; it is not a global minimum over events in flight, and nothing is
rolled back.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.lineage import new_folder


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files; local times become UTC instants."""
    schema = spark.read.parquet(path).schema
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(_folder(path)).select(*schema.fieldNames())
    return found


def _folder(path: str) -> str:
    # a file source streams a folder; a pattern with one match names a single file
    head, _, name = path.rpartition("/")
    return f"{head}/{name[:-1]}[{name[-1]}]"


def run_to_end(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it put out, from the shared folder.

    folder: where a run before has left its checkpoint and output; this one goes on there.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start().awaitTermination()
    else:
        # the last batch of a complete result replaces the ones before
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        writer.foreachBatch(replace).outputMode("complete").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def keyed_updates(events: DataFrame, key: str, value: str) -> DataFrame:
    """A table of xor updates by key; works on a stream and on a table."""
    return events.groupBy(key).agg(F.bit_xor(value).alias("x"), F.count("*").alias("n"))


def windowed(events: DataFrame, time: str, size: str, by: str, delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key; on a stream, windows close once the watermark has passed."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_t", delay)
    return rows.groupBy(F.window("_t", size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def chunked(rows: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, chunk, part): large items cut into parts of a fixed size."""
    n = F.greatest(F.lit(1), F.ceil(F.length(data) / size).cast("int"))
    return rows.select(key, data, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select(key, "chunk", F.expr(f"substring({data}, chunk * {size} + 1, {size})").alias("part"))


def reassembled(chunks: DataFrame, key: str) -> DataFrame:
    """(key, data) of the parts in order."""
    return chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("z")).select(key, F.array_join(F.col("z.part"), "").alias("data"))


def completion(counts: DataFrame, produced: str, consumed: str, done: str) -> DataFrame:
    """Complete once all producers are done and as much is consumed as produced."""
    return counts.agg(F.sum(produced).alias("produced"), F.sum(consumed).alias("consumed"), F.bool_and(done).alias("all_done")).withColumn("complete", F.col("all_done") & (F.col("produced") == F.col("consumed")))


def quiescent(before: DataFrame, after: DataFrame) -> bool:
    """Two counting phases (created, processed) with equal and unchanged sums."""
    a, b = (x.agg(F.sum("created"), F.sum("processed")).first() for x in (before, after))
    return tuple(a) == tuple(b) and a[0] == a[1]


def optimistic_fold(events: DataFrame, key: str, time: str, arrival: str, value: str, step: Callable[[float, float], float]) -> DataFrame:
    """(key, events, rollbacks, undone, state): each object's events taken as they arrive, and undone where an earlier one comes late.

    An object keeps its state before every event. An event older than the last
    one taken rolls the object back to its place: the events after it are undone
    and taken again. What is left equals the fold in order of time. Of equal
    times, the one that arrived first goes first. The history of one object is
    one task's, as every state follows from the one before.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        times, values, before = [], [], [0.0]
        rollbacks = undone = 0
        for t, v in zip(f["t"], f["v"], strict=True):
            place = bisect.bisect_right(times, t)
            rollbacks += place < len(times)
            undone += len(times) - place
            times.insert(place, t)
            values.insert(place, v)
            del before[place + 1 :]
            for x in values[place:]:
                before.append(step(before[-1], x))
        return pd.DataFrame({key: [f[key].iat[0]], "events": [len(f)], "rollbacks": [rollbacks], "undone": [undone], "state": [before[-1]]})

    rows = events.select(F.col(key).cast("long").alias(key), F.col(time).cast("timestamp").alias("t"), F.col(arrival).alias("at"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).applyInPandas(run, f"`{key}` long, events long, rollbacks long, undone long, state double")


def event_time_fold(events: DataFrame, key: str, time: str, value: str, step: Callable[[float, float], float], delay: str = "1 hour") -> DataFrame:
    """(key, events, state): each object's events folded in order of their time, as batches arrive.

    A conservative strategy: only events before the watermark are committed; the
    others wait in the state, sorted, and late ones are dropped by the watermark.
    """
    rows = events.select(key, F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("v"))
    if not rows.isStreaming:
        def whole(f: pd.DataFrame) -> pd.DataFrame:
            s = 0.0
            for v in f.sort_values(["t", "v"])["v"]:
                s = step(s, v)
            return pd.DataFrame({key: [f[key].iat[0]], "events": [len(f)], "state": [s]})

        return rows.groupBy(key).applyInPandas(whole, f"`{key}` long, events long, state double")

    def commit(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s, waiting = (json.loads(x) if i == 2 else x for i, x in enumerate(state.get)) if state.exists else (0, 0.0, [])
        waiting = list(waiting)
        for f in frames:
            waiting += [[int(t.value), float(v)] for t, v in zip(f["t"], f["v"], strict=True)]
        waiting.sort()
        safe = state.getCurrentWatermarkMs() * 1_000_000
        timed_out = state.hasTimedOut
        while waiting and (timed_out or waiting[0][0] < safe):
            s = step(s, waiting.pop(0)[1])
            n += 1
        if timed_out:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "events": [n], "state": [s]})
        else:
            state.update((n, s, json.dumps(waiting)))
            last = waiting[-1][0] // 1_000_000 if waiting else safe // 1_000_000
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    grouped = rows.withWatermark("t", delay).groupBy(key)
    return grouped.applyInPandasWithState(commit, f"`{key}` long, events long, state double", "n long, s double, waiting string", "append", "EventTimeTimeout")

