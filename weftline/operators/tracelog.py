"""Event-log analytics: utilization by time bin, summaries, nesting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def utilization(log: DataFrame, bin_ms: int) -> DataFrame:
    """(bin, ep, busy): executions (ep, begin, end) cut at the edges of time bins."""
    bins = F.sequence(F.floor(F.col("begin") / bin_ms), F.floor((F.col("end") - 1) / bin_ms))
    d = log.select("ep", "begin", "end", F.explode(bins).alias("bin"))
    part = F.least(F.col("end"), (F.col("bin") + 1) * bin_ms) - F.greatest(F.col("begin"), F.col("bin") * bin_ms)
    return d.groupBy("bin", "ep").agg(F.sum(part).alias("busy"))


def entry_summary(log: DataFrame, entry: str, time: str, threshold: float, interval: float, bins: int = 10) -> DataFrame:
    """Total, longest and count per entry, and counts in bins above the threshold; what is not above it is in no bin."""
    t = F.col(time)
    edges = [threshold + interval * k for k in range(bins)]
    each = [F.count_if((t > lo) & (F.lit(True) if k == bins - 1 else t <= edges[k + 1])).alias(f"bin_{k}") for k, lo in enumerate(edges)]
    return log.groupBy(entry).agg(F.sum(t).alias("total"), F.max(t).alias("longest"), F.count("*").alias("n"), *each)


def nesting(log: DataFrame, by: Sequence[str], order: str, change: str) -> DataFrame:
    """Adds the depth after each begin (+1) and end (-1)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("depth", F.sum(change).over(w))


def matched_pairs(events: DataFrame, by: str, order: str, step: str) -> DataFrame:
    """(by, level, begin_id, end_id): each begin (step 1) with the end (step -1) that brings the nesting back to where it was."""
    after = F.sum(step).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("level", (after + F.when(F.col(step) < 0, 1).otherwise(0)).cast("long"))
    w = Window.partitionBy(by, "level").orderBy(order)
    rows = rows.withColumns({"end_id": F.lead(order).over(w), "_next": F.lead(step).over(w)})
    return rows.where((F.col(step) == 1) & (F.col("_next") == -1)).select(by, "level", F.col(order).alias("begin_id"), "end_id")
