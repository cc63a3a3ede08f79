"""Index spaces, sections, priorities, sets and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.lineage import cut


def index_space(spark: SparkSession, ranges: Sequence[tuple[int, int, int]]) -> DataFrame:
    """All indices (i0, i1, ...) of (start, end, step) per dimension: one range, split by arithmetic, so no join."""
    sizes = [max(0, -(-(end - start) // step)) for start, end, step in ranges]
    total, below, columns = 1, 1, []
    for n in sizes:
        total *= n
    for k in reversed(range(len(ranges))):
        start, _, step = ranges[k]
        columns.append(((F.floor(F.col("id") / below) % max(1, sizes[k])) * step + start).cast("long").alias(f"i{k}"))
        below *= max(1, sizes[k])
    return spark.range(total).select(*columns[::-1])


def strided(index: Column, lo: int, hi: int, step: int) -> Column:
    """Whether an index lies in lo..hi (both in) by steps."""
    return index.between(lo, hi) & ((index - lo) % step == 0)


def explicit_section(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys are listed; lists may repeat."""
    return df.join(members, list(keys), "left_semi")


def upsert(base: DataFrame, inserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Base without what is deleted or inserted anew, with the inserts."""
    kept = base.join(deletes, key, "left_anti").join(inserts, key, "left_anti")
    return kept.unionByName(inserts)


def queue_order(df: DataFrame, by: Sequence[str], priority: str, seq: str, lifo: bool = False, out: str = "turn") -> DataFrame:
    """Turn in a priority queue: least priority first, equal ones first in first out, or last in first out."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(priority, F.desc(seq) if lifo else F.asc(seq))).cast("long"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_turn") <= k).drop("_turn")


def compact_sequence(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., start, last, n): runs of consecutive values of a set of integers."""
    rows = df.select(*by, value).distinct()
    run = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return rows.withColumn("_run", run).groupBy(*by, "_run").agg(F.min(value).alias("start"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_run")


def ordered_ranks(df: DataFrame, by: Sequence[str], out: str = "rank") -> DataFrame:
    """The rows with their place from 0 in the order of ``by``, over the whole table.

    Rows go to ranges; a range knows its size, and the sizes of the few ranges
    before it are summed up. No task sees more than a range. Rows alike in ``by``
    get places in no set order.
    """
    names = df.columns
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the high bits of the id are the partition, the low ones the place in it
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    first = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_first"))
    ranked = rows.withColumn("_part", part).join(first, "_part")
    return ranked.select(*names, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(out))


def median_halves(df: DataFrame, by: str, order: Sequence[str], out: str = "upper") -> DataFrame:
    """Whether a row lies above the median place of its group; groups may be of any size, as ranks are those of the whole table."""
    ranked = cut(ordered_ranks(df, [by, *order], "_rank"))
    groups = ranked.groupBy(F.col(by).alias("_by")).agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    met = ranked.join(groups, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return met.withColumn(out, F.col("_rank") - F.col("_first") >= F.ceil(F.col("_n") / 2)).drop("_rank", "_first", "_n")


def ordered_union(a: DataFrame, b: DataFrame, key: str, seq: str) -> DataFrame:
    """Members of a in its order, then those only in b in its order, as (key, turn) from 0."""
    both = a.select(key, F.lit(0).alias("_side"), seq).unionByName(b.select(key, F.lit(1).alias("_side"), seq))
    first = both.groupBy(key).agg(F.min(F.struct("_side", seq)).alias("z"))
    return ordered_ranks(first.select(key, F.col("z._side").alias("_side"), F.col(f"z.{seq}").alias("_seq")), ["_side", "_seq"], "turn").select(key, "turn")


def hilbert_index(x: Column, y: Column, order: int) -> Column:
    """Place of a cell on the Hilbert curve over a square of 2**order cells a side."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    sides = F.array(*(F.lit(1 << k).cast("long") for k in reversed(range(order))))

    def step(s: Column, n: Column) -> Column:
        rx, ry = (s["x"].bitwiseAND(n) > 0).cast("long"), (s["y"].bitwiseAND(n) > 0).cast("long")
        d = s["d"] + n * n * (3 * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        a, b = F.when(flip, F.lit((1 << order) - 1) - s["x"]).otherwise(s["x"]), F.when(flip, F.lit((1 << order) - 1) - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, b).otherwise(a).alias("x"), F.when(ry == 0, a).otherwise(b).alias("y"), d.alias("d"))

    return F.aggregate(sides, start, step)["d"]
