"""Typed, vector, keyed and custom reductions.

All reducers are aggregate expressions, so Spark combines them in the map tasks
before any shuffle. Nulls are skipped, and an empty group has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reducer name -> aggregate of a column. Logical reducers take numbers, zero is false; xor is the parity of the true inputs.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "logical_and": lambda c: F.bool_and(c != 0).cast("int"),
    "logical_or": lambda c: F.bool_or(c != 0).cast("int"),
    "logical_xor": lambda c: (F.count_if(c != 0) % 2).cast("int"),
    "bitvec_and": F.bit_and,
    "bitvec_or": F.bit_or,
    "bitvec_xor": F.bit_xor,
    "random": F.any_value,
    "count": F.count,
    "concat": lambda c: F.array_sort(F.flatten(F.collect_list(c))),
    "set": lambda c: F.array_sort(F.collect_list(c)),
}
#: What a reduction over nothing yields where every index must have a value.
IDENTITIES = {"sum": 0, "product": 1, "logical_and": 1, "logical_or": 0, "logical_xor": 0, "bitvec_or": 0, "bitvec_xor": 0, "count": 0}


def reduce_by(df: DataFrame, by: Sequence[str], **outputs: tuple[str, str | Column]) -> DataFrame:
    """Several reductions in one pass: reduce_by(df, ["k"], total=("sum", "x"), ...)."""
    aggs = [REDUCERS[op](F.col(c) if isinstance(c, str) else c).alias(name) for name, (op, c) in outputs.items()]
    return df.groupBy(*by).agg(*aggs)


def max_loc(value: Column, location: Column) -> Column:
    """struct(v, loc) of the largest value; of equal values the one with the lowest location."""
    found = F.max(F.struct(value.alias("v"), (-location).alias("nl")))
    return F.struct(found["v"].alias("v"), (-found["nl"]).alias("loc"))


def min_loc(value: Column, location: Column) -> Column:
    return F.min(F.struct(value.alias("v"), location.alias("loc")))


def statistics(c: Column, prefix: str = "") -> list[Column]:
    """Count, mean, sample variance and deviation, extremes, and root mean square."""
    return [F.count(c).alias(f"{prefix}n"), F.avg(c).alias(f"{prefix}mean"), F.var_samp(c).alias(f"{prefix}var"), F.stddev_samp(c).alias(f"{prefix}sd"), F.min(c).alias(f"{prefix}lo"), F.max(c).alias(f"{prefix}hi"), F.sqrt(F.avg(c * c)).alias(f"{prefix}rms")]


def vector_reduce(df: DataFrame, by: Sequence[str], vector: str, op: str, out: str = "v") -> DataFrame:
    """Element-wise reduction of equally long vectors, as (by..., pos, out): one row per element, so that long vectors spread over the cluster."""
    return df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(REDUCERS[op](F.col("x")).alias(out))


def as_vectors(elements: DataFrame, by: Sequence[str], value: str, out: str = "vector") -> DataFrame:
    """The elements of ``vector_reduce`` as arrays again."""
    return elements.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("z")).select(*by, F.col(f"z.{value}").alias(out))


def sparse_reduce(df: DataFrame, index: Sequence[str], op: str, value: str, out: str) -> DataFrame:
    """One row per contributed index of one to six dimensions."""
    return df.groupBy(*index).agg(REDUCERS[op](F.col(value)).alias(out))


def segment_reduce(df: DataFrame, rectangle: Sequence[str], values: str, op: str, out: str = "v") -> DataFrame:
    """Reduction of dense 2-D segments (sx, sy, ex, ey, row-major values): one row per cell (x, y)."""
    sx, sy, ex, _ = rectangle
    width = F.col(ex) - F.col(sx) + 1
    cells = df.select(F.col(sx).alias("sx"), F.col(sy).alias("sy"), width.alias("w"), F.posexplode(values).alias("p", "z"))
    cell = cells.select((F.col("sx") + F.col("p") % F.col("w")).alias("x"), (F.col("sy") + F.floor(F.col("p") / F.col("w"))).cast("long").alias("y"), "z")
    return cell.groupBy("x", "y").agg(REDUCERS[op](F.col("z")).alias(out))


def accumulate(updates: DataFrame, index: str, size: int, op: str, value: str, out: str, identity=None) -> DataFrame:
    """Accumulate phase of a shared array: every index of 0..size-1 has a row, untouched ones the identity."""
    identity = IDENTITIES[op] if identity is None else identity
    merged = updates.groupBy(F.col(index).cast("long").alias(index)).agg(REDUCERS[op](F.col(value)).alias(out))
    kind = merged.schema[out].dataType
    every = updates.sparkSession.range(size).withColumnRenamed("id", index)
    return every.join(merged, index, "left").select(index, F.coalesce(F.col(out), F.lit(identity).cast(kind)).alias(out))


def histogram(df: DataFrame, value: Column, bins: int, top: float, low: float = 0.0) -> DataFrame:
    """(bin, n): equal bins over [low, top), outliers in the end bins, empty bins kept."""
    width = (top - low) / bins
    bin_of = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / F.lit(width)))).cast("long")
    counted = df.select(bin_of.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fold_small(df: DataFrame, by: Sequence[str], item: str, value: str, threshold: float, other: str = "other") -> DataFrame:
    """Sums per (by, item), where items with less than ``threshold`` of their group's total fold into one."""
    sums = df.groupBy(*by, item).agg(F.sum(value).alias("s"))
    totals = df.groupBy(*by).agg(F.sum(value).alias("t"))
    name = F.when(F.col("s") < threshold * F.col("t"), F.lit(other)).otherwise(F.col(item).cast("string"))
    return sums.join(totals, list(by)).withColumn(item, name).groupBy(*by, item).agg(F.sum("s").alias(value))


def custom_reduce(df: DataFrame, by: Sequence[str], column: str, function: Callable[[pd.Series], float], kind: str = "double", out: str = "v", merge: Callable[[pd.Series], float] | None = None, parts: int = 32) -> DataFrame:
    """A reducer written in Python.

    With ``merge`` (a streamable reducer), a group is reduced in parts and the
    parts' results are merged, so a hot group never meets in one task.
    """
    reducer = _grouped(function, kind)
    if merge is None:
        return df.groupBy(*by).agg(reducer(F.col(column)).alias(out))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part")
    first = df.select(*by, F.col(column).alias("x"), part).groupBy(*by, "part").agg(reducer(F.col("x")).alias("x"))
    return first.groupBy(*by).agg(_grouped(merge, kind)(F.col("x")).alias(out))


def _grouped(function: Callable[[pd.Series], float], kind: str):
    def call(x: pd.Series) -> float:
        return function(x)

    return F.pandas_udf(call, kind)
