"""Rank-ordered collectives over grouped rows.

A communicator is a grouping key, a rank is a column. Windows are partitioned
by communicator; nothing is ordered over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.reduce import REDUCERS


def _order(comm: Sequence[str], rank: str):
    return Window.partitionBy(*comm).orderBy(rank)


def scan(df: DataFrame, comm: Sequence[str], rank: str, op: str, value: str, out: str) -> DataFrame:
    """Inclusive prefix in rank order."""
    return df.withColumn(out, REDUCERS[op](F.col(value)).over(_order(comm, rank).rowsBetween(Window.unboundedPreceding, 0)))


def exscan(df: DataFrame, comm: Sequence[str], rank: str, op: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix; rank 0 has null."""
    return df.withColumn(out, REDUCERS[op](F.col(value)).over(_order(comm, rank).rowsBetween(Window.unboundedPreceding, -1)))


def allreduce(df: DataFrame, comm: Sequence[str], op: str, value: str, out: str) -> DataFrame:
    """Every row gets its communicator's result: an aggregate joined back, so no group is gathered in a window."""
    return df.join(df.groupBy(*comm).agg(REDUCERS[op](F.col(value)).alias(out)), list(comm))


def bcast(df: DataFrame, comm: Sequence[str], rank: str, root: int, value: str, out: str) -> DataFrame:
    """Every rank gets the root's value."""
    return df.join(df.where(F.col(rank) == root).select(*comm, F.col(value).alias(out)), list(comm), "left")


def gather(df: DataFrame, comm: Sequence[str], rank: str, value: str, out: str) -> DataFrame:
    """One array per communicator in rank order."""
    got = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v"))))
    return df.groupBy(*comm).agg(got.alias("z")).select(*comm, F.col("z.v").alias(out))


def scatter(df: DataFrame, position: str, per_rank: int) -> DataFrame:
    """Adds the rank that gets each row of a root's buffer, and the place in that rank's part."""
    return df.withColumn("rank", F.floor(F.col(position) / per_rank).cast("long")).withColumn("place", (F.col(position) % per_rank).cast("long"))


def alltoall(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Swaps sender and receiver: what src held for dst, dst now holds from src."""
    return df.withColumnsRenamed({src: "_was_src", dst: src}).withColumnRenamed("_was_src", dst)


def reduce_scatter(df: DataFrame, vector: str, op: str, per_rank: int, out: str) -> DataFrame:
    """Element-wise reduction of vectors, whose parts then go to the ranks in turn."""
    summed = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(REDUCERS[op](F.col("x")).alias(out))
    return summed.select(F.floor(F.col("pos") / per_rank).cast("long").alias("rank"), (F.col("pos") % per_rank).cast("long").alias("place"), out)


def ordered_fold(df: DataFrame, comm: Sequence[str], rank: str, value: str, start: Column, step: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """A fold in rank order for operations that do not commute. A communicator's values are one array."""
    got = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v"))))
    return df.groupBy(*comm).agg(got.alias("z")).select(*comm, F.aggregate("z", start, lambda s, x: step(s, x["v"])).alias(out))


def split(df: DataFrame, color: str, key: Sequence[str], out: str = "new_rank") -> DataFrame:
    """New ranks from 0 within each color, ordered by key."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(color).orderBy(*key)) - 1).cast("long"))


def dims_create(n: int, d: int) -> list[int]:
    """Factors of n in d dimensions, as even as can be, largest first."""
    if d == 1:
        return [n]
    best = None
    for f in range(1, n + 1):
        if n % f == 0:
            rest = sorted([f, *dims_create(n // f, d - 1)], reverse=True)
            if best is None or rest[0] - rest[-1] < best[0] - best[-1]:
                best = rest
    return best


def cart_coords(rank: Column, dims: Sequence[int]) -> list[Column]:
    """Coordinates of a rank, last dimension fastest."""
    out, below = [], 1
    for n in reversed(dims):
        out.append((F.floor(rank / below) % n).cast("long"))
        below *= n
    return out[::-1]


def cart_rank(coords: Sequence[Column], dims: Sequence[int]) -> Column:
    rank = F.lit(0)
    for c, n in zip(coords, dims, strict=True):
        rank = rank * n + c
    return rank.cast("long")


def cart_shift(rank: Column, dims: Sequence[int], axis: int, by: int, periodic: bool) -> Column:
    """The rank ``by`` steps along an axis; beyond an edge that is not periodic, null."""
    coords = cart_coords(rank, dims)
    moved = coords[axis] + by
    inside = F.lit(True) if periodic else (moved >= 0) & (moved < dims[axis])
    coords[axis] = F.pmod(moved, F.lit(dims[axis]))
    return F.when(inside, cart_rank(coords, dims))


def cart_sub(rank: Column, dims: Sequence[int], keep: Sequence[bool]) -> tuple[Column, Column]:
    """(number of the sub-grid, rank in it) where only the dimensions to keep are left; sub-grids are numbered by the others."""
    coords = cart_coords(rank, dims)
    split = lambda wanted: ([c for c, k in zip(coords, keep, strict=True) if k == wanted], [n for n, k in zip(dims, keep, strict=True) if k == wanted])
    return cart_rank(*split(False)), cart_rank(*split(True))


def in_ranges(rank: Column, ranges: Sequence[tuple[int, int, int]]) -> Column:
    """Whether a rank lies in one of the ranges (first, last, step), last included, steps of either sign."""
    out = F.lit(False)
    for first, last, step in ranges:
        out = out | (rank.between(min(first, last), max(first, last)) & ((rank - first) % step == 0))
    return out


def neighbor_alltoall(edges: DataFrame) -> DataFrame:
    """(src, dst, sent, got): the place of each edge among those of its sender and of its receiver, from 0."""
    place = lambda a, b: (F.row_number().over(Window.partitionBy(a).orderBy(b)) - 1).cast("long")
    return edges.select("src", "dst", place("src", "dst").alias("sent"), place("dst", "src").alias("got"))


def match_any(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """(dst, send_id, recv_id): each receive, in order, takes the first message not yet taken that fits; a null source or tag fits all.

    sends: (dst, source, tag, send_id), receives: (dst, source, tag, recv_id). What
    one destination receives depends on all it has received before, so it is one
    task's; waiting messages are held by source and tag.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[tuple[int, int], list[int]] = {}
        sent = f[f["recv_id"].isna()].sort_values("send_id")
        for s, t, k in zip(sent["source"].astype(int), sent["tag"].astype(int), sent["send_id"].astype(int), strict=True):
            waiting.setdefault((s, t), []).append(k)
        first, out = dict.fromkeys(waiting, 0), []
        wanted = f[f["recv_id"].notna()].sort_values("recv_id")
        for s, t, k in zip(wanted["source"], wanted["tag"], wanted["recv_id"].astype(int), strict=True):
            fits = [x for x, q in waiting.items() if first[x] < len(q) and (pd.isna(s) or x[0] == s) and (pd.isna(t) or x[1] == t)]
            if fits:
                x = min(fits, key=lambda x: waiting[x][first[x]])
                out.append((f["dst"].iat[0], waiting[x][first[x]], k))
                first[x] += 1
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["dst", "send_id", "recv_id"])

    kinds = lambda d, *more: d.select(*(F.col(c).cast("long").alias(c) for c in ("dst", "source", "tag")), *(F.lit(None).cast("long").alias(c) if c not in d.columns else F.col(c).cast("long").alias(c) for c in more))
    both = kinds(sends, "send_id", "recv_id").unionByName(kinds(receives, "send_id", "recv_id"))
    return both.groupBy("dst").applyInPandas(run, "dst long, send_id long, recv_id long")


def indexed_place(pos: Column, blocks: Sequence[tuple[int, int]], extent: int) -> Column:
    """The packed place of an element of a type of blocks (place, length) that is repeated every ``extent``; null outside."""
    inside, total, out = pos % extent, sum(n for _, n in blocks), F.lit(None).cast("long")
    before = 0
    for at, n in blocks:
        out = F.when((inside >= at) & (inside < at + n), F.floor(pos / extent) * total + before + inside - at).otherwise(out)
        before += n
    return out.cast("long")


def block_cyclic(pos: Column, block: int, ranks: int) -> tuple[Column, Column]:
    """(owner, place there) of an element of an array dealt out in blocks, in turn."""
    nth = F.floor(pos / block)
    return (nth % ranks).cast("long"), (F.floor(nth / ranks) * block + pos % block).cast("long")


def neighbor_allgather(values: DataFrame, edges: DataFrame, rank: str, value: str, out: str) -> DataFrame:
    """(dst, src, value) along the edges of a graph: what each rank gets from its neighbours."""
    return edges.join(values.select(F.col(rank).alias("src"), F.col(value).alias(out)), "src")


def match_messages(sends: DataFrame, receives: DataFrame, keys: Sequence[str], send_order: str, receive_order: str) -> DataFrame:
    """Pairs the n-th send with the n-th receive of equal keys, first in first out."""
    turn = lambda by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    return sends.withColumn("turn", turn(send_order)).join(receives.withColumn("turn", turn(receive_order)), [*keys, "turn"])


def apply_updates(base: DataFrame, updates: DataFrame, key: str, op: str, value: str) -> DataFrame:
    """One-sided accumulate: updates merged by key into the base, keys of both sides kept."""
    return base.select(key, value).unionByName(updates.select(key, value)).groupBy(key).agg(REDUCERS[op](F.col(value)).alias(value))


def put_last(base: DataFrame, updates: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """One-sided put: the update with the highest sequence number wins, else the base value stays."""
    last = updates.groupBy(key).agg(F.max(F.struct(seq, value))[value].alias("put"))
    return base.join(last, key, "full").select(key, F.coalesce("put", value).alias(value))


def compare_and_swap(updates: DataFrame, key: str, seq: str, expected: str, new: str, start: Column, out: str) -> DataFrame:
    """The value of each key after its compare-and-swaps in order of ``seq``."""
    ops = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(expected).alias("e"), F.col(new).alias("n"))))
    return updates.groupBy(key).agg(ops.alias("z")).select(key, F.aggregate("z", start, lambda v, x: F.when(v == x["e"], x["n"]).otherwise(v)).alias(out))


def typed_slice(df: DataFrame, position: str, count: int, block: int, stride: int, start: int = 0) -> DataFrame:
    """The elements that a strided vector type of ``count`` blocks picks, with their place in the packed buffer."""
    at = F.col(position) - start
    picked = df.where((at >= 0) & (at < count * stride) & (at % stride < block))
    return picked.withColumn("packed", (F.floor((F.col(position) - start) / stride) * block + (F.col(position) - start) % stride).cast("long"))
