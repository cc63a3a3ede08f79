"""Iteration, search, packing and partitioning.

Loops run on the driver over distributed tables; lineage is cut in the shared
folder every few rounds. Nothing but a few numbers per round comes back.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.lineage import cut
from weftline.operators.select import ordered_ranks
from weftline.operators.spatial import nearest_center


def kmeans(points: DataFrame, vector: str, seeds: Sequence[Sequence[float]], rounds: int = 50, tolerance: float = 1e-6) -> tuple[list[list[float]], int]:
    """(means, rounds): assign, sum up, move; an empty cluster keeps its mean; ends when all moves are within the tolerance. A row per cluster comes back each round."""
    means = [list(map(float, s)) for s in seeds]
    width = len(means[0])
    rows = points.select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    for k in range(1, rounds + 1):
        found = rows.select("v", nearest_center(F.col("v"), means)["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)))
        moved = 0.0
        for r in found.collect():
            new = [r[f"s{i}"] / r["n"] for i in range(width)]
            moved = max(moved, float(np.linalg.norm(np.subtract(new, means[r["k"]]))))
            means[r["k"]] = new
        if moved <= tolerance:
            return means, k
    return means, rounds


def jacobi(grid: DataFrame, n: int, rounds: int, threshold: float, axes: Sequence[str] = ("i", "j")) -> tuple[DataFrame, int]:
    """Relaxation of a field (axes..., v) of n cells a side by each cell's mean with its neighbours along the axes, five in a plane, seven in a cube; edges fixed; ends when no cell moves by the threshold."""
    state, axes = cut(grid), list(axes)
    offsets = [dict.fromkeys(axes, 0), *(dict.fromkeys(axes, 0) | {a: d} for a in axes for d in (1, -1))]
    inner = F.lit(True)
    for a in axes:
        inner = inner & F.col(a).between(1, n - 2)
    for k in range(1, rounds + 1):
        to = F.explode(F.array(*(F.struct(*((F.col(a) + d).alias(a) for a, d in off.items())) for off in offsets))).alias("to")
        around = state.select(to, "v").groupBy(*(f"to.{a}" for a in axes)).agg(F.avg("v").alias("m"))
        new = cut(state.join(around, axes).select(*axes, F.when(inner, F.col("m")).otherwise(F.col("v")).alias("v"), F.abs(F.when(inner, F.col("m") - F.col("v")).otherwise(0.0)).alias("d")))
        done = new.agg(F.bool_and(F.col("d") < threshold)).first()[0]
        state = new.drop("d")
        if done:
            return state, k
    return state, rounds


def wave(grid: DataFrame, rounds: int) -> DataFrame:
    """Leapfrog steps of the wave equation on a periodic grid (i, j, now, before) of n x n cells with 0.16 of the Laplacian."""
    n = grid.agg(F.max("i")).first()[0] + 1
    state = grid
    for k in range(rounds):
        to = F.explode(F.array(*(F.struct(F.pmod(F.col("i") + a, F.lit(n)).alias("i"), F.pmod(F.col("j") + b, F.lit(n)).alias("j")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))).alias("to")
        around = state.select(to, "now").groupBy("to.i", "to.j").agg(F.sum("now").alias("s"))
        state = state.join(around, ["i", "j"]).select("i", "j", (2 * F.col("now") - F.col("before") + 0.16 * (F.col("s") - 4 * F.col("now"))).alias("new"), F.col("now").alias("before")).withColumnRenamed("new", "now")
        if k % 4 == 3:
            state = cut(state)
    return state


def queens(spark: SparkSession, n: int) -> DataFrame:
    """Number of ways to place n queens: a row per partial placement, a level per rank of the board."""
    level = spark.range(n).select(F.array(F.col("id").cast("int")).alias("q"))
    for row in range(1, n):
        more = level.select("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"))
        free = F.forall(F.transform("q", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z["x"] >= 0)
        ok = F.lit(True)
        for k in range(row):
            x = F.element_at("q", k + 1)
            ok = ok & (F.col("c") != x) & (F.abs(F.col("c") - x) != row - k)
        level = more.where(free & ok).select(F.concat("q", F.array("c")).alias("q"))
        level = level.repartition(min(64, n * row)) if row < 3 else level
    return level.agg(F.count("*").alias("solutions"))


def task_levels(tasks: DataFrame, deps: DataFrame, rounds: int = 1000) -> DataFrame:
    """(task, level): a task runs one level after the last of its dependencies; deps: (task, needs)."""
    level = cut(tasks.select("task", F.lit(0).cast("long").alias("level")))
    total = 0
    for _ in range(rounds):
        after = deps.join(level.withColumnRenamed("task", "needs"), "needs").groupBy("task").agg((F.max("level") + 1).alias("after"))
        level = cut(level.join(after, "task", "left").select("task", F.greatest("level", F.coalesce("after", F.lit(0))).alias("level")))
        now = level.agg(F.sum("level")).first()[0] or 0
        if now == total:
            return level
        total = now
    raise ValueError("the dependencies hold a cycle")


def frontier_search(start: DataFrame, expand: Callable[[DataFrame], DataFrame], bound: Callable[[DataFrame], DataFrame], finished: Callable[[DataFrame], DataFrame], cost: str, depth: int) -> float | None:
    """Branch and bound, level by level: what is bound above the best solution so far is dropped. Returns the least cost, or None."""
    best, level = None, cut(start)
    for _ in range(depth):
        found = finished(level).agg(F.min(cost)).first()[0]
        best = found if best is None else best if found is None else min(best, found)
        level = bound(expand(level))
        if best is not None:
            level = level.where(F.col("bound") < best)
        level = cut(level)
        if level.isEmpty():
            break
    found = finished(level).agg(F.min(cost)).first()[0]
    return found if best is None else best if found is None else min(best, found)


def _greedy(frame: pd.DataFrame, bins: int) -> np.ndarray:
    heap = [(0.0, b) for b in range(bins)]
    out = np.zeros(len(frame), np.int64)
    load = frame["load"].to_numpy()
    for k in np.lexsort((frame["obj"].to_numpy(), -load)):
        held, b = heapq.heappop(heap)
        out[k] = b
        heapq.heappush(heap, (held + float(load[k]), b))
    return out


def greedy_packing(objs: DataFrame, bins: int, by: str = "pe_group") -> DataFrame:
    """(by, obj, load, bin): largest first onto the least loaded bin, apart for each group of processors."""
    kinds = f"`{by}` long, obj long, load double, bin long"
    return objs.select(F.col(by).cast("long").alias(by), F.col("obj").cast("long").alias("obj"), F.col("load").cast("double").alias("load")).groupBy(by).applyInPandas(lambda f: f.assign(bin=_greedy(f, bins)), kinds)


def greedy_refine(objs: DataFrame, bins: int, tolerance: float = 1.1, by: str = "pe_group") -> DataFrame:
    """As ``greedy_packing``, but an object stays in its ``old`` bin while that holds no more than the tolerance over the greedy maximum."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        plain = _greedy(f, bins)
        load = f["load"].to_numpy()
        limit = tolerance * max(np.bincount(plain, load, bins).max(), 0)
        held = np.zeros(bins)
        out = np.zeros(len(f), np.int64)
        old = f["old"].to_numpy()
        for k in np.lexsort((f["obj"].to_numpy(), -load)):
            b = int(old[k])
            if held[b] + load[k] > limit:
                b = int(held.argmin())
            out[k] = b
            held[b] += load[k]
        return f.assign(bin=out)

    rows = objs.select(F.col(by).cast("long").alias(by), F.col("obj").cast("long").alias("obj"), F.col("load").cast("double").alias("load"), F.col("old").cast("long").alias("old"))
    return rows.groupBy(by).applyInPandas(run, f"`{by}` long, obj long, load double, old long, bin long")


def refine_packing(objs: DataFrame, bins: int, by: str = "pe_group") -> DataFrame:
    """Moves objects off bins over a target, heaviest that fits first; the target is bisected down to 1 %."""

    def attempt(load, old, target):
        held, out = np.bincount(old, load, bins), old.copy()
        for b in np.flatnonzero(held > target):
            own = np.flatnonzero(old == b)
            for k in own[np.argsort(-load[own], kind="stable")]:
                if held[b] <= target:
                    break
                to = int(held.argmin())
                if held[to] + load[k] <= target:
                    out[k], held[b], held[to] = to, held[b] - load[k], held[to] + load[k]
        return out, held.max()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        load, old = f["load"].to_numpy(), f["old"].to_numpy()
        lo = max(np.bincount(_greedy(f, bins), load, bins).max(), 1e-12)
        hi = 1.5 * lo
        best, _ = attempt(load, old, hi)
        while hi - lo > 0.01 * lo:
            mid = (lo + hi) / 2
            out, top = attempt(load, old, mid)
            if top <= mid:
                best, hi = out, mid
            else:
                lo = mid
        return f.assign(bin=best)

    rows = objs.select(F.col(by).cast("long").alias(by), F.col("obj").cast("long").alias("obj"), F.col("load").cast("double").alias("load"), F.col("old").cast("long").alias("old"))
    return rows.groupBy(by).applyInPandas(run, f"`{by}` long, obj long, load double, old long, bin long")


def imbalance(objs: DataFrame, pe: str, load: str, target: float = 1.0) -> DataFrame:
    """(pe, load, avg, ratio, under): each processor's load against the mean; underloaded below the target share."""
    per = objs.groupBy(pe).agg(F.sum(load).alias("load"))
    means = per.agg(F.avg("load").alias("avg"), F.max("load").alias("top"))
    return per.join(F.broadcast(means)).select(pe, "load", "avg", (F.col("top") / F.col("avg")).alias("ratio"), (F.col("load") < target * F.col("avg")).alias("under"))


def edge_cut(parts: DataFrame, comm: DataFrame) -> DataFrame:
    """Bytes between objects of different parts; parts: (obj, part), comm: (src, dst, bytes)."""
    a = comm.join(parts.select(F.col("obj").alias("src"), F.col("part").alias("pa")), "src").join(parts.select(F.col("obj").alias("dst"), F.col("part").alias("pb")), "dst")
    return a.agg(F.sum(F.when(F.col("pa") != F.col("pb"), F.col("bytes")).otherwise(0)).alias("cut"), F.sum("bytes").alias("total"))


def planar_order(points: DataFrame, axis: str, id_col: str, parts: int) -> DataFrame:
    """Parts of equal size along one axis: of n rows the first n % parts parts have one more."""
    ranked = ordered_ranks(points, [axis, id_col], "_rank")
    n = ranked.count()
    size, longer = n // parts, n % parts
    rank, edge = F.col("_rank"), longer * (size + 1)
    return ranked.withColumn("part", F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(longer + F.floor((rank - edge) / max(size, 1))).cast("long")).drop("_rank")


def fft_lines(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, k, re, im): the discrete Fourier transform of each row's array; no row leaves its task. Rows with null arrays or components have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [np.fft.fft(np.asarray(v, np.float64)) for v in part.column(1).to_pylist()]
                n = np.array([len(f) for f in found], np.int64)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), n)))
                flat = np.concatenate(found) if found else np.zeros(0, complex)
                k = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch([ids, pa.array(k), pa.array(flat.real), pa.array(flat.imag)], names=[id_col, "k", "re", "im"])

    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    return rows.where(whole).select(F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"`{id_col}` long, k long, re double, im double")


def fft_slabs(field: DataFrame, n: int) -> DataFrame:
    """(x, y, z, re, im): the transform of a field (x, y, z, v) on n x n x n places, absent ones zero.

    A slab is a plane of one x, transformed in two dimensions by one task. The
    transpose is one shuffle by (y, z); a line of n numbers along x ends it.
    """

    def plane(frame: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((n, n))
        full[frame["y"].to_numpy(), frame["z"].to_numpy()] = frame["v"].to_numpy()
        found = np.fft.fft2(full)
        y, z = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({"x": frame["x"].iat[0], "y": y, "z": z, "re": found.real.ravel(), "im": found.imag.ravel()})

    def line(frame: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(n, complex)
        full[frame["x"].to_numpy()] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
        found = np.fft.fft(full)
        return pd.DataFrame({"x": np.arange(n), "y": frame["y"].iat[0], "z": frame["z"].iat[0], "re": found.real, "im": found.imag})

    kinds = "x long, y long, z long, re double, im double"
    rows = field.select(*(F.col(k).cast("long").alias(k) for k in "xyz"), F.col("v").cast("double").alias("v"))
    return rows.groupBy("x").applyInPandas(plane, kinds).groupBy("y", "z").applyInPandas(line, kinds)


def fit_line(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of a load over time, per object."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
