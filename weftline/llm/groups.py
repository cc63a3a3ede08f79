"""Links within groups of rows, some of which may hold a large share of all rows.

A group within its limit is one task. A larger one is dealt into blocks, each
of which also gets a few leaders of the whole group. After that, rows that are
already joined need no further comparison: only the rows outside the largest
part meet all blocks. A group of true near copies thus costs time in proportion
to its rows; rows that link to little are compared with all others, block by
block, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.lineage import cut

#: Leaders of a large group, in the mean.
LEADERS = 64
_LINK = "a long, b long"


class Forest:
    """Union of links between n things; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.parent[i], self.parent[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if not len(i):
                return
            hi, lo = np.maximum(ri, rj), np.minimum(ri, rj)
            # one link for each root that is hung below a smaller one
            order = np.lexsort((lo, hi))
            first = order[np.concatenate(([True], hi[order][1:] != hi[order][:-1]))]
            self.parent[hi[first]] = lo[first]
            self.kept.append((i[first], j[first]))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.kept, strict=True))

    def stars(self, ids: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(smallest id of the tree, id) for all ids but the smallest themselves; of: the thing of each id, if not one for one."""
        root = self.parent if of is None else self.parent[of]
        least = np.full(len(self.parent), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        first = least[root]
        other = first != ids
        return first[other], ids[other]


#: Links that one task thins out.
TASK_LINKS = 1 << 20


def thinned(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(a, b), a < b: fewer links of the same components: of each task's share, a star for each of its components."""
    links = cut(links.select("a", "b").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        forest = Forest(len(ids))
        forest.add(at[: len(a)], at[len(a) :])
        a, b = forest.stars(ids)
        for k in range(0, len(a), 65536):
            yield pa.record_batch([pa.array(a[k : k + 65536]), pa.array(b[k : k + 65536])], names=["a", "b"])

    return links.repartition(1 + links.count() // task_links).mapInArrow(run, _LINK)


def _out(pairs: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    a, b = pairs
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def links_in_groups(
    rows: DataFrame, limit: int, within: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], across: Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]], names: list[str], whole: str | None = None, leaders: int = LEADERS
) -> DataFrame:
    """(a, b), a < b: links that span the same components as all links inside the groups would.

    rows: (group, id, weight and the columns ``names``), a stored table.
    within(frame): id pairs that span the links among its rows. across(x, y):
    the same of links between the rows of x and those of y, which have a column
    ``part``; rows of one part are joined already. limit: weight that a task may
    hold. whole: a column of a coarser grouping, by which groups within the
    limit are put together where their sum is within it too.
    """
    sizes = cut(rows.groupBy(*([whole] if whole else []), "group").agg(F.sum("weight").alias("weight")))
    hot = cut(sizes.where(F.col("weight") > limit).select("group", "weight"))
    columns = ["id", *names]
    if whole:
        # groups of a coarse one that is too large for a task go on their own
        apart = cut(sizes.groupBy(whole).agg(F.sum("weight").alias("sum")).where(F.col("sum") > limit).select(whole, F.lit(True).alias("apart")))
        keyed = rows.withColumn("apart", F.lit(False)) if apart.isEmpty() else rows.join(apart, whole, "left")
        keyed = keyed.withColumn("task", F.when(F.col("apart"), F.col("group")).otherwise(-1 - F.col(whole)))
    else:
        keyed = rows.withColumn("task", F.col("group"))
    run = lambda frame: _out(within(frame))
    if hot.isEmpty():
        return keyed.select("task", *columns).groupBy("task").applyInPandas(run, _LINK)
    links = cut(keyed.join(hot.select("group"), "group", "left_anti").select("task", *columns).groupBy("task").applyInPandas(run, _LINK))

    place = F.xxhash64("id", F.lit(42))
    large = rows.join(hot.select("group", "weight").withColumnRenamed("weight", "all"), "group").withColumn("k", F.ceil(F.col("all") / limit).cast("int"))
    large = cut(large.withColumn("block", F.pmod(place, F.col("k")).cast("int")).select("group", "weight", "block", "k", *columns))
    counts = cut(large.groupBy("group").agg(F.count("*").alias("n")))
    # a hash below a share of its range chooses the leaders: about so many, wherever they lie
    chosen = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) < F.lit(float(leaders << 40)) / F.col("n")
    heads = large.join(counts, "group").where(chosen).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = large.select("group", "block", *columns).unionByName(heads.select("group", "block", *columns))
    first = cut(dealt.groupBy("group", "block").applyInPandas(run, _LINK).distinct())

    parts = connected_components(links.unionByName(first))
    own = cut(large.join(parts, large["id"] == parts["node"], "left").drop("node").withColumn("part", F.coalesce("component", "id")).drop("component"))
    most = own.groupBy("group", "part").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    own = cut(own.join(most, "group").withColumn("rest", F.col("part") != F.col("main")))
    left = cut(own.where("rest").groupBy("group").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("r")))
    if left.isEmpty():
        return links.unionByName(first)
    own = own.join(left, "group").withColumn("p", F.pmod(F.xxhash64("id", F.lit(11)), F.col("r")).cast("int"))
    columns = [*columns, "part"]
    searching = own.where("rest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("group", "p", "block", *columns, F.lit(True).alias("rest"))
    met = own.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).select("group", "p", "block", *columns, F.lit(False).alias("rest"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        of = frame["rest"].to_numpy()
        return _out(across(frame[of], frame[~of]))

    second = searching.unionByName(met).groupBy("group", "p", "block").applyInPandas(meet, _LINK)
    return links.unionByName(first).unionByName(second)
