"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits its rows again and again by a random direction at a random
place near the mean, until a leaf is small. Rows near the place go to both
sides (spill). All rows of one label begin in one node, so labels never meet.
Pairs are compared within leaves. A row carries the leaves that it lies in,
and a pair counts only in the first leaf, in a fixed order, that both lie in:
so a leaf hands on counts and the links of a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.lineage import cut, tidied
from weftline.llm.groups import Forest

#: Rows of a leaf that one task compares; a node beyond it is split.
LEAF_ROWS = 1024
#: A node of which a side keeps more than this share is too dense to split: its rows are compared in blocks.
DENSE = 0.9
#: Splits of a tree at most; larger nodes are then compared in blocks.
LEVELS = 40
#: Rows of a block of such a node: a row goes to as many tasks as the node has blocks.
BLOCK_ROWS = 4096


def _directions(trees: int, levels: int, width: int, seed: int) -> np.ndarray:
    d = np.random.default_rng(seed).standard_normal((trees, levels, width))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


def _unit(values: list) -> np.ndarray | None:
    """The vector over its length, in double precision; None if it is null, zero or not finite."""
    if values is None or not values or any(x is None for x in values):
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def _pairs_in_leaf(ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, leaf: int, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) that link and for which ``leaf`` is the first in common."""
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        s = vectors[rows] @ vectors[right].T
        i, j = np.nonzero(s >= threshold - 1e-9)
        i, j = rows[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        # the product of a matrix may add up in another order: the last digits are settled pair by pair
        ok = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= threshold
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            shared = np.where((leaves[a][:, :, None] == leaves[b][:, None, :]).any(axis=2) & (leaves[a] >= 0), leaves[a], np.iinfo(np.int64).max).min(axis=1)
            mine = shared == leaf
            yield a[mine], b[mine]


def _compare(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    leaf = int(frame["leaf"].iat[0])
    ids, many = frame["id"].to_numpy(), frame["many"].to_numpy()
    vectors = np.stack(frame["unit"].to_list())
    widest = max(map(len, frame["leaves"]))
    leaves = np.full((len(ids), widest), -1, np.int64)
    for k, x in enumerate(frame["leaves"]):
        leaves[k, : len(x)] = x
    block = frame["block"].to_numpy()
    c1, c2 = int(frame["c1"].iat[0]), int(frame["c2"].iat[0])
    left = np.flatnonzero(block == c1)
    right = left if c1 == c2 else np.flatnonzero(block == c2)
    links = np.zeros(len(ids), np.int64)
    forest = Forest(len(ids))
    for i, j in _pairs_in_leaf(ids, vectors, leaves, leaf, left, right, c1 == c2, threshold):
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        forest.add(i, j)
    i, j = forest.links()
    hit = np.flatnonzero(links)
    return pd.DataFrame({"a": np.concatenate((ids[hit], ids[i])), "b": np.concatenate((np.full(len(hit), -1), ids[j])), "n": np.concatenate((links[hit], np.zeros(len(i), np.int64)))})


@tidied
def embedding_near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, trees: int = 5, spill: float = 1.2, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Rows link if their labels are equal and not null and the cosine of their
    vectors, in double precision, is ``threshold`` or more. Null, empty or zero
    vectors and such with null or non-finite components link with nothing, and
    neither do vectors of different lengths. Equal vectors of a label are one
    node with a weight, so copies add to n_links without being compared.
    Repeated rows of an id each give a row and count as linked vectors. Rows
    with a null id link with nothing and get a null component. Other columns are
    not read. An empty table gives an empty result.

    spill: half the width of the band whose rows go to both sides, in standard
    deviations of what parts two rows at the threshold along a random direction:
    their distance, over the root of the number of dimensions. So the band is the
    same share of a node in any number of dimensions. At 1.2 a pair is parted in a
    split with a probability of about 0.001, in all of the trees with one far
    below 1e-6.
    """
    apart = math.sqrt(max(2 - 2 * threshold, 0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = rows.withColumn("good", F.coalesce((F.size("v") > 0) & F.col("label").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = cut(rows.withColumn("key", F.when(F.col("good"), F.md5(F.concat(F.col("label").cast("string"), F.lit(":"), F.array_join(F.col("v").cast("array<string>"), ","))))))
    heads = rows.where("good").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.min("label").alias("label"), F.min("v").alias("v"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                units = [_unit(v) for v in part.column(3).to_pylist()]
                along = []
                for u in units:
                    w = len(u)
                    if w not in directions:
                        directions[w] = _directions(trees, LEVELS, w, seed).reshape(trees * LEVELS, w)
                    along.append((directions[w] @ u).astype(np.float32))
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array([len(u) for u in units], pa.int32()), pa.array([u.tolist() for u in units], pa.list_(pa.float64())), pa.array([x.tolist() for x in along], pa.list_(pa.float32()))], names=["id", "many", "label", "width", "unit", "along"])

    heads = cut(heads.select("id", "many", "label", "v").mapInArrow(project, "id long, many long, label long, width int, unit array<double>, along array<float>"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    nodes = cut(heads.select("id", "label", "width", tree, F.lit("").alias("node"), "along").select("id", (F.lit(spill * apart) / F.sqrt("width")).alias("band"), F.concat_ws("/", "label", "width", "tree").alias("root"), "node", F.slice("along", F.col("tree") * LEVELS + 1, LEVELS).alias("along")))

    key = ["root", "node"]
    leaves: list[DataFrame] = []
    level = 0
    while True:
        size = nodes.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.element_at("along", level + 1)).alias("mean"), F.stddev_pop(F.element_at("along", level + 1)).alias("sd"))
        place = F.col("mean") + 0.25 * F.col("sd") * (F.crc32(F.concat_ws("/", F.lit(str(seed)), *key)) / F.lit(2.0**31) - 1)
        large = cut(size.where(F.col("n") > leaf_rows).select(*key, "n", place.alias("at")))
        if large.isEmpty():
            leaves.append(nodes.select("id", *key, F.lit(False).alias("dense")))
            break
        leaves.append(nodes.join(large, key, "left_anti").select("id", *key, F.lit(False).alias("dense")))
        inside = nodes.join(large, key)
        t = F.element_at("along", level + 1)
        low, high = t <= F.col("at") + F.col("band"), t >= F.col("at") - F.col("band")
        share = inside.groupBy(*key).agg(F.max("n").alias("n"), F.count_if(low).alias("lo"), F.count_if(high).alias("hi"))
        dense = cut(share.where((F.greatest("lo", "hi") > DENSE * F.col("n")) | F.lit(level + 1 >= LEVELS)).select(*key))
        leaves.append(nodes.join(dense, key, "left_semi").select("id", *key, F.lit(True).alias("dense")))
        inside = inside.join(dense, key, "left_anti")
        sides = F.array_compact(F.array(F.when(low, F.lit("0")), F.when(high, F.lit("1"))))
        nodes = cut(inside.withColumn("side", F.explode(sides)).select("id", "band", "root", F.concat("node", "side").alias("node"), "along"))
        level += 1
    placed = leaves[0]
    for x in leaves[1:]:
        placed = placed.unionByName(x)
    leaf = F.xxhash64("root", "node").bitwiseAND(F.lit((1 << 62) - 1))
    placed = cut(placed.select("id", leaf.alias("leaf"), "dense"))
    # dense nodes: blocks of rows, each pair of blocks a task
    sizes = placed.where("dense").groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    own = placed.groupBy("id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # as many as trees, times the spill
    carried = cut(heads.join(own, "id").select("id", "many", "unit", "leaves"))
    dealt = placed.join(sizes, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "leaf", "block", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"))
    found = dealt.join(carried, "id").groupBy("leaf", "c1", "c2").applyInPandas(lambda x: _compare(x, threshold), "a long, b long, n long")
    found = cut(found)
    counts = found.where("b = -1").groupBy("a").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b <> -1"))
    weights = heads.select("id", "many")
    per = weights.join(counts, weights["id"] == counts["a"], "left").select(weights["id"].alias("head"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"))
    per = cut(per.join(components, per["head"] == components["node"], "left").select("head", "n", F.coalesce("component", "head").alias("component")))
    member = cut(rows.where("good").groupBy("key").agg(F.min("id").alias("head")).join(per, "head").select("key", "n", "component"))
    out = rows.join(member, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
