"""Connected components by parent hooking and pointer shortcuts.

Every step is an aggregate with partial combination or an equi-join of two
stored tables, which adaptive execution can split where a node is a hub. No
group of neighbours is gathered anywhere. Labels fall monotonically, so an
unchanged sum of labels is a fixed point: every node then holds the smallest
id that it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.lineage import cut, tidied


def _label_sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]


@tidied
def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node id reachable.

    Loops, null ends and repeated edges are allowed and change nothing. Rounds
    grow with the logarithm of the longest path.
    """
    # both directions from one evaluation: which of several spanning links an operator gives may depend on the order of its rows
    pairs = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"))
    pairs = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
    total = _label_sum(labels)
    while total is not None:
        near = pairs.join(labels.select(F.col("u").alias("v"), "p"), "v").groupBy("u").agg(F.min("p").alias("m"))
        hooked = near.join(labels, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("p").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("p"))
        labels = cut(labels.unionByName(hooked).groupBy("u").agg(F.min("p").alias("p")))
        up = labels.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        labels = cut(labels.join(up, "p").select("u", F.col("pp").alias("p")))
        before, total = total, _label_sum(labels)
        if before == total:
            break
    return labels.select(F.col("u").alias("node"), F.col("p").alias("component"))
