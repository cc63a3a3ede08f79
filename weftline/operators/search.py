"""Searches of state spaces, level by level: a row per open state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.lineage import cut


def satisfying(spark: SparkSession, clauses: Sequence[Sequence[int]], n: int) -> DataFrame:
    """(assignment,): the assignments of n variables, a bit each, that satisfy all clauses of signed variable numbers.

    A level sets one variable and drops what breaks a clause whose variables are all set.
    """
    level = spark.range(1).select(F.lit(0).cast("long").alias("assignment"))
    for k in range(1, n + 1):
        level = level.select(F.explode(F.array(F.col("assignment"), F.col("assignment") + (1 << (k - 1)))).alias("assignment"))
        for clause in clauses:
            if max(map(abs, clause)) == k:
                holds = F.lit(False)
                for x in clause:
                    bit = F.shiftright("assignment", abs(x) - 1).bitwiseAND(F.lit(1)) == (1 if x > 0 else 0)
                    holds = holds | bit
                level = level.where(holds)
        if k % 8 == 0:
            level = cut(level.repartition(8))
    return level


def hamiltonian_cycles(edges: DataFrame, n: int, start: int = 0) -> DataFrame:
    """(path,): the closed tours of all n nodes from ``start``, each in both ways; edges (u, v) are taken both ways."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    paths = edges.sparkSession.range(1).select(F.array(F.lit(start).cast("long")).alias("path"))
    for k in range(1, n):
        paths = paths.join(both, F.element_at("path", -1) == F.col("u")).where(~F.array_contains("path", F.col("v"))).select(F.concat("path", F.array("v")).alias("path"))
        if k % 4 == 0:
            paths = cut(paths)
    return paths.join(both, (F.element_at("path", -1) == F.col("u")) & (F.col("v") == start), "left_semi")


def tree_levels(spark: SparkSession, depth: int, children, root: int = 1) -> DataFrame:
    """(level, n) of an implicit tree: ``children`` maps a node's number to the array of its children's."""
    level, out = spark.range(1).select(F.lit(root).cast("long").alias("x")), None
    for k in range(depth + 1):
        level = cut(level)
        row = level.agg(F.count("*").alias("n")).select(F.lit(k).cast("long").alias("level"), "n")
        out = row if out is None else out.unionByName(row)
        level = level.select(F.explode(children(F.col("x"))).alias("x"))
    return out
