"""Readers of mesh, tour, clause and edge files and of event logs; all by Spark's own scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, pattern: str = r"\s+") -> DataFrame:
    """(file, line, f) with the fields of every line that is not empty; lines ascend within a file: by the block that they lie in, then in it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line"))
    return rows.select("file", "line", F.split(F.trim("value"), pattern).alias("f")).where(F.col("f")[0] != "")


def read_mesh_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, boundary) of ``.node`` files: a head line (nodes, dimensions, attributes, markers), a line per node, comments after #.

    The head is the first line that is no comment. boundary is null where the head names no markers.
    """
    d = _fields(spark, path).where(~F.col("f")[0].startswith("#"))
    heads = d.groupBy("file").agg(F.min(F.struct("line", "f")).alias("head")).select("file", F.col("head.line").alias("first"), (F.element_at("head.f", 4) != "0").alias("marked"))
    d = d.join(heads, "file").where(F.col("line") != F.col("first"))
    marker = F.when(F.col("marked"), F.element_at("f", -1).cast("int"))
    return d.select(F.col("f")[0].cast("long").alias("id"), F.col("f")[1].cast("double").alias("x"), F.col("f")[2].cast("double").alias("y"), marker.alias("boundary"))


def read_mesh_elements(spark: SparkSession, path: str) -> DataFrame:
    """(id, n1, n2, n3) of ``.ele`` files; the head line has only three fields."""
    d = _fields(spark, path).where(~F.col("f")[0].startswith("#") & (F.size("f") >= 4))
    return d.select(*(F.col("f")[k].cast("long").alias(n) for k, n in enumerate(("id", "n1", "n2", "n3"))))


def read_tour(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y) of the cities of a tour file."""
    d = _fields(spark, path).where((F.size("f") == 3) & F.col("f")[0].rlike(r"^\d+$"))
    return d.select(F.col("f")[0].cast("long").alias("id"), F.col("f")[1].cast("double").alias("x"), F.col("f")[2].cast("double").alias("y"))


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    """(file, clause, literals) of CNF files: clauses from 0, each closed by 0, over as many lines as it takes."""
    d = _fields(spark, path).where(F.col("f")[0].rlike(r"^-?\d+$"))
    tokens = d.select("file", "line", F.posexplode("f").alias("pos", "x")).withColumn("x", F.col("x").cast("int"))
    before = Window.partitionBy("file").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    tokens = tokens.withColumn("clause", F.coalesce(F.count_if(F.col("x") == 0).over(before), F.lit(0))).where("x <> 0")
    return tokens.groupBy("file", "clause").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", "x"))), lambda z: z["x"]).alias("literals"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of the edges of a cycle problem; -1 ends the list."""
    d = _fields(spark, path).where((F.size("f") == 2) & F.col("f")[0].rlike(r"^\d+$") & F.col("f")[1].rlike(r"^\d+$"))
    return d.select(F.col("f")[0].cast("long").alias("u"), F.col("f")[1].cast("long").alias("v"))


LOG_SCHEMA = "type int, time long, pe int, event int, entry int, msglen int"


def write_log(log: DataFrame, path: str) -> None:
    """An event log as gzip-compressed lines."""
    log.write.option("sep", " ").option("compression", "gzip").csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("sep", " ").csv(path)
