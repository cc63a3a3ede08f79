"""Sessions that read and write large files by byte ranges.

A reader seeks to its range, so no task holds more than that, however large the
file. A write session is a set of files, each a run of bytes that follow each
other, and a table that says which bytes they hold; a part counts only if its
task has ended well, so what a lost or second attempt writes is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.lineage import cut

_READ = "path string, offset long, data binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at, from_, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_file(name) as f:
                f.seek(from_)
                yield pa.record_batch([pa.array([path]), pa.array([at], pa.int64()), pa.array([f.read(length)], pa.binary())], names=["path", "offset", "data"])


def read_slices(slices: DataFrame) -> DataFrame:
    """(path, offset, data) of slices (path, offset, length); a slice beyond the end of its file is as short as what is there."""
    return slices.select("path", F.col("offset").cast("long").alias("at"), F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length")).mapInArrow(_read, _READ)


def _files(spark: SparkSession, path: str) -> DataFrame:
    # the contents are not read: they are not selected
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, offset, data) of whole files in ranges of ``size`` bytes; every byte lies in one range, an empty file has none."""
    n = F.ceil(F.col("length") / size).cast("long")
    parts = _files(spark, path).where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return read_slices(parts.select("path", (F.col("k") * size).alias("offset"), F.least(F.lit(size), F.col("length") - F.col("k") * size).alias("length")))


def read_view(spark: SparkSession, path: str, displacement: int, block: int, stride: int) -> DataFrame:
    """(path, offset, data) as a file view shows them: after ``displacement``, of every ``stride`` bytes the first ``block``."""
    n = F.ceil((F.col("length") - displacement) / F.lit(stride)).cast("long")
    parts = _files(spark, path).where(F.col("length") > displacement).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    at = displacement + F.col("k") * stride
    return read_slices(parts.select("path", at.alias("offset"), F.least(F.lit(block), F.col("length") - at).alias("length")))


def write_session(rows: DataFrame, folder: str, offset: str = "offset", data: str = "data") -> DataFrame:
    """Writes rows (offset, data) in any order; (path, offset, length) per run of bytes that follow each other in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, out, name, begin, end = None, None, "", 0, -1

        def done() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([[name], [begin], [end - begin]], names=["path", "offset", "length"])

        for batch in batches:
            for at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at != end:
                    if out is not None:
                        yield done()
                    name, begin, end = f"{folder}/{uuid.uuid4().hex}.part", at, at
                    where, path = fs.FileSystem.from_uri(name)
                    where.create_dir(path.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(path)
                out.write(data)
                end += len(data)
        if out is not None:
            yield done()

    ordered = rows.select(F.col(offset).cast("long").alias("offset"), F.col(data).alias("data")).repartitionByRange("offset").sortWithinPartitions("offset")
    return cut(ordered.mapInArrow(run, "path string, offset long, length long"))


def read_session(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(offset, data) of wanted (offset, length), each within one part of ``write_session``: parts of equal halves of a power of two meet what begins there."""
    # a part is named in each block of bytes that it touches; blocks are as long as the longest part, so that is two at most
    size = max(1, parts.agg(F.max("length")).first()[0] or 1)
    block = lambda c: F.floor(c / size).cast("long")
    named = parts.select("path", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"))
    named = named.withColumn("block", F.explode(F.sequence(block(F.col("begin")), block(F.col("end")))))
    met = wanted.withColumn("block", block(F.col("offset"))).join(named, "block").where((F.col("offset") >= F.col("begin")) & (F.col("offset") + F.col("length") <= F.col("end")) & ((F.col("offset") < F.col("end")) | (F.col("length") > 0)))
    slices = met.select("path", F.col("offset").alias("at"), (F.col("offset") - F.col("begin")).alias("from"), F.col("length").cast("long").alias("length"))
    return slices.mapInArrow(_read, _READ).select("offset", "data")
