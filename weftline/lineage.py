"""Cutting of lineage in the folder that all executors share.

``cut`` writes a table below ``spark.checkpoint.dir`` and reads it again, so a
lost executor costs a re-read and never a recomputation of the whole plan, and
adaptive execution plans from real sizes. ``tidied`` operators delete what they
cut on the way as soon as their result is written.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_LOCAL = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session without one, a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="weftline-"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended: the folder then goes with the application's
        pass


def _scopes() -> list[list[tuple]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the folders that were made inside and not handed on."""
    own: list[tuple] = []
    _scopes().append(own)
    try:
        yield
    finally:
        _scopes().remove(own)
        for args in own:
            _delete(*args)


def new_folder(spark: SparkSession, outer: bool = False) -> str:
    """A fresh folder name; it is deleted with the innermost scope (outer: the one around it), or when the program ends."""
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    context = spark.sparkContext
    args = (context._jvm, context._jsc.hadoopConfiguration(), path)
    scopes = _scopes()[:-1] if outer else _scopes()
    if scopes:
        scopes[-1].append(args)
    else:
        atexit.register(_delete, *args)
    return path


def cut(df: DataFrame, outer: bool = False) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = new_folder(spark, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written, and everything that it cut on the way deleted."""

    @wraps(operator)
    def run(*args, **options) -> DataFrame:
        with scope():
            return cut(operator(*args, **options), outer=True)

    return run
