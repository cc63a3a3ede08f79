"""All queries of the library: name, DataFrame form and SQL form."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that define SPECS: name -> (callable, SQL or None).
MODULES = ["reductions", "collectives", "selection", "scalars", "meshes", "iterations", "streams", "further"]


def _specs() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for m in MODULES:
        specs = importlib.import_module(f"weftline.plans.{m}").SPECS
        if twice := out.keys() & specs.keys():
            raise ValueError(f"queries defined twice: {sorted(twice)}")
        out |= specs
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _specs().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _specs().items() if sql}
