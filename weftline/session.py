"""Session defaults used by tests, bench and the examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A UTC session with adaptive execution; extra settings win over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | extra
    spark = SparkSession.builder.master(master).appName("weftline").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
