"""The session settings every flowlark plan relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session to the operators instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowlark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
