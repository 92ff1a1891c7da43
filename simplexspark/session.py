"""Session settings shared by tests, bench and examples.

On a cluster the session comes from the submitter; nothing in the library needs
more than adaptive execution and a UTC session time zone.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "simplexspark", cores: int | str | None = None, **conf: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # else a submitter started us and names the master
        builder = builder.master(f"local[{cores}]")
    builder = (
        builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIMPLEXSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
