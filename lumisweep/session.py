"""Session defaults shared by the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lumisweep", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster the master and the partition count come from the submit
    configuration; both arguments are for local runs.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if master:
        builder = (builder.master(master).config("spark.ui.showConsoleProgress", "false")
                   .config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "12g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
