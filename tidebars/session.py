"""Session factory with the settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidebars", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution; a master that is already set (spark-submit) is kept."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
