"""Session settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", memory: str = "8g", app: str = "auditloom") -> SparkSession:
    """Session for tests and the bench.  On a cluster the caller's session is used as is."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    n = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    spark = (
        b.config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
