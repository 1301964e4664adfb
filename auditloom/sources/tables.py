"""Columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, spread_by: list[str] | None = None) -> DataFrame:
    """Parquet table.

    ``spread_by`` is for CPU-heavy row work: a table with fewer splits than the cluster has cores
    is hashed over all of them once.  Tables with enough splits, as large ones have, are read as
    they are, without a shuffle.
    """
    df = spark.read.parquet(path)
    if spread_by:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores, *spread_by)
    return df


def constant_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows written in code as a frame, without a Python stage."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])))
