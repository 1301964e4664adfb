"""Cutting lineage in iterative jobs.

Intermediate results are written as Parquet tables below ``spark.checkpoint.dir``.  Unlike
block-manager checkpoints they survive the loss of executors, they are computed once, and
their footers give the optimizer real sizes for the next round's join choice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only in local mode and only if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As :func:`cut`, with the number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and return a scan of the result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables that are deleted together once the result no longer needs them.

    Use as a context manager around a job that ends by writing its result elsewhere.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/auditloom-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def cut_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        out = self.cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]


def cut_bucketed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """As :func:`cut`, stored in buckets of ``keys``: later joins on exactly these keys do not shuffle it.

    Also returns the catalog name, to be given to :func:`forget` when no plan needs the table.
    """
    spark = df.sparkSession
    ident = f"auditloom_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{shared_dir(spark)}/{ident}")
     .format("parquet").saveAsTable(ident))
    return spark.table(ident), ident


def forget(spark: SparkSession, names: list[str]) -> None:
    """Remove bucketed tables from the catalog; their files stay in the shared folder."""
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")
