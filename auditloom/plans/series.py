"""Ordered series per key without one task per key.

A plain ``lag`` or ``rowsBetween`` window sends every row of a key to one task.  Here a series
is first cut by an order-preserving bucket (a day, a month), positions are made dense by adding
the sizes of earlier buckets, and frames are computed on fixed-size chunks of positions that
carry the few preceding rows they need.  Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 100_000


def with_position(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "pos") -> DataFrame:
    """Dense 1-based position of each row in its key.

    ``bucket`` must be monotone in ``order`` and fine enough that one bucket of the busiest key fits
    a task (a minute, say).  Only bucket sizes, one row per key and bucket, are gathered per key.
    """
    rows = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(sizes, part)
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )


def framed(df: DataFrame, keys: list[str], pos: str, n: int, exprs: Callable[[object], dict[str, Column]],
           chunk: int = CHUNK) -> DataFrame:
    """Add ``exprs(window)`` over the last ``n`` rows (this row included) of each key."""
    if chunk < n:
        raise ValueError("chunk must be at least the frame length")
    own = F.floor((F.col(pos) - 1) / F.lit(chunk))
    tail = F.pmod(F.col(pos) - 1, F.lit(chunk)) >= F.lit(chunk - (n - 1))
    rows = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-(n - 1), 0)
    for name, e in exprs(w).items():
        rows = rows.withColumn(name, e)
    return rows.where(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk")


def previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, cols: dict[str, str],
             chunk: int = CHUNK) -> DataFrame:
    """Columns of the preceding row of the same key: ``cols`` maps source column to new name."""
    placed = with_position(df, keys, order, bucket)
    wanted = lambda w: {new: F.when(F.count(F.lit(1)).over(w) > 1, F.first(old).over(w)) for old, new in cols.items()}
    return framed(placed, keys, "pos", 2, wanted, chunk).drop("pos")
