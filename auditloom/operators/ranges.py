"""Range joins: values in intervals, intervals in intervals, without comparing every pair.

An interval is put on the level whose bins are at least as long as it is, a power of two, so it touches at most two bins there,
however long it is.  A value has one bin on each level that any interval is on.  Both sides then meet by level and bin, and
the bounds are tested on what meets: at most four times as many pairs as there are results on evenly spread bounds.
Bounds are whole numbers of up to 38 digits.  Pairs are dealt evenly to all tasks, whatever bins they are in: results may grow as the
product of both sides, tables that one task reads included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.plans.lineage import cut
from auditloom.plans.skew import pair_join

WHOLE = "decimal(38,0)"


def _level(lo: Column, hi: Column) -> Column:
    """Smallest k, or the one above it, with 2^k >= hi - lo + 1."""
    return F.ceil(F.log2((hi - lo + 1).cast("double") * 1.0000001)).cast("int")


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast(WHOLE)


def _bin(value: Column, level: Column) -> Column:
    return value - F.pmod(value, _size(level))


def values_in(values: DataFrame, value: str, intervals: DataFrame, lo: str = "lo", hi: str = "hi", extra: Column | None = None) -> DataFrame:
    """Every row of ``values`` with every interval that its value lies in; all columns of both sides, whose names must differ.

    ``extra`` is a further test on the pair.  Null values and bounds and empty intervals (lo > hi) meet nothing.
    """
    both = set(values.columns) & set(intervals.columns)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    a, z, v = (F.col(c).cast(WHOLE) for c in (lo, hi, value))
    placed = intervals.where(a <= z).withColumn("_level", _level(a, z))
    first = _bin(a, F.col("_level"))
    second = first + _size(F.col("_level"))
    bins = F.when(second <= z, F.array(first, second)).otherwise(F.array(first)).cast(f"array<{WHOLE}>")
    placed = cut(placed.withColumn("_bin", F.explode(bins)))
    # The levels in use: at most 127 numbers.
    levels = placed.agg(F.sort_array(F.collect_set("_level")).alias("levels"))
    spread = values.where(v.isNotNull()).withColumn("_level", F.explode(levels.scalar()))
    spread = spread.withColumn("_bin", _bin(v, F.col("_level")).cast(WHOLE))
    pairs = pair_join(placed, spread, ["_level", "_bin"])
    inside = (a <= v) & (v <= z)
    return pairs.where(inside if extra is None else inside & extra).drop("_level", "_bin")


def intervals_in(inner: DataFrame, inner_lo: str, inner_hi: str, outer: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Every interval of ``inner`` with every interval of ``outer`` that contains it; empty inner ones are in nothing."""
    own = inner.where(F.col(inner_lo).cast(WHOLE) <= F.col(inner_hi).cast(WHOLE))
    return values_in(own, inner_lo, outer, lo, hi, F.col(inner_hi).cast(WHOLE) <= F.col(hi).cast(WHOLE))
