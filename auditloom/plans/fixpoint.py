"""Frontier iteration: only what was new in the last round is joined in the next one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import DataFrame, functions as F

from auditloom.plans.lineage import cut_counted

#: A round has few rows when it has less than 1/FEW of all so far.
FEW = 16


def closure(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """Rows reachable from ``seeds`` by ``step``, one row per ``keys``, first found wins.

    ``step`` must return at most one row per ``keys``.  The driver only learns the row count of a round.
    After a round of many rows the next one's are looked up in all earlier ones as they come.  After one of few, as in the long
    tail of late rounds, they are written first and Spark sends them to the scans of the earlier rows, which then do not move.
    Rounds go on until one finds nothing new; ``max_rounds`` is a safety bound, reaching it is an error.
    """
    seen, total = cut_counted(seeds)
    frontier, n = seen, total
    for rounds in count(1):
        found = step(frontier).select(*seen.columns)
        if n * FEW > total:
            fresh, n = cut_counted(found.join(seen.select(*keys), keys, "left_anti"))
        else:
            found, n = cut_counted(found)
            if n:
                known = seen.select(*keys).join(found.select(*keys), keys, "left_semi")
                fresh, n = cut_counted(found.join(known, keys, "left_anti").select(*seen.columns))
        if n == 0:
            return seen
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
        seen = seen.unionByName(fresh)
        frontier, total = fresh, total + n


def states(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """``start`` and all rows that ``step`` leads to, with ``depth``, the number of steps; all columns are the key, nulls are equal.

    ``step`` may return rows repeatedly.  A round with many rows needs one shuffle: its rows and all earlier ones are
    grouped together, and those whose first depth is the round's are new; nothing is sorted and nothing is written twice.
    """
    keys = start.columns
    seen, total = cut_counted(start.distinct().withColumn("depth", F.lit(0)))
    frontier, n = seen, total
    for rounds in count(1):
        found = step(frontier.select(*keys)).select(*keys)
        if n * FEW > total:
            rows = found.withColumn("depth", F.lit(rounds)).unionByName(seen)
            fresh, n = cut_counted(rows.groupBy(*keys).agg(F.min("depth").alias("depth")).where(F.col("depth") == rounds))
        else:
            found, n = cut_counted(found.distinct())
            if n:
                same = reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
                known = seen.select(*keys).alias("a").join(found.alias("b"), same, "left_semi")
                fresh, n = cut_counted(found.alias("a").join(known.alias("b"), same, "left_anti").withColumn("depth", F.lit(rounds)))
        if n == 0:
            return seen
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
        seen = seen.unionByName(fresh)
        frontier, total = fresh, total + n
