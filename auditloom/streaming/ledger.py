"""Ledgers: rows that a stream dropped as late, and batches that were delivered to each target."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

LATE_SCHEMA = "run string, batch_id long, operator int, kind string, dropped long"


class LateRows(StreamingQueryListener):
    """Writes, for every batch and stateful operator that dropped late rows, how many, to a table in a shared folder.

    Rows dropped by a watermark are lost without an error, so their number is kept where it can be asked for later.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.runId), p.batchId, k, s.operatorName, s.numRowsDroppedByWatermark) for k, s in enumerate(p.stateOperators) if s.numRowsDroppedByWatermark]
        if rows:
            self.spark.createDataFrame(rows, LATE_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Events arrive after the query has ended; return when its last one has."""
        self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds)

    def table(self) -> DataFrame:
        self.spark.createDataFrame([], LATE_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return self.spark.read.schema(LATE_SCHEMA).parquet(self.path)


@dataclass
class Target:
    """Where alerts go: a name that stays, and a function that delivers a batch."""

    name: str
    write: Callable[[DataFrame, int], None]


def folder(name: str, path: str) -> Target:
    return Target(name, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch_id={n}"))


DELIVERED_SCHEMA = "batch_id long, target string"


def deliver_once(stream: DataFrame, min_level: int, targets: Sequence[Target], checkpoint: str, level: str = "level", name: str = "alerts", **trigger) -> StreamingQuery:
    """Rows at or above a level to every target, each batch once per target.

    After each target the ledger below ``checkpoint`` gets a row.  A batch that is repeated after a failure between two targets goes
    only to those without one.  Only a failure between a target's own commit and its ledger row can deliver twice; a target that
    writes a folder per batch, as :func:`folder` does, then overwrites what it wrote.
    """
    spark = stream.sparkSession
    ledger = f"{checkpoint}/delivered"
    if len({t.name for t in targets}) < len(targets):
        raise ValueError("targets need different names")
    note = lambda rows: spark.createDataFrame(rows, DELIVERED_SCHEMA).coalesce(1).write.mode("append").parquet(ledger)
    note([])

    def deliver(batch: DataFrame, batch_id: int) -> None:
        done = {r["target"] for r in spark.read.schema(DELIVERED_SCHEMA).parquet(ledger).where(F.col("batch_id") == batch_id).collect()}
        left = [t for t in targets if t.name not in done]
        if not left:
            return
        due = batch.where(F.col(level) >= min_level).persist()
        try:
            for t in left:
                t.write(due, batch_id)
                note([(batch_id, t.name)])
        finally:
            due.unpersist()

    w = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{checkpoint}/query").queryName(name)
    return w.trigger(**(trigger or {"availableNow": True})).start()
