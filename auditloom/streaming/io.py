"""Stream sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from auditloom.plans.lineage import shared_dir
from auditloom.plans.skew import parts_of

POLL = "500 milliseconds"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: The state store that has timers and several states a key.
STORE_WITH_TIMERS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use a state store with timers."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, STORE_WITH_TIMERS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def read_tx_stream(spark: SparkSession, path: str, schema, max_per_trigger: int | None = 100, fmt: str = "parquet",
                   pattern: str | None = None, **options: str) -> DataFrame:
    """Transactions as a stream; the checkpoint keeps the cursor, a trigger takes a bounded number of files."""
    r = spark.readStream.format(fmt).schema(schema)
    if fmt == "kafka":
        return r.options(**options).load()
    if max_per_trigger:
        r = r.option("maxFilesPerTrigger", max_per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.options(**options).load(path)


def alert_sink(stream: DataFrame, min_level: int, targets: Sequence[str], checkpoint: str, level: str = "level",
               once: bool = False, name: str = "alerts") -> StreamingQuery:
    """Deliver rows at or above a level to every target folder.

    A batch goes to ``<target>/batch_id=<n>`` and overwrites that folder, so a batch replayed
    after a failure is not delivered twice.
    """
    def deliver(batch: DataFrame, batch_id: int) -> None:
        due = batch.where(F.col(level) >= min_level).persist()
        try:
            for t in targets:
                due.write.mode("overwrite").parquet(f"{t}/batch_id={batch_id}")
        finally:
            due.unpersist()

    w = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).queryName(name)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=POLL)).start()


def run_to_table(stream: DataFrame, mode: str = "append", ordered: bool = False) -> DataFrame:
    """Process what is available now and return the result as a table in the shared folder; ``ordered`` for :mod:`~auditloom.streaming.stateful`."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        w = w.outputMode("append").format("parquet").option("path", f"{base}/data")
    else:
        w = w.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/data"))
    if ordered:
        with timers(spark):
            q = w.start()
            q.awaitTermination()
    else:
        w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


#: Rows of a slice for each file it is written in.
ROWS_A_FILE = 100_000


def in_triggers(df: DataFrame, slices: list) -> tuple[str, int]:
    """A folder with as many files for each condition of ``slices``, in order of age, and that number: a stream of so many files a trigger gets them one by one.

    All tasks read and write a slice.  As it has ``ROWS_A_FILE`` rows for each file, rows dealt round robin leave none of them out.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    rows = df.agg(*[F.count_if(s).alias(f"n{k}") for k, s in enumerate(slices)]).first()
    files = max(1, min(min(rows) // ROWS_A_FILE, parts_of(spark)))
    for s in slices:
        df.where(s).repartition(files).write.mode("append").parquet(path)
    return path, files
