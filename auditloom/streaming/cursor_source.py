"""A stream source that follows a log by id: the offset is the last id seen, and a trigger takes a bounded number of rows.

The log is a folder of Parquet files with an ``id`` that grows (an export of transactions, say), to which files may be added.
A trigger gets the next ``rows`` ids after its offset, split into ``slices`` tasks, which read only row groups of their range.  Only
the ids of one trigger are looked at on the driver.

Spark keeps the offsets.  After a restart it asks for the newest offset before it says where it stopped; so the source writes
each planned offset to ``cursor``, after Spark has logged it.  Nothing is lost or repeated.
"""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class IdRange(InputPartition):
    def __init__(self, after: int, last: int):
        self.after, self.last = after, last


class CursorReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.schema = to_arrow_schema(schema)
        self.path, self.id, self.cursor = options["path"], options["id"], options["cursor"]
        self.rows, self.slices, self.start = int(options["rows"]), int(options.get("slices", "4")), int(options.get("after", "-1"))
        self.last = None

    def _files(self):
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(self.path)
        names = [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet")]
        return dataset.dataset(names, self.schema, format="parquet", filesystem=system)

    def _cursor(self, value: int | None = None) -> int | None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.cursor)
        if value is None:
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return None
            with system.open_input_stream(path) as f:
                return json.loads(f.read())["id"]
        with system.open_output_stream(path) as f:
            f.write(json.dumps({"id": value}).encode())
        return value

    def initialOffset(self) -> dict:
        return {"id": self.start}

    def latestOffset(self) -> dict:
        import heapq

        from pyarrow import dataset

        if self.last is None:
            known = self._cursor()
            self.last = self.start if known is None else known
        ids: list[int] = []
        for b in self._files().to_batches(columns=[self.id], filter=dataset.field(self.id) > self.last):
            # The smallest ids so far: never more than a trigger's rows, whatever the order of the log.
            ids = heapq.nsmallest(self.rows, [*ids, *b.column(0).to_pylist()])
        self.last = ids[-1] if ids else self.last
        return {"id": self.last}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        self.last = self._cursor(end["id"])
        a, z = start["id"], end["id"]
        n = max(1, min(self.slices, z - a))
        edges = [a + (z - a) * k // n for k in range(n + 1)]
        return [IdRange(lo, hi) for lo, hi in zip(edges, edges[1:])]

    def read(self, partition: IdRange):
        from pyarrow import dataset

        at = dataset.field(self.id)
        yield from self._files().to_batches(filter=(at > partition.after) & (at <= partition.last))


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "id_cursor"

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(schema, self.options)


def read_by_id(spark: SparkSession, path: str, schema, ident: str, rows: int, cursor: str, slices: int = 4, after: int = -1):
    """The log at ``path`` as a stream, ``rows`` ids a trigger from the one after ``after``; ``cursor``: a file of this stream in a shared folder."""
    spark.dataSource.register(CursorSource)
    options = {"id": ident, "rows": rows, "cursor": cursor, "slices": slices, "after": after}
    return spark.readStream.format("id_cursor").schema(schema).options(**options).load(path)
