"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Characters worked on at once inside a task; one text above it is a piece of its own.
PIECE_CHARS = 1 << 19


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names that do not clash with ``columns``, compared as Spark does, without case."""
    taken = {c.lower() for c in columns}
    out = []
    for w in wanted:
        n = f"_{w}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text, so that working memory stays bounded."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, work: Callable[[list[str]], dict | list]) -> DataFrame:
    """Columns ``keep`` of every row with what ``work`` makes of its text; null counts as empty.

    ``work`` gets the texts of a piece and returns a list of arrow-convertible columns in the order of
    ``schema``.  Rows neither meet nor move: no shuffle.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema])
    new = _types(schema)

    def run(batches):
        for b in batches:
            for p in pieces(b, text):
                texts = [t or "" for t in p.column(text).to_pylist()]
                cols = [p.column(c) for c in keep]
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(work(texts), new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(cols + made, names=keep + list(new))

    return map_arrow(df.select(*dict.fromkeys([*keep, text])), run, full)


def _types(schema: str) -> dict[str, pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
             "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "float": pa.float32()}
    return {n: kinds[k] for n, k in (x.split() for x in schema.split(", "))}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bits of the largest filter that is broadcast (16 MB), and of one row of it on its way to the driver.
FILTER_BITS, FILTER_ROW = 1 << 27, 1 << 16


def bit_filter(keys: DataFrame, n: int) -> np.ndarray:
    """Bits that are set for every ``key`` (long) of a table with ``n`` rows; other keys seldom have theirs set.

    Sixteen bits a key, at most ``FILTER_BITS``: beyond, more keys pass that are not in the table.  So it may only decide
    what is looked at more closely.
    """
    bits = min(max(FILTER_ROW, 1 << (16 * n).bit_length()), FILTER_BITS)

    def pack(batches):
        for b in batches:
            rows = []
            for slots in b.column("slots").to_pylist():
                row = np.zeros(FILTER_ROW, bool)
                row[slots] = True
                rows.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(rows, pa.binary())], names=["row", "bits"])

    slot = F.expr(f"key & {bits - 1}L")
    grouped = (keys.select(slot.alias("slot")).distinct().groupBy(F.expr(f"slot div {FILTER_ROW}").alias("row"))
               .agg(F.collect_list((F.col("slot") % FILTER_ROW).cast("int")).alias("slots")))
    out = np.zeros(bits // 8, np.uint8)
    for r in map_arrow(grouped, pack, "row long, bits binary").collect():
        out[r["row"] * FILTER_ROW // 8:(r["row"] + 1) * FILTER_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` (64 bits) a :func:`bit_filter` lets pass."""
    slot = keys.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
