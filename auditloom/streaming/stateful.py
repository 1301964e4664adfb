"""State kept per key across triggers, with rows taken in the order of their event time.

A trigger brings rows in any order, and rows of an earlier time may still come in a later one.  So a key's
rows wait in its state until the watermark has passed them; only then are they worked through, in the order of time and then of
all their columns.  A result therefore does not depend on how rows were dealt to triggers, and equals the batch twin for every
row up to the final watermark.  A timer is set on the earliest waiting row.

The classes need a state store with timers (:func:`auditloom.streaming.io.run_to_table` sets it).  They are
pickled by value, so workers need no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class InOrder(StatefulProcessor):
    """Base: :meth:`advance` gets a key's rows once and in order, a trigger's due rows together."""

    def __init__(self, row_schema: str, ts: str):
        self.row_schema, self.ts = row_schema, ts

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.open()

    def open(self) -> None:
        """Further states."""

    def advance(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def idle(self, key, watermark_ms: int) -> None:
        """A timer fired; called before due rows are worked through."""

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        self.waiting.appendList([tuple(r) for r in new[self.columns()].itertuples(index=False)])
        self.handle.registerTimer(int(new[self.ts].min().value // 1_000_000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        self.idle(key, watermark)
        held = pd.DataFrame(list(self.waiting.get()), columns=self.columns())
        if not len(held):
            return
        # A row that is not late lies above the watermark, so nothing can still come before these.
        due = pd.to_datetime(held[self.ts]).astype("datetime64[us]").astype("int64") <= watermark * 1000
        rest = held[~due]
        self.waiting.put([tuple(r) for r in rest.itertuples(index=False)]) if len(rest) else self.waiting.clear()
        if len(rest):
            self.handle.registerTimer(int(pd.to_datetime(rest[self.ts]).min().value // 1_000_000))
        if due.any():
            yield self.advance(key, held[due].sort_values([self.ts, *[c for c in self.columns() if c != self.ts]], kind="stable").reset_index(drop=True))

    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.row_schema.split(", ")]

    def close(self) -> None:
        pass


class SampleMetrics(InOrder):
    """Rolling means of the last samples' transactions per slot, by running sums over arrays."""

    def __init__(self, row_schema: str, ts: str, frame: int, recent: int, expected: int, peak: int, per_tx: int, cap: int):
        super().__init__(row_schema, ts)
        self.frame, self.recent, self.expected, self.peak, self.per_tx, self.cap = frame, recent, expected, peak, per_tx, float(cap)

    def open(self) -> None:
        self.last = self.handle.getListState("last", "per_slot double")

    def advance(self, key, rows):
        ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(rows)), where=b > 0)
        slots, tx, nonvote, period = (rows[c].to_numpy(float) for c in ("num_slots", "num_transactions", "num_non_vote_transactions", "sample_period_secs"))
        before = np.array([r[0] for r in self.last.get()], float)
        seen = np.r_[before, ratio(tx, slots)]
        at = np.arange(len(before), len(seen))

        def mean(n: int) -> np.ndarray:
            first = np.maximum(at - n + 1, 0)
            total = np.r_[0.0, np.cumsum(seen)]
            return (total[at + 1] - total[first]) / (at + 1 - first)

        self.last.put([(float(x),) for x in seen[-self.frame:]])
        return pd.DataFrame({
            "validator": key[0], "ts": rows[self.ts],
            "skip_pct": np.maximum(0.0, (self.expected - mean(self.frame)) / self.expected * 100),
            "stress_pct": np.minimum(100.0, mean(self.recent) / self.peak * 100),
            "lag_ms": np.minimum(self.cap, ratio(nonvote, slots) * self.per_tx), "tps": ratio(tx, period)})


class Changes(InOrder):
    """Rows whose value differs from the one before of their ``key``; a value is forgotten ``expiry_ms`` after its last row.

    Serves all keys of a bucket at once, see :func:`in_buckets`: their last values are one list, read and written as a whole.
    """

    def __init__(self, row_schema: str, ts: str, key: str, value: str, expiry_ms: int | None):
        super().__init__(row_schema, ts)
        self.key, self.value, self.expiry = key, value, expiry_ms

    def open(self) -> None:
        kind = next(c.split(" ", 1)[1] for c in self.row_schema.split(", ") if c.split()[0] == self.key)
        self.known = self.handle.getListState("known", f"key {kind}, value string, at long")

    def keep(self, known: list[tuple]) -> None:
        # What still waits or comes lies above the watermark, so beyond the time of the values that go.
        known = known if self.expiry is None else [k for k in known if k[2] + self.expiry > self.watermark]
        self.known.put(known) if known else self.known.clear()

    def idle(self, key, watermark_ms):
        self.watermark = watermark_ms
        if self.expiry is not None and self.known.exists() and not self.waiting.exists():
            self.keep([tuple(k) for k in self.known.get()])

    def advance(self, key, rows):
        at = pd.to_datetime(rows[self.ts]).astype("datetime64[us]").astype("int64").to_numpy() // 1000
        value = rows[self.value].to_numpy(object)
        known = [tuple(k) for k in self.known.get()]
        code = pd.factorize(pd.concat([pd.Series([k[0] for k in known], dtype=rows[self.key].dtype), rows[self.key]]), use_na_sentinel=False)[0]
        # Known values come first, then the rows in order; the entry before of the same key is the one to compare with.
        value, at = np.r_[np.array([k[1] for k in known], object), value], np.r_[np.array([k[2] for k in known], np.int64), at]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        prev = np.full(len(code), -1)
        prev[order[1:][same]] = order[:-1][same]
        prev = prev[len(known):]
        before = np.where(prev >= 0, value[prev], None)
        fresh = np.array([b is not None and b != v for b, v in zip(before, value[len(known):])], bool)
        if self.expiry is not None:
            fresh &= at[len(known):] - at[prev] < self.expiry
            self.handle.registerTimer(int(at.max() + self.expiry))
        last = order[np.r_[~same, True]]
        keys = [k[0] for k in known] + rows[self.key].tolist()
        self.keep([(keys[i], value[i], int(at[i])) for i in last])
        return rows.assign(before=before)[fresh]


class FirstRows(InOrder):
    """The first row of a key by event time; the key stays known.  Serves all keys of a bucket, see :func:`in_buckets`."""

    def __init__(self, row_schema: str, ts: str, key: str):
        super().__init__(row_schema, ts)
        self.key = key

    def open(self) -> None:
        kind = next(c.split(" ", 1)[1] for c in self.row_schema.split(", ") if c.split()[0] == self.key)
        self.done = self.handle.getListState("done", f"key {kind}")

    def new(self, rows: pd.DataFrame) -> pd.DataFrame:
        done = [k[0] for k in self.done.get()] if self.done.exists() else []
        return rows[~rows[self.key].isin(done)]

    def advance(self, key, rows):
        first = self.new(rows).drop_duplicates(self.key)
        if len(first):
            self.done.appendList([(k,) for k in first[self.key].tolist()])
        return first

    def handleInputRows(self, key, rows, timerValues):
        fresh = self.new(pd.concat(list(rows)))
        if len(fresh):
            yield from super().handleInputRows(key, iter([fresh]), timerValues)


#: Keys share this many states.  A call serves a bucket, so calls do not grow with keys; a bucket's waiting rows must fit a task.
BUCKETS = 256


def in_buckets(df: DataFrame, keys: list[str], processor: InOrder, out: str, ts: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """As :func:`in_order`, for processors that serve many keys at once; rows keep their ``keys``."""
    return in_order(df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), ["_bucket"], processor, out, ts)


def in_order(df: DataFrame, keys: list[str], processor: InOrder, out: str, ts: str | None = None) -> DataFrame:
    """Run ``processor`` on the stream ``df``, which has a watermark; with ``ts`` its output can feed further windows."""
    g = df.groupBy(*keys)
    if ts is None:
        return g.transformWithStateInPandas(processor, out, "append", "eventTime")
    return g.transformWithStateInPandas(processor, out, "append", "eventTime", eventTimeColumnName=ts)
