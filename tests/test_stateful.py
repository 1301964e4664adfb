"""Ordered state, chained windows, ledgers and the id cursor, over several triggers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auditloom.streaming import io, ledger, monitor as M
from auditloom.streaming.cursor_source import CursorReader, read_by_id

T0 = datetime(2024, 1, 1)


def dealt(spark, tmp_path, rows, schema, batches, name="in"):
    """A stream that gets ``rows`` in the given batches (lists of indices)."""
    path = str(tmp_path / name)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}")
    for b in batches:
        df.where(F.col("_k").isin(b)).drop("_k").coalesce(1).write.mode("append").parquet(path)
    return io.read_tx_stream(spark, path, df.drop("_k").schema, max_per_trigger=1)


def shuffled(n, batches, late, seed):
    """Indices 0..n in time order, some one batch late, each batch shuffled."""
    r = random.Random(seed)
    size = -(-n // batches)
    out = [[] for _ in range(batches)]
    for k in range(n):
        at = k // size
        if k % size >= size - late and at + 1 < batches and r.random() < 0.5:
            at += 1
        out[at].append(k)
    for b in out:
        r.shuffle(b)
    return out


def test_value_changes_over_triggers(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice("xy"), T0 + timedelta(minutes=k // 2), k, r.choice("abc")) for k in range(200)]
    s = dealt(spark, tmp_path, rows, "key string, ts timestamp, id long, value string", shuffled(200, 5, 8, 2))
    got = io.run_to_table(M.value_changed_stream(s, "key", "ts", ["id"], "value", None, "10 minutes"), ordered=True).collect()
    last, want = {}, set()
    for key, ts, k, value in rows:
        if ts <= rows[-1][1] - timedelta(minutes=10) and last.get(key, value) != value:
            want.add((key, k, last[key], value))
        last[key] = value
    assert {(x.key, x.id, x.before, x.value) for x in got} == want and len(got) == len(want) > 50


def test_value_is_forgotten_after_its_time(spark, tmp_path):
    rows = [("x", T0, 1, "a"), ("x", T0 + timedelta(minutes=5), 2, "b"), ("x", T0 + timedelta(hours=3), 3, "c"), ("x", T0 + timedelta(hours=3, minutes=1), 4, "d"),
            ("z", T0 + timedelta(hours=9), 5, "e"), ("z", T0 + timedelta(hours=10), 6, "e")]
    s = dealt(spark, tmp_path, rows, "key string, ts timestamp, id long, value string", [[0, 1], [4], [5], [2, 3]])
    # The rows of the last trigger are hours behind the watermark that the one before worked with.
    got = io.run_to_table(M.value_changed_stream(s, "key", "ts", ["id"], "value", 3_600_000, "1 minute"), ordered=True).collect()
    assert {(x.id, x.before) for x in got} == {(2, "a")}
    s = dealt(spark, tmp_path, rows, "key string, ts timestamp, id long, value string", [[0, 1], [2, 3], [4]], "in2")
    got = io.run_to_table(M.value_changed_stream(s, "key", "ts", ["id"], "value", 3_600_000, "1 minute"), ordered=True).collect()
    assert {(x.id, x.before) for x in got} == {(2, "a"), (4, "c")}


def test_new_accounts_return(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("abcdefghij") + str(k // 60), T0 + timedelta(minutes=k), k) for k in range(240)]
    s = dealt(spark, tmp_path, rows, "account string, ts timestamp, id long", shuffled(240, 4, 20, 4))
    got = io.run_to_table(M.new_account_spike(s, "account", "ts", "id", 3, "20 minutes", "30 minutes"), ordered=True).collect()
    first = {}
    for a, ts, _ in rows:
        first.setdefault(a, ts)
    counts = {}
    for ts in first.values():
        w = T0 + timedelta(minutes=(ts - T0).seconds // 1200 * 20)
        counts[w] = counts.get(w, 0) + 1
    end = rows[-1][1] - timedelta(minutes=30)
    assert {(x.start, x.n) for x in got} == {(w, n) for w, n in counts.items() if n >= 3 and w + timedelta(minutes=20) <= end}
    batch = M.first_sight(spark.createDataFrame(rows, "account string, ts timestamp, id long"), "account", "ts", "id").collect()
    assert {(x.account, x.ts) for x in batch} == set(first.items())


def test_deviating_ticks_do_not_overflow(spark, tmp_path):
    big = 2**62
    rows = [("k", T0, 1, big), ("k", T0 + timedelta(minutes=1), 2, big // 4), ("k", T0 + timedelta(minutes=2), 3, big // 4), ("k", T0 + timedelta(hours=2), 4, 1)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, price long")
    assert {x.id for x in M.deviating_ticks(df, "key", "ts", "price", ["id"], 60, "1 hour").collect()} == {1}
    assert M.price_deviation(df, "key", "ts", "price", 60, "1 hour").count() == 1
    s = dealt(spark, tmp_path, rows, "key string, ts timestamp, id long, price long", [[0], [1, 2], [3]])
    assert {x.id for x in io.run_to_table(M.deviating_ticks(s, "key", "ts", "price", ["id"], 60, "1 hour", "5 minutes")).collect()} == {1}


def test_late_rows_are_counted(spark, tmp_path):
    rows = [(k, T0 + timedelta(hours=h)) for k, h in enumerate([0, 1, 9, 10, 2, 3, 11])]
    s = dealt(spark, tmp_path, rows, "id long, ts timestamp", [[0, 1], [2, 3], [6], [4, 5]])
    seen = ledger.LateRows(spark, str(tmp_path / "late"))
    spark.streams.addListener(seen)
    q = M.dedup_stream(s, "id", "ts", "1 hour").writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen.wait(q)
    spark.streams.removeListener(seen)
    assert [(x.batch_id, x.kind, x.dropped) for x in seen.table().collect()] == [(3, "dedupeWithinWatermark", 2)]
    assert spark.read.parquet(str(tmp_path / "d")).count() == 5


@pytest.mark.parametrize("broken", ["first", "second"])
def test_failure_between_targets_is_resumed(spark, tmp_path, broken):
    s = dealt(spark, tmp_path, [(k, k % 5) for k in range(30)], "id long, level int", [list(range(10)), list(range(10, 20)), list(range(20, 30))])
    failed = []

    def append(name):
        def write(df, n):
            if name == broken and n == 1 and not failed:
                failed.append(n)
                raise RuntimeError("away")
            df.write.mode("append").parquet(str(tmp_path / name))
        return ledger.Target(name, write)

    targets = [append("first"), append("second")]
    with pytest.raises(StreamingQueryException):
        ledger.deliver_once(s, 3, targets, str(tmp_path / "c")).awaitTermination()
    ledger.deliver_once(s, 3, targets, str(tmp_path / "c")).awaitTermination()
    for t in targets:
        got = sorted(x.id for x in spark.read.parquet(str(tmp_path / t.name)).collect())
        assert got == [k for k in range(30) if k % 5 >= 3]
    with pytest.raises(ValueError):
        ledger.deliver_once(s, 3, [targets[0], targets[0]], str(tmp_path / "e"))


def test_cursor_takes_bounded_steps_and_resumes(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(k * 3, f"v{k}") for k in range(50)], "id long, v string")
    df.repartition(4).write.parquet(log)
    start = lambda: read_by_id(spark, log, df.schema, "id", 7, str(tmp_path / "cursor"), slices=3).writeStream.option(
        "checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(processingTime="0 seconds").start()
    q = start()
    q.processAllAvailable()
    sizes = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    q.stop()
    assert sum(sizes) == 50 and max(sizes) <= 7
    spark.createDataFrame([(1000 + k, "new") for k in range(9)], "id long, v string").write.mode("append").parquet(log)
    q = start()
    q.processAllAvailable()
    q.stop()
    got = [x.id for x in spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [k * 3 for k in range(50)] + [1000 + k for k in range(9)]


def test_cursor_follows_planned_offsets_only(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(k,) for k in range(20)], "id long")
    df.write.parquet(log)
    options = {"path": log, "id": "id", "cursor": str(tmp_path / "cursor"), "rows": "6"}
    r = CursorReader(df.schema, options)
    assert (r.initialOffset(), r.latestOffset()) == ({"id": -1}, {"id": 5})
    # Not planned yet: a new reader starts at the beginning again.
    assert CursorReader(df.schema, options).latestOffset() == {"id": 5}
    parts = r.partitions({"id": -1}, {"id": 5})
    assert sorted(x for p in parts for b in r.read(p) for x in b.column(0).to_pylist()) == list(range(6))
    assert CursorReader(df.schema, options).latestOffset() == {"id": 11}


def test_a_call_serves_many_keys():
    import pandas as pd
    from auditloom.streaming import stateful

    class Held(list):
        get, exists, appendList = list.copy, lambda s: bool(s), list.extend

        def put(self, rows):
            self[:] = rows

    class Handle:
        def __init__(self):
            self.lists, self.timers = {}, []

        def getListState(self, name, schema):
            return self.lists.setdefault(name, Held())

        def registerTimer(self, at):
            self.timers.append(at)

    at = lambda m: pd.Timestamp(T0 + timedelta(minutes=m))
    rows = lambda *r: pd.DataFrame(r, columns=["key", "ts", "value"])
    run, h = stateful.Changes("key string, ts timestamp, value string", "ts", "key", "value", 600_000), Handle()
    run.init(h)
    run.idle((0,), 0)
    got = run.advance((0,), rows(("x", at(0), "a"), ("y", at(0), "b"), ("x", at(1), "c"), ("y", at(2), "b")))
    assert got[["key", "value", "before"]].values.tolist() == [["x", "c", "a"]]
    got = run.advance((0,), rows(("y", at(3), "a"), ("x", at(12), "d"), ("z", at(12), "a")))
    assert got[["key", "value", "before"]].values.tolist() == [["y", "a", "b"]] and sorted(k[0] for k in h.lists["known"]) == ["x", "y", "z"]
    run.idle((0,), at(15).value // 1_000_000)
    assert sorted(k[0] for k in h.lists["known"]) == ["x", "z"]
    first, h = stateful.FirstRows("key string, ts timestamp, value string", "ts", "key"), Handle()
    first.init(h)
    assert first.advance((0,), rows(("x", at(0), "a"), ("y", at(0), "b"), ("x", at(1), "c"))).key.tolist() == ["x", "y"]
    assert first.advance((0,), rows(("x", at(2), "a"), ("z", at(3), "b"))).key.tolist() == ["z"]
