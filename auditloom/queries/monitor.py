"""Queries on transactions and time series, in batch and as streams."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auditloom.plans.lineage import shared_dir
from auditloom.queries import views as V
from auditloom.queries.base import Area
from auditloom.queries.views import LINE_ID_SQL, SAMPLES_SQL, TICKS_SQL, with_sql
from auditloom.streaming import io, ledger, monitor as M, transactions as X
from auditloom.streaming.cursor_source import read_by_id

area = Area()
QUERIES, ORACLE, query = area.queries, area.oracle, area.query
C = F.col

# ---------------------------------------------------------------- transactions
_TX_SQL = f"""tx_v AS (SELECT {LINE_ID_SQL} AS signature, l_shipdate AS block_time, CAST(l_extendedprice * 20 AS BIGINT) AS compute_units, CAST(round(l_tax * 100) AS BIGINT) * 5000 AS fee,
  CASE WHEN l_returnflag = 'R' THEN 'Err' END AS error, list_transform(range(1, l_linenumber * 4 + 1), lambda i: 'k' || ((l_partkey * i + l_suppkey) % 101)) AS accounts,
  l_partkey * 10000000000 AS pre1, l_suppkey * 30000000000 AS post1, CAST(l_quantity AS BIGINT) AS pre2, CAST(l_quantity AS BIGINT) + l_linenumber % 2 AS post2,
  CAST(round(l_discount * 100) AS BIGINT) AS pre3, l_linenumber::BIGINT - 1 AS post3, l_linestatus = 'O' AS same_mint FROM lineitem)"""


def transactions(l):
    """Transactions derived row by row from line items."""
    bal = lambda acc, mint, amount: F.struct(F.lit(acc).alias("account"), mint.alias("mint"), amount.cast("decimal(20,0)").alias("amount"), F.lit(6).alias("decimals"))
    m1, q = F.lit("m1"), C("l_quantity").cast("long")
    moved = F.when(C("l_linestatus") == "O", m1).otherwise("m9")
    return l.select(
        V.line_id().alias("signature"), C("l_shipdate").alias("block_time"), F.round(C("l_extendedprice") * 20).cast("long").alias("compute_units"),
        (F.round(C("l_tax") * 100).cast("long") * 5000).alias("fee"), F.when(C("l_returnflag") == "R", "Err").alias("error"),
        F.transform(F.sequence(F.lit(1), C("l_linenumber") * 4), lambda i: F.concat(F.lit("k"), ((C("l_partkey") * i + C("l_suppkey")) % 101).cast("string"))).alias("accounts"),
        F.array(bal("a", m1, C("l_partkey") * 10_000_000_000), bal("b", F.lit("m2"), q), bal("c", F.lit("m3"), F.round(C("l_discount") * 100))).alias("pre_token_balances"),
        F.array(bal("a", moved, C("l_suppkey") * 30_000_000_000), bal("b", F.lit("m2"), q + C("l_linenumber") % 2), bal("c", F.lit("m3"), C("l_linenumber") - 1)).alias("post_token_balances"))


_SIG_SQL = """sig AS (
  SELECT signature, 1 AS ord, 'FlashLoanAttack' AS threat_type, 0.7::DOUBLE AS confidence, 'Large token movement with return to original balance detected' AS details FROM tx_v
    WHERE abs(pre1 - post1) > 1000000000000 AND ((pre2 = post2 AND pre2 > 0) OR (pre3 = post3 AND pre3 > 0) OR (pre1 = post1 AND pre1 > 0))
  UNION ALL SELECT signature, 2, 'AbnormalTokenFlow', 0.8, 'Large token movement: ' || d || ' tokens (' || (d * 100 // p) || '% of balance)' FROM (
    SELECT signature, CASE WHEN h1 THEN abs(pre1 - post1) WHEN h2 THEN abs(pre2 - post2) ELSE abs(pre3 - post3) END AS d, CASE WHEN h1 THEN pre1 WHEN h2 THEN pre2 ELSE pre3 END AS p FROM (
      SELECT *, same_mint AND pre1 > 0 AND abs(pre1 - post1) > pre1 * 9 // 10 AS h1, pre2 > 0 AND abs(pre2 - post2) > pre2 * 9 // 10 AS h2, pre3 > 0 AND abs(pre3 - post3) > pre3 * 9 // 10 AS h3 FROM tx_v) WHERE h1 OR h2 OR h3)
  UNION ALL SELECT signature, 3, CASE WHEN len(accounts) > 20 THEN 'UnusualAccountPattern' ELSE 'ReentrancyAttempt' END, CASE WHEN len(accounts) > 20 THEN 0.5 ELSE 0.6 END,
    CASE WHEN len(accounts) > 20 THEN 'Unusually high account count: ' || len(accounts) ELSE 'Duplicate accounts detected - possible reentrancy setup' END FROM tx_v
    WHERE len(accounts) > 20 OR len(list_distinct(accounts)) < len(accounts)
  UNION ALL SELECT signature, 4, 'SuspiciousTimingPattern', 0.4, 'Very high compute usage: ' || compute_units || ' CUs' FROM tx_v WHERE compute_units > 1200000)"""
_TX_SQL = _TX_SQL.replace("CAST(l_extendedprice * 20 AS BIGINT)", "CAST(round(l_extendedprice * 20) AS BIGINT)")
_LEVEL_SQL = "CASE threat_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in X.LEVEL_OF.items()) + " ELSE 1 END"


@query("transaction_signals", with_sql(_TX_SQL, _SIG_SQL, body="SELECT signature, threat_type, confidence, details FROM sig"))
def _(spark, sf):
    return X.tx_signals(transactions(V.lineitem(spark, sf)), ["signature"])


_FOLD_SQL = f"""SELECT signature, arg_min(threat_type, ord) AS threat_type, CAST(MAX({_LEVEL_SQL}) AS INTEGER) AS level, MAX(confidence) AS confidence, string_agg(details, '; ' ORDER BY ord) AS explanation,
  CASE MAX({_LEVEL_SQL}) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS threat_level FROM sig GROUP BY signature HAVING MAX({_LEVEL_SQL}) >= 2"""


@query("folded_threats", with_sql(_TX_SQL, _SIG_SQL, body=_FOLD_SQL))
def _(spark, sf):
    return X.fold_signals(transactions(V.lineitem(spark, sf)), ["signature"], 2)


@query("zipped_balances", with_sql(_TX_SQL, body="""SELECT signature, pre1 > post1 OR pre2 > post2 OR pre3 > post3 AS any_drop, pre1 = post1 OR pre2 = post2 OR pre3 = post3 AS any_same FROM tx_v"""))
def _(spark, sf):
    a, b = C("pre_token_balances"), C("post_token_balances")
    return transactions(V.lineitem(spark, sf)).select(
        "signature", X.zip_any(a, b, lambda l, r: l["amount"] > r["amount"]).alias("any_drop"), X.zip_any(a, b, lambda l, r: l["amount"] == r["amount"]).alias("any_same"))


@query("transaction_details", with_sql(_TX_SQL, body="""SELECT signature, CASE WHEN error IS NULL THEN 'Success' ELSE 'Failed' END AS status, fee / 1000000000.0::DOUBLE AS fee_coins, CAST(i AS INTEGER) AS pos,
 (['a', 'b', 'c'])[i + 1] AS account, ([post1 - pre1, post2 - pre2, post3 - pre3])[i + 1] AS delta FROM tx_v, (SELECT unnest([0, 1, 2]) AS i)"""))
def _(spark, sf):
    amounts = lambda c: F.transform(c, lambda x: x["amount"].cast("long"))
    t = transactions(V.lineitem(spark, sf)).select(
        "signature", "error", "fee", F.transform("pre_token_balances", lambda x: x["account"]).alias("accounts"),
        amounts("pre_token_balances").alias("pre_balances"), amounts("post_token_balances").alias("post_balances"))
    return X.tx_detail(t, ["signature"])


@query("monitor_statistics", with_sql(_TX_SQL, _SIG_SQL, f"lv AS (SELECT signature, MAX({_LEVEL_SQL}) AS level FROM sig GROUP BY 1)", body="""
SELECT (SELECT COUNT(*) FROM tx_v) AS analysed, COUNT(*) AS threats, COUNT(*) FILTER (WHERE level >= 3) AS alerts FROM lv"""))
def _(spark, sf):
    t = transactions(V.lineitem(spark, sf)).select(X.signals().alias("signals"))
    return M.monitor_stats(t.select(X.max_level(C("signals")).alias("level")))


@query("user_signals", with_sql(_TX_SQL, _SIG_SQL, body=f"""SELECT signature, arg_min(threat_type, ord) AS threat_type, CAST(MAX({_LEVEL_SQL}) AS INTEGER) AS level, MAX(confidence) AS confidence, string_agg(details, '; ' ORDER BY ord) AS explanation FROM (
  SELECT * FROM sig UNION ALL SELECT signature, 5, 'AccountHijacking', 0.9, 'fee ' || fee FROM tx_v WHERE fee >= 40000 AND error IS NOT NULL) GROUP BY signature"""))
def _(spark, sf):
    """A signal of a user folded with the built-in ones."""
    from auditloom.ext import Registry
    reg = Registry()
    reg.register_signal(F.when((C("fee") >= 40_000) & C("error").isNotNull(), X.signal("AccountHijacking", 0.9, F.concat(F.lit("fee "), C("fee").cast("string")))))
    return X.fold_signals(transactions(V.lineitem(spark, sf)), ["signature"], 1, reg.signals).drop("threat_level")


# ---------------------------------------------------------------- validators
_METRIC_SQL = """vm AS (SELECT validator, ts, greatest(0.0::DOUBLE, (3000 - AVG(p) OVER (PARTITION BY validator ORDER BY ts ROWS 9 PRECEDING)) / 3000 * 100) AS skip_pct,
  least(100.0::DOUBLE, AVG(p) OVER (PARTITION BY validator ORDER BY ts ROWS 4 PRECEDING) / 5000 * 100) AS stress_pct,
  least(2000.0::DOUBLE, num_non_vote_transactions::DOUBLE / num_slots * 10) AS lag_ms, num_transactions::DOUBLE / sample_period_secs AS tps
  FROM (SELECT *, num_transactions::DOUBLE / num_slots AS p FROM samples_v))"""
_ROUND_SQL = ", ".join(f"round({c}, 4) AS {c}" for c in ("skip_pct", "stress_pct", "lag_ms", "tps"))
_rounded = lambda df: df.select("validator", "ts", *[F.round(c, 4).alias(c) for c in ("skip_pct", "stress_pct", "lag_ms", "tps")])


@query("validator_metrics", with_sql(SAMPLES_SQL, _METRIC_SQL, body=f"SELECT validator, ts, {_ROUND_SQL} FROM vm"))
def _(spark, sf):
    return _rounded(M.validator_metrics(V.samples(spark, sf), ["validator"], "ts", F.date_trunc("day", "ts")))


@query("validator_tiers", with_sql(SAMPLES_SQL, _METRIC_SQL, body=" UNION ALL ".join(
    f"SELECT validator, ts, '{m}' AS metric, round({m}, 4) AS observed, CAST(CASE WHEN {m} > {h} THEN 5 WHEN {m} > {b} THEN 4 ELSE 3 END AS INTEGER) AS severity FROM vm WHERE {m} > {a}"
    for m, (a, b, h) in M.TIERS.items() if m != "latency_ms")))
def _(spark, sf):
    m = M.validator_metrics(V.samples(spark, sf), ["validator"], "ts", F.date_trunc("day", "ts"))
    return M.tier(m, ["validator", "ts"], ["lag_ms", "skip_pct", "stress_pct"]).withColumn("observed", F.round("observed", 4))


# ---------------------------------------------------------------- windows
@query("rapid_drain", with_sql(TICKS_SQL, """w AS (SELECT key, cents, ts, event_id, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM ticks_v),
g AS (SELECT key, start, MAX(cents) AS peak, arg_max(cents, ts) AS last FROM w GROUP BY ALL)""", body="SELECT key, start, start + INTERVAL 12 HOUR AS \"end\", peak, last FROM g WHERE last * 100 <= peak * 15"))
def _(spark, sf):
    return M.rapid_drain(V.ticks(spark, sf), "key", "ts", "cents", 85, "12 hours", "6 hours")


@query("signup_spike", with_sql(TICKS_SQL, body="SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", COUNT(*) AS n FROM ticks_v WHERE is_new GROUP BY 1 HAVING COUNT(*) >= 65"))
def _(spark, sf):
    return M.spike(V.ticks(spark, sf), "ts", C("is_new"), 65, "1 day")


@query("failure_rate", with_sql(TICKS_SQL, body="""SELECT key, date_trunc('day', ts) AS start, COUNT(*) AS n, COUNT(*) FILTER (WHERE failed) AS failed FROM ticks_v GROUP BY 1, 2
HAVING COUNT(*) FILTER (WHERE failed) * 100 > COUNT(*) * 30 AND COUNT(*) >= 2"""))
def _(spark, sf):
    return M.failure_rate(V.ticks(spark, sf), "key", "ts", "failed", 30, "1 day", 2)


@query("price_deviation", with_sql(TICKS_SQL, body="""SELECT key, date_trunc('day', ts) AS start, COUNT(*) AS n, MIN(cents) AS lo, MAX(cents) AS hi, round(SUM(cents)::DOUBLE / COUNT(*), 4) AS mean FROM ticks_v GROUP BY 1, 2
HAVING greatest(MAX(cents) * COUNT(*) - SUM(cents), SUM(cents) - MIN(cents) * COUNT(*)) * 100 > SUM(cents) * 50"""))
def _(spark, sf):
    return M.price_deviation(V.ticks(spark, sf), "key", "ts", "cents", 50, "1 day").withColumn("mean", F.round("mean", 4))


@query("stale_feeds", with_sql(TICKS_SQL, body="""SELECT key, last_seen, ts AS resumed FROM (SELECT key, ts, lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS last_seen FROM ticks_v)
WHERE epoch_us(ts) - epoch_us(last_seen) >= 86400000000"""))
def _(spark, sf):
    return M.stale_feed(V.ticks(spark, sf), "key", "ts", 86_400, F.date_trunc("minute", "ts"), ["event_id"])


@query("large_moves", with_sql(TICKS_SQL, body="SELECT event_id, key, cents FROM ticks_v WHERE cents >= 15000"))
def _(spark, sf):
    return M.large_move(V.ticks(spark, sf), "cents", 15_000).select("event_id", "key", "cents")


@query("value_changes", with_sql(TICKS_SQL, body="""SELECT event_id, key, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM ticks_v) WHERE before <> event_type"""))
def _(spark, sf):
    return M.value_changed(V.ticks(spark, sf), "key", ["ts", "event_id"], F.date_trunc("minute", "ts"), "event_type").select("event_id", "key", "before", "event_type")


def _alerts(t):
    big = M.alert(M.large_move(t, "cents", 15_000), "large_move", 4, C("key"), C("ts"), F.concat(F.lit("moved "), C("cents").cast("string")), C("event_id"))
    fail = M.alert(t.where("failed and cents > 10000"), "failed_large", 3, C("key"), C("ts"), F.lit("failed"), C("event_id"))
    return M.alert_feed(big, fail)


_ALERT_SQL = lambda t, sev, d, w: f"""SELECT substring(sha256('{t}|' || key || '|' || strftime(ts, '%Y%m%d%H%M%S%f') || '|' || event_id), 1, 16) AS id, ts, '{t}' AS alert_type, {sev} AS severity, key AS program, {d} AS description,
 event_id::VARCHAR AS tx, false AS resolved FROM ticks_v WHERE {w}"""
_FEED_SQL = with_sql(TICKS_SQL, body=_ALERT_SQL("large_move", 4, "'moved ' || cents", "cents >= 15000") + " UNION ALL " + _ALERT_SQL("failed_large", 3, "'failed'", "failed AND cents > 10000"))


@query("alert_feed", _FEED_SQL)
def _(spark, sf):
    return _alerts(V.ticks(spark, sf))


# ---------------------------------------------------------------- streams
def event_stream(spark, sf):
    return io.read_tx_stream(spark, sf, V.table(spark, sf, "events").schema, pattern="events.parquet")


@query("alert_feed_stream", _FEED_SQL)
def _(spark, sf):
    return io.run_to_table(_alerts(V.tick_columns(event_stream(spark, sf))))


@query("threats_stream", with_sql(_TX_SQL, _SIG_SQL, body=_FOLD_SQL))
def _(spark, sf):
    s = io.read_tx_stream(spark, sf, V.table(spark, sf, "lineitem").schema, pattern="lineitem.parquet")
    return io.run_to_table(X.fold_signals(transactions(s), ["signature"], 2))


@query("signup_spike_stream", with_sql(TICKS_SQL, body="""SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", COUNT(*) AS n FROM ticks_v WHERE is_new GROUP BY 1
HAVING COUNT(*) >= 65 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM ticks_v)"""))
def _(spark, sf):
    return io.run_to_table(M.spike(V.tick_columns(event_stream(spark, sf)), "ts", C("is_new"), 65, "1 day"))


@query("deduplicated_stream", "SELECT COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids FROM events")
def _(spark, sf):
    s = V.tick_columns(event_stream(spark, sf))
    twice = s.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2))))
    return io.run_to_table(M.dedup_stream(twice, "event_id", "ts").select("event_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("monitor_statistics_stream", """SELECT COUNT(*) AS analysed, COUNT(*) FILTER (WHERE value >= 100) AS threats, COUNT(*) FILTER (WHERE value >= 200) AS alerts FROM events""")
def _(spark, sf):
    lv = event_stream(spark, sf).select(F.when(C("value") >= 200, 3).when(C("value") >= 100, 1).otherwise(0).alias("level"))
    return io.run_to_table(M.monitor_stats(lv), "complete")


@query("feed_sessions_stream", with_sql(TICKS_SQL, """g AS (SELECT key, ts, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS nxt FROM ticks_v)""", body="""
SELECT key, ts AS last_seen FROM g WHERE epoch_us(coalesce(nxt, TIMESTAMP '2100-01-01')) - epoch_us(ts) >= 86400000000 AND ts + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM ticks_v)"""))
def _(spark, sf):
    return io.run_to_table(M.stale_feed_stream(V.tick_columns(event_stream(spark, sf)), "key", "ts", 86_400))


# Streams of five triggers.  A slice is six days; every second event of its last hour comes one trigger late, inside the watermark.
SLICES, DELAY, DELAY_SQL = 5, "2 hours", "INTERVAL 2 HOUR"


def slices(n: int = SLICES, ident=None):
    """Which trigger a row comes in, one condition each."""
    at = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(n - 1))
    late = (F.dayofmonth("ts") % 6 == 0) & (F.hour("ts") == 23)
    at = F.least(at + F.when(late & (F.lit(True) if ident is None else ident % 2 == 1), 1).otherwise(0), F.lit(n - 1))
    return [at == k for k in range(n)]


def sliced_ticks(spark, sf):
    t = V.ticks(spark, sf)
    path, files = io.in_triggers(t, slices(ident=C("event_id")))
    return io.read_tx_stream(spark, path, t.schema, max_per_trigger=files)


@query("validator_metrics_stream", with_sql(SAMPLES_SQL, _METRIC_SQL, body=f"SELECT validator, ts, {_ROUND_SQL} FROM vm WHERE ts <= (SELECT MAX(ts) - {DELAY_SQL} FROM samples_v)"))
def _(spark, sf):
    s = V.samples(spark, sf)
    path, files = io.in_triggers(s, slices(ident=F.ascii(F.substring("validator", 2, 1))))
    return _rounded(io.run_to_table(M.validator_metrics_stream(io.read_tx_stream(spark, path, s.schema, max_per_trigger=files), DELAY), ordered=True))


_BEFORE_SQL = f"ts <= (SELECT date_trunc('millisecond', MAX(ts)) - {DELAY_SQL} FROM ticks_v)"


@query("value_changes_stream", with_sql(TICKS_SQL, body=f"""SELECT key, ts, event_id, event_type, before FROM (SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS last_ts FROM ticks_v
WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)) WHERE before <> event_type AND epoch_ms(ts) - epoch_ms(last_ts) < 172800000 AND {_BEFORE_SQL}"""))
def _(spark, sf):
    return io.run_to_table(M.value_changed_stream(sliced_ticks(spark, sf), "key", "ts", ["event_id"], "event_type", 172_800_000, DELAY), ordered=True)


@query("new_account_spike_stream", with_sql(TICKS_SQL, """first_v AS (SELECT key, MIN(ts) AS ts FROM ticks_v GROUP BY key)""", body=f"""
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS "end", COUNT(*) AS n FROM first_v GROUP BY 1
HAVING COUNT(*) >= 2 AND time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) - {DELAY_SQL} FROM ticks_v)"""))
def _(spark, sf):
    return io.run_to_table(M.new_account_spike(sliced_ticks(spark, sf), "key", "ts", "event_id", 2, "6 hours", DELAY), ordered=True)


_TICK_DEV_SQL = with_sql(TICKS_SQL, "m AS (SELECT key, date_trunc('day', ts) AS start, COUNT(*) AS n, SUM(cents) AS total FROM ticks_v GROUP BY 1, 2)", body="""
SELECT event_id, cents, start, round(total::DOUBLE / n, 4) AS mean FROM ticks_v t JOIN m ON t.key = m.key AND date_trunc('day', t.ts) = m.start WHERE abs(cents * n - total) * 100 > total * 50""")


@query("deviating_ticks", _TICK_DEV_SQL)
def _(spark, sf):
    return M.deviating_ticks(V.ticks(spark, sf), "key", "ts", "cents", ["event_id", "cents"], 50, "1 day").withColumn("mean", F.round("mean", 4))


@query("deviating_ticks_stream", _TICK_DEV_SQL + f" AND start + INTERVAL 1 DAY <= (SELECT MAX(ts) - {DELAY_SQL} FROM ticks_v)")
def _(spark, sf):
    out = M.deviating_ticks(sliced_ticks(spark, sf), "key", "ts", "cents", ["event_id", "cents"], 50, "1 day", DELAY)
    return io.run_to_table(out).withColumn("mean", F.round("mean", 4))


@query("late_rows", f"""SELECT 4::BIGINT AS batch_id, 'dedupeWithinWatermark' AS kind, COUNT(*) AS dropped FROM events WHERE event_id % 50 = 0 AND day(ts) <= 18
AND ts <= (SELECT MAX(ts) - {DELAY_SQL} FROM events WHERE day(ts) <= 18 AND event_id % 50 <> 0) HAVING COUNT(*) > 0""")
def _(spark, sf):
    """Every fiftieth event of the first eighteen days comes in the last trigger; those behind the watermark that the trigger before it worked with are late."""
    t = V.ticks(spark, sf)
    late = (C("event_id") % 50 == 0) & (F.dayofmonth("ts") <= 18)
    at = F.when(late, 4).otherwise(F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4)))
    path, files = io.in_triggers(t, [at == k for k in range(5)])
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    seen = ledger.LateRows(spark, f"{base}/late")
    spark.streams.addListener(seen)
    try:
        s = M.dedup_stream(io.read_tx_stream(spark, path, t.schema, max_per_trigger=files), "event_id", "ts", DELAY)
        q = s.writeStream.option("checkpointLocation", f"{base}/checkpoint").format("parquet").option("path", f"{base}/data").trigger(availableNow=True).start()
        q.awaitTermination()
        seen.wait(q)
    finally:
        spark.streams.removeListener(seen)
    return seen.table().groupBy("batch_id", "kind").agg(F.sum("dropped").alias("dropped"))


@query("delivered_alerts", with_sql(TICKS_SQL, body="""SELECT target, COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids, SUM(cents)::BIGINT AS cents
FROM ticks_v, (SELECT unnest(['archive', 'pager']) AS target) WHERE cents >= 15000 GROUP BY target"""))
def _(spark, sf):
    """Two targets that append; the second fails in the second trigger, the query is started again."""
    base = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    failed: list[int] = []

    def append(name, fail_once=False):
        def write(df, batch_id):
            if fail_once and batch_id == 1 and not failed:
                failed.append(batch_id)
                raise RuntimeError("target is away")
            df.write.mode("append").parquet(f"{base}/{name}")
        return ledger.Target(name, write)

    alerts = sliced_ticks(spark, sf).select("event_id", "cents", F.when(C("cents") >= 15_000, 4).otherwise(1).alias("level"))
    targets = [append("archive"), append("pager", fail_once=True)]
    for _ in range(2):
        q = ledger.deliver_once(alerts, 3, targets, f"{base}/checkpoint")
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if len(failed) != 1:
                raise
    out = [spark.read.schema("event_id long, cents long, level int").parquet(f"{base}/{n.name}").withColumn("target", F.lit(n.name)) for n in targets]
    return out[0].unionByName(out[1]).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.sum("cents").alias("cents"))


@query("followed_by_id", with_sql(TICKS_SQL, body="SELECT event_id, key, cents FROM ticks_v"))
def _(spark, sf):
    """A log followed by id, a quarter of it a trigger, stopped and started again after two triggers."""
    t = V.ticks(spark, sf).select("event_id", "key", "cents")
    base = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    t.repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(f"{base}/log")
    rows = t.count() // 4 + 1
    for stop_after in (2, None):
        s = read_by_id(spark, f"{base}/log", t.schema, "event_id", rows, f"{base}/cursor")
        q = s.writeStream.option("checkpointLocation", f"{base}/checkpoint").format("parquet").option("path", f"{base}/data").trigger(processingTime="0 seconds").start()
        if stop_after is None:
            q.processAllAvailable()
        while stop_after and q.isActive and (q.lastProgress is None or q.lastProgress.batchId < stop_after - 1):
            time.sleep(0.1)
        q.stop()
    return spark.read.schema(t.schema).parquet(f"{base}/data")


@query("rapid_drain_stream", with_sql(TICKS_SQL, """w AS (SELECT key, cents, ts, event_id, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM ticks_v),
g AS (SELECT key, start, MAX(cents) AS peak, arg_max(cents, ts) AS last FROM w GROUP BY ALL)""", body=f"""SELECT key, start, start + INTERVAL 12 HOUR AS "end", peak, last FROM g
WHERE last * 100 <= peak * 15 AND start + INTERVAL 12 HOUR <= (SELECT MAX(ts) - {DELAY_SQL} FROM ticks_v)"""))
def _(spark, sf):
    return io.run_to_table(M.rapid_drain(sliced_ticks(spark, sf), "key", "ts", "cents", 85, "12 hours", "6 hours", DELAY))


@query("failure_rate_stream", with_sql(TICKS_SQL, body=f"""SELECT key, date_trunc('day', ts) AS start, COUNT(*) AS n, COUNT(*) FILTER (WHERE failed) AS failed FROM ticks_v GROUP BY 1, 2
HAVING COUNT(*) FILTER (WHERE failed) * 100 > COUNT(*) * 30 AND COUNT(*) >= 2 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - {DELAY_SQL} FROM ticks_v)"""))
def _(spark, sf):
    return io.run_to_table(M.failure_rate(sliced_ticks(spark, sf), "key", "ts", "failed", 30, "1 day", 2, DELAY))
