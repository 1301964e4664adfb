"""Windows, thresholds and alerts over time series.

Functions take batch or streaming frames.  On a stream the watermark bounds state and drops late
rows; in batch the same windows are plain aggregates with a map-side part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.plans.series import framed, previous, with_position
from auditloom.streaming import stateful

LATENESS = "10 minutes"


def watermarked(df: DataFrame, ts: str, delay: str = LATENESS) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def dedup_stream(df: DataFrame, key: str, ts: str, delay: str = LATENESS) -> DataFrame:
    """Each key once; on a stream duplicates are recognised within the watermark."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def monitor_stats(df: DataFrame, level: str = "level", alert_level: int = 3) -> DataFrame:
    """Running counts of analysed transactions, threats and alerts."""
    return df.agg(F.count(F.lit(1)).alias("analysed"), F.count_if(F.coalesce(F.col(level), F.lit(0)) > 0).alias("threats"),
                  F.count_if(F.coalesce(F.col(level), F.lit(0)) >= alert_level).alias("alerts"))


#: Expected and peak transactions per slot, frames and caps of the metrics.
EXPECTED_PER_SLOT, PEAK_PER_SLOT = 3000, 5000
SKIP_FRAME, STRESS_FRAME = 10, 5
LAG_MS_PER_TX, LAG_CAP = 10, 2000


def sample_metrics(slots: Column, tx: Column, nonvote: Column, period: Column, mean_tx: Column, mean_recent: Column) -> dict[str, Column]:
    skip = F.greatest(F.lit(0.0), (EXPECTED_PER_SLOT - mean_tx) / EXPECTED_PER_SLOT * 100)
    stress = F.least(F.lit(100.0), mean_recent / PEAK_PER_SLOT * 100)
    lag = F.when(slots > 0, F.least(F.lit(float(LAG_CAP)), nonvote / slots * LAG_MS_PER_TX)).otherwise(0.0)
    return {"skip_pct": skip, "stress_pct": stress, "lag_ms": lag, "tps": F.when(period > 0, tx / period).otherwise(0.0)}


def validator_metrics(samples: DataFrame, keys: list[str], ts: str, bucket: Column) -> DataFrame:
    """Skip, stress, lag and rate from the last samples of each validator (batch)."""
    per_slot = F.when(F.col("num_slots") > 0, F.col("num_transactions") / F.col("num_slots")).otherwise(0.0)
    placed = with_position(samples.withColumn("_per_slot", per_slot), keys, [ts], bucket)
    def over(w) -> dict[str, Column]:
        recent = w.rowsBetween(-(STRESS_FRAME - 1), 0)
        return {"_m10": F.avg("_per_slot").over(w), "_m5": F.avg("_per_slot").over(recent)}
    f = framed(placed, keys, "pos", SKIP_FRAME, over)
    m = sample_metrics(F.col("num_slots"), F.col("num_transactions"), F.col("num_non_vote_transactions"), F.col("sample_period_secs"), F.col("_m10"), F.col("_m5"))
    return f.select(*keys, ts, *[c.alias(n) for n, c in m.items()])


METRICS_SCHEMA = "validator string, ts timestamp, skip_pct double, stress_pct double, lag_ms double, tps double"
SAMPLE_SCHEMA = "ts timestamp, num_transactions double, num_slots double, num_non_vote_transactions double, sample_period_secs double"


def validator_metrics_stream(samples: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Streaming twin of :func:`validator_metrics`, for samples up to the watermark, in whatever order they come.

    State of a validator: the last ten ratios and the samples that the watermark has not passed.
    """
    run = stateful.SampleMetrics(SAMPLE_SCHEMA, "ts", SKIP_FRAME, STRESS_FRAME, EXPECTED_PER_SLOT, PEAK_PER_SLOT, LAG_MS_PER_TX, LAG_CAP)
    numbers = [c.split()[0] for c in SAMPLE_SCHEMA.split(", ")[1:]]
    rows = samples.withWatermark("ts", delay).select("validator", "ts", *[F.col(c).cast("double").alias(c) for c in numbers])
    return stateful.in_order(rows, ["validator"], run, METRICS_SCHEMA)


#: Metric -> thresholds of Medium, High, Critical.
TIERS = {"lag_ms": (500, 1000, 1500), "latency_ms": (1000, 2000, 3000), "skip_pct": (3, 6, 9), "stress_pct": (70, 80, 90)}


def tier(df: DataFrame, keep: list[str], metrics: list[str], tiers: dict[str, tuple] = TIERS) -> DataFrame:
    """One row per metric above its first threshold, with severity 3..5."""
    def graded(m: str) -> Column:
        lo, mid, hi = tiers[m]
        v = F.col(m)
        sev = F.when(v > hi, 5).when(v > mid, 4).when(v > lo, 3)
        return F.when(sev.isNotNull(), F.struct(F.lit(m).alias("metric"), v.cast("double").alias("observed"), sev.alias("severity")))
    return df.select(*keep, F.inline(F.filter(F.array(*[graded(m) for m in metrics]), lambda x: x.isNotNull())))


def rapid_drain(df: DataFrame, key: str, ts: str, amount: str, pct: int = 80, length: str = "3 minutes", slide: str = "1 minute",
                delay: str = LATENESS) -> DataFrame:
    """Windows in which the last balance (the larger one at equal times) is at least ``pct`` percent below the peak."""
    g = watermarked(df, ts, delay).groupBy(key, F.window(ts, length, slide)).agg(F.max(amount).alias("peak"), F.max_by(amount, F.struct(ts, amount)).alias("last"))
    return g.where(F.col("last") * 100 <= F.col("peak") * (100 - pct)).select(
        key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "peak", "last")


def spike(df: DataFrame, ts: str, is_new: Column, n: int = 200, length: str = "5 minutes", keys: list[str] | None = None) -> DataFrame:
    """Windows with at least ``n`` new accounts."""
    g = watermarked(df, ts).where(is_new).groupBy(*(keys or []), F.window(ts, length)).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= n).select(*(keys or []), F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def first_sight(df: DataFrame, account: str, ts: str, ident: str, delay: str = LATENESS) -> DataFrame:
    """The first row (account, ts, id) of each account by event time, however often it returns.

    On a stream an account's rows wait until the watermark has passed them; its output keeps the watermark, so windows may follow.
    """
    rows = df.select(F.col(account).alias("account"), F.col(ts).alias("ts"), F.col(ident).alias("id"))
    if not df.isStreaming:
        first = rows.groupBy("account").agg(F.min(F.struct("ts", "id")).alias("x"))
        return first.select("account", "x.ts", "x.id")
    kind = rows.schema["id"].dataType.simpleString()
    run = stateful.FirstRows(f"account string, ts timestamp, id {kind}", "ts", "account")
    rows = rows.select(F.col("account").cast("string").alias("account"), "ts", "id").withWatermark("ts", delay)
    return stateful.in_buckets(rows, ["account"], run, run.row_schema, "ts")


def new_account_spike(df: DataFrame, account: str, ts: str, ident: str, n: int = 200, length: str = "5 minutes", delay: str = LATENESS) -> DataFrame:
    """Windows in which at least ``n`` accounts are seen for the first time.  On a stream two stateful operators in a chain."""
    g = first_sight(df, account, ts, ident, delay).groupBy(F.window("ts", length)).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= n).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def failure_rate(df: DataFrame, key: str, ts: str, failed: str, pct: int, length: str, min_rows: int = 1, delay: str = LATENESS) -> DataFrame:
    """Windows of a program in which more than ``pct`` percent of the transactions failed."""
    g = watermarked(df, ts, delay).groupBy(key, F.window(ts, length)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(failed)).alias("failed"))
    return g.where((F.col("failed") * 100 > F.col("n") * pct) & (F.col("n") >= min_rows)).select(key, F.col("window.start").alias("start"), "n", "failed")


def _off(n: Column, total: Column, price: Column) -> Column:
    """How far ``price`` is off the mean, times n: products of 38 digits, as sums of prices may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.abs(wide(price) * wide(n) - wide(total))


def _beyond(off: Column, total: Column, pct: int) -> Column:
    return off * 100 > total.cast("decimal(28,0)") * pct


def price_deviation(df: DataFrame, key: str, ts: str, price: str, pct: int = 5, length: str = "5 minutes", delay: str = LATENESS) -> DataFrame:
    """Windows whose lowest or highest price is more than ``pct`` percent off the window average.

    Works on the sums only, so a window is one row of state and ticks are not joined back.
    """
    g = watermarked(df, ts, delay).groupBy(key, F.window(ts, length)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"), F.min(price).alias("lo"), F.max(price).alias("hi"))
    n, t = F.col("n"), F.col("total")
    off = F.greatest(_off(n, t, F.col("hi")), _off(n, t, F.col("lo")))
    return g.where(_beyond(off, t, pct)).select(key, F.col("window.start").alias("start"), "n", "lo", "hi", (t / n).alias("mean"))


def deviating_ticks(df: DataFrame, key: str, ts: str, price: str, keep: list[str], pct: int = 5, length: str = "5 minutes", delay: str = LATENESS) -> DataFrame:
    """Every tick that is more than ``pct`` percent off the average of its window.

    Ticks meet the sums of their window by key and window.  On a stream that is a join of the ticks with the
    aggregate of the same stream; both sides are bounded by the watermark, a tick waits until its window is closed.
    """
    timed = watermarked(df, ts, delay)
    ticks = timed.select(*keep, F.col(key).alias("_key"), F.col(price).alias("_price"), F.window(ts, length).alias("_window"))
    sums = timed.groupBy(F.col(key).alias("_key"), F.window(ts, length).alias("_window")).agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"))
    n, t, p = F.col("n"), F.col("total"), F.col("_price")
    return (ticks.join(sums, ["_key", "_window"]).where(_beyond(_off(n, t, p), t, pct))
            .select(*keep, F.col("_window.start").alias("start"), (t / n).alias("mean")))


def stale_feed(df: DataFrame, key: str, ts: str, seconds: int, bucket: Column, ties: list[str] | None = None) -> DataFrame:
    """Batch: silences of at least ``seconds`` between updates of a feed; ``ties`` order updates at the same time."""
    ties = ties or []
    p = previous(df.select(key, ts, *ties), [key], [ts, *ties], bucket, {ts: "last_seen"})
    gap = F.unix_micros(ts) - F.unix_micros("last_seen")
    return p.where(gap >= seconds * 1_000_000).select(key, "last_seen", F.col(ts).alias("resumed"))


def stale_feed_stream(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Stream: a feed is reported once it has been silent for ``seconds`` of event time."""
    g = watermarked(df, ts).groupBy(key, F.session_window(ts, f"{seconds} seconds")).agg(F.max(ts).alias("last_seen"))
    return g.select(key, "last_seen")


def large_move(df: DataFrame, amount: str, limit: int) -> DataFrame:
    return df.where(F.col(amount) >= limit)


def value_changed(df: DataFrame, key: str, order: list[str], bucket: Column, value: str) -> DataFrame:
    """Rows whose value differs from the previous one of the key (batch)."""
    p = previous(df, [key], order, bucket, {value: "before"})
    return p.where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def value_changed_stream(df: DataFrame, key: str, ts: str, order: list[str], value: str, expiry_ms: int | None = None, delay: str = LATENESS) -> DataFrame:
    """Streaming twin of :func:`value_changed`: (key, ts, ``order``, value, before) of rows up to the watermark.

    Rows at the same time are taken by the columns ``order``.  A value is compared only within ``expiry_ms``; then its state goes.
    """
    cols = list(dict.fromkeys([key, ts, *order, value]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols)
    run = stateful.Changes(schema, ts, key, value, expiry_ms)
    return stateful.in_buckets(df.withWatermark(ts, delay).select(*cols), [key], run, f"{schema}, before string")


ALERT_COLUMNS = ("id", "ts", "alert_type", "severity", "program", "description", "tx", "resolved")


def alert(df: DataFrame, alert_type: str, severity: Column | int, program: Column, ts: Column, description: Column, tx: Column | None = None) -> DataFrame:
    """Rows of any detector in the alert schema with a deterministic id."""
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    ref = (tx if tx is not None else F.lit(None)).cast("string")
    ident = F.substring(F.sha2(F.concat_ws("|", F.lit(alert_type), program.cast("string"), F.date_format(ts, "yyyyMMddHHmmssSSSSSS"), ref), 256), 1, 16)
    return df.select(ident.alias("id"), ts.alias("ts"), F.lit(alert_type).alias("alert_type"), sev.alias("severity"), program.cast("string").alias("program"),
                     description.alias("description"), ref.alias("tx"), F.lit(False).alias("resolved"))


def alert_feed(*alerts: DataFrame) -> DataFrame:
    out = alerts[0]
    for a in alerts[1:]:
        out = out.unionByName(a)
    return out
