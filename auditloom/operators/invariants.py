"""Invariants: mined from text, and checked on state snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.operators.scan import scan_rules
from auditloom.plans.series import previous
from auditloom.rules.contract import INVARIANT_RULES


def mine_invariants(files: DataFrame, text: str, keep: list[str], min_confidence: float = 0.7):
    """(invariants per file of at least ``min_confidence``, those with a counterexample)."""
    hits = scan_rules(files, INVARIANT_RULES, text, keep)
    kept = hits.where(F.col("rule_confidence") >= min_confidence).withColumnRenamed("rule_confidence", "confidence")
    violated = hits.where("note <> ''").withColumnRenamed("note", "counterexample")
    return kept, violated


def monotonic(df: DataFrame, keys: list[str], ts: list[str], bucket: Column, cols: list[str], holds) -> DataFrame:
    """Compare each state with the previous one of its key; ``holds(now, before)`` on dicts of columns.

    The first state of a key has nothing to compare with and passes.
    """
    prev = previous(df, keys, ts, bucket, {c: f"_prev_{c}" for c in cols})
    now, before = {c: F.col(c) for c in cols}, {c: F.col(f"_prev_{c}") for c in cols}
    ok = F.when(before[cols[0]].isNull(), True).otherwise(holds(now, before))
    return prev.withColumn("ok", ok).drop(*[f"_prev_{c}" for c in cols])


def wide(c: Column) -> Column:
    """Any unsigned 64-bit value."""
    return c.cast("decimal(20,0)")


#: Digits of the low part of a split product.
LOW = 10**10
_dec = lambda c: c.cast("decimal(38,0)")


def _quotient(x: Column, y: Column) -> tuple[Column, Column]:
    """Exact floor of x / y and the rest, for non-negative decimals (a plain quotient would be rounded)."""
    rest = _dec(F.pmod(_dec(x), _dec(y)))
    return _dec(_dec(x - rest) / _dec(y)), rest


def product(a: Column, b: Column) -> tuple[Column, Column]:
    """Exact product of two unsigned 64-bit values as (high, low), value = high * LOW + low.  It would not fit one decimal."""
    low = F.lit(LOW).cast("decimal(20,0)")
    b_high, b_low = _quotient(wide(b), low)
    carry, rest = _quotient(_dec(wide(a) * b_low.cast("decimal(11,0)")), low)
    return _dec(_dec(wide(a) * b_high.cast("decimal(11,0)")) + carry), rest


def at_least(x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
    return (x[0] > y[0]) | ((x[0] == y[0]) & (x[1] >= y[1]))


def product_div(a: Column, b: Column, y: Column) -> Column:
    """Exact floor of a * b / y; null when y is 0, the largest decimal when it is too large for one."""
    some = F.nullif(wide(y), F.lit(0).cast("decimal(20,0)"))
    high, low = product(a, b)
    q_high, rest = _quotient(high, some)
    q_low, _ = _quotient(_dec(_dec(rest * F.lit(LOW).cast("decimal(11,0)")) + low), some)
    return F.when(q_high >= _dec(F.lit("1" + "0" * 28)), _dec(F.lit("9" * 38))).otherwise(_dec(_dec(q_high.cast("decimal(28,0)") * F.lit(LOW).cast("decimal(11,0)")) + q_low))


def check_pool(df: DataFrame, keys: list[str], ts: list[str], bucket: Column, tolerance: int = 1000) -> DataFrame:
    """Pool states: product close to ``expected_k``, not falling, and the shares that ``deposit_x`` and
    ``deposit_y`` earn of ``total_lp`` equal within 1.

    Reserves are any unsigned 64-bit values.  Products are compared exactly; ``k`` itself stops at the largest
    decimal.  An empty reserve has no shares: they are then equal only when both are.
    """
    high, low = product(F.col("reserve_x"), F.col("reserve_y"))
    k = F.when(high >= _dec(F.lit("1" + "0" * 28)), _dec(F.lit("9" * 38))).otherwise(_dec(_dec(high.cast("decimal(28,0)") * F.lit(LOW).cast("decimal(11,0)")) + low))
    at = df.withColumns({"k": k, "_k_high": high, "_k_low": low})
    not_falling = lambda n, b: at_least((n["_k_high"], n["_k_low"]), (b["_k_high"], b["_k_low"]))
    out = monotonic(at, keys, ts, bucket, ["_k_high", "_k_low"], not_falling).withColumnRenamed("ok", "k_not_falling").drop("_k_high", "_k_low")
    k, expected = F.col("k"), _dec(F.col("expected_k"))
    within = F.greatest(k, expected) - F.least(k, expected) <= tolerance
    x, y = (product_div(F.col(f"deposit_{side}"), F.col("total_lp"), F.col(f"reserve_{side}")) for side in "xy")
    equal = F.coalesce(F.greatest(x, y) - F.least(x, y) <= 1, F.lit(True)) & (x.isNull() == y.isNull())
    return out.withColumn("k_within", within).withColumn("share_proportional", equal)


def check_lending(df: DataFrame, min_ratio_bps: int = 10_000) -> DataFrame:
    """Solvency, collateral ratio and health of lending pools; no borrows passes."""
    b, c = wide(F.col("total_borrows")), wide(F.col("total_collateral"))
    none = F.col("total_borrows") == 0
    safe = F.when(none, F.lit(1).cast("decimal(20,0)")).otherwise(b)
    ratio, _ = _quotient(_dec(c * 10_000), safe)
    health, _ = _quotient(_dec(c * F.col("liquidation_threshold_bps").cast("decimal(10,0)")), _dec(safe * 100))
    return (df.withColumn("solvent", F.col("total_deposits") >= F.col("total_borrows"))
            .withColumn("collateral_ok", none | (ratio >= min_ratio_bps)).withColumn("healthy", none | (health >= 100)))


def check_vault(df: DataFrame, keys: list[str], ts: list[str], bucket: Column) -> DataFrame:
    """Vault states: share price not falling (cross-multiplied), deposits mint shares, dead shares exist."""
    price = lambda n, b: at_least(product(n["total_assets"], b["total_shares"]), product(b["total_assets"], n["total_shares"]))
    out = monotonic(df, keys, ts, bucket, ["total_assets", "total_shares"], price).withColumnRenamed("ok", "price_not_falling")
    minted = F.coalesce(product_div(F.col("deposit"), F.col("total_shares"), F.col("total_assets")), _dec(F.col("deposit")))
    return out.withColumn("mints", (F.col("deposit") == 0) | (minted > 0)).withColumn("has_dead_shares", F.col("dead_shares") > 0)


def check_staking(users: DataFrame, totals: DataFrame) -> DataFrame:
    """Sum of user stakes equals the total; rewards do not exceed elapsed time x rate."""
    s = users.groupBy("pool").agg(F.sum(wide(F.col("amount"))).alias("staked"))
    elapsed = F.greatest(wide(F.lit(0)), wide(F.col("now")) - wide(F.col("last_update")))
    bounded = at_least(product(elapsed, F.col("reward_rate")), product(F.col("total_rewards"), F.lit(1)))
    return totals.join(s, "pool", "left").select(
        "pool", (F.coalesce("staked", F.lit(0)) == F.col("total_staked")).alias("conserved"), bounded.alias("rewards_bounded"))


def check_fees(df: DataFrame) -> DataFrame:
    """Fee at most amount x basis points / 10000."""
    return df.withColumn("fee_ok", at_least(product(F.col("amount"), F.col("bps")), product(F.col("fee"), F.lit(10_000))))


def overall(df: DataFrame, by: list[str], checks: list[str]) -> DataFrame:
    """Violated when any check of any row fails."""
    bad = F.lit(False)
    for c in checks:
        bad = bad | ~F.col(c)
    return df.groupBy(*by).agg(F.when(F.bool_or(bad), "Violated").otherwise("Proven").alias("status"), F.count_if(bad).alias("violations"))
