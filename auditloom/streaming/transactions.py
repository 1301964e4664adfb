"""Signals on single transactions.

All functions are stateless projections, so the same code serves batch tables and streams and
needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Thresholds of the signals.
LARGE_CHANGE = 1_000_000_000_000
MAX_ACCOUNTS = 20
MAX_COMPUTE = 1_200_000
LEVEL_OF = {"FlashLoanAttack": 4, "ReentrancyAttempt": 4, "OracleManipulation": 4, "AuthorityBypass": 4, "AbnormalTokenFlow": 3,
            "SandwichAttack": 3, "AccountHijacking": 4, "UnusualAccountPattern": 2, "SuspiciousTimingPattern": 1, "Unknown": 1}
LEVEL_NAMES = {1: "Low", 2: "Medium", 3: "High", 4: "Critical"}
UNSURE = 0.3

def signal(threat: str, confidence: float, details: Column) -> Column:
    return F.struct(F.lit(threat).alias("threat_type"), F.lit(confidence).alias("confidence"), details.alias("details"))


def _paired(a: Column, b: Column) -> Column:
    """(l, r) for every position common to both arrays."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("l"), F.slice(b, F.lit(1), n).alias("r"))


def zip_any(a: Column, b: Column, test) -> Column:
    """Some position common to both arrays satisfies ``test(left, right)``."""
    return F.exists(_paired(a, b), lambda p: test(p["l"], p["r"]))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, which may use it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def _token_signals(moves: Column) -> Column:
    """Signals on (amount before, change, same mint) of each token; amounts are whole numbers."""
    loan = F.exists(moves, lambda m: m["d"] > LARGE_CHANGE) & F.exists(moves, lambda m: (m["d"] == 0) & (m["a"] > 0))
    drained = F.filter(moves, lambda m: m["same"] & (m["a"] > 0) & (m["d"] * 10 > m["a"] * 9))
    text = lambda h: F.when(h.isNotNull(), signal("AbnormalTokenFlow", 0.8, F.concat(
        F.lit("Large token movement: "), h["d"].cast("string"), F.lit(" tokens ("),
        F.floor(h["d"] * 100 / h["a"]).cast("string"), F.lit("% of balance)"))))
    return F.array(
        F.when(loan, signal("FlashLoanAttack", 0.7, F.lit("Large token movement with return to original balance detected"))),
        bind(F.get(drained, F.lit(0)), text))


def default_signals() -> Column:
    """Array of the four built-in signals; one that does not fire is null."""
    # Positions that one side lacks give nulls, on which no signal fires.
    moves = F.zip_with("pre_token_balances", "post_token_balances", lambda l, r: F.struct(
        l["amount"].alias("a"), F.abs(l["amount"] - r["amount"]).alias("d"), (l["mint"] == r["mint"]).alias("same")))

    def crowd(acc: Column) -> Column:
        n = F.size(acc)
        return F.when(n > MAX_ACCOUNTS, signal("UnusualAccountPattern", 0.5, F.concat(F.lit("Unusually high account count: "), n.cast("string")))).when(
            F.size(F.array_distinct(acc)) < n, signal("ReentrancyAttempt", 0.6, F.lit("Duplicate accounts detected - possible reentrancy setup")))

    # Bound, as the accounts may be an expression that is computed at every use.
    many = bind(F.col("accounts"), crowd)
    heavy = F.when(F.col("compute_units") > MAX_COMPUTE, signal("SuspiciousTimingPattern", 0.4, F.concat(
        F.lit("Very high compute usage: "), F.col("compute_units").cast("string"), F.lit(" CUs"))))
    return F.concat(bind(moves, _token_signals), F.array(many, heavy))


def signals(extra: Sequence[Column] = ()) -> Column:
    """Array of the signals that fire, in order; user signals come last."""
    every = F.concat(default_signals(), F.array(*extra)) if extra else default_signals()
    return F.filter(every, lambda s: s.isNotNull())


def tx_signals(tx: DataFrame, keep: list[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One row per signal."""
    return tx.select(*keep, F.inline(signals(extra)))


def threat_level(threat: Column, confidence: Column) -> Column:
    """Ordinal level by type; an unsure signal drops one step from Critical or High."""
    base = F.lit(1)
    for t, n in LEVEL_OF.items():
        base = F.when(threat == t, n).otherwise(base)
    return F.when((confidence < UNSURE) & (base >= 3), base - 1).otherwise(base)


def level_name(level: Column) -> Column:
    out = F.lit("Low")
    for n, name in LEVEL_NAMES.items():
        out = F.when(level == n, name).otherwise(out)
    return out


def max_level(fired: Column) -> Column:
    return F.array_max(F.transform(fired, lambda x: threat_level(x["threat_type"], x["confidence"])))


def fold_signals(tx: DataFrame, keep: list[str], min_level: int = 1, extra: Sequence[Column] = ()) -> DataFrame:
    """One threat per transaction: highest level, first type, highest confidence, joined details."""
    def folded(s: Column) -> Column:
        return F.when(F.size(s) > 0, F.struct(
            F.get(s, F.lit(0))["threat_type"].alias("threat_type"), max_level(s).alias("level"),
            F.array_max(F.transform(s, lambda x: x["confidence"])).alias("confidence"),
            F.array_join(F.transform(s, lambda x: x["details"]), "; ").alias("explanation")))
    one = F.filter(F.transform(F.array(signals(extra)), folded), lambda x: x.isNotNull())
    out = tx.select(*keep, F.inline(one))
    return out.where(F.col("level") >= min_level).withColumn("threat_level", level_name(F.col("level")))


def tx_detail(tx: DataFrame, keep: list[str]) -> DataFrame:
    """Status, fee in coins and the balance change of each account."""
    zipped = F.arrays_zip(F.col("accounts").alias("account"), F.col("pre_balances").alias("pre"), F.col("post_balances").alias("post"))
    return tx.select(*keep, F.when(F.col("error").isNull(), "Success").otherwise("Failed").alias("status"), (F.col("fee") / 1e9).alias("fee_coins"),
                     F.posexplode(zipped).alias("pos", "z")).select(
        *keep, "status", "fee_coins", "pos", F.col("z.account").alias("account"), (F.col("z.post") - F.col("z.pre")).alias("delta"))
