"""Checks on fact tables and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.operators.scan import _hits, scan_rules
from auditloom.plans.lineage import cut, cut_counted
from auditloom.plans.skew import hot_keys, replicated, salted_join, with_salt
from auditloom.rules.facts import CONSTRAINT_RULES, DERIVATION_RULES, FIELD_RULES, HOOK_RULES, USAGE_RULES


def _rule_rows(df: DataFrame, keep: list[str], rules: list[tuple[str, int, Column]]) -> DataFrame:
    facts = F.array(*[F.struct(F.lit(n).alias("rule_id"), F.lit(s).alias("severity")) for n, s, _ in rules])
    return df.select(*keep, F.inline(_hits([c for _, _, c in rules], facts)))


def _columns(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def check_usages(df: DataFrame, keep: list[str]) -> DataFrame:
    """Price usages: ``kind, context, asset, validations``."""
    return scan_rules(df, USAGE_RULES, _columns("kind", "context", "asset", "validations"), keep).select(*keep, "rule_id", "severity")


def check_derivations(df: DataFrame, keep: list[str]) -> DataFrame:
    """Derived addresses: ``bump_source, program_id_source, seeds``; one more row per unsanitised seed."""
    at = df.withColumn("seed_sources", F.transform("seeds", lambda s: s["source"]))
    whole = scan_rules(at, DERIVATION_RULES, _columns("bump_source", "program_id_source", "seed_sources"), keep).select(
        *keep, "rule_id", "severity", F.lit(None).cast("string").alias("seed"))
    bad = F.filter("seeds", lambda s: (s["source"] == "Parameter") & ~s["is_validated"])
    seeds = df.select(*keep, F.explode(bad).alias("s")).select(
        *keep, F.lit("UnsanitizedSeed").alias("rule_id"), F.lit(4).alias("severity"), F.col("s.expr").alias("seed"))
    return whole.unionByName(seeds)


def collisions(df: DataFrame, pattern: str, purpose: str) -> DataFrame:
    """Derivations whose seed pattern serves more than one purpose.

    Smallest and largest purpose differ exactly when there are two, so no distinct count is
    needed; the join back is salted because one pattern may dominate.
    """
    shared = df.groupBy(pattern).agg(F.min(purpose).alias("_a"), F.max(purpose).alias("_b")).where("_a <> _b").select(pattern)
    return salted_join(df, shared, [pattern], [c for c in df.columns if c != pattern][:1])


#: Protections that count as strong for an upgrade.
STRONG_THRESHOLD, STRONG_TOTAL, STRONG_DELAY = 3, 5, 172_800


def check_privileges(df: DataFrame, keep: list[str]) -> DataFrame:
    """Privileged functions: ``name, can_modify, protections(kind, threshold, total, delay_seconds)``."""
    p, m = F.col("protections"), F.col("can_modify")
    has = lambda *kinds: F.exists(p, lambda x: x["kind"].isin(*kinds))
    authority = F.array_contains(m, "Authority")
    strong = F.exists(p, lambda x: ((x["kind"] == "MultiSig") & (x["threshold"] >= STRONG_THRESHOLD) & (x["total"] >= STRONG_TOTAL))
                      | (x["kind"] == "Governance") | ((x["kind"] == "Timelock") & (x["delay_seconds"] >= STRONG_DELAY)))
    unpause = F.lower("name").rlike("unpause|resume")
    return _rule_rows(df, keep, [
        ("InstantAuthorityUpdate", 4, authority & ~has("Timelock", "MultiSig")),
        ("SinglePointOfFailure", 3, authority & (F.size(p) == 1) & has("SingleSigner")),
        ("UnsafeEmergencyFunction", 3, F.array_contains(m, "PauseState") & unpause & ~has("MultiSig", "Governance", "Timelock")),
        ("UnprotectedUpgrade", 5, F.array_contains(m, "ProgramUpgrade") & ~strong),
        ("ZeroAuthorityPossible", 3, authority),
        ("UnconstrainedTransfer", 4, authority & ((F.size(p) == 0) | has("None"))),
    ])


def check_accounts(accounts: DataFrame, constraints: DataFrame, keep: list[str]) -> DataFrame:
    """Accounts (``name, type, source, operations, validations``) against declared ``constraints(name, constraint)``."""
    c = F.col("constraint")
    flags = constraints.groupBy("name").agg(*[F.bool_or(F.contains(c, F.lit(t))).alias(f"_{n}") for n, t in (
        ("owner", "owner"), ("typed", "Account<"), ("signer", "Signer"), ("mut", "mut"))])
    op = lambda o: F.array_contains("operations", o)
    ok = lambda v: F.array_contains("validations", v)
    remaining = F.col("source") == "RemainingAccounts"
    # What a rule asks of the account itself, and the constraint that excuses it.
    rules = [
        ("MissingOwnerCheck", 5, (F.col("type") == "StateAccount") & ~ok("OwnerCheck"), "owner"),
        ("MissingDiscriminatorCheck", 4, op("Read") & ~ok("DiscriminatorCheck") & (F.col("source") != "InstructionContext"), "typed"),
        ("MissingSignerCheck", 5, (op("TransferLamports") | op("TokenTransfer")) & ~ok("IsSignerCheck"), "signer"),
        ("MissingInitializationCheck", 4, op("Read") & ~ok("IsInitializedCheck") & remaining, None),
        ("UncheckedRemainingAccounts", 4, remaining & (F.size("validations") == 0), None),
        ("MissingWritableCheck", 3, op("Write") & ~ok("IsWritableCheck") & remaining, "mut"),
    ]
    may = sum((F.when(test, F.lit(1 << i)).otherwise(0) for i, (_, _, test, _) in enumerate(rules)), F.lit(0)).cast("byte")
    # One byte a row meets the constraints, and only rows that some rule asks for.
    hot, n_hot = cut_counted(hot_keys(accounts, ["name"]))
    asked = accounts.select(*dict.fromkeys([*keep, "name"]), may.alias("_may")).where(F.col("_may") != 0)
    if n_hot:
        a = with_salt(asked, hot, ["name"], keep).join(replicated(flags, hot, ["name"]), ["name", "salt"], "left")
    else:
        a = asked.join(flags, "name", "left")
    yes = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(False))
    hit = lambda i, n: (F.col("_may").bitwiseAND(F.lit(1 << i)) != 0) & (F.lit(True) if n is None else ~yes(n))
    return _rule_rows(a, keep, [(rule, sev, hit(i, n)) for i, (rule, sev, _, n) in enumerate(rules)])


def check_pricing(reads: DataFrame, calcs: DataFrame, checks: DataFrame, by: str) -> DataFrame:
    """Spot reads, unprotected first deposits, pro-rata formulas, and programs with no slippage check at all."""
    row = lambda df, rule, sev: df.select(by, F.col("id"), F.lit(rule).alias("rule_id"), F.lit(sev).alias("severity"))
    spot = row(reads.where("source = 'SpotReserves'"), "SpotPriceForCriticalDecision", 5)
    first = row(calcs.where("not has_first_deposit_protection"), "FirstDepositInflation", 5)
    donate = row(calcs.where("formula_type = 'ProRata'"), "DonationVulnerable", 3)
    checked = checks.where("check_type <> 'None'").select(by).distinct()
    bare = calcs.select(by).distinct().join(checked, by, "left_anti").select(
        by, F.lit(None).cast("string").alias("id"), F.lit("NoSlippageProtection").alias("rule_id"), F.lit(4).alias("severity"))
    return spot.unionByName(first).unionByName(donate).unionByName(bare)


def check_runs(runs: DataFrame, functions: DataFrame) -> DataFrame:
    """Execution logs: ``run_id, accounts(is_signer, owner), changes(function, had_signer_check)``.

    One row per run and violated property, naming the first changed function concerned.
    """
    signed = F.exists("accounts", lambda a: a["is_signer"])
    owners = F.size(F.array_distinct(F.transform("accounts", lambda a: a["owner"])))
    first = F.get("changes", F.lit(0))["function"]
    unsigned = F.get(F.filter("changes", lambda c: ~c["had_signer_check"]), F.lit(0))["function"]
    direct = runs.select("run_id", F.explode(F.filter(F.array(
        F.when(~signed & unsigned.isNotNull(), F.struct(F.lit("MissingSignerCheck").alias("rule_id"), F.lit(5).alias("severity"), unsigned.alias("function"))),
        F.when((owners > 1) & first.isNotNull(), F.struct(F.lit("MissingOwnerCheck").alias("rule_id"), F.lit(4).alias("severity"), first.alias("function"))),
        F.when(first.isNotNull(), F.struct(F.lit("ArbitraryAccountSubstitution").alias("rule_id"), F.lit(4).alias("severity"), first.alias("function")))),
        lambda x: x.isNotNull())).alias("v")).select("run_id", "v.*")
    bad = functions.where("modifies and not has_signer_check").select(F.col("name").alias("function")).distinct()
    changes = runs.select("run_id", F.posexplode(F.transform("changes", lambda c: c["function"])).alias("i", "function"))
    mutated = salted_join(changes, bad, ["function"], ["run_id"]).groupBy("run_id").agg(F.min_by("function", "i").alias("function"))
    return direct.unionByName(mutated.select("run_id", F.lit("UnauthorizedStateChange").alias("rule_id"), F.lit(5).alias("severity"), "function"))


def scan_fields(fields: DataFrame, keep: list[str]) -> DataFrame:
    """Struct-field rules on ``field_name, field_type, attrs``."""
    return scan_rules(fields, FIELD_RULES, _columns("field_name", "field_type", "attrs"), keep).select(*keep, "rule_id", "category", "severity", "cwe")


def scan_constraints(fields: DataFrame, keep: list[str]) -> DataFrame:
    """Framework-constraint rules; ``siblings`` holds the attributes of the whole struct."""
    return scan_rules(fields, CONSTRAINT_RULES, _columns("field_name", "field_type", "attrs", "siblings"), keep).select(
        *keep, "rule_id", "category", "severity", "cwe")


def scan_hooks(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return scan_rules(files, HOOK_RULES, text, keep).select(*keep, "rule_id", "category", "severity")


def missing_checks(ops: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(required checks that do not precede their operation, checks made after it).

    ``ops(op_id, line, required)``, ``checks(op_id, type, line)``.  Checks shrink to the earliest
    line per (operation, type) before they meet the operations.
    """
    earliest = checks.groupBy("op_id", F.col("type").alias("required")).agg(F.min("line").alias("_line"))
    need = ops.select("op_id", "line", F.explode("required").alias("required"))
    missing = need.join(earliest, ["op_id", "required"], "left").where(F.col("_line").isNull() | (F.col("_line") >= F.col("line"))).select(
        "op_id", "line", "required")
    late = salted_join(checks, ops.select("op_id", F.col("line").alias("op_line")), ["op_id"], ["type", "line"]).where(
        F.col("line") >= F.col("op_line")).select("op_id", "type", "line", "op_line")
    return missing, late


#: Words whose fields must not be the same account.
RELATED_WORDS = (("source", "destination"), ("source", "dest"), ("from", "to"), ("sender", "receiver"), ("sender", "recipient"),
                 ("input", "output"), ("user", "vault"), ("deposit", "withdraw"), ("token_a", "token_b"), ("base", "quote"), ("pool", "user"))
STEM_TAIL = r"[ab\p{N}_]+$"


def related_blocks(fields: DataFrame, by: list[str]) -> DataFrame:
    """Mutable accounts by block, in long form: ``by``, block, side, pos, name.

    A block is a struct with a shared stem (one side) or with a word pair (two sides); every field of
    it is a row, so it is as long as its struct whatever its size.
    """
    name = F.lower("field_name")
    stem = F.regexp_replace(name, STEM_TAIL, "")
    tags = [F.when(stem != "", F.struct(F.concat(F.lit("="), stem).alias("block"), F.lit("s").alias("side")))]
    for i, (a, b) in enumerate(RELATED_WORDS):
        for word, side in ((a, "a"), (b, "b")):
            tags.append(F.when(F.contains(name, F.lit(word)), F.struct(F.lit(f"#{i:02d}").alias("block"), F.lit(side).alias("side"))))
    is_account = F.col("field_type").rlike("Account<|AccountInfo|UncheckedAccount<")
    is_mut = F.contains("attrs", F.lit("mut")) & ~F.contains("attrs", F.lit("immut"))
    return fields.where(is_account & is_mut).select(*by, "pos", F.col("field_name").alias("name"), F.inline(
        F.filter(F.array(*tags), lambda t: t.isNotNull())))


def related_pairs(fields: DataFrame, by: list[str]) -> DataFrame:
    """Related mutable accounts of one struct without a distinctness constraint: all pairs of :func:`related_blocks`.

    The pairs are as many as the report asks for, with the square of a struct's fields; the blocks are the short form.
    """
    e = related_blocks(fields, by)
    block = [*by, "block", "side"]
    other = F.when(F.col("side") == "a", "b").when(F.col("side") == "b", "a").otherwise("s").alias("side")
    left = e.select(*block, F.col("pos").alias("pos_a"), F.col("name").alias("name_a"))
    right = e.select(*by, "block", other, F.col("pos").alias("pos_b"), F.col("name").alias("name_b"))
    differ = (F.col("side") != "s") | (F.lower("name_a") != F.lower("name_b"))
    listed = left.join(right, block).where((F.col("pos_a") < F.col("pos_b")) & differ).select(*by, "pos_a", "name_a", "pos_b", "name_b")
    pattern = r"(\w+)\.key\(\) != (\w+)\.key\(\)|require_keys_neq!\((\w+), (\w+)\)"
    names = lambda g, h: F.filter(F.array(*[F.nullif(F.regexp_extract("_t", pattern, i), F.lit("")) for i in (g, h)]), lambda x: x.isNotNull())
    stated = fields.select(*by, F.explode(F.regexp_extract_all("attrs", F.lit(f"({pattern})"), F.lit(1))).alias("_t")).select(
        *by, F.get(names(1, 3), 0).alias("_x"), F.get(names(2, 4), 0).alias("_y"))
    stated = stated.select(*by, F.least("_x", "_y").alias("_lo"), F.greatest("_x", "_y").alias("_hi")).distinct()
    pairs = listed.distinct().withColumn("_lo", F.least("name_a", "name_b")).withColumn("_hi", F.greatest("name_a", "name_b"))
    return pairs.join(stated, [*by, "_lo", "_hi"], "left_anti").drop("_lo", "_hi")
