import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import facts as FT, invariants as IV
from auditloom.plans.series import framed, previous, with_position
from auditloom.plans.skew import hot_keys, salted_join


def ids(df):
    return sorted(r.rule_id for r in df.collect())


@pytest.mark.parametrize("prot,fires", [([("MultiSig", 2, 3, 0)], True), ([("MultiSig", 3, 5, 0)], False), ([("Timelock", 0, 0, 172799)], True), ([("Timelock", 0, 0, 172800)], False), ([("Governance", 0, 0, 0)], False)])
def test_upgrade_protection(spark, prot, fires):
    df = spark.createDataFrame([(1, "upgrade", ["ProgramUpgrade"], prot)], "id int, name string, can_modify array<string>, protections array<struct<kind:string,threshold:int,total:int,delay_seconds:long>>")
    assert ("UnprotectedUpgrade" in ids(FT.check_privileges(df, ["id"]))) == fires


def test_checks_before_and_after(spark):
    ops = spark.createDataFrame([("o", 5, ["Signer", "Owner"])], "op_id string, line int, required array<string>")
    checks = spark.createDataFrame([("o", "Signer", 4), ("o", "Owner", 6), ("o", "Owner", 5)], "op_id string, type string, line int")
    missing, late = FT.missing_checks(ops, checks)
    assert [r.required for r in missing.collect()] == ["Owner"] and sorted(r.line for r in late.collect()) == [5, 6]


def pair_fields(spark, names, attrs=None):
    return spark.createDataFrame([("s", i, n, (attrs or {}).get(n, "#[account(mut)]"), "Account<'info, T>") for i, n in enumerate(names)], "struct_name string, pos int, field_name string, attrs string, field_type string")


@pytest.mark.parametrize("names,related", [(["from", "to"], True), (["token_a", "token_b"], True), (["user_1", "user_2"], True), (["mint", "clock"], False)])
def test_related(spark, names, related):
    assert (FT.related_pairs(pair_fields(spark, names), ["struct_name"]).count() == 1) == related


def test_distinct_constraint(spark):
    f = pair_fields(spark, ["from", "to"], {"to": "#[account(mut, constraint = to.key() != from.key())]"})
    assert FT.related_pairs(f, ["struct_name"]).count() == 0


@pytest.mark.parametrize("n", [64, 65, 200])
def test_all_pairs_at_any_size(spark, n):
    f = pair_fields(spark, [f"user_{i}" for i in range(n)], {"user_3": "#[account(mut, constraint = user_3.key() != user_7.key())]"})
    rows = {(r.pos_a, r.pos_b) for r in FT.related_pairs(f, ["struct_name"]).collect()}
    assert rows == {(a, b) for a in range(n) for b in range(a + 1, n)} - {(3, 7)}
    assert FT.related_blocks(f, ["struct_name"]).count() == 3 * n  # the stem, and two word pairs that "user" is in


def test_fields(spark):
    f = spark.createDataFrame([("authority", "AccountInfo<'info>", "", ""), ("vault", "Account<'info, V>", "#[account(seeds = [b\"v\"])]", ""), ("pool", "UncheckedAccount<'info>", "/// CHECK: x\n", ""), ("owner", "Signer<'info>", "", "")],
                              "field_name string, field_type string, attrs string, siblings string")
    by = {}
    for r in FT.scan_fields(f, ["field_name"]).collect():
        by.setdefault(r.field_name, set()).add(r.rule_id)
    assert by == {"authority": {"SEC3-RAW", "SEC3-OWNER-RAW", "SEC3-SIGNER"}, "vault": {"SEC3-BUMP"}, "pool": {"SEC3-OWNER", "SEC3-NOSEED"}}
    assert {(r.field_name, r.rule_id) for r in FT.scan_constraints(f, ["field_name"]).collect()} == {
        ("authority", "ANC-SIGNER"), ("vault", "ANC-BUMP"), ("vault", "ANC-PDA-STATIC"), ("owner", "ANC-HASONE")}


def test_collisions(spark):
    d = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "q", "a"), (4, "q", "a")], "id int, pattern string, purpose string")
    assert sorted(r.id for r in FT.collisions(d, "pattern", "purpose").collect()) == [1, 2]


@pytest.mark.parametrize("dep,bor,col,want", [(1_000_000, 500_000, 750_000, (True, True, True)), (0, 0, 0, (True, True, True)), (10, 10, 10, (True, True, False)), (10, 20, 19, (False, False, False)),
                                             (2 ** 62, 2 ** 61, 2 ** 61 - 1, (True, False, False))])
def test_lending(spark, dep, bor, col, want):
    df = spark.createDataFrame([(dep, bor, col, 8000)], "total_deposits long, total_borrows long, total_collateral long, liquidation_threshold_bps long")
    r = IV.check_lending(df).first()
    got = (r.solvent, r.collateral_ok, r.healthy)
    assert got[:2] == want[:2] and got[2] == (bor == 0 or col * 8000 // (bor * 100) >= 100)


def test_pool_near_limits(spark):
    x = 2 ** 62
    rows = [("p", i, a, b, a, a, 0, 0) for i, (a, b) in enumerate([(x, x), (x, x - 1), (x - 1, x + 1)])]
    df = spark.createDataFrame(rows, "pool string, ts int, reserve_x long, reserve_y long, total_lp long, deposit_x long, deposit_y long, e long").withColumn("deposit_y", F.col("reserve_y")).withColumn(
        "expected_k", IV.wide(F.col("reserve_x")) * IV.wide(F.col("reserve_y")))
    got = IV.check_pool(df, ["pool"], ["ts"], F.col("ts")).orderBy("ts").collect()
    assert [r.k_not_falling for r in got] == [True, False, True] and all(r.k_within and r.share_proportional for r in got)


def test_staking_and_fees(spark):
    users = spark.createDataFrame([("p", 5), ("p", 6), ("q", 1)], "pool string, amount long")
    totals = spark.createDataFrame([("p", 11, 10, 1, 0, 10), ("q", 2, 1, 1, 10, 5)], "pool string, total_staked long, total_rewards long, reward_rate long, last_update long, now long")
    got = {r.pool: (r.conserved, r.rewards_bounded) for r in IV.check_staking(users, totals).collect()}
    assert got == {"p": (True, True), "q": (False, False)}
    fees = spark.createDataFrame([("a", 30, 10000, 30), ("a", 31, 10000, 30), ("b", 0, 0, 0)], "k string, fee long, amount long, bps long")
    assert {r.k: r.status for r in IV.overall(IV.check_fees(fees), ["k"], ["fee_ok"]).collect()} == {"a": "Violated", "b": "Proven"}


def test_series_equals_plain_window(spark):
    """A hot key over several buckets and chunks gives what a plain window gives."""
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", rnd.randrange(300), i, rnd.randrange(100)) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, ts int, id int, v int")
    bucket = F.floor(F.col("ts") / 20)
    by = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(k, []).append((i, v))
    prev = {r.id: r.before for r in previous(df, ["key"], ["ts", "id"], bucket, {"v": "before"}, chunk=7).collect()}
    pos = {r.id: r.pos for r in with_position(df, ["key"], ["ts", "id"], bucket).collect()}
    placed = with_position(df, ["key"], ["ts", "id"], bucket)
    rolled = {r.id: r.s for r in framed(placed, ["key"], "pos", 5, lambda w: {"s": F.sum("v").over(w)}, chunk=6).collect()}
    for series in by.values():
        for n, (i, v) in enumerate(series):
            assert pos[i] == n + 1 and prev[i] == (series[n - 1][1] if n else None) and rolled[i] == sum(x for _, x in series[max(0, n - 4):n + 1])
    assert len(prev) == len(rolled) == 1000


def test_salted_join_keeps_every_row(spark):
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)], "k string, i int")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, w int")
    hot = hot_keys(many, ["k"])
    assert hot.count() < 256 and "hot" in {r.k for r in hot.collect()}
    for how in ("inner", "left"):
        want = sorted(map(tuple, many.join(few, "k", how).collect()), key=str)
        assert sorted(map(tuple, salted_join(many, few, ["k"], ["i"], how).collect()), key=str) == want


U64 = 2 ** 64 - 1
EDGES = [0, 1, 2 ** 63, U64]


def u64_frame(spark, names, rows):
    return spark.createDataFrame([tuple(str(v) for v in r) for r in rows], ", ".join(f"{n} string" for n in names)).select(
        *[F.col(n).cast("decimal(20,0)").alias(n) for n in names])


def test_full_range_products(spark):
    rows = [(a, b, c) for a in EDGES for b in EDGES for c in EDGES]
    df = u64_frame(spark, ["a", "b", "c"], rows)
    high, low = IV.product(F.col("a"), F.col("b"))
    got = df.select("a", "b", "c", high.alias("high"), low.alias("low"), IV.product_div(F.col("a"), F.col("b"), F.col("c")).alias("q")).collect()
    for r in got:
        a, b, c = int(r.a), int(r.b), int(r.c)
        assert int(r.high) * IV.LOW + int(r.low) == a * b
        assert r.q is None if c == 0 else int(r.q) == min(a * b // c, 10 ** 38 - 1)


def test_full_range_checks(spark):
    pools = u64_frame(spark, ["pool", "ts", "reserve_x", "reserve_y", "total_lp", "deposit_x", "deposit_y", "expected_k"], [
        (0, t, x, y, U64, x, y, 0) for t, (x, y) in enumerate([(0, 0), (0, U64), (1, 1), (U64, U64), (U64, U64 - 1)])])
    got = IV.check_pool(pools, ["pool"], ["ts"], F.col("ts")).orderBy("ts").collect()
    assert [r.k_not_falling for r in got] == [True, True, True, True, False]
    assert [r.k_within for r in got] == [True, True, True, False, False] and [r.share_proportional for r in got] == [True, False, True, True, True]
    vaults = u64_frame(spark, ["v", "ts", "total_assets", "total_shares", "deposit", "dead_shares"], [(0, 0, U64, U64, 1, 1), (0, 1, U64, U64 - 1, U64, 0), (0, 2, 0, 0, 5, 0)])
    got = IV.check_vault(vaults, ["v"], ["ts"], F.col("ts")).orderBy("ts").collect()
    assert [(r.price_not_falling, r.mints) for r in got] == [(True, True), (True, True), (True, True)]
    fees = u64_frame(spark, ["fee", "amount", "bps"], [(U64, U64, 10_000), (U64, U64, 9_999), (10 ** 16, 10 ** 16, 10_000), (0, 0, 0)])
    assert [r.fee_ok for r in IV.check_fees(fees).collect()] == [True, False, True, True]
    users = u64_frame(spark, ["pool", "amount"], [(1, U64), (1, U64), (2, 1)])
    totals = u64_frame(spark, ["pool", "total_staked", "total_rewards", "reward_rate", "last_update", "now"], [(1, U64, U64, U64, 0, U64), (2, 1, 1, U64, 5, 0)])
    assert {int(r.pool): (r.conserved, r.rewards_bounded) for r in IV.check_staking(users, totals).collect()} == {1: (False, True), 2: (True, False)}
    lend = u64_frame(spark, ["total_deposits", "total_borrows", "total_collateral", "liquidation_threshold_bps"], [(U64, U64, U64, 8000), (0, 0, 0, 0), (1, U64, 1, 1)])
    assert [(r.solvent, r.collateral_ok, r.healthy) for r in IV.check_lending(lend).collect()] == [(True, True, False), (True, True, True), (False, False, False)]


def test_account_checks_move_one_byte_a_row(spark):
    """Rows meet their constraints as bits, those that no rule asks for not at all."""
    schema = "k long, name string, type string, source string, operations array<string>, validations array<string>"
    rows = [(1, "a", "StateAccount", "Stored", ["Read"], []), (2, "b", "Program", "Stored", ["Write"], ["OwnerCheck"]), (3, None, "Program", "RemainingAccounts", [], []),
            (4, "c", "TokenAccount", "RemainingAccounts", ["Write", "TokenTransfer"], None), (5, "d", "StateAccount", "Stored", [], [])]
    con = spark.createDataFrame([("a", "Account<'info, T>"), ("c", "Signer<'info>"), ("d", "owner = x")], "name string, constraint string")
    out = FT.check_accounts(spark.createDataFrame(rows, schema), con, ["k"])
    assert sorted((r.k, r.rule_id) for r in out.collect()) == [(1, "MissingOwnerCheck"), (3, "UncheckedRemainingAccounts")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter"):].splitlines()[1]
    assert "operations" not in join and "validations" not in join
