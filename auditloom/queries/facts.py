"""Queries on fact tables, pairs and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import facts as FT, invariants as IV, scores as SC
from auditloom.queries import views as V
from auditloom.queries.base import Area
from auditloom.queries.text import FIELDS_SQL, UNITS_SQL, fields
from auditloom.queries.views import KEY_SQL, LINE_KEYS, choose, choose_sql, some, some_sql, with_sql
from auditloom.rules import facts as RF

area = Area()
QUERIES, ORACLE, query = area.queries, area.oracle, area.query
C = F.col
lineitem = V.lineitem
_text = lambda c: C(c).cast("string")

# ---------------------------------------------------------------- usages
_SOURCES = ("Pyth", "Switchboard", "AMMSpot", "TWAP", "Chainlink", "Custom", "Hardcoded")
_CONTEXTS = ("Liquidation", "CollateralValuation", "BorrowingPower", "Swap", "Display")
_ASSETS = ("USDC", "SOL", "USDT", "ETH")
_VALID = (("StalenessCheck", 2), ("ConfidenceCheck", 3), ("BoundsCheck", 5), ("MultiOracleCheck", 7))
_Q = lambda: C("l_quantity").cast("int")
_USAGES_SQL = f"""usages_v AS (SELECT {KEY_SQL}, {choose_sql(_SOURCES, 'l_partkey')} AS kind, {choose_sql(_CONTEXTS, 'l_suppkey')} AS context, {choose_sql(_ASSETS, 'l_linenumber')} AS asset,
  {some_sql([(n, f'CAST(l_quantity AS INTEGER) % {m} = 0') for n, m in _VALID])} AS validations FROM lineitem)"""


def usages(spark, sf):
    return lineitem(spark, sf).select(*LINE_KEYS, choose(_SOURCES, C("l_partkey")).alias("kind"), choose(_CONTEXTS, C("l_suppkey")).alias("context"),
                                      choose(_ASSETS, C("l_linenumber")).alias("asset"), some([(n, _Q() % m == 0) for n, m in _VALID]).alias("validations"))


_cols = lambda *n: {x: x for x in n}
_rules_sql = lambda view, rules, cols, keep: " UNION ALL ".join(
    f"SELECT {keep}, '{r.id}' AS rule_id, {r.severity} AS severity FROM {view} WHERE {r.when.sql(cols)}" for r in rules)


@query("price_usage_checks", with_sql(_USAGES_SQL, body=_rules_sql("usages_v", RF.USAGE_RULES, _cols("kind", "context", "asset", "validations"), KEY_SQL)))
def _(spark, sf):
    return FT.check_usages(usages(spark, sf), LINE_KEYS)


@query("source_diversity", with_sql(_USAGES_SQL, body="""SELECT l_suppkey, COUNT(DISTINCT kind) AS sources, bool_or(kind IN ('Pyth', 'Switchboard', 'Chainlink')) AS external, bool_and(len(validations) > 0) AS validated,
 CASE WHEN bool_or(kind IN ('Pyth', 'Switchboard', 'Chainlink')) AND bool_and(len(validations) > 0) THEN 'LOW' WHEN bool_or(kind IN ('Pyth', 'Switchboard', 'Chainlink')) OR bool_and(len(validations) > 0) THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level
 FROM usages_v GROUP BY 1"""))
def _(spark, sf):
    return SC.diversity(usages(spark, sf), ["l_suppkey"])


# ---------------------------------------------------------------- derivations
_BUMPS = ("Canonical", "UserProvided", "Stored", "Unknown", "Canonical")
_PIDS = ("Own", "UserProvided", "Constant", "Own", "Constant", "Own", "Constant")
_SEEDS = ("Constant", "Parameter", "AccountKey", "StateVariable")
_SEED_SQL = lambda n: f"{{'expr': 's' || (l_partkey % {n + 3}), 'source': {choose_sql(_SEEDS, f'l_suppkey + {n} * l_linenumber')}, 'is_validated': l_partkey % {n + 2} = 0}}"
_DERIV_SQL = f"""deriv_v AS (SELECT {KEY_SQL}, {choose_sql(_BUMPS, 'l_partkey')} AS bump_source, {choose_sql(_PIDS, 'l_suppkey')} AS program_id_source, l_returnflag AS purpose,
  'p' || l_partkey || '-' || l_linenumber AS seed_pattern, ([{_SEED_SQL(0)}, {_SEED_SQL(1)}, {_SEED_SQL(2)}])[1:(CAST(l_quantity AS INTEGER) % 4)] AS seeds FROM lineitem)"""


def derivations(spark, sf):
    seed = lambda n: F.struct(F.concat(F.lit("s"), (C("l_partkey") % (n + 3)).cast("string")).alias("expr"),
                              choose(_SEEDS, C("l_suppkey") + n * C("l_linenumber")).alias("source"), (C("l_partkey") % (n + 2) == 0).alias("is_validated"))
    return lineitem(spark, sf).select(
        *LINE_KEYS, choose(_BUMPS, C("l_partkey")).alias("bump_source"), choose(_PIDS, C("l_suppkey")).alias("program_id_source"), C("l_returnflag").alias("purpose"),
        F.concat(F.lit("p"), C("l_partkey").cast("string"), F.lit("-"), _text("l_linenumber")).alias("seed_pattern"),
        F.slice(F.array(seed(0), seed(1), seed(2)), F.lit(1), _Q() % 4).alias("seeds"))


@query("derivation_checks", with_sql(_DERIV_SQL, "d2 AS (SELECT *, list_transform(seeds, lambda s: s.source) AS seed_sources FROM deriv_v)",
    body=_rules_sql("d2", RF.DERIVATION_RULES, _cols("bump_source", "program_id_source", "seed_sources"), KEY_SQL + ", NULL::VARCHAR AS seed") +
    f""" UNION ALL SELECT {KEY_SQL}, s.expr AS seed, 'UnsanitizedSeed' AS rule_id, 4 AS severity FROM (SELECT {KEY_SQL}, unnest(seeds) AS s FROM deriv_v) WHERE s.source = 'Parameter' AND NOT s.is_validated"""))
def _(spark, sf):
    return FT.check_derivations(derivations(spark, sf), LINE_KEYS)


@query("seed_collisions", with_sql(_DERIV_SQL, body=f"""SELECT {KEY_SQL}, seed_pattern, purpose FROM deriv_v WHERE seed_pattern IN (SELECT seed_pattern FROM deriv_v GROUP BY 1 HAVING COUNT(DISTINCT purpose) > 1)"""))
def _(spark, sf):
    d = derivations(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seed_pattern", "purpose")
    return FT.collisions(d, "seed_pattern", "purpose")


# ---------------------------------------------------------------- privileges
_NAMES = ("set_authority", "unpause", "upgrade", "Resume_ops", "pause", "set_fee")
_TARGETS = (("Authority", 2), ("PauseState", 3), ("ProgramUpgrade", 5))
_PROT = (("MultiSig", 3), ("Timelock", 4), ("Governance", 11), ("SingleSigner", 2), ("None", 17))
_PROT_SQL = "list_filter([" + ", ".join(f"CASE WHEN o_custkey % {m} = 0 THEN {{'kind': '{n}', 'threshold': CAST(o_orderkey % 5 AS INTEGER), 'total': CAST(o_orderkey % 7 AS INTEGER), 'delay_seconds': (o_orderkey % 4) * 86400}} END"
                                        for n, m in _PROT) + "], lambda x: x IS NOT NULL)"
_PRIV_SQL = f"""priv_v AS (SELECT o_orderkey, {choose_sql(_NAMES, 'o_orderkey')} AS name, {some_sql([(n, f'o_orderkey % {m} < 2') for n, m in _TARGETS])} AS can_modify, {_PROT_SQL} AS protections FROM orders)"""


def privileges(spark, sf):
    o = C("o_orderkey")
    prot = F.filter(F.array(*[F.when(C("o_custkey") % m == 0, F.struct(F.lit(n).alias("kind"), (o % 5).cast("int").alias("threshold"), (o % 7).cast("int").alias("total"),
                                                                       ((o % 4) * 86400).alias("delay_seconds"))) for n, m in _PROT]), lambda x: x.isNotNull())
    return V.table(spark, sf, "orders").select("o_orderkey", choose(_NAMES, o).alias("name"), some([(n, o % m < 2) for n, m in _TARGETS]).alias("can_modify"), prot.alias("protections"))


_has = lambda *k: f"len(list_filter(protections, lambda x: x.kind IN ({', '.join(repr(i) for i in k)}))) > 0"
_mod = lambda m: f"list_contains(can_modify, '{m}')"
_PRIV_RULES = (("InstantAuthorityUpdate", 4, f"{_mod('Authority')} AND NOT {_has('Timelock', 'MultiSig')}"),
               ("SinglePointOfFailure", 3, f"{_mod('Authority')} AND len(protections) = 1 AND {_has('SingleSigner')}"),
               ("UnsafeEmergencyFunction", 3, f"{_mod('PauseState')} AND regexp_matches(lower(name), 'unpause|resume') AND NOT {_has('MultiSig', 'Governance', 'Timelock')}"),
               ("UnprotectedUpgrade", 5, f"{_mod('ProgramUpgrade')} AND len(list_filter(protections, lambda x: (x.kind = 'MultiSig' AND x.threshold >= 3 AND x.total >= 5) OR x.kind = 'Governance' OR (x.kind = 'Timelock' AND x.delay_seconds >= 172800))) = 0"),
               ("ZeroAuthorityPossible", 3, _mod("Authority")), ("UnconstrainedTransfer", 4, f"{_mod('Authority')} AND (len(protections) = 0 OR {_has('None')})"))


@query("privilege_checks", with_sql(_PRIV_SQL, body=" UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS rule_id, {s} AS severity FROM priv_v WHERE {w}" for n, s, w in _PRIV_RULES)))
def _(spark, sf):
    return FT.check_privileges(privileges(spark, sf), ["o_orderkey"])


# ---------------------------------------------------------------- accounts
_TYPES = ("StateAccount", "TokenAccount", "Program")
_ASRC = ("InstructionContext", "RemainingAccounts", "Stored")
_OPS = (("Read", 2), ("Write", 3), ("TransferLamports", 5), ("TokenTransfer", 7))
_CHK = (("OwnerCheck", 3), ("DiscriminatorCheck", 4), ("IsSignerCheck", 5), ("IsInitializedCheck", 6), ("IsWritableCheck", 7))
_CONS = ("owner = x", "Account<'info, T>", "Signer<'info>", "mut", "seeds")
_ACC_SQL = (f"""acc_v AS (SELECT {KEY_SQL}, 'a' || l_partkey AS name, {choose_sql(_TYPES, 'l_suppkey')} AS type, {choose_sql(_ASRC, 'l_linenumber')} AS source,
  {some_sql([(n, f'CAST(l_quantity AS INTEGER) % {m} = 0') for n, m in _OPS])} AS operations, {some_sql([(n, f'l_suppkey % {m} = 0') for n, m in _CHK])} AS validations FROM lineitem)""",
    f"""con_v AS (SELECT 'a' || p_partkey AS name, {choose_sql(_CONS, 'p_size')} AS c FROM part)""",
    """con_f AS (SELECT name, bool_or(contains(c, 'owner')) AS o, bool_or(contains(c, 'Account<')) AS t, bool_or(contains(c, 'Signer')) AS s, bool_or(contains(c, 'mut')) AS m FROM con_v GROUP BY 1)""",
    "acc AS (SELECT a.*, coalesce(o, false) AS o, coalesce(t, false) AS t, coalesce(s, false) AS s, coalesce(m, false) AS m FROM acc_v a LEFT JOIN con_f USING (name))")
_op = lambda o: f"list_contains(operations, '{o}')"
_ok = lambda o: f"list_contains(validations, '{o}')"
_ACC_RULES = (("MissingOwnerCheck", 5, f"type = 'StateAccount' AND NOT {_ok('OwnerCheck')} AND NOT o"),
              ("MissingDiscriminatorCheck", 4, f"{_op('Read')} AND NOT {_ok('DiscriminatorCheck')} AND NOT t AND source <> 'InstructionContext'"),
              ("MissingSignerCheck", 5, f"({_op('TransferLamports')} OR {_op('TokenTransfer')}) AND NOT {_ok('IsSignerCheck')} AND NOT s"),
              ("MissingInitializationCheck", 4, f"{_op('Read')} AND NOT {_ok('IsInitializedCheck')} AND source = 'RemainingAccounts'"),
              ("UncheckedRemainingAccounts", 4, "source = 'RemainingAccounts' AND len(validations) = 0"),
              ("MissingWritableCheck", 3, f"{_op('Write')} AND NOT {_ok('IsWritableCheck')} AND NOT m AND source = 'RemainingAccounts'"))


@query("account_checks", with_sql(*_ACC_SQL, body=" UNION ALL ".join(f"SELECT {KEY_SQL}, '{n}' AS rule_id, {s} AS severity FROM acc WHERE {w}" for n, s, w in _ACC_RULES)))
def _(spark, sf):
    acc = lineitem(spark, sf).select(*LINE_KEYS, F.concat(F.lit("a"), _text("l_partkey")).alias("name"), choose(_TYPES, C("l_suppkey")).alias("type"),
                                     choose(_ASRC, C("l_linenumber")).alias("source"), some([(n, _Q() % m == 0) for n, m in _OPS]).alias("operations"),
                                     some([(n, C("l_suppkey") % m == 0) for n, m in _CHK]).alias("validations"))
    con = V.table(spark, sf, "part").select(F.concat(F.lit("a"), _text("p_partkey")).alias("name"), choose(_CONS, C("p_size")).alias("constraint"))
    return FT.check_accounts(acc, con, LINE_KEYS)


# ---------------------------------------------------------------- pricing
_PSRC, _FORM, _SLIP = ("SpotReserves", "TWAP", "Oracle"), ("ProRata", "Virtual", "Fixed", "Curve"), ("None", "None", "MinOut")


@query("pricing_checks", with_sql(f"""pr AS (SELECT l_suppkey AS program, {V.LINE_ID_SQL} AS id, {choose_sql(_PSRC, 'l_partkey')} AS source, {choose_sql(_FORM, 'l_partkey')} AS form, l_linenumber % 3 = 0 AS prot,
  {choose_sql(_SLIP, 'l_suppkey')} AS slip, l_returnflag AS f FROM lineitem)""", body="""SELECT program, id, 'SpotPriceForCriticalDecision' AS rule_id, 5 AS severity FROM pr WHERE f = 'R' AND source = 'SpotReserves'
UNION ALL SELECT program, id, 'FirstDepositInflation', 5 FROM pr WHERE f = 'A' AND NOT prot UNION ALL SELECT program, id, 'DonationVulnerable', 3 FROM pr WHERE f = 'A' AND form = 'ProRata'
UNION ALL SELECT DISTINCT program, NULL, 'NoSlippageProtection', 4 FROM pr WHERE f = 'A' AND program NOT IN (SELECT program FROM pr WHERE f = 'N' AND slip <> 'None')"""))
def _(spark, sf):
    l = lineitem(spark, sf)
    base = [C("l_suppkey").alias("program"), V.line_id().alias("id")]
    reads = l.where("l_returnflag = 'R'").select(*base, choose(_PSRC, C("l_partkey")).alias("source"))
    calcs = l.where("l_returnflag = 'A'").select(*base, choose(_FORM, C("l_partkey")).alias("formula_type"), (C("l_linenumber") % 3 == 0).alias("has_first_deposit_protection"))
    checks = l.where("l_returnflag = 'N'").select(*base, choose(_SLIP, C("l_suppkey")).alias("check_type"))
    return FT.check_pricing(reads, calcs, checks, "program")


# ---------------------------------------------------------------- execution logs
_RUNS_SQL = """runs_v AS (SELECT event_id AS run_id, list_transform(range(0, CAST(1 + user_id % 4 AS BIGINT)), lambda i: {'is_signer': (event_id + i) % 3 = 0, 'owner': 'o' || ((user_id + i * (event_id % 2)) % 5)}) AS accounts,
  list_transform(range(0, CAST(event_id % 3 AS BIGINT)), lambda i: {'function': 'f' || ((user_id + i) % 20), 'had': (event_id + i) % 2 = 0}) AS changes FROM events),
bad AS (SELECT 'f' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey % 2 = 0)"""


@query("run_log_checks", with_sql(_RUNS_SQL, "ch AS (SELECT run_id, generate_subscripts(changes, 1) AS i, unnest(changes).function AS fn FROM runs_v)", body="""
SELECT run_id, 'MissingSignerCheck' AS rule_id, 5 AS severity, list_filter(changes, lambda c: NOT c.had)[1].function AS function FROM runs_v
  WHERE len(list_filter(accounts, lambda a: a.is_signer)) = 0 AND len(list_filter(changes, lambda c: NOT c.had)) > 0
UNION ALL SELECT run_id, 'MissingOwnerCheck', 4, changes[1].function FROM runs_v WHERE len(list_distinct(list_transform(accounts, lambda a: a.owner))) > 1 AND len(changes) > 0
UNION ALL SELECT run_id, 'ArbitraryAccountSubstitution', 4, changes[1].function FROM runs_v WHERE len(changes) > 0
UNION ALL SELECT run_id, 'UnauthorizedStateChange', 5, arg_min(fn, i) FROM ch WHERE fn IN (SELECT name FROM bad) GROUP BY run_id"""))
def _(spark, sf):
    e = V.table(spark, sf, "events")
    n, u = C("event_id"), C("user_id")
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    runs = e.select(n.alias("run_id"), F.transform(upto(1 + u % 4), lambda i: F.struct(((n + i) % 3 == 0).alias("is_signer"), F.concat(F.lit("o"), ((u + i * (n % 2)) % 5).cast("string")).alias("owner"))).alias("accounts"),
                    F.transform(upto(n % 3), lambda i: F.struct(F.concat(F.lit("f"), ((u + i) % 20).cast("string")).alias("function"), ((n + i) % 2 == 0).alias("had_signer_check"))).alias("changes"))
    s = V.table(spark, sf, "supplier")
    fns = s.select(F.concat(F.lit("f"), _text("s_suppkey")).alias("name"), (C("s_suppkey") % 3 != 0).alias("modifies"), (C("s_nationkey") % 2 != 0).alias("has_signer_check"))
    return FT.check_runs(runs, fns)


# ---------------------------------------------------------------- fields
_FIELD_KEYS = ["doc_id", "line_no", "struct_name", "pos"]
_FK_SQL = "doc_id, CAST(line_no AS INTEGER) AS line_no, struct_name, pos"
_frules = lambda view, rules, cols: " UNION ALL ".join(f"SELECT {_FK_SQL}, '{r.id}' AS rule_id, '{r.category}' AS category, {r.severity} AS severity, '{r.cwe}' AS cwe FROM {view} WHERE {r.when.sql(cols)}" for r in rules)


@query("field_rules", with_sql(*UNITS_SQL, FIELDS_SQL, body=_frules("fields", RF.FIELD_RULES, _cols("field_name", "field_type", "attrs"))))
def _(spark, sf):
    return FT.scan_fields(fields(spark, sf), _FIELD_KEYS)


@query("constraint_rules", with_sql(*UNITS_SQL, FIELDS_SQL, "f2 AS (SELECT f.*, u.code AS siblings FROM fields f JOIN units u ON u.doc_id = f.doc_id AND u.line_no = f.line_no AND u.unit_kind = 'struct')",
    body=_frules("f2", RF.CONSTRAINT_RULES, _cols("field_name", "field_type", "attrs", "siblings"))))
def _(spark, sf):
    from auditloom.operators import source as S
    units = S.segment_units(V.code(spark, sf), "content", ["doc_id"]).withColumn("siblings", C("code"))
    return FT.scan_constraints(S.struct_fields(units, ["doc_id", "line_no", "siblings"]), _FIELD_KEYS)


@query("transfer_hook_rules", with_sql(V.CODE_SQL, "h AS (SELECT doc_id, replace(content, 'mint_to', 'transfer_hook mint_to') AS content FROM code_v)", body=" UNION ALL ".join(
    f"SELECT doc_id, '{r.id}' AS rule_id, '{r.category}' AS category, {r.severity} AS severity FROM h WHERE {r.when.sql('content')}" for r in RF.HOOK_RULES)))
def _(spark, sf):
    h = V.code(spark, sf).withColumn("content", F.replace("content", F.lit("mint_to"), F.lit("transfer_hook mint_to")))
    return FT.scan_hooks(h, "content", ["doc_id"])


# ---------------------------------------------------------------- ordered checks and pairs
_REQ = (("Signer", 2), ("Owner", 3), ("Derivation", 5), ("Authority", 7))
_CT = ("Signer", "Owner", "Derivation", "Authority")
_OPS_SQL = (f"ops AS (SELECT o_orderkey AS op_id, CAST(2 + o_custkey % 5 AS INTEGER) AS line, {some_sql([(n, f'o_orderkey % {m} = 0') for n, m in _REQ])} AS required FROM orders)",
            f"chk AS (SELECT l_orderkey AS op_id, {choose_sql(_CT, 'l_suppkey')} AS type, l_linenumber AS line FROM lineitem)")


def ops_checks(spark, sf):
    ops = V.table(spark, sf, "orders").select(C("o_orderkey").alias("op_id"), (2 + C("o_custkey") % 5).cast("int").alias("line"), some([(n, C("o_orderkey") % m == 0) for n, m in _REQ]).alias("required"))
    return ops, lineitem(spark, sf).select(C("l_orderkey").alias("op_id"), choose(_CT, C("l_suppkey")).alias("type"), C("l_linenumber").alias("line"))


@query("missing_checks", with_sql(*_OPS_SQL, body="""SELECT op_id, line, required FROM (SELECT op_id, line, unnest(required) AS required FROM ops) r
 WHERE NOT EXISTS (SELECT 1 FROM chk c WHERE c.op_id = r.op_id AND c.type = r.required AND c.line < r.line)"""))
def _(spark, sf):
    return FT.missing_checks(*ops_checks(spark, sf))[0]


@query("late_checks", with_sql(*_OPS_SQL, body="SELECT c.op_id, c.type, c.line, o.line AS op_line FROM chk c JOIN ops o ON o.op_id = c.op_id WHERE c.line >= o.line"))
def _(spark, sf):
    return FT.missing_checks(*ops_checks(spark, sf))[1]


_FN = ("from", "to", "token_a", "token_b", "user_1", "user_2", "pool", "vault", "mint", "clock", "source", "dest_acc", "Deposit", "withdraw_1")
_PAIR_SQL = f"""pf AS (SELECT l_orderkey AS struct_id, l_linenumber * 100000 + l_partkey AS pos, {choose_sql(_FN, 'l_partkey')} AS name,
  CASE WHEN l_suppkey % 4 = 0 THEN 'mut, constraint = from.key() != to.key()' WHEN l_suppkey % 5 = 0 THEN '' ELSE 'mut' END AS attrs,
  CASE WHEN l_suppkey % 6 = 0 THEN 'Signer' ELSE 'Account<T>' END AS ty FROM lineitem),
mutf AS (SELECT *, lower(name) AS ln, regexp_replace(lower(name), '[ab\\p{{N}}_]+$', '') AS stem FROM pf WHERE contains(attrs, 'mut') AND contains(ty, 'Account<')),
st AS (SELECT DISTINCT struct_id FROM pf WHERE contains(attrs, '!='))"""
_REL_SQL = " OR ".join(f"(contains(a.ln, '{x}') AND contains(b.ln, '{y}')) OR (contains(a.ln, '{y}') AND contains(b.ln, '{x}'))" for x, y in FT.RELATED_WORDS)


@query("related_account_pairs", with_sql(_PAIR_SQL, body=f"""SELECT DISTINCT a.struct_id, a.pos AS pos_a, a.name AS name_a, b.pos AS pos_b, b.name AS name_b
FROM mutf a JOIN mutf b ON a.struct_id = b.struct_id AND a.pos < b.pos WHERE ({_REL_SQL} OR (a.stem <> '' AND a.stem = b.stem AND a.ln <> b.ln))
 AND NOT (least(a.name, b.name) = 'from' AND greatest(a.name, b.name) = 'to' AND a.struct_id IN (SELECT struct_id FROM st))"""))
def _(spark, sf):
    return FT.related_pairs(account_fields(spark, sf), ["struct_id"])


@query("related_blocks", with_sql(_PAIR_SQL, body="SELECT struct_id, '=' || stem AS block, 's' AS side, pos, name FROM mutf WHERE stem <> ''" + "".join(
    f" UNION ALL SELECT struct_id, '#{i:02d}', '{side}', pos, name FROM mutf WHERE contains(ln, '{w}')" for i, pair in enumerate(FT.RELATED_WORDS) for w, side in zip(pair, "ab"))))
def _(spark, sf):
    return FT.related_blocks(account_fields(spark, sf), ["struct_id"])


def account_fields(spark, sf):
    return lineitem(spark, sf).select(
        C("l_orderkey").alias("struct_id"), (C("l_linenumber") * 100000 + C("l_partkey")).alias("pos"), choose(_FN, C("l_partkey")).alias("field_name"),
        F.when(C("l_suppkey") % 4 == 0, "mut, constraint = from.key() != to.key()").when(C("l_suppkey") % 5 == 0, "").otherwise("mut").alias("attrs"),
        F.when(C("l_suppkey") % 6 == 0, "Signer").otherwise("Account<T>").alias("field_type"))


# ---------------------------------------------------------------- invariants
_POOL_SQL = """pools_v AS (SELECT l_suppkey AS pool, date_trunc('month', l_shipdate) AS ts, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS x, CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)"""


def pools(spark, sf):
    return lineitem(spark, sf).groupBy(C("l_suppkey").alias("pool"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(
        F.sum(C("l_quantity").cast("long")).alias("reserve_x"), F.sum(F.round(C("l_extendedprice") * 100).cast("long")).alias("reserve_y"), F.count(F.lit(1)).alias("n"))


@query("pool_invariants", with_sql(_POOL_SQL, body="""SELECT pool, ts, x::HUGEINT * y >= coalesce(lag(x::HUGEINT * y) OVER (PARTITION BY pool ORDER BY ts), 0) AS k_not_falling,
 abs(x::HUGEINT * y - (x::HUGEINT * y - (n % 3) * 700)) <= 1000 AS k_within, abs((n % 7)::HUGEINT * x // x - ((n % 7) * (y // x) + (y // x) * (n % 3))::HUGEINT * x // y) <= 1 AS share_proportional FROM pools_v"""))
def _(spark, sf):
    k = IV.wide(C("reserve_x")) * IV.wide(C("reserve_y"))
    per_share = F.expr("reserve_y div reserve_x")
    p = pools(spark, sf).withColumn("expected_k", k - (C("n") % 3) * 700).select(
        "*", C("reserve_x").alias("total_lp"), (C("n") % 7).alias("deposit_x"), ((C("n") % 7) * per_share + per_share * (C("n") % 3)).alias("deposit_y"))
    return IV.check_pool(p, ["pool"], ["ts"], F.year("ts")).select("pool", "ts", "k_not_falling", "k_within", "share_proportional")


@query("vault_invariants", with_sql(_POOL_SQL, body="""SELECT pool, ts, CASE WHEN py IS NULL THEN true ELSE y::HUGEINT * px >= py::HUGEINT * x END AS price_not_falling,
 (n % 5 = 0) OR ((n % 5)::HUGEINT * x // y > 0) AS mints, n % 4 > 0 AS has_dead_shares FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pools_v WINDOW w AS (PARTITION BY pool ORDER BY ts))"""))
def _(spark, sf):
    v = pools(spark, sf).select("pool", "ts", C("reserve_y").alias("total_assets"), C("reserve_x").alias("total_shares"), (C("n") % 5).alias("deposit"), (C("n") % 4).alias("dead_shares"))
    return IV.check_vault(v, ["pool"], ["ts"], F.year("ts")).select("pool", "ts", "price_not_falling", "mints", "has_dead_shares")


@query("lending_invariants", """SELECT o_orderkey, d >= b AS solvent, b = 0 OR c * 10000 // nullif(b, 0) >= 10000 AS collateral_ok, b = 0 OR c * t // nullif(b * 100, 0) >= 100 AS healthy FROM (
 SELECT o_orderkey, CAST(round(o_totalprice * 100) AS HUGEINT) AS d, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS HUGEINT) * (o_custkey % 13) // 10 END AS b,
 CAST(round(o_totalprice * 100) AS HUGEINT) * (o_orderkey % 17) // 10 AS c, 7000 + (o_orderkey % 3) * 1000 AS t FROM orders)""")
def _(spark, sf):
    d = F.round(C("o_totalprice") * 100).cast("long")
    o = V.table(spark, sf, "orders").select("o_orderkey", d.alias("total_deposits"), F.when(C("o_custkey") % 9 == 0, 0).otherwise(F.floor(d * (C("o_custkey") % 13) / 10)).cast("long").alias("total_borrows"),
                                            F.floor(d * (C("o_orderkey") % 17) / 10).cast("long").alias("total_collateral"), (7000 + (C("o_orderkey") % 3) * 1000).alias("liquidation_threshold_bps"))
    return IV.check_lending(o).select("o_orderkey", "solvent", "collateral_ok", "healthy")


@query("staking_invariants", """SELECT o_orderkey AS pool, coalesce(s, 0) = coalesce(s, 0) + (o_custkey % 4 = 0)::INT AS conserved, CAST(round(o_totalprice) AS BIGINT) <= greatest(0, o_custkey % 1000 - 100) * 500 AS rewards_bounded
 FROM orders LEFT JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, sf):
    users = lineitem(spark, sf).select(C("l_orderkey").alias("pool"), C("l_quantity").cast("long").alias("amount"))
    true_total = users.groupBy("pool").agg(F.sum("amount").alias("t"))
    totals = V.table(spark, sf, "orders").select(C("o_orderkey").alias("pool"), "o_custkey", "o_totalprice").join(true_total, "pool", "left").select(
        "pool", (F.coalesce("t", F.lit(0)) + (C("o_custkey") % 4 == 0).cast("int")).alias("total_staked"), F.round("o_totalprice").cast("long").alias("total_rewards"),
        F.lit(500).alias("reward_rate"), F.lit(100).cast("long").alias("last_update"), (C("o_custkey") % 1000).alias("now"))
    return IV.check_staking(users, totals)


@query("fee_bounds", """SELECT l_suppkey, CASE WHEN bool_or(fee * 10000 > amount * bps) THEN 'Violated' ELSE 'Proven' END AS status, COUNT(*) FILTER (WHERE fee * 10000 > amount * bps) AS violations FROM (
 SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(round(l_tax * 10000) AS BIGINT) AS bps, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 130 AS fee FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    amount = F.round(C("l_extendedprice") * 100).cast("long")
    f = lineitem(spark, sf).select("l_suppkey", amount.alias("amount"), F.round(C("l_tax") * 10000).cast("long").alias("bps"), F.expr(
        "cast(round(l_extendedprice * 100) as bigint) * cast(round(l_discount * 100) as bigint) div 130").alias("fee"))
    return IV.overall(IV.check_fees(f), ["l_suppkey"], ["fee_ok"])
