"""Operator inputs derived from the driver tables, in Spark and in SQL.

Every view is a narrow projection or a partial-aggregable aggregate of whole tables, so the work
of a query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditloom.rules.formula import quote
from auditloom.sources.tables import read_table


def table(spark: SparkSession, sf: str, name: str, spread_by: list[str] | None = None) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", spread_by)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for CPU-heavy text work."""
    return table(spark, sf, "documents", ["doc_id"])


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Line items for CPU-heavy row work."""
    return table(spark, sf, "lineitem", LINE_KEYS)


# ---------------------------------------------------------------- text
#: Source lines a document line is mapped to, by (length + position) modulo their number.
LISTING: tuple[str, ...] = (
    "pub fn deposit(ctx: Context<Deposit>, amount: u64) -> Result<()> {",
    "    let total = vault.balance + amount;",
    "    invoke(&ix, &[source.clone(), dest.clone()])?;",
    "    ctx.accounts.vault.balance = total;",
    "    Ok(())",
    "}",
    "#[derive(Accounts)]",
    "pub struct Deposit<'info> {",
    "    pub authority: AccountInfo<'info>,",
    "    #[account(mut, seeds = [b\"vault\"])]",
    "    pub vault: Account<'info, Vault>,",
    "    #[account(mut)]",
    "    pub token_a: Account<'info, TokenAccount>,",
    "    #[account(mut)]",
    "    pub token_b: Account<'info, TokenAccount>,",
    "    // SAFETY: pointer checked by the caller",
    "    unsafe { invoke(&ix, raw) }",
    "pub fn withdraw(ctx: Context<Withdraw>, amount: u64) -> Result<()> {",
    "    require_keys_eq!(program.key(), expected_program::ID);",
    "    let fee = amount / rate * price;",
    "    for acc in ctx.remaining_accounts.iter() {",
    "    require!(acc.owner == program_id, Bad);",
    "    **from.lamports.borrow_mut() = 0;",
    "    let mut data = acc.data.borrow_mut(); data.fill(0);",
    "    token::transfer(cpi, amount)?;",
    "pub struct Withdraw<'info> {",
    "    pub owner: Signer<'info>,",
    "    /// CHECK: compared with the stored key",
    "    pub treasury: UncheckedAccount<'info>,",
    "    #[account(mut, has_one = owner, close = owner)]",
    "    pub user_state: Account<'info, State>,",
    "unsafe fn read_raw(p: *const u8) -> u64 {",
    "    let v = ptr::read_volatile(p.offset(4)) as u64;",
    "    let q = p.add(8).as_ptr(); // step",
    "    std::mem::transmute::<u64, f64>(v)",
    "fn swap(pool: &mut Pool, amount: u64, shares: u64) -> u64 {",
    "    let k = pool.x * pool.y;",
    "    let out = amount.checked_mul(shares).unwrap();",
    "    return deposit(ctx, out);",
    "    let price = oracle.get_price(&price_feed)?;",
    "    msg!(\"swapped\");",
    "pub fn initialize(ctx: Context<Init>) -> Result<()> {",
    "    let acc = Vault::try_from_slice(&info.try_borrow_data()?)?;",
    "    mint_to(cpi, amount)?;",
    "    let reward = stake * duration / supply;",
    "    set_authority(ctx.accounts.authority.key());",
    "    let cpi = CpiContext::new(program.account_info(), accs);",
    "",
    "    let x = a << 2 % m;",
    "#[account(init, payer = owner, space = 8)]",
    "    let (pda, bump) = Pubkey::find_program_address(&[user.key().as_ref()], program_id);",
    "/* flash_loan callback without reentrancy guard */",
    "    flash_loan(callback, amount)?;",
    "    execute_proposal(governance)?;",
    "    let addr = Pubkey::from_str(\"admin\").unwrap();",
    "    withdraw(ctx, initialize(ctx));",
    "    let t = Clock::get()?.unix_timestamp + lock;",
    "#[cfg(test)]",
    "#[test]",
    "pub async fn settle(ctx: Context<Withdraw>) -> Result<()> {",
    "pub(crate) const fn limit() -> u64 {",
)


def lines_sql(col: str) -> str:
    return (f"CASE WHEN {col} = '' THEN CAST([] AS VARCHAR[]) ELSE "
            f"string_split(regexp_replace({col}, '\\r?\\n$', ''), chr(10)) END")


_LISTING_SQL = "[" + ", ".join(quote(x) for x in LISTING) + "]"

CODE_SQL = f"""code_v AS (
  SELECT doc_id, source AS repo, 'doc/' || doc_id || '.rs' AS path,
         array_to_string(list_transform(string_split(text, chr(10)),
            lambda l, i: ({_LISTING_SQL})[((length(l) + i) % {len(LISTING)}) + 1]), chr(10)) AS content
  FROM documents)"""

LINES_SQL = f"""code_lines AS (
  SELECT doc_id, repo, path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS text
  FROM (SELECT doc_id, repo, path, {lines_sql('content')} AS ls FROM code_v))"""


def code(spark: SparkSession, sf: str) -> DataFrame:
    """Source listings derived line by line from ``documents`` (repo, path, content)."""
    n = len(LISTING)
    listing = F.array(*[F.lit(x) for x in LISTING])
    pick = lambda l, i: F.element_at(listing, F.pmod(F.length(l) + i + 1, F.lit(n)) + 1)
    return documents(spark, sf).select(
        "doc_id", F.col("source").alias("repo"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("path"),
        F.array_join(F.transform(F.split("text", "\n"), pick), "\n").alias("content"))


MANIFEST_SQL = """manifest_v AS (
  SELECT doc_id, source AS repo, 'm/' || doc_id || '/Cargo.toml' AS path,
         '[dependencies]' || chr(10) || 'anchor-lang = "0.' || (n_chars % 30) || '.' || (doc_id % 3) || '"' || chr(10) ||
         CASE WHEN doc_id % 2 = 0 THEN '[profile.release]' || chr(10) || 'overflow-checks = true' || chr(10) ELSE '' END AS content
  FROM documents)"""


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    s = lambda c: F.col(c).cast("string")
    return d.select(
        "doc_id", F.col("source").alias("repo"), F.concat(F.lit("m/"), s("doc_id"), F.lit("/Cargo.toml")).alias("path"),
        F.concat(F.lit('[dependencies]\nanchor-lang = "0.'), F.pmod("n_chars", F.lit(30)).cast("string"), F.lit("."),
                 F.pmod("doc_id", F.lit(3)).cast("string"), F.lit('"\n'),
                 F.when(F.col("doc_id") % 2 == 0, "[profile.release]\noverflow-checks = true\n").otherwise("")).alias("content"))


# ---------------------------------------------------------------- findings
ENGINES = ("SOL", "SEC3", "KANI", "GEI", "L3X")
CATEGORIES = {"click": "Authentication", "view": "Arithmetic", "error": "Price Oracle", "signup": "PDA Security",
              "purchase": "Account Validation"}
TYPES = ("Missing Signer Validation", "Integer Overflow/Underflow", "Missing Owner Check", "Arbitrary CPI",
         "Oracle Manipulation", "Missing Pause Mechanism", "Missing Event Emission")

_list = lambda xs: "[" + ", ".join(quote(x) for x in xs) + "]"
FINDINGS_SQL = f"""findings_v AS (
  SELECT CASE WHEN engine = 'KANI' THEN 'KANI-FN' || (k % 20) ELSE engine || '-' || event_id END AS finding_id, *,
         CASE WHEN k % 10 = 0 THEN 'proof_fn' || (user_id % 20) ELSE 'fn' || (user_id % 20) END AS instruction,
         k AS line_number
  FROM (SELECT event_id AS seq, event_id, user_id, ts, CAST(user_id AS VARCHAR) AS program,
               ({_list(ENGINES)})[event_id % 5 + 1] AS engine,
               CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items())} END AS category,
               CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) AS k,
               ({_list(TYPES)})[CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) % 7 + 1] AS vuln_type,
               CAST(1 + (event_id // 5) % 5 AS INTEGER) AS severity,
               CAST(least(99, floor(value)) AS INTEGER) AS confidence,
               CAST(round(value * 100) AS BIGINT) * 100 AS risk
        FROM events))"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in the common schema derived from ``events``."""
    e = table(spark, sf, "events")
    cats = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    base = e.select(
        F.col("event_id").alias("seq"), "event_id", "user_id", "ts", F.col("user_id").cast("string").alias("program"),
        pick(ENGINES, F.col("event_id") % 5).alias("engine"), cats[F.col("event_type")].alias("category"), k.alias("k"),
        pick(TYPES, k % 7).alias("vuln_type"),
        (1 + F.floor(F.col("event_id") / 5) % 5).cast("int").alias("severity"),
        F.least(F.lit(99), F.floor("value")).cast("int").alias("confidence"),
        (F.round(F.col("value") * 100).cast("long") * 100).alias("risk"))
    user = (F.col("user_id") % 20).cast("string")
    return base.select(
        F.when(F.col("engine") == "KANI", F.concat(F.lit("KANI-FN"), (F.col("k") % 20).cast("string")))
        .otherwise(F.concat("engine", F.lit("-"), F.col("event_id").cast("string"))).alias("finding_id"), "*",
        F.concat(F.when(F.col("k") % 10 == 0, "proof_fn").otherwise("fn"), user).alias("instruction"),
        F.col("k").alias("line_number"))


REPORTS_SQL = """reports_v AS (
  SELECT program, strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS total,
         COUNT(*) FILTER (WHERE severity = 5) AS critical_count, COUNT(*) FILTER (WHERE severity = 4) AS high_count,
         COUNT(*) FILTER (WHERE severity = 3) AS medium_count, COUNT(*) FILTER (WHERE severity = 2) AS low_count
  FROM findings_v GROUP BY ALL)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).groupBy("program", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == n).alias(f"{name}_count")
          for n, name in ((5, "critical"), (4, "high"), (3, "medium"), (2, "low"))])


# ---------------------------------------------------------------- votes
VOTES_SQL = """votes_v AS (
  SELECT CAST(conv_id AS VARCHAR) AS finding_id, turn, role AS model,
         (['Confirmed', 'Rejected', 'Uncertain'])[length(text) % 3 + 1] AS verdict,
         CAST(length(text) % 100 AS INTEGER) AS conf_pct FROM conversations)"""


def votes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("finding_id"), "turn", F.col("role").alias("model"),
        F.element_at(F.array(F.lit("Confirmed"), F.lit("Rejected"), F.lit("Uncertain")), n % 3 + 1).alias("verdict"),
        (n % 100).cast("int").alias("conf_pct"))


# ---------------------------------------------------------------- line items as facts
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def line_id() -> Column:
    """Identity of a line item: its keys and its price in cents."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in LINE_KEYS], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))


LINE_ID_SQL = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT)"


def choose(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def choose_sql(values: tuple[str, ...], n: str) -> str:
    return f"({_list(values)})[({n}) % {len(values)} + 1]"


def some(parts: list[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds."""
    return F.filter(F.array(*[F.when(c, F.lit(v)) for v, c in parts]), lambda x: x.isNotNull())


def some_sql(parts: list[tuple[str, str]]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN '{v}' END" for v, c in parts)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


# ---------------------------------------------------------------- edges
EDGES_SQL = """edges_v AS (
  SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
  UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
SEEDS_SQL = "seeds_v AS (SELECT c_mktsegment AS label, 'c' || c_custkey AS node FROM customer)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges, some repeatedly: paths and reachability are the same, and a shuffle of all edges is saved."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, l, s = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier"))
    return (o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
            .unionByName(l.select(name("o", "l_orderkey").alias("src"), name("s", "l_suppkey").alias("dst")))
            .unionByName(s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))))


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("label"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


# ---------------------------------------------------------------- control flow
CFG_SQL = """cfg_nodes AS (SELECT DISTINCT l_orderkey AS func, l_linenumber AS node FROM lineitem),
cfg_edges AS (
  SELECT DISTINCT a.func, a.node AS src, b.node AS dst FROM cfg_nodes a JOIN cfg_nodes b ON a.func = b.func
  WHERE b.node - a.node IN (1, 2, 3) OR (a.node >= 5 AND b.node = 1)),
cfg_defs AS (SELECT DISTINCT l_orderkey AS func, l_linenumber AS node, (['x', 'y', 'z'])[l_partkey % 3 + 1] AS var FROM lineitem),
cfg_uses AS (SELECT DISTINCT l_orderkey AS func, l_linenumber AS node, (['x', 'y', 'z'])[l_suppkey % 3 + 1] AS var FROM lineitem)"""


def cfg(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Nodes, edges, definitions and uses; one flow graph per order, at most seven nodes each."""
    l = table(spark, sf, "lineitem")
    at = [F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("node")]
    nodes = l.select(*at).distinct()
    var = lambda c: choose(("x", "y", "z"), F.col(c)).alias("var")
    # A function's few nodes are one array, from which its edges come without a join.
    def ahead(n):
        last = F.when(n >= 5, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
        there = F.filter(F.concat(F.array(n + 1, n + 2, n + 3), last), lambda d: F.array_contains("nodes", d))
        return F.transform(there, lambda d: F.struct(n.alias("src"), d.alias("dst")))

    edge = l.groupBy(F.col("l_orderkey").alias("func")).agg(F.collect_set("l_linenumber").alias("nodes")).where("func is not null").select(
        "func", F.inline(F.flatten(F.transform("nodes", ahead))))
    return {"nodes": nodes, "edges": edge, "defs": l.select(*at, var("l_partkey")).distinct(),
            "uses": l.select(*at, var("l_suppkey")).distinct()}


# ---------------------------------------------------------------- series
TICKS_SQL = """ticks_v AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS key, ts, CAST(round(value * 100) AS BIGINT) AS cents,
         event_type = 'error' AS failed, event_type = 'signup' AS is_new, event_type FROM events)"""


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return tick_columns(table(spark, sf, "events"))


def tick_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"),
        (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "signup").alias("is_new"), "event_type")


SAMPLES_SQL = """samples_v AS (
  SELECT 'v' || (user_id % 4) AS validator, date_trunc('hour', ts) AS ts, COUNT(*) * 1000 AS num_transactions,
         COUNT(DISTINCT user_id) AS num_slots, COUNT(*) FILTER (WHERE event_type <> 'view') * 200 AS num_non_vote_transactions,
         3600 AS sample_period_secs
  FROM events GROUP BY 1, 2)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly performance samples of four validators."""
    e = table(spark, sf, "events")
    return e.groupBy(F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("validator"),
                     F.date_trunc("hour", "ts").alias("ts")).agg(
        (F.count(F.lit(1)) * 1000).alias("num_transactions"), F.countDistinct("user_id").alias("num_slots"),
        (F.count_if(F.col("event_type") != "view") * 200).alias("num_non_vote_transactions"),
        F.lit(3600).alias("sample_period_secs"))


def with_sql(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
