from pyspark.sql import functions as F
import pytest

from auditloom.functions.text import strip_comments
from auditloom.operators import scan, source as S
from auditloom.rules import contract, lines as L
from auditloom.rules.formula import AtLeast, Count, Has, Matches, SomeLine

SIGNER_TYPED = """
pub struct Update<'info> {
    pub authority: Signer<'info>,
}
pub fn update(ctx: Context<Update>) -> Result<()> {
    Ok(())
}
"""
RAW_AUTHORITY = """
#[derive(Accounts)]
pub struct Update<'info> {
    pub authority: AccountInfo<'info>,
}
pub fn update(ctx: Context<Update>) -> Result<()> {
    Ok(())
}
"""
CASES = [
    ("typed signer", SIGNER_TYPED, "SOL-001", False),
    ("raw authority", RAW_AUTHORITY, "SOL-001", True),
    ("is_signer", "pub fn f(authority: AccountInfo<'info>) { if !authority.is_signer { return; } }", "SOL-001", False),
    ("checked math", "pub fn f(amount: u64) { let x = amount.checked_add(1).unwrap() + 0; }", "SOL-002", False),
    ("saturating math", "pub fn f(balance: u64) { balance.saturating_sub(1); let y = 1 - 1; }", "SOL-002", False),
    ("unchecked balance", "pub fn f(amount: u64) {\n  vault.balance = vault.balance + amount;\n}", "SOL-002", True),
    ("owner validated", "pub fn f(a: AccountInfo<'info>) { a.try_borrow_data(); require!(a.owner == id); }", "SOL-003", False),
    ("owner missing", "pub fn f(a: AccountInfo<'info>) { let d = a.try_borrow_data(); }", "SOL-003", True),
    ("seeds and bump", "pub fn f() { #[account(seeds = [b\"v\", user.key().as_ref()], bump)] }", "SOL-007", False),
    ("user seed", "pub fn f() { #[account(seeds = [b\"v\", user.key().as_ref()], bump)] escrow }", "SOL-008", False),
    ("program id", "pub fn f(p: Program<'info, Token>) { invoke(&ix, &accs); }", "SOL-005", False),
    ("raw call", "pub fn f() { invoke(&ix, &accs); }", "SOL-005", True),
    ("staleness", "pub fn f() { let p = price_feed.get(); require!(now - p.timestamp < 60); }", "SOL-020", False),
    ("stale", "pub fn f() { let p = price_feed.get(); }", "SOL-020", True),
    ("test code", "pub fn f() { #[test] invoke(&ix, &accs); }", "SOL-005", False),
    ("division first", "pub fn f(amount: u64) {\n  let x = amount / 3 * fee;\n}", "SOL-037", True),
    ("multiplication first", "pub fn f(amount: u64) {\n  let x = amount * 3 / fee;\n}", "SOL-037", False),
    ("two of eight", "pub fn f(ctx: Context<A>) { swap(); deposit(); }", "SOL-042", False),
    ("three of eight", "pub fn f(ctx: Context<A>) { swap(); deposit(); vault(); }", "SOL-042", True),
]


HARMLESS = ["", "pub fn {", "pub fn größe() { let ä = 1; }", "mod a { mod b { mod c { } } }",
            "// authority AccountInfo< invoke( price_feed\n/* transfer u64 amount + 1 */\npub fn f() {}"]


@pytest.fixture(scope="module")
def hits(spark):
    """Findings of all cases in one scan, by case name."""
    rows = [(c[0], c[1]) for c in CASES] + [(f"harmless {i}", t) for i, t in enumerate(HARMLESS)]
    files = spark.createDataFrame(rows, "path string, content string")
    units = S.attach_context(files, "content", ["path"]).withColumn("code", strip_comments(F.col("code")))
    out = {name: [] for name, _ in rows}
    for r in scan.scan_rules(units, contract.UNIT_RULES, "code", ["path"], kind="unit_kind").collect():
        out[r.path].append(r)
    return out


@pytest.mark.parametrize("name,code,rule,fires", CASES, ids=[c[0] for c in CASES])
def test_rule(hits, name, code, rule, fires):
    assert (rule in {r.rule_id for r in hits[name]}) == fires
    assert all(1 <= r.severity <= 5 and r.rule_id for r in hits[name])


@pytest.mark.parametrize("i", range(len(HARMLESS)))
def test_harmless_inputs(hits, i):
    assert hits[f"harmless {i}"] == []


def test_catalogue_is_complete():
    assert [r.id for r in contract.UNIT_RULES] == [f"SOL-{n:03d}" for n in range(1, 53)]


def test_struct_units_need_opening(spark):
    units = spark.createDataFrame([("struct", RAW_AUTHORITY + "fn ")], "unit_kind string, code string")
    closed = scan.scan_rules(units, contract.UNIT_RULES, "code", [], kind="unit_kind")
    opened = scan.scan_rules(units, contract.UNIT_RULES, "code", [], kinds=("struct",), kind="unit_kind")
    assert closed.count() == 0 and opened.count() > 0


def test_result_does_not_depend_on_partitions(spark):
    files = spark.createDataFrame([(f"f{i}", c[1]) for i, c in enumerate(CASES)], "path string, content string")
    run = lambda n: sorted(map(tuple, scan.scan_rules(S.attach_context(files.repartition(n), "content", ["path"]), contract.UNIT_RULES, "code", ["path"]).collect()), key=str)
    assert run(1) == run(7)


@pytest.mark.parametrize("test,text,want", [
    (Count("ab", 2), "abab", True), (Count("ab", 3), "abab", False), (Count("aa", 2), "aaa", False),
    (AtLeast(2, (Has("a"), Has("b"), Has("c"))), "a c", True), (Has("%"), "a_b", False), (Has("."), "a.b", True),
    (SomeLine("x.*y"), "// x y\nx y", True), (SomeLine("x.*y"), "// x y\nx\ny", False), (Matches("(?s)a.*b"), "a\nb", True)])
def test_formula_nodes(spark, test, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(test.column(F.col("t"))).first()[0] is want


@pytest.mark.parametrize("line,rule", [("let p: *const u8 = x;", "PTR-CONST"), ("p as *mut u8", "PTR-MUT"), ("v.as_ptr()", "PTR-AS"),
                                       ("std::ptr::null_mut()", "PTR-NULL"), ("ptr::read_volatile(p)", "PTR-READ"), ("mem::transmute::<A, B>(x)", "CONV-TRANSMUTE"),
                                       ("#[link(name = \"c\")]", "LINK-ATTR"), ("extern \"system\" {", "LINK-SYSTEM"), ("unsafe impl Send for X {}", "UNSAFE-IMPL"),
                                       ("asm!(\"nop\")", "ASM"), ("pub union U { a: u8 }", "UNION")])
def test_unsafe_lines(spark, line, rule):
    df = spark.createDataFrame([(line,)], "text string")
    assert rule in {r.rule_id for r in scan.scan_lines(df, L.UNSAFE_CODE_RULES, "text", []).collect()}


def test_mined_invariants(spark):
    from auditloom.operators.invariants import mine_invariants
    files = spark.createDataFrame([("a", "transfer(from, to); authority u64")], "path string, content string")
    kept, bad = mine_invariants(files, "content", ["path"])
    assert {r.rule_id for r in kept.collect()} == {"BC-transfer"}
    assert {r.rule_id for r in bad.collect()} == {"AC-unsigned?", "AR-unchecked?"}
