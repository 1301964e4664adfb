import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import source as S
from auditloom.rules import lines as L


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def files(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, content string")


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["a", "", "b"]), ("a\r\nb\r\n", ["a", "b"]), ("\n", [""])])
def test_lines(spark, text, want):
    assert one(spark, text, T.lines_of) == want


def test_empty_last_lines_stay(spark):
    body = "fn f() {\n}\n\n\n"
    assert one(spark, body, T.lines_of) == ["fn f() {", "}", "", ""] and one(spark, "\n\n", T.lines_of) == ["", ""]
    assert one(spark, "a\r\n\r\n", T.lines_of) == ["a", ""] and one(spark, "a\n\u2028", T.lines_of) == ["a", "\u2028"]
    d = files(spark, body)
    assert [r.code for r in S.segment_units(d, "content", ["path"]).collect()] == ["fn f() {\n}\n\n"]
    assert [r.code for r in S.attach_context(d, "content", ["path"]).collect()] == ["fn f() {\n}\n\n"]
    assert [r.line_no for r in S.enclosing_fn(d, "content", ["path"]).collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("name,want", [("InitializeVaultAccounts", "initialize_vault"), ("DepositCtx", "deposit"), ("Context", "context"), ("ABC", "a_b_c"), ("Swap", "swap")])
def test_snake_name(spark, name, want):
    assert one(spark, name, T.snake_name) == want


@pytest.mark.parametrize("target,kind,value", [
    ("git@gitlab.com:org/project.git", "git", "https://gitlab.com/org/project.git"),
    ("git@github.com:u/r/", "git", "https://github.com/u/r.git"),
    ("https://github.com/u/r/tree/main", "git", "https://github.com/u/r.git"),
    ("https://github.com/u/r/blob/main/x.rs", "git", "https://github.com/u/r.git"),
    ("https://github.com/u/r/", "git", "https://github.com/u/r.git"),
    ("https://example.com/u/r.git", "git", "https://example.com/u/r.git"),
    ("http://example.com/page", "path", "http://example.com/page"),
    ("A" * 32, "address", "A" * 32), ("b" * 44, "address", "b" * 44), ("b" * 45, "path", "b" * 45), ("a" * 31, "path", "a" * 31),
    ("./my-program", "path", "./my-program"), ("", "path", "")])
def test_targets(spark, target, kind, value):
    k, v = T.classify_target(F.col("t"))
    assert tuple(spark.createDataFrame([(target,)], "t string").select(k, v).first()) == (kind, value)


@pytest.mark.parametrize("text,want", [
    ('ok {"verdict": "confirmed", "confidence": 0.9, "reasoning": "r"} end', ("Confirmed", 0.9, "r", None)),
    ('{"verdict": "REJECTED"}', ("Rejected", 0.5, "No reasoning provided", None)),
    ('{"confidence": 1.0}', ("Uncertain", 1.0, "No reasoning provided", None)),
    ("nothing here", (None, None, None, "no JSON")), ("{broken", (None, None, None, "no JSON")), ("{broken}", (None, None, None, "bad JSON"))])
def test_votes(spark, text, want):
    assert tuple(one(spark, text, T.extract_vote)) == want


def test_severity_round_trip(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 6)], "s int").select("s", T.severity_ordinal(F.lower(T.severity_label(F.col("s")))).alias("b"))
    assert all(r.s == r.b for r in df.collect())
    assert one(spark, "whatever", T.severity_ordinal) == 3


def test_units_and_context(spark):
    code = "use x;\n#[derive(Accounts)]\npub struct A<'info> {\n  a: Signer<'info>,\n}\nimpl B {\n  pub fn go(ctx: Context<'_, A>) {\n    x\n  }\n}\nfn tail() {}"
    f = files(spark, code)
    assert [(u.unit_kind, u.unit_name, u.line_no) for u in S.segment_units(f, "content", []).collect()] == [("struct", "A", 3), ("fn", "go", 7), ("fn", "tail", 11)]
    go, tail = S.attach_context(f, "content", []).collect()
    assert go.context_name == "A" and go.code.startswith("#[derive(Accounts)]\npub struct A") and "pub fn go" in go.code
    assert tail.context_name == "" and tail.code == "fn tail() {}"


def test_enclosing_function(spark):
    f = files(spark, "a\nfn one() {\nb\n}\nfn two() {\nc")
    assert [r.fn_name for r in S.enclosing_fn(f, "content", []).orderBy("line_no").collect()] == ["unknown", "one", "one", "one", "two", "two"]


@pytest.mark.parametrize("trigger,evidence,lo,hi,call,proof", [
    (L.CALL_TRIGGER, L.CALL_EVIDENCE, -10, 4, "invoke(x)", "program::id()"),
    (L.REMAINING_TRIGGER, L.REMAINING_EVIDENCE, -5, 14, "ctx.remaining_accounts", "try_from(a)"),
    (L.CLOSE_TRIGGER, L.CLOSE_EVIDENCE, 0, 9, "**a.lamports.borrow_mut() = 0;", "realloc(0, false)"),
    (L.UNSAFE_BLOCK, L.SAFETY_COMMENT, -3, -1, "unsafe { x }", "// SAFETY: fine")])
def test_window_edges(spark, trigger, evidence, lo, hi, call, proof):
    for off, guarded in ((lo - 1, False), (lo, True), (hi, True), (hi + 1, False)):
        if off == 0:
            continue
        body = ["x"] * 60
        body[30], body[30 + off] = call, proof
        assert (S.scan_guarded(files(spark, "\n".join(body)), "content", [], trigger, evidence, lo, hi).count() == 0) == guarded, off


@pytest.mark.parametrize("body,lines", [
    (["invoke(a)", "x.balance = 1;"], [2]), (["invoke(a)", "return;", "x.balance = 1;"], []), (["invoke(a)", "Ok(())", "set_x()"], []),
    (["x.balance = 1;", "invoke(a)"], []), (["invoke(a)", "set_x()", "set_y()"], [2]), (["invoke(a)", "let y = 1;", "a == b", "data = 2"], [4])])
def test_writes_after_call(spark, body, lines):
    got = S.writes_after_call(files(spark, "\n".join(["fn f() {", *body])), "content", []).collect()
    assert [r.line_no - 1 for r in got] == lines and all(r.fn_name == "f" for r in got)


def test_unsafe_matrix(spark):
    rows = lambda t: [r.severity for r in S.unsafe_severity(files(spark, t), "content", []).collect()]
    assert rows("unsafe { invoke(x) }") == [5]
    assert rows("// SAFETY: ok\nunsafe { invoke(x) }") == [4]
    assert rows("unsafe { x }") == [4]
    assert rows("// SAFETY: ok\nunsafe { x }") == [3]
    assert rows("unsafe fn f() {") == [4] and rows("/// SAFETY: ok\nunsafe fn f() {") == [3]


def test_fields_and_schema(spark):
    code = "pub struct V<'info> {\n    #[account(mut)]\n    pub a: Account<'info, T>,\n    /// CHECK: ok\n    b: AccountInfo<'info>,\n}"
    u = S.segment_units(files(spark, code), "content", [])
    f = S.struct_fields(u, []).collect()
    assert [(r.field_name, r.field_type) for r in f] == [("a", "Account<'info, T>"), ("b", "AccountInfo<'info>")]
    assert "mut" in f[0].attrs and "CHECK" in f[1].attrs
    assert S.struct_schemas(u, []).first()["schema"] == {"a": "Account<'info, T>", "b": "AccountInfo<'info>"}


def test_calls_and_program_id(spark):
    f = files(spark, 'declare_id!("Abc111");\nfn a() {\n b(1);\n println(x);\n}\nfn b() {\n}')
    assert [tuple(r) for r in S.call_edges(S.segment_units(f, "content", ["path"]), ["path"]).collect()] == [("p0", "a", "b")]
    two = spark.createDataFrame([("r", "b", 'declare_id!("B")'), ("r", "a", 'declare_id!( "A" )'), ("q", "c", "x")], "repo string, path string, content string")
    assert [tuple(r) for r in S.program_id(two, "content", ["repo"]).collect()] == [("r", "A")]


def test_manifest(spark):
    f = files(spark, '[dependencies]\nanchor-lang = { version = "0.29.0", features = [] }\n[profile.release]\nlto = true\noverflow-checks = true', '[profile.dev]\noverflow-checks = true')
    a, b = S.manifest_facts(f, "content", ["path"]).orderBy("path").collect()
    assert (a.framework_version, a.overflow_checks) == ("0.29.0", True) and (b.framework_version, b.overflow_checks) == (None, False)


@pytest.mark.parametrize("rows,kind", [([("a/Cargo.toml", "anchor-lang"), ("a/l.rs", "declare_id!(1)")], "AnchorProgram"), ([("l.rs", "entrypoint!(p)")], "NativeSolanaProgram"),
                                       ([("Cargo.toml", "solana-program = 1")], "RustInfrastructure"), ([("Cargo.toml", "anchor-lang\nsolana-program")], "AnchorProgram")])
def test_repo_type(spark, rows, kind):
    df = spark.createDataFrame([("r", *r) for r in rows], "repo string, path string, content string")
    assert S.repo_type(df).first().repo_type == kind


def test_arithmetic(spark):
    l = spark.createDataFrame([(1, "let x = a + b;"), (2, "let x = a.checked_add(b) + c;"), (3, "// a + b"), (4, "x = a / b * c;"), (5, "y as u8")], "line_no int, text string")
    got = {(r.line_no, r.issue, r.severity) for r in S.scan_arithmetic(l, ["line_no"], F.lit(False)).collect()}
    assert got == {(1, "raw +", 5), (4, "raw /", 4), (4, "raw *", 5), (4, "division before multiplication", 4), (4, "precision loss", 3), (5, "narrowing cast", 3)}
    assert {r.severity for r in S.scan_arithmetic(l, [], F.lit(True)).where("issue like 'raw%'").collect()} == {3}


def test_units_own_what_stands_above_them(spark):
    text = "\n".join(["use x;", "/// Makes an account.", "pub async fn handler(ctx: Context<Make>) {", "    create_account(&ix);", "}", "#[test]", "fn checks() {", "    create_account(&ix);", "}",
                      "#[derive(Accounts)]", "pub struct Make<'info> {", "    pub a: Signer<'info>,", "}", "pub struct Plain {", "}", "pub(crate) const fn one() -> u8 { 1 }", 'unsafe extern "C" fn two() {}'])
    files = spark.createDataFrame([("f", text)], "path string, content string")
    units = {r.unit_name: r for r in S.segment_units(files, "content", ["path"]).collect()}
    assert list(units) == ["handler", "checks", "Make", "Plain", "one", "two"] and units["handler"].line_no == 3 and units["checks"].line_no == 7
    assert units["handler"].code.startswith("/// Makes") and "#[test]" not in units["handler"].code
    assert units["checks"].code.startswith("#[test]") and units["Make"].code.startswith("#[derive(Accounts)]")
    full = {r.unit_name: r for r in S.attach_context(files, "content", ["path"]).collect()}
    assert full["handler"].context_code == units["Make"].code and full["checks"].context_code == ""


def test_test_code_is_told_from_the_handler_before_it(spark):
    from auditloom.operators import scan
    from auditloom.rules import contract
    text = "pub fn handler(p: AccountInfo<'info>) {\n    invoke(&ix, &accs);\n}\n#[test]\nfn checks() {\n    invoke(&ix, &accs);\n}"
    units = S.attach_context(spark.createDataFrame([("f", text)], "path string, content string"), "content", ["path"])
    hits = scan.scan_rules(units, contract.UNIT_RULES, "code", ["unit_name"], kind="unit_kind").where("rule_id = 'SOL-005'").collect()
    assert [r.unit_name for r in hits] == ["handler"]


def test_plain_struct_is_no_context(spark):
    text = "pub fn f(ctx: Context<Data>) {\n}\npub struct Data {\n    pub x: u64,\n}"
    got = S.attach_context(spark.createDataFrame([("f", text)], "path string, content string"), "content", ["path"]).first()
    assert got.context_name == "Data" and got.context_code == ""


def test_struct_schema_flags_and_repeats(spark):
    code = "#[account]\npub struct Vault {\n    pub a: u64,\n    pub b: Pubkey,\n    pub a: u128,\n}\n"
    other = "#[derive(Accounts)]\npub struct Ctx<'info> {\n    pub z: Signer<'info>,\n}\n"
    units = spark.createDataFrame([("struct", "Vault", code), ("struct", "Ctx", other), ("fn", "f", "fn f() {}")], "unit_kind string, unit_name string, code string")
    got = {r["struct_name"]: r for r in S.struct_schemas(units, []).collect()}
    assert got["Vault"]["schema"] == {"a": "u128", "b": "Pubkey"} and (got["Vault"]["is_account"], got["Vault"]["is_context"]) == (True, False)
    assert (got["Ctx"]["is_account"], got["Ctx"]["is_context"]) == (False, True)
    assert [r["struct_name"] for r in S.struct_schemas(units, [], annotated=True).collect()] == ["Vault"]


def test_writes_after_call_name_their_function(spark):
    call, write = "    invoke(&ix, &accounts)?;", "    vault.balance = 1;"
    texts = {1: [call, write], 2: [call, write, "fn a() {", call, write, "}", "fn b() {", call, write, "}"], 3: ["fn only() {"], 4: [""]}
    files = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "id int, text string")
    got = sorted((r.id, r.line_no, r.fn_name) for r in S.writes_after_call(files, "text", ["id"]).collect())
    assert got == [(1, 2, "unknown"), (2, 2, "unknown"), (2, 5, "a"), (2, 9, "b")]
