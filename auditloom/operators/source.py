"""Operators on source files.

A file is one row and its text fits in one row, so line and unit work is done on arrays inside
the row: no shuffle, no window, and a huge repository is as parallel as its file count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.functions.text import context_struct, is_code_line, lines_of
from auditloom.rules import lines as L


def explode_lines(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """1-based numbered lines."""
    return files.select(*keep, F.posexplode(lines_of(F.col(text))).alias("_p", "text")).select(
        *keep, (F.col("_p") + 1).alias("line_no"), "text")


def drop_comments(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.where(is_code_line(F.col(text)))


def _positions(lines: Column, pattern: str) -> Column:
    """0-based positions of lines that match."""
    return F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(pattern), i)), lambda i: i.isNotNull())


def _unit_array(files: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, Column]:
    """Frame with lines, and the expression for its array of (kind, name, line_no, code).

    The array is exploded as an expression, not as a column: for a column the optimizer infers a
    non-empty filter, pushes it below the projections and computes everything again in it.
    """
    at = files.select(*keep, lines_of(F.col(text)).alias("_lines")).withColumns({
        "_starts": _positions(F.col("_lines"), L.UNIT_START), "_heads": F.transform("_lines", lambda l: l.rlike(L.UNIT_HEAD))})
    line, starts = F.col("_lines"), F.col("_starts")

    def begin(s: Column, j: Column) -> Column:
        """First of the attribute and comment lines right above the start; each line is looked at once."""
        gap = s - F.coalesce(F.get(starts, j - 1) + 1, F.lit(0))
        above = F.reverse(F.slice("_heads", s - gap + 1, gap))
        stop = F.array_position(above, False).cast("int")
        return s - F.when(stop > 0, stop - 1).otherwise(gap)

    at = at.withColumn("_begins", F.transform(starts, begin))
    begins = F.col("_begins")
    unit = lambda s, j: F.struct(
        F.regexp_extract(F.get(line, s), L.UNIT_START, 1).alias("unit_kind"),
        F.regexp_extract(F.get(line, s), L.UNIT_START, 2).alias("unit_name"),
        (s + 1).alias("line_no"),
        F.array_join(F.slice(line, F.get(begins, j) + 1, F.coalesce(F.get(begins, j + 1), F.size(line)) - F.get(begins, j)), "\n").alias("code"))
    return at, F.transform(starts, unit)


def segment_units(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Function and struct units found by their first line (no parser), with the attributes and comments right above it."""
    at, units = _unit_array(files, text, keep)
    return at.select(*keep, F.inline(units))


def attach_context(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Function units with the text of the ``derive(Accounts)`` struct named in ``Context<..>`` put before their own."""
    units, contexts = F.col("units"), F.col("contexts")
    def joined(u: Column) -> Column:
        wanted = context_struct(u["code"])
        struct = F.get(F.filter(contexts, lambda s: s["unit_name"] == wanted), 0)
        return F.struct(
            u["unit_kind"].alias("unit_kind"), u["unit_name"].alias("unit_name"), u["line_no"].alias("line_no"),
            wanted.alias("context_name"), F.coalesce(struct["code"], F.lit("")).alias("context_code"),
            F.when(struct.isNotNull(), F.concat(struct["code"], F.lit("\n"), u["code"])).otherwise(u["code"]).alias("code"))
    fns = F.transform(F.filter(units, lambda u: u["unit_kind"] == "fn"), joined)
    at, array = _unit_array(files, text, keep)
    # Structs are tested once a file; functions then only compare names with those that are contexts.
    named = F.filter("units", lambda s: (s["unit_kind"] == "struct") & s["code"].rlike(L.ACCOUNTS_STRUCT))
    return at.select(*keep, array.alias("units")).withColumn("contexts", named).select(*keep, F.inline(fns))


def enclosing_fn(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Every line with the name of the function whose first line is nearest at or above it."""
    at = files.select(*keep, lines_of(F.col(text)).alias("_lines")).withColumn(
        "_starts", F.array_union(F.array(F.lit(0)), _positions(F.col("_lines"), L.FUNCTION_START)))
    line, starts = F.col("_lines"), F.col("_starts")
    part = lambda s, j: F.struct(
        s.alias("first"),
        F.coalesce(F.nullif(F.regexp_extract(F.get(line, s), L.FUNCTION_START, 1), F.lit("")), F.lit("unknown")).alias("fn_name"),
        F.slice(line, s + 1, F.coalesce(F.get(starts, j + 1), F.size(line)) - s).alias("body"))
    parts = at.where(F.size(line) > 0).select(*keep, F.inline(F.transform(starts, part)))
    return parts.select(*keep, "fn_name", "first", F.posexplode("body").alias("_p", "text")).select(
        *keep, (F.col("first") + F.col("_p") + 1).alias("line_no"), "fn_name", "text")


def nearby(files: DataFrame, text: str, keep: list[str], trigger: str, evidence: str, lo: int, hi: int) -> DataFrame:
    """Lines matching ``trigger``, with ``has_evidence`` = some line at offset lo..hi matches ``evidence``."""
    at = files.select(*keep, lines_of(F.col(text)).alias("_lines")).select(
        *keep, "_lines", F.transform("_lines", lambda l: l.rlike(evidence)).alias("_flags"))
    line, flags = F.col("_lines"), F.col("_flags")
    def row(l: Column, i: Column) -> Column:
        first = F.greatest(i + lo, F.lit(0))
        width = F.least(i + hi + 1, F.size(flags)) - first
        seen = F.exists(F.slice(flags, first + 1, F.greatest(width, F.lit(0))), lambda f: f)
        return F.when(l.rlike(trigger), F.struct((i + 1).alias("line_no"), l.alias("text"), seen.alias("has_evidence")))
    return at.select(*keep, F.inline(F.filter(F.transform(line, row), lambda r: r.isNotNull())))


def scan_guarded(files: DataFrame, text: str, keep: list[str], trigger: str, evidence: str, lo: int, hi: int) -> DataFrame:
    """Trigger lines without evidence in their neighbourhood."""
    return nearby(files, text, keep, trigger, evidence, lo, hi).where(~F.col("has_evidence")).drop("has_evidence")


def unsafe_severity(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Unsafe blocks and functions graded by domain tokens on the line and a SAFETY comment above."""
    found = nearby(files, text, keep, f"{L.UNSAFE_BLOCK}|{L.UNSAFE_FN}", L.SAFETY_COMMENT, -3, -1)
    block = F.col("text").rlike(L.UNSAFE_BLOCK)
    domain = F.col("text").rlike(L.DOMAIN_TOKENS)
    ok = F.col("has_evidence")
    sev = F.when(block, F.when(domain & ~ok, 5).when(domain | ~ok, 4).otherwise(3)).otherwise(F.when(ok, 3).otherwise(4))
    return found.select(*keep, "line_no", F.when(block, "UnsafeBlock").otherwise("UnsafeFunction").alias("category"),
                        sev.alias("severity"))


def writes_after_call(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """State writes reached after a cross-program call with no return or other write in between.

    Only call, write and return lines matter; a write is reported exactly when the line before it
    in that reduced sequence is a call that does not return.
    """
    at = files.select(*keep, lines_of(F.col(text)).alias("_lines"))
    def event(l: Column, i: Column) -> Column:
        call, ret = l.rlike(L.CALL_LINE), l.rlike(L.RETURN_LINE)
        write = l.rlike(L.WRITE_LINE_TOKENS) | (l.rlike("=") & ~l.rlike("==") & ~l.rlike("let"))
        return F.when(call | ret | write, F.struct(i.alias("i"), (call & ~ret).alias("opens"), (write & ~call).alias("writes")))
    ev = at.select(*keep, "_lines", F.filter(F.transform("_lines", event), lambda e: e.isNotNull()).alias("_ev"),
                   F.filter(F.transform("_lines", lambda l, i: F.when(
                       l.rlike(L.FUNCTION_START),
                       F.struct(i.alias("i"), F.regexp_extract(l, L.FUNCTION_START, 1).alias("n")))),
                       lambda f: f.isNotNull()).alias("_fns"))
    # The name of the function each line lies in, from the first function's line on: one entry a line.
    fns, n = F.col("_fns"), F.size("_lines")
    names = F.flatten(F.transform(fns, lambda f, k: F.array_repeat(f["n"], (F.coalesce(F.get(fns, k + 1)["i"], n) - f["i"]).cast("int"))))
    ev = ev.withColumn("_names", names)
    e = F.col("_ev")
    def hit(x: Column, j: Column) -> Column:
        before = F.get(e, j - 1)
        first = F.get(fns, 0)["i"]
        name = F.when(x["i"] >= first, F.get("_names", (x["i"] - first).cast("int")))
        return F.when(x["writes"] & (j > 0) & before["opens"], F.struct(
            (x["i"] + 1).alias("line_no"), (before["i"] + 1).alias("call_line"),
            F.coalesce(F.when(F.size(fns) > 0, name), F.lit("unknown")).alias("fn_name")))
    return ev.select(*keep, F.inline(F.filter(F.transform(e, hit), lambda h: h.isNotNull())))


def ordered_tokens(files: DataFrame, text: str, keep: list[str], pattern: str) -> DataFrame:
    """First non-comment line matching an ordered same-line pattern."""
    at = files.select(*keep, lines_of(F.col(text)).alias("_lines"))
    hit = F.array_min(F.filter(F.transform("_lines", lambda l, i: F.when(
        l.rlike(pattern) & ~l.rlike(L.COMMENT), i + 1)), lambda i: i.isNotNull()))
    return at.select(*keep, hit.alias("line_no")).where("line_no is not null")


#: operator -> severity without overflow checks in the build profile (fixed values)
ARITHMETIC_SEVERITY = {"+": 5, "-": 5, "*": 5, "/": 4, "%": 4, "<<": 4, ">>": 4}
GUARDED_MATH = r"(?i)checked_|saturating_|\.try_into\(\)|wrapping_"


def scan_arithmetic(lines: DataFrame, keep: list[str], overflow_checks: Column) -> DataFrame:
    """One row per (line, issue): raw operators, division then multiplication, division, narrowing casts."""
    t = F.col("text")
    raw = [F.when(F.contains(t, F.lit(f" {op} ")) & ~t.rlike(GUARDED_MATH), F.struct(
        F.lit("raw " + op).alias("issue"), F.when(overflow_checks, 3).otherwise(sev).alias("severity")))
        for op, sev in ARITHMETIC_SEVERITY.items()]
    more = [
        F.when(t.rlike(r" / .* \* |\([^()]* / [^()]*\) \* "), F.struct(F.lit("division before multiplication").alias("issue"), F.lit(4).alias("severity"))),
        F.when(F.contains(t, F.lit(" / ")), F.struct(F.lit("precision loss").alias("issue"), F.lit(3).alias("severity"))),
        F.when(t.rlike(r"\bas (u64|u32|u8)\b"), F.struct(F.lit("narrowing cast").alias("issue"), F.lit(3).alias("severity"))),
    ]
    found = F.filter(F.array(*raw, *more), lambda x: x.isNotNull())
    return drop_comments(lines).select(*keep, F.inline(found))


FIELD = r"((?:[ \t]*(?:#\[|///)[^\n]*\n)*)[ \t]*(?:pub )?(\w+): ([^\n]+),"


def struct_fields(units: DataFrame, keep: list[str]) -> DataFrame:
    """Fields of struct units: position, name, type, attribute lines."""
    part = lambda g: F.regexp_extract_all("code", F.lit(FIELD), F.lit(g))
    zipped = F.arrays_zip(part(2).alias("field_name"), part(3).alias("field_type"), part(1).alias("attrs"))
    return units.where("unit_kind = 'struct'").select(
        *keep, F.col("unit_name").alias("struct_name"), F.posexplode(zipped).alias("pos", "f")).select(
        *keep, "struct_name", "pos", "f.field_name", "f.field_type", "f.attrs")


#: Annotations of a struct: state of an account, accounts of a handler.
ACCOUNT_STATE = r"#\[account\b"


def struct_schemas(units: DataFrame, keep: list[str], annotated: bool = False) -> DataFrame:
    """Struct name with a map field -> type (last declaration wins) and flags of what it is annotated as.

    ``is_account``: state of an account; ``is_context``: accounts of a handler.  ``annotated`` keeps only the former.
    Fields are sorted by name and place once, so a struct costs n log n in its fields.
    """
    part = lambda g: F.regexp_extract_all("code", F.lit(FIELD), F.lit(g))
    pairs = F.transform(F.arrays_zip(part(2).alias("k"), part(3).alias("v")), lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    last = lambda s: F.map_from_entries(F.transform(F.filter(s, lambda p, i: ~F.get(s, i + 1)["k"].eqNullSafe(p["k"])), lambda p: F.struct(p["k"], p["v"])))
    schema = F.get(F.transform(F.array(F.array_sort(pairs)), last), 0)
    out = units.where("unit_kind = 'struct'").select(
        *keep, F.col("unit_name").alias("struct_name"), schema.alias("schema"), F.col("code").rlike(ACCOUNT_STATE).alias("is_account"),
        F.col("code").rlike(L.ACCOUNTS_STRUCT).alias("is_context"))
    return out.where("is_account") if annotated else out


def program_id(files: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Program id from ``declare_id!``, first path wins when several files declare one."""
    pid = F.regexp_extract(text, r'declare_id!\(\s*"([^"]+)"\s*\)', 1)
    return files.select(*keys, "path", pid.alias("program_id")).where("program_id <> ''").groupBy(*keys).agg(
        F.min_by("program_id", "path").alias("program_id"))


def manifest_facts(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Framework version and the release profile's overflow flag from manifests."""
    c = F.col(text)
    return files.select(
        *keep,
        F.nullif(F.regexp_extract(c, r'anchor-lang\s*=\s*(?:\{[^}\n]*version\s*=\s*)?"([^"]+)"', 1), F.lit("")).alias("framework_version"),
        c.rlike(r"(?s)\[profile\.release\][^\[]*overflow-checks\s*=\s*true").alias("overflow_checks"))


def call_edges(units: DataFrame, keys: list[str]) -> DataFrame:
    """Calls between known units: names followed by ``(`` inside a body, kept when a unit has that name."""
    named = units.where("unit_kind = 'fn'")
    names = named.select(*keys, F.col("unit_name").alias("callee")).distinct()
    body = F.regexp_replace("code", r"^[^\n]*\n?", "")
    calls = named.select(*keys, F.col("unit_name").alias("caller"), F.explode(F.array_distinct(
        F.regexp_extract_all(body, F.lit(r"\b([a-z_]\w*)\s*\("), F.lit(1)))).alias("callee"))
    return calls.join(names, [*keys, "callee"], "left_semi").select(*keys, "caller", "callee").distinct()


def repo_type(files: DataFrame, key: str = "repo", path: str = "path", text: str = "content") -> DataFrame:
    """Profile of each repository from markers over all of its files."""
    c, p = F.col(text), F.col(path)
    toml, rs = F.endswith(p, F.lit("Cargo.toml")), F.endswith(p, F.lit(".rs"))
    flags = {
        "has_anchor": (toml & c.rlike("anchor-lang|anchor_lang")) | (rs & c.rlike(r"anchor_lang::prelude|#\[program\]")),
        "has_crate": toml & c.rlike("solana-program|solana_program"),
        "has_declare": rs & c.rlike("declare_id!|declare_program!"),
        "has_entry": rs & c.rlike("entrypoint!|fn process_instruction"),
    }
    agg = files.groupBy(key).agg(*[F.bool_or(v).alias(k) for k, v in flags.items()])
    kind = F.when(F.col("has_anchor") & (F.col("has_declare") | F.col("has_crate")), "AnchorProgram").when(
        F.col("has_declare") | F.col("has_entry"), "NativeSolanaProgram").otherwise("RustInfrastructure")
    return agg.select(key, kind.alias("repo_type"), *flags)


def file_ratios(files: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Ratio features per file, for files with at least one function."""
    n = lambda p: F.size(_positions(F.col("_lines"), p))
    c = files.select(*keep, lines_of(F.col(text)).alias("_lines")).select(
        *keep, n(r"^\s*pub \w+: ").alias("accounts"), n(L.FUNCTION_START).alias("fns"), n("require|assert").alias("checks"),
        n(r"borrow_mut|\.balance = ").alias("mutations"), n(r"Signer<|is_signer").alias("signers")).where("fns > 0")
    return c.select(*keep, (F.col("accounts") / F.col("fns")).alias("account_to_instruction_ratio"),
                    (F.col("checks") / F.greatest("mutations", F.lit(1))).alias("check_to_mutation_ratio"),
                    (F.col("signers") / F.col("fns")).alias("signer_check_frequency"))
