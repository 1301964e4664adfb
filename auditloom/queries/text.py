"""Queries on text: lines, units, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import audit as AU, scan, source as S
from auditloom.queries import views as V
from auditloom.queries.base import Area
from auditloom.queries.views import CODE_SQL, LINES_SQL, with_sql
from auditloom.rules import contract, lines as L
from auditloom.rules.formula import Has, Rule, all_of, any_of, none_of, quote

area = Area()
QUERIES, ORACLE, query = area.queries, area.oracle, area.query


KEEP = ["doc_id"]

#: Text rules for prose documents: licence lines, secrets, personal data, junk.
PROSE_RULES: tuple[Rule, ...] = (
    Rule("DOC-LICENSE", "License Text", "Licensing", 2, None, any_of("icense", "opyright", "ermission is hereby")),
    Rule("DOC-KEY", "Credential Assignment", "Secrets", 5, "CWE-798",
         any_of("api_key", "apikey", "secret", "password", "token=", "AKIA", "BEGIN RSA", "BEGIN PRIVATE")),
    Rule("DOC-MAIL", "Mail Address", "Personal Data", 4, "CWE-359", Has("@") & none_of("@param", "@return")),
    Rule("DOC-LINK", "Unencrypted Link", "Transport", 3, "CWE-319", Has("http://") & ~Has("https://")),
    Rule("DOC-MARKUP", "Markup Residue", "Quality", 1, None, any_of("<div", "<script", "&nbsp;", "</") | all_of("{{", "}}")),
    Rule("DOC-CODE", "Code Residue", "Quality", 1, None, all_of("{", "}") & any_of("function", "return", ";")),
    Rule("DOC-THE", "English Text", "Language", 2, None, Has("the") & none_of("der", "les")),
    Rule("DOC-NUMBER", "Digits", "Personal Data", 3, "CWE-359", any_of("+1", "555-", "-00", "000")),
)

_PROSE_FACTS = ", ".join(
    f"('{r.id}', '{r.vuln_type}', '{r.category}', {r.severity})" for r in PROSE_RULES)


def audit_documents(spark, sf):
    """Flagship: prose rules over whole documents, fingerprints, severity counts and risk per source."""
    docs = V.documents(spark, sf).select("doc_id", "source", "text")
    hits = scan.scan_rules(docs, PROSE_RULES, "text", ["doc_id", "source"])
    fp = hits.withColumn("fp", T.fingerprint(F.col("source"), F.col("doc_id"), F.col("rule_id")))
    n = lambda s: F.count_if(F.col("severity") == s)
    return fp.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), n(5).alias("critical"), n(4).alias("high"), n(3).alias("medium"), n(2).alias("low"),
        F.min("fp").alias("first_fp"),
        F.least(F.lit(100), 40 * n(5) + 20 * n(4) + 10 * n(3) + 5 * n(2)).alias("risk_score"))


QUERIES["audit_documents"] = audit_documents
ORACLE["audit_documents"] = with_sql(
    "hits AS (" + " UNION ALL ".join(
        f"SELECT doc_id, source, '{r.id}' AS rule_id, {r.severity} AS severity FROM documents WHERE {r.when.sql('text')}"
        for r in PROSE_RULES) + ")",
    body="""SELECT source, COUNT(*) AS total, COUNT(*) FILTER (WHERE severity = 5) AS critical, COUNT(*) FILTER (WHERE severity = 4) AS high,
  COUNT(*) FILTER (WHERE severity = 3) AS medium, COUNT(*) FILTER (WHERE severity = 2) AS low,
  MIN(sha256(source || ':' || doc_id || ':' || rule_id)) AS first_fp,
  LEAST(100, CAST(40 * COUNT(*) FILTER (WHERE severity = 5) + 20 * COUNT(*) FILTER (WHERE severity = 4) + 10 * COUNT(*) FILTER (WHERE severity = 3)
        + 5 * COUNT(*) FILTER (WHERE severity = 2) AS BIGINT)) AS risk_score
FROM hits GROUP BY source""")


@query("prose_rule_hits", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{r.id}' AS rule_id, '{r.category}' AS category, {r.severity} AS severity FROM documents WHERE {r.when.sql('text')}"
    for r in PROSE_RULES) + ")")
def _(spark, sf):
    return scan.scan_rules(V.documents(spark, sf), PROSE_RULES, "text", KEEP).select(
        "doc_id", "rule_id", "category", "severity")


@query("numbered_lines", f"""SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS text
FROM (SELECT doc_id, {V.lines_sql('text')} AS ls FROM documents)""")
def _(spark, sf):
    return S.explode_lines(V.table(spark, sf, "documents"), "text", KEEP)


@query("code_lines_kept", with_sql(CODE_SQL, LINES_SQL, body=r"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text FROM code_lines
WHERE NOT regexp_matches(text, '^\s*(//|/\*|\*)') AND trim(text) <> ''"""))
def _(spark, sf):
    return S.drop_comments(S.explode_lines(V.code(spark, sf), "content", KEEP))


_UNITS_SQL = rf"""unit_starts AS (
  SELECT doc_id, repo, path, line_no, regexp_extract(text, {quote(L.UNIT_START)}, 1) AS unit_kind,
         regexp_extract(text, {quote(L.UNIT_START)}, 2) AS unit_name
  FROM code_lines WHERE regexp_matches(text, {quote(L.UNIT_START)})),
below AS (  -- the next line that is neither attribute nor comment: what a line belongs to
  SELECT doc_id, line_no, min(CASE WHEN NOT regexp_matches(text, '^\s*(#!?\[|//)') THEN line_no END)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS owner FROM code_lines),
unit_spans AS (
  SELECT s.*, b.first_line, lead(b.first_line, 1, 1000000000) OVER (PARTITION BY s.doc_id ORDER BY s.line_no) AS next_line
  FROM unit_starts s JOIN (SELECT doc_id, owner, min(line_no) AS first_line FROM below GROUP BY ALL) b ON b.doc_id = s.doc_id AND b.owner = s.line_no),
units AS (
  SELECT s.doc_id, s.repo, s.path, s.unit_kind, s.unit_name, s.line_no, string_agg(l.text, chr(10) ORDER BY l.line_no) AS code
  FROM unit_spans s JOIN code_lines l ON l.doc_id = s.doc_id AND l.line_no >= s.first_line AND l.line_no < s.next_line
  GROUP BY s.doc_id, s.repo, s.path, s.unit_kind, s.unit_name, s.line_no)"""
UNITS_SQL = (CODE_SQL, LINES_SQL, _UNITS_SQL)

_CONTEXT_SQL = r"""handlers AS (
  SELECT *, regexp_extract(trim(list_extract(string_split(regexp_extract(code, 'Context\s*<([^>]*)>', 1), ','), -1)),
                           '^[A-Z]\w*', 0) AS context_name
  FROM units WHERE unit_kind = 'fn'),
structs AS (
  SELECT doc_id, unit_name, arg_min(code, line_no) AS code FROM units WHERE unit_kind = 'struct' AND regexp_matches(code, 'derive\([^)]*\bAccounts\b') GROUP BY ALL),
full_units AS (
  SELECT h.doc_id, h.unit_kind, h.unit_name, h.line_no, h.context_name, coalesce(s.code, '') AS context_code,
         CASE WHEN s.code IS NULL THEN h.code ELSE s.code || chr(10) || h.code END AS code
  FROM handlers h LEFT JOIN structs s ON s.doc_id = h.doc_id AND s.unit_name = h.context_name)"""
FULL_SQL = (*UNITS_SQL, _CONTEXT_SQL)
STRIPPED_SQL = r"""stripped AS (
  SELECT doc_id, unit_name, line_no, unit_kind, regexp_replace(code, '(?s)/\*.*?\*/|//[^\n]*', '', 'g') AS code FROM full_units)"""


@query("unit_segments", with_sql(*UNITS_SQL, body="""
SELECT doc_id, unit_kind, unit_name, CAST(line_no AS INTEGER) AS line_no, code FROM units"""))
def _(spark, sf):
    return S.segment_units(V.code(spark, sf), "content", KEEP)


@query("handler_context", with_sql(*FULL_SQL, body="""
SELECT doc_id, unit_name, CAST(line_no AS INTEGER) AS line_no, context_name, code FROM full_units"""))
def _(spark, sf):
    return S.attach_context(V.code(spark, sf), "content", KEEP).select("doc_id", "unit_name", "line_no", "context_name", "code")


def unit_text(spark, sf):
    u = S.attach_context(V.code(spark, sf), "content", KEEP)
    return u.withColumn("code", T.strip_comments(F.col("code")))


@query("contract_rule_scan", with_sql(*FULL_SQL, STRIPPED_SQL, body=scan.rules_sql(
    "stripped", contract.UNIT_RULES, "code", "doc_id, unit_name, CAST(line_no AS INTEGER) AS line_no")))
def _(spark, sf):
    return scan.scan_rules(unit_text(spark, sf), contract.UNIT_RULES, "code", ["doc_id", "unit_name", "line_no"],
                           kind="unit_kind").select("doc_id", "unit_name", "line_no", "rule_id", "category", "severity")


@query("extra_unit_rule_scan", with_sql(*FULL_SQL, STRIPPED_SQL, body=scan.rules_sql(
    "stripped", contract.EXTRA_UNIT_RULES, "code", "doc_id, unit_name, CAST(line_no AS INTEGER) AS line_no")))
def _(spark, sf):
    return scan.scan_rules(unit_text(spark, sf), contract.EXTRA_UNIT_RULES, "code", ["doc_id", "unit_name", "line_no"],
                           kind="unit_kind").select("doc_id", "unit_name", "line_no", "rule_id", "category", "severity")


@query("struct_unit_rule_scan", with_sql(*UNITS_SQL, body=scan.rules_sql(
    "units", contract.UNIT_RULES, "code", "doc_id, unit_kind, unit_name, CAST(line_no AS INTEGER) AS line_no")))
def _(spark, sf):
    units = S.segment_units(V.code(spark, sf), "content", KEEP)
    return scan.scan_rules(units, contract.UNIT_RULES, "code", ["doc_id", "unit_kind", "unit_name", "line_no"],
                           kinds=("struct",), kind="unit_kind").select(
        "doc_id", "unit_kind", "unit_name", "line_no", "rule_id", "category", "severity")


@query("test_code_flags", with_sql(*UNITS_SQL, body="""
SELECT doc_id, unit_kind, COUNT(*) AS units, COUNT(*) FILTER (WHERE contains(code, '#[test]') OR contains(code, '#[cfg(test)]')) AS flagged
FROM units GROUP BY ALL"""))
def _(spark, sf):
    units = S.segment_units(V.code(spark, sf), "content", KEEP)
    flag = any_of("#[test]", "#[cfg(test)]").column(F.col("code"))
    return units.groupBy("doc_id", "unit_kind").agg(F.count(F.lit(1)).alias("units"), F.count_if(flag).alias("flagged"))


@query("unsafe_line_rules", with_sql(CODE_SQL, LINES_SQL, body=" UNION ALL ".join(
    f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '{r.id}' AS rule_id, '{r.category}' AS category, {r.severity} AS severity, "
    f"'{r.cwe}' AS cwe FROM code_lines WHERE regexp_matches(text, {quote(r.pattern)}) AND NOT regexp_matches(text, {quote(L.COMMENT)}) AND trim(text) <> ''"
    for r in L.UNSAFE_CODE_RULES)))
def _(spark, sf):
    lines = S.drop_comments(S.explode_lines(V.code(spark, sf), "content", KEEP))
    return scan.scan_lines(lines, L.UNSAFE_CODE_RULES, "text", ["doc_id", "line_no"])


@query("incident_signatures", with_sql(CODE_SQL, LINES_SQL, body=" UNION ALL ".join(
    f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '{r.id}' AS rule_id, '{r.category}' AS category, "
    f"0.85 AS similarity FROM code_lines WHERE regexp_matches(text, {quote(r.pattern)})" for r in L.INCIDENT_RULES)
    .replace("0.85 AS", "CAST(0.85 AS DOUBLE) AS")))
def _(spark, sf):
    hits = scan.scan_lines(S.explode_lines(V.code(spark, sf), "content", KEEP), L.INCIDENT_RULES, "text", ["doc_id", "line_no"])
    return hits.select("doc_id", "line_no", "rule_id", "category", F.lit(L.INCIDENT_SIMILARITY).alias("similarity")).where(
        F.col("similarity") > L.INCIDENT_THRESHOLD)


@query("occurrence_counts", """
SELECT doc_id, len(regexp_extract_all(text, 'the')) >= 2 AS the_twice,
  length(text) - length(replace(text, 'an', '')) >= 6 AS an_thrice,
  (CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'and') AS INT) + CAST(contains(text, 'of') AS INT)
   + CAST(contains(text, 'by') AS INT)) >= 3 AS three_signals
FROM documents""")
def _(spark, sf):
    from auditloom.rules.formula import Count
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", (F.regexp_count("text", F.lit("the")) >= 2).alias("the_twice"),
                    Count("an", 3).column(F.col("text")).alias("an_thrice"),
                    scan.count_at_least(F.col("text"), ["the", "and", "of", "by"], 3).alias("three_signals"))


@query("ordered_line_tokens", with_sql(CODE_SQL, LINES_SQL, body=r"""
SELECT doc_id, CAST(MIN(line_no) AS INTEGER) AS line_no FROM code_lines
WHERE regexp_matches(text, ' / .* \* ') AND NOT regexp_matches(text, '^\s*(//|/\*|\*)') GROUP BY doc_id"""))
def _(spark, sf):
    return S.ordered_tokens(V.code(spark, sf), "content", KEEP, r" / .* \* ")


def _nearby_sql(trigger, evidence, lo, hi):
    frame = lambda n: f"{-n} PRECEDING" if n < 0 else ("CURRENT ROW" if n == 0 else f"{n} FOLLOWING")
    return with_sql(CODE_SQL, LINES_SQL, f"""flags AS (
  SELECT doc_id, line_no, text, coalesce(bool_or(regexp_matches(text, {quote(evidence)}))
     OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {frame(lo)} AND {frame(hi)}), false) AS seen FROM code_lines)""",
                    body=f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text FROM flags WHERE regexp_matches(text, {quote(trigger)}) AND NOT seen")


_GUARDED = {
    "unguarded_calls": (L.CALL_TRIGGER, L.CALL_EVIDENCE, -10, 4),
    "unvalidated_remaining_accounts": (L.REMAINING_TRIGGER, L.REMAINING_EVIDENCE, -5, 14),
    "close_without_zeroing": (L.CLOSE_TRIGGER, L.CLOSE_EVIDENCE, 0, 9),
}
for _name, _args in _GUARDED.items():
    QUERIES[_name] = lambda spark, sf, a=_args: S.scan_guarded(V.code(spark, sf), "content", KEEP, *a)
    ORACLE[_name] = _nearby_sql(*_args)


@query("nearby_evidence", with_sql(CODE_SQL, LINES_SQL, body=f"""
SELECT * FROM (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text,
  coalesce(bool_or(regexp_matches(text, {quote(L.SAFETY_COMMENT)})) OVER (PARTITION BY doc_id ORDER BY line_no
     ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS has_evidence FROM code_lines)
WHERE contains(text, 'unsafe')"""))
def _(spark, sf):
    return S.nearby(V.code(spark, sf), "content", KEEP, "unsafe", L.SAFETY_COMMENT, -3, -1)


@query("raw_call_context", with_sql(CODE_SQL, LINES_SQL, body=f"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM code_lines WHERE regexp_matches(text, {quote(L.RAW_CONTEXT)})"""))
def _(spark, sf):
    return S.explode_lines(V.code(spark, sf), "content", KEEP).where(F.col("text").rlike(L.RAW_CONTEXT)).select("doc_id", "line_no")


@query("enclosing_functions", with_sql(CODE_SQL, LINES_SQL, body=f"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(last_value(CASE WHEN regexp_matches(text, {quote(L.FUNCTION_START)})
   THEN regexp_extract(text, {quote(L.FUNCTION_START)}, 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
   ROWS UNBOUNDED PRECEDING), 'unknown') AS fn_name FROM code_lines"""))
def _(spark, sf):
    return S.enclosing_fn(V.code(spark, sf), "content", KEEP).select("doc_id", "line_no", "fn_name")


@query("unsafe_severity_matrix", with_sql(CODE_SQL, LINES_SQL, body=rf"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN block THEN 'UnsafeBlock' ELSE 'UnsafeFunction' END AS category,
  CAST(CASE WHEN block AND domain AND NOT ok THEN 5 WHEN block AND (domain OR NOT ok) THEN 4 WHEN block THEN 3
       WHEN ok THEN 3 ELSE 4 END AS INTEGER) AS severity
FROM (SELECT doc_id, line_no, regexp_matches(text, {quote(L.UNSAFE_BLOCK)}) AS block, regexp_matches(text, {quote(L.UNSAFE_FN)}) AS fnn,
   regexp_matches(text, {quote(L.DOMAIN_TOKENS)}) AS domain,
   coalesce(bool_or(regexp_matches(text, {quote(L.SAFETY_COMMENT)})) OVER (PARTITION BY doc_id ORDER BY line_no
     ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS ok FROM code_lines)
WHERE block OR fnn"""))
def _(spark, sf):
    return S.unsafe_severity(V.code(spark, sf), "content", KEEP)


@query("writes_after_call", with_sql(CODE_SQL, LINES_SQL, rf"""marked AS (
  SELECT doc_id, line_no, text, regexp_matches(text, {quote(L.CALL_LINE)}) AS c, regexp_matches(text, {quote(L.RETURN_LINE)}) AS r,
    regexp_matches(text, {quote(L.WRITE_LINE_TOKENS)}) OR (contains(text, '=') AND NOT contains(text, '==') AND NOT contains(text, 'let')) AS w,
    coalesce(last_value(CASE WHEN regexp_matches(text, {quote(L.FUNCTION_START)}) THEN regexp_extract(text, {quote(L.FUNCTION_START)}, 1) END
      IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'unknown') AS fn_name FROM code_lines),
ev AS (
  SELECT *, lag(c AND NOT r) OVER (PARTITION BY doc_id ORDER BY line_no) AS opened,
         lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS call_line FROM marked WHERE c OR r OR w)""",
    body="""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(call_line AS INTEGER) AS call_line, fn_name
FROM ev WHERE w AND NOT c AND opened"""))
def _(spark, sf):
    return S.writes_after_call(V.code(spark, sf), "content", KEEP)


@query("arithmetic_line_rules", with_sql(CODE_SQL, LINES_SQL, V.MANIFEST_SQL, r"""flagged AS (
  SELECT l.doc_id, l.line_no, l.text, regexp_matches(m.content, '(?s)\[profile\.release\][^\[]*overflow-checks\s*=\s*true') AS oc
  FROM code_lines l LEFT JOIN manifest_v m ON m.doc_id = l.doc_id
  WHERE NOT regexp_matches(l.text, '^\s*(//|/\*|\*)') AND trim(l.text) <> '')""", body=" UNION ALL ".join(
    [f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'raw {op}' AS issue, CASE WHEN oc THEN 3 ELSE {sev} END AS severity FROM flagged "
     f"WHERE contains(text, ' {op} ') AND NOT regexp_matches(text, {quote(S.GUARDED_MATH)})" for op, sev in S.ARITHMETIC_SEVERITY.items()]
    + [f"SELECT doc_id, CAST(line_no AS INTEGER), '{n}', {sev} FROM flagged WHERE regexp_matches(text, {quote(p)})" for n, p, sev in (
        ("division before multiplication", r" / .* \* |\([^()]* / [^()]*\) \* ", 4), ("precision loss", " / ", 3),
        ("narrowing cast", r"\bas (u64|u32|u8)\b", 3))])))
def _(spark, sf):
    facts = S.manifest_facts(V.manifests(spark, sf), "content", KEEP)
    files = V.code(spark, sf).join(facts, "doc_id", "left")
    lines = S.explode_lines(files, "content", ["doc_id", "overflow_checks"])
    return S.scan_arithmetic(lines, ["doc_id", "line_no"], F.coalesce(F.col("overflow_checks"), F.lit(False)))


@query("manifest_facts", with_sql(V.MANIFEST_SQL, body=r"""
SELECT doc_id, regexp_extract(content, 'anchor-lang = "([^"]+)"', 1) AS framework_version,
  regexp_matches(content, '(?s)\[profile\.release\][^\[]*overflow-checks\s*=\s*true') AS overflow_checks FROM manifest_v"""))
def _(spark, sf):
    return S.manifest_facts(V.manifests(spark, sf), "content", KEEP)


@query("mined_invariants", with_sql(CODE_SQL, "hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{r.id}' AS rule_id, '{r.category}' AS category, CAST({r.confidence} AS DOUBLE) AS confidence, {i} AS ord FROM code_v WHERE {r.when.sql('content')}"
    for i, r in enumerate(contract.INVARIANT_RULES)) + ")", body="""
SELECT doc_id, rule_id, category, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM hits WHERE confidence >= 0.7) WHERE rn <= 50"""))
def _(spark, sf):
    from auditloom.operators.invariants import mine_invariants
    return mine_invariants(V.code(spark, sf), "content", KEEP)[0].select("doc_id", "rule_id", "category", "confidence")


@query("invariant_counterexamples", with_sql(CODE_SQL, body=" UNION ALL ".join(
    f"SELECT doc_id, '{r.id}' AS rule_id, '{r.note}' AS counterexample FROM code_v WHERE {r.when.sql('content')}"
    for r in contract.INVARIANT_RULES if r.note)))
def _(spark, sf):
    from auditloom.operators.invariants import mine_invariants
    return mine_invariants(V.code(spark, sf), "content", KEEP)[1].select("doc_id", "rule_id", "counterexample")


_SIG = contract.UNIT_SIGNALS


@query("unit_signals", with_sql(*FULL_SQL, body=f"""
SELECT doc_id, unit_name, CAST(line_no AS INTEGER) AS line_no,
  {_SIG['signer_check'].sql('own')} OR regexp_matches(ctx, 'Signer|signer|has_one|constraint') AS signer_check,
  {_SIG['owner_check'].sql('own')} OR regexp_matches(ctx, 'Account ?<|has_one|owner|constraint') AS owner_check,
  {_SIG['pda_check'].sql('own')} OR regexp_matches(ctx, 'seeds|bump') AS pda_check,
  {_SIG['checked_math'].sql('own')} AS checked_math,
  {_SIG['raw_math'].sql('own')} AND NOT {_SIG['checked_math'].sql('own')} AS unchecked_math
FROM (SELECT doc_id, unit_name, line_no, context_code AS ctx,
   CASE WHEN context_code = '' THEN code ELSE substring(code, length(context_code) + 2) END AS own FROM full_units)"""))
def _(spark, sf):
    u = S.attach_context(V.code(spark, sf), "content", KEEP)
    own = F.when(F.col("context_code") == "", F.col("code")).otherwise(
        F.substring(F.col("code"), F.length("context_code") + 2, F.length("code")))
    at = u.withColumn("own", own)
    c, o = F.col("context_code"), F.col("own")
    s = {k: t.column(o) for k, t in _SIG.items()}
    return at.select(
        "doc_id", "unit_name", "line_no", (s["signer_check"] | c.rlike("Signer|signer|has_one|constraint")).alias("signer_check"),
        (s["owner_check"] | c.rlike("Account ?<|has_one|owner|constraint")).alias("owner_check"),
        (s["pda_check"] | c.rlike("seeds|bump")).alias("pda_check"), s["checked_math"].alias("checked_math"),
        (s["raw_math"] & ~s["checked_math"]).alias("unchecked_math"))


@query("statement_stats", with_sql(*UNITS_SQL, body=r"""
SELECT doc_id, unit_name, CAST(line_no AS INTEGER) AS line_no,
  CAST(len(regexp_extract_all(code, ' [-+*/%] | [-+*/%]= ')) AS INTEGER) AS arithmetic,
  CAST(len(regexp_extract_all(code, '\.(checked|saturating|wrapping)_(add|sub|mul|div)\(')) AS INTEGER) AS checked_arithmetic,
  CAST(len(regexp_extract_all(code, '[^=!<>+\-*/%]=[^=>]|[-+*/%]= ')) AS INTEGER) AS assignments FROM units"""))
def _(spark, sf):
    u = S.segment_units(V.code(spark, sf), "content", KEEP)
    return u.select("doc_id", "unit_name", "line_no", *[v.alias(k) for k, v in T.statement_stats(F.col("code")).items()])


FIELDS_SQL = rf"""fields AS (
  SELECT doc_id, struct_name, line_no, CAST(generate_subscripts(n, 1) - 1 AS INTEGER) AS pos, unnest(n) AS field_name, unnest(t) AS field_type, unnest(a) AS attrs
  FROM (SELECT doc_id, unit_name AS struct_name, line_no, regexp_extract_all(code, {quote(S.FIELD)}, 2) AS n,
        regexp_extract_all(code, {quote(S.FIELD)}, 3) AS t, regexp_extract_all(code, {quote(S.FIELD)}, 1) AS a
        FROM units WHERE unit_kind = 'struct'))"""


def fields(spark, sf):
    return S.struct_fields(S.segment_units(V.code(spark, sf), "content", KEEP), ["doc_id", "line_no"])


@query("struct_fields", with_sql(*UNITS_SQL, FIELDS_SQL, body="""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, struct_name, pos, field_name, field_type, attrs FROM fields"""))
def _(spark, sf):
    return fields(spark, sf)


@query("struct_schemas", with_sql(*UNITS_SQL, FIELDS_SQL, body=r"""
SELECT f.*, regexp_matches(code, '#\[account\b') AS is_account, regexp_matches(code, """ + quote(L.ACCOUNTS_STRUCT) + r""") AS is_context FROM (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, struct_name, string_agg(field_name || '=' || field_type, '|' ORDER BY field_name) AS schema_text FROM (
  SELECT doc_id, line_no, struct_name, field_name, arg_max(field_type, pos) AS field_type FROM fields GROUP BY ALL) GROUP BY ALL) f
JOIN units u ON u.doc_id = f.doc_id AND u.line_no = f.line_no AND u.unit_kind = 'struct' AND u.unit_name = f.struct_name"""))
def _(spark, sf):
    u = S.segment_units(V.code(spark, sf), "content", KEEP)
    m = S.struct_schemas(u, ["doc_id", "line_no"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("schema")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return m.select("doc_id", "line_no", "struct_name", text.alias("schema_text"), "is_account", "is_context").where("schema_text <> ''")


@query("text_call_edges", with_sql(*UNITS_SQL, r"""calls AS (
  SELECT DISTINCT doc_id, unit_name AS caller, unnest(regexp_extract_all(regexp_replace(code, '^[^\n]*\n?', ''), '\b([a-z_]\w*)\s*\(', 1)) AS callee
  FROM units WHERE unit_kind = 'fn')""", body="""
SELECT c.doc_id, c.caller, c.callee FROM calls c SEMI JOIN (SELECT doc_id, unit_name FROM units WHERE unit_kind = 'fn') u
ON u.doc_id = c.doc_id AND u.unit_name = c.callee"""))
def _(spark, sf):
    return S.call_edges(S.segment_units(V.code(spark, sf), "content", KEEP), KEEP)


@query("repo_profiles", with_sql(CODE_SQL, V.MANIFEST_SQL, r"""files AS (
  SELECT repo, path, content FROM code_v UNION ALL SELECT repo, path, content FROM manifest_v),
flags AS (SELECT repo, bool_or((path LIKE '%Cargo.toml' AND regexp_matches(content, 'anchor-lang|anchor_lang'))
      OR (path LIKE '%.rs' AND regexp_matches(content, 'anchor_lang::prelude|#\[program\]'))) AS a,
    bool_or(path LIKE '%Cargo.toml' AND regexp_matches(content, 'solana-program|solana_program')) AS c,
    bool_or(path LIKE '%.rs' AND regexp_matches(content, 'declare_id!|declare_program!')) AS d,
    bool_or(path LIKE '%.rs' AND regexp_matches(content, 'entrypoint!|fn process_instruction')) AS e FROM files GROUP BY repo)""",
    body="""SELECT repo, CASE WHEN a AND (d OR c) THEN 'AnchorProgram' WHEN d OR e THEN 'NativeSolanaProgram' ELSE 'RustInfrastructure' END AS repo_type,
  a AS has_anchor, c AS has_crate, d AS has_declare, e AS has_entry FROM flags"""))
def _(spark, sf):
    cols = ["repo", "path", "content"]
    return S.repo_type(V.code(spark, sf).select(*cols).unionByName(V.manifests(spark, sf).select(*cols)))


@query("finding_fingerprints", """SELECT doc_id, sha256(source || ':' || doc_id || ':' || n_chars) AS fp,
 'SEC3-' || upper(substring(sha256(source || ':' || doc_id || ':' || n_chars), 1, 8)) AS short_id,
 'L3X-' || substring(sha256(source || ':' || doc_id || ':' || n_chars), 1, 16) AS long_id FROM documents""")
def _(spark, sf):
    fp = T.fingerprint(F.col("source"), F.col("doc_id"), F.col("n_chars"))
    return V.table(spark, sf, "documents").select("doc_id", fp.alias("fp"), T.short_id("SEC3", fp, upper=True).alias("short_id"),
                                                  T.short_id("L3X", fp, 16).alias("long_id"))


@query("instruction_names", r"""
SELECT p_partkey, camel, CASE WHEN stem = '' THEN lower(camel) ELSE
  lower(regexp_replace(regexp_replace(stem, '(.)([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z])', '\1_\2', 'g')) END AS snake
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(camel, '(Accounts)+$', ''), '(Context)+$', ''), '(Ctx)+$', '') AS stem
  FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), '') ||
    (['Accounts', 'Context', 'Ctx', ''])[p_partkey % 4 + 1] AS camel FROM part))""")
def _(spark, sf):
    words = F.array_join(F.transform(F.split("p_name", " "), F.initcap), "")
    camel = F.concat(words, V.choose(("Accounts", "Context", "Ctx", ""), F.col("p_partkey")))
    return V.table(spark, sf, "part").select("p_partkey", camel.alias("camel"), T.snake_name(camel).alias("snake"))


@query("field_names", with_sql(CODE_SQL, LINES_SQL, body=r"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, list_extract(string_split_regex(trim(split_part(text, ':', 1)), '\s+'), -1) AS field_name
FROM code_lines WHERE contains(text, ':') AND trim(split_part(text, ':', 1)) <> ''"""))
def _(spark, sf):
    return S.explode_lines(V.code(spark, sf), "content", KEEP).select(
        "doc_id", "line_no", T.field_name(F.col("text")).alias("field_name")).where("field_name is not null")


_TARGET_SQL = """targets AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'git@host.example:u' || page_id || '/r/'
  WHEN 2 THEN 'https://github.com/u/r' || page_id || '/tree/main' WHEN 3 THEN substring(replace(sha256(url), '-', ''), 1, 40)
  ELSE './p' || page_id END AS target FROM pages)"""


@query("scan_targets", with_sql(_TARGET_SQL, body=r"""
SELECT page_id, CASE WHEN ssh OR web THEN 'git' WHEN regexp_matches(target, '^[A-Za-z0-9]{32,44}$') THEN 'address' ELSE 'path' END AS kind,
  CASE WHEN ssh THEN 'https://' || split_part(substring(target, 5), ':', 1) || '/' || rtrim(substring(target, 5 + length(split_part(substring(target, 5), ':', 1)) + 1), '/') || '.git'
       WHEN web THEN CASE WHEN ends_with(base, '.git') THEN base ELSE base || '.git' END ELSE target END AS normalised
FROM (SELECT *, starts_with(target, 'git@') AND contains(target, ':') AS ssh,
   rtrim(CASE WHEN contains(target, '/tree/') THEN split_part(target, '/tree/', 1) WHEN contains(target, '/blob/') THEN split_part(target, '/blob/', 1) ELSE target END, '/') AS base,
   regexp_matches(target, '^https?://') AND (regexp_extract(target, '^https?://([^/]*)', 1) IN ('github.com', 'gitlab.com', 'bitbucket.org', 'codeberg.org', 'git.sr.ht', 'gitea.com')
     OR regexp_matches(target, '\.git$|\.git/|/tree/|/blob/')) AS web FROM targets)"""))
def _(spark, sf):
    p, n = V.table(spark, sf, "pages"), F.col("page_id") % 5
    s = F.col("page_id").cast("string")
    target = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("git@host.example:u"), s, F.lit("/r/"))).when(
        n == 2, F.concat(F.lit("https://github.com/u/r"), s, F.lit("/tree/main"))).when(
        n == 3, F.substring(F.sha2("url", 256), 1, 40)).otherwise(F.concat(F.lit("./p"), s))
    kind, value = T.classify_target(F.col("target"))
    return p.select("page_id", target.alias("target")).select("page_id", kind.alias("kind"), value.alias("normalised"))


_VOTE_TEXT_SQL = """prose AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN text
  ELSE text || ' {"verdict": "' || (['confirmed', 'REJECTED', 'maybe'])[length(text) % 3 + 1] || '"' ||
  CASE WHEN turn % 4 = 0 THEN ', "confidence": 0.' || (length(text) % 9) ELSE '' END || ', "reasoning": "r' || turn || '"} tail' END AS body FROM conversations)"""


@query("embedded_votes", with_sql(_VOTE_TEXT_SQL, body=r"""
SELECT conv_id, turn, CASE WHEN js = '' THEN NULL WHEN upper(v) = 'CONFIRMED' THEN 'Confirmed' WHEN upper(v) = 'REJECTED' THEN 'Rejected' ELSE 'Uncertain' END AS verdict,
  CASE WHEN js = '' THEN NULL ELSE coalesce(TRY_CAST(nullif(c, '') AS DOUBLE), 0.5) END AS confidence,
  CASE WHEN js = '' THEN 'no JSON' END AS error
FROM (SELECT *, regexp_extract(js, '"verdict": "([^"]*)"', 1) AS v, regexp_extract(js, '"confidence": ([0-9.]+)', 1) AS c
  FROM (SELECT conv_id, turn, regexp_extract(body, '(?s)\{.*\}', 0) AS js FROM prose))"""))
def _(spark, sf):
    c, n = V.table(spark, sf, "conversations"), F.length("text")
    js = F.concat("text", F.lit(' {"verdict": "'), V.choose(("confirmed", "REJECTED", "maybe"), n), F.lit('"'),
                  F.when(F.col("turn") % 4 == 0, F.concat(F.lit(', "confidence": 0.'), (n % 9).cast("string"))).otherwise(""),
                  F.lit(', "reasoning": "r'), F.col("turn").cast("string"), F.lit('"} tail'))
    body = F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(js)
    v = T.extract_vote(F.col("body"))
    return c.select("conv_id", "turn", body.alias("body")).select("conv_id", "turn", v.alias("v")).select(
        "conv_id", "turn", "v.verdict", "v.confidence", "v.error")


@query("message_templates", """SELECT doc_id, 'Document ' || doc_id || ' from ' || source || ' has ' || n_chars || ' characters' AS message FROM documents""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.render(
        "Document {id} from {src} has {n} characters", {"id": F.col("doc_id"), "src": F.col("source"), "n": F.col("n_chars")}).alias("message"))


# ---------------------------------------------------------------- the whole audit
_AUDIT_SQL = (*FULL_SQL, STRIPPED_SQL, "hits AS (" + " UNION ALL ".join(
    [f"SELECT doc_id, '{r.vuln_type.replace(chr(39), chr(39) * 2)}' AS vuln_type, '{r.category}' AS category, {r.severity} AS severity, unit_name AS instruction, CAST(line_no AS INTEGER) AS line_no FROM stripped WHERE {r.when.sql('code')}"
     for r in contract.UNIT_RULES]
    + [f"SELECT doc_id, '{r.category}', '{r.category}', {r.severity}, '', CAST(line_no AS INTEGER) FROM code_lines WHERE regexp_matches(text, {quote(r.pattern)}) AND NOT regexp_matches(text, {quote(L.COMMENT)}) AND trim(text) <> ''"
       for r in L.UNSAFE_CODE_RULES]) + ")")


@query("batch_audit", with_sql(*_AUDIT_SQL, """kept AS (SELECT source AS program, doc_id, vuln_type, instruction, line_no, MAX(severity) AS severity FROM hits JOIN documents USING (doc_id) GROUP BY ALL)""",
    body="""SELECT program, COUNT(*) AS findings, SUM(severity)::BIGINT AS severity_sum, COUNT(*) FILTER (WHERE severity = 5) AS critical_count FROM kept GROUP BY program"""))
def _(spark, sf):
    found = AU.audit_findings(V.code(spark, sf).select("repo", "path", "content"))
    return found.groupBy("program").agg(F.count(F.lit(1)).alias("findings"), F.sum("severity").alias("severity_sum"), F.count_if(F.col("severity") == 5).alias("critical_count"))
