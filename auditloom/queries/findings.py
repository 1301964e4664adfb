"""Queries on finding tables and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditloom.functions import labels as LB, text as T
from auditloom.operators import findings as FN, ranges as R, scores as SC
from auditloom.queries import views as V
from auditloom.queries.base import Area
from auditloom.sources.tables import constant_rows
from auditloom.queries.views import FINDINGS_SQL, REPORTS_SQL, VOTES_SQL, with_sql

area = Area()
QUERIES, ORACLE, query = area.queries, area.oracle, area.query
BY = ["program"]

_CASE = lambda col, d, default="NULL": f"CASE {col} " + " ".join(
    f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in d.items()) + f" ELSE {default} END"
_TAX_SQL = ("CASE " + " ".join("WHEN " + " OR ".join(f"contains(vuln_type, '{w}')" for w in ws) + f" THEN '{t}'" for ws, t in T.TYPE_WORDS)
            + " ELSE " + _CASE("category", T.CATEGORY_TAXONOMY, "'UninitializedData'") + " END")
_LABEL_SQL = "CASE severity " + " ".join(f"WHEN {n} THEN '{l}'" for n, l in T.SEVERITY_LABELS.items()) + " ELSE 'MEDIUM' END"


@query("severity_normalised", with_sql(FINDINGS_SQL, body=f"""
SELECT seq, {_LABEL_SQL} AS label, CAST(severity AS INTEGER) AS back FROM findings_v"""))
def _(spark, sf):
    f = V.findings(spark, sf)
    label = T.severity_label(F.col("severity"))
    return f.select("seq", label.alias("label"), T.severity_ordinal(F.lower(label)).alias("back"))


@query("finding_enrichment", with_sql(FINDINGS_SQL, body=f"""
SELECT seq, taxonomy, {_LABEL_SQL} AS severity_label, {_CASE('taxonomy', {k: v[0] for k, v in LB.HISTORY.items()})} AS reference_id,
  {_CASE('taxonomy', {k: v[1] for k, v in LB.HISTORY.items()})} AS incident,
  CAST({_CASE('taxonomy', {k: v[2] for k, v in LB.HISTORY.items()}, str(LB.DEFAULT_EFFORT))} AS INTEGER) AS effort_units
FROM (SELECT *, {_TAX_SQL} AS taxonomy FROM findings_v)"""))
def _(spark, sf):
    return FN.enrich(V.findings(spark, sf)).select("seq", "taxonomy", "severity_label", "reference_id", "incident", "effort_units")


@query("category_cwe", with_sql(FINDINGS_SQL, body=f"""
SELECT seq, {_CASE('taxonomy', LB.CATEGORY_CWE)} AS cwe FROM (SELECT *, {_TAX_SQL} AS taxonomy FROM findings_v)"""))
def _(spark, sf):
    return V.findings(spark, sf).select("seq", LB.lookup(T.taxonomy(F.col("vuln_type"), F.col("category")), LB.CATEGORY_CWE).alias("cwe"))


@query("dimension_join", with_sql(FINDINGS_SQL, body="""SELECT seq, s_name AS owner, coalesce(s_nationkey, -1) AS unit FROM findings_v LEFT JOIN supplier ON s_suppkey = user_id"""))
def _(spark, sf):
    dim = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("owner"), F.col("s_nationkey").alias("unit"))
    return FN.join_dimension(V.findings(spark, sf), dim, "user_id", ["owner", "unit"]).select(
        "seq", "owner", F.coalesce("unit", F.lit(-1)).alias("unit"))


@query("evidence_confidence", with_sql(FINDINGS_SQL, body="""
SELECT seq, CAST(least(99, greatest(0, CASE severity WHEN 5 THEN 80 WHEN 4 THEN 70 WHEN 3 THEN 60 WHEN 2 THEN 50 ELSE 40 END
  + CASE WHEN line_number > 0 THEN 8 ELSE 0 END + 5
  - CASE WHEN contains(vuln_type, 'Missing Pause') OR contains(vuln_type, 'Missing Event') OR contains(vuln_type, 'Hardcoded Address') THEN 30 ELSE 0 END)) AS INTEGER) AS conf
FROM findings_v"""))
def _(spark, sf):
    return V.findings(spark, sf).select("seq", LB.evidence_confidence(
        F.col("severity"), F.col("line_number"), F.col("instruction"), F.col("vuln_type")).alias("conf"))


_EC = LB.ENGINE_CONFIDENCE
_EC_SQL = "CASE WHEN engine = 'L3X' THEN CAST(floor(confidence) AS INTEGER) " + " ".join(
    f"WHEN engine = '{e}' THEN {by[0]}" if 0 in by else " ".join(f"WHEN engine = '{e}' AND severity = {s} THEN {c}" for s, c in by.items())
    for e, by in _EC.items()) + " END"


@query("engine_confidence", with_sql(FINDINGS_SQL, body=f"SELECT seq, engine, coalesce({_EC_SQL}, 0) AS conf FROM findings_v"))
def _(spark, sf):
    f = V.findings(spark, sf)
    return f.select("seq", "engine", F.coalesce(LB.engine_confidence(
        F.col("engine"), F.col("severity"), F.col("confidence") / 100.0 + 0.001, F.lit(True)), F.lit(0)).alias("conf"))


def labelled(spark, sf):
    f = V.findings(spark, sf)
    prio = F.when(F.col("risk") >= 100 * 10_000, "high").when(F.col("risk") >= 100 * 2_000, "medium").otherwise("low")
    return f.select("*", T.severity_label(F.col("severity")).alias("severity_label"), prio.alias("priority"),
                    F.concat(F.lit("Found "), F.col("vuln_type"), F.lit(" in "), F.col("instruction")).alias("description"))


@query("finding_search", with_sql(FINDINGS_SQL, body=f"""
SELECT seq, severity, category FROM (SELECT *, {_LABEL_SQL} AS label,
   CASE WHEN risk >= 1000000 THEN 'high' WHEN risk >= 200000 THEN 'medium' ELSE 'low' END AS prio FROM findings_v)
WHERE (lower(label) = 'high' OR prio = 'high') AND contains(lower(category), 'auth')
  AND (contains(lower(vuln_type), 'missing') OR contains(lower('Found ' || vuln_type || ' in ' || instruction), 'missing') OR contains(lower(finding_id), 'missing'))"""))
def _(spark, sf):
    return FN.query_findings(labelled(spark, sf), "HIGH", "auth", "Missing").select("seq", "severity", "category")


@query("configured_findings", with_sql(FINDINGS_SQL, body="""
SELECT seq, category, severity FROM findings_v WHERE severity >= 3 AND category IN ('Authentication', 'Arithmetic', 'PDA Security')
  AND category NOT IN ('PDA Security') ORDER BY severity DESC, seq LIMIT 500"""))
def _(spark, sf):
    return FN.apply_config(V.findings(spark, sf), 3, ["Authentication", "Arithmetic", "PDA Security"], ["PDA Security"], 500,
                           [F.desc("severity"), F.asc("seq")]).select("seq", "category", "severity")


@query("confident_findings", with_sql(FINDINGS_SQL, body="SELECT seq FROM findings_v WHERE confidence >= 40"))
def _(spark, sf):
    return FN.min_confidence(V.findings(spark, sf), 40).select("seq")


_PROFILE_SQL = "CASE WHEN user_id % 3 = 0 THEN 'RustInfrastructure' ELSE 'AnchorProgram' END"
_profile = lambda: F.when(F.col("user_id") % 3 == 0, "RustInfrastructure").otherwise("AnchorProgram")
_NOISE_SQL = (f"({_PROFILE_SQL} = 'RustInfrastructure' AND (regexp_matches(finding_id, '^({'|'.join(FN.NOISE_PREFIXES)})') OR contains(category, 'Anchor') "
              f"OR category IN ({', '.join(repr(c) for c in FN.NOISE_CATEGORIES)})))")


@query("profile_suppression", with_sql(FINDINGS_SQL, body=f"SELECT seq FROM findings_v WHERE NOT {_NOISE_SQL}"))
def _(spark, sf):
    return FN.suppress_for_profile(V.findings(spark, sf), _profile()).select("seq")


_SYNTH_SQL = "(starts_with(lower(instruction), 'proof_') AND line_number <= 1)"
_MIRROR_SQL = """(starts_with(finding_id, 'SEC3-') AND starts_with(lower(instruction), 'proof_') AND EXISTS (SELECT 1 FROM findings_v k
  WHERE starts_with(k.finding_id, 'KANI-') AND k.program = f.program AND lower(substring(k.finding_id, 6)) = substring(lower(f.instruction), 7)))"""


@query("synthetic_removed", with_sql(FINDINGS_SQL, body=f"SELECT seq FROM findings_v WHERE NOT {_SYNTH_SQL}"))
def _(spark, sf):
    return FN.drop_synthetic(V.findings(spark, sf)).select("seq")


@query("mirrors_removed", with_sql(FINDINGS_SQL, body=f"SELECT seq FROM findings_v f WHERE NOT {_MIRROR_SQL}"))
def _(spark, sf):
    return FN.drop_mirrors(V.findings(spark, sf), BY).select("seq")


_RN = lambda part, order, n, src: (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {src}) WHERE rn <= {n}")
_SEV = "severity DESC, confidence DESC, seq"


@query("best_of_duplicates", with_sql(FINDINGS_SQL, "r AS (" + _RN("vuln_type, instruction, line_number", "confidence DESC, seq", 1, "findings_v") + ")",
                                      body="SELECT seq, vuln_type, instruction, line_number, confidence FROM r"))
def _(spark, sf):
    return FN.dedup_best(V.findings(spark, sf), []).select("seq", "vuln_type", "instruction", "line_number", "confidence")


@query("category_caps", with_sql(FINDINGS_SQL, "r AS (" + _RN("program, category", _SEV, 10, "findings_v") + ")", body="SELECT seq, program, category FROM r"))
def _(spark, sf):
    return FN.cap_per(V.findings(spark, sf), ["program", "category"], 10).select("seq", "program", "category")


@query("type_caps", with_sql(FINDINGS_SQL, "r AS (" + _RN("vuln_type", _SEV, 5, "findings_v") + ")", body="SELECT seq, vuln_type FROM r"))
def _(spark, sf):
    return FN.cap_per(V.findings(spark, sf), ["vuln_type"], 5).select("seq", "vuln_type")


@query("fingerprint_dedup", """SELECT doc_id, fp FROM (SELECT doc_id, sha256(text) AS fp, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn
FROM documents) WHERE rn = 1""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    return FN.dedup_fingerprint(d, "fp", "doc_id")


_CONS = ("s1 AS (SELECT * FROM findings_v f WHERE NOT " + _MIRROR_SQL + ")",
         f"s2 AS (SELECT * FROM s1 WHERE NOT {_SYNTH_SQL} AND NOT {_NOISE_SQL} AND confidence >= 20)",
         "s3 AS (" + _RN("program, vuln_type, instruction, line_number", "confidence DESC, seq", 1, "s2") + ")",
         "s4 AS (" + _RN("program, category", _SEV, 10, "s3") + ")", "s5 AS (" + _RN("program, vuln_type", _SEV, 5, "s4") + ")")


def consolidated(spark, sf):
    """With the caps per category and type, which these reports have."""
    return FN.consolidate(V.findings(spark, sf), BY, _profile(), 20, 10, 5)


@query("consolidated_findings", with_sql(FINDINGS_SQL, *_CONS, body="SELECT program, finding_id, category, vuln_type, severity, confidence, seq FROM s5"))
def _(spark, sf):
    return consolidated(spark, sf).select("program", "finding_id", "category", "vuln_type", "severity", "confidence", "seq")


@query("union_of_engines", with_sql(FINDINGS_SQL, V.CODE_SQL, V.LINES_SQL, body="""
SELECT engine, category, COUNT(*) AS n, SUM(severity)::BIGINT AS severity_sum, COUNT(confidence) AS with_confidence FROM (
  SELECT engine, category, severity, confidence FROM findings_v
  UNION ALL SELECT 'GEI-LINE', 'RawPointer', 5, 92 FROM code_lines WHERE contains(text, '.offset(')
  UNION ALL SELECT 'PROSE', 'Personal Data', 4, NULL FROM documents WHERE contains(text, '@')) GROUP BY ALL"""))
def _(spark, sf):
    from auditloom.operators import source as S
    lines = S.explode_lines(V.code(spark, sf), "content", ["doc_id", "path"]).where(F.contains("text", F.lit(".offset(")))
    unsafe = lines.select(F.lit("GEI-LINE").alias("engine"), "path", F.lit("RawPointer").alias("category"), F.lit(5).alias("severity"),
                          F.lit(92).alias("confidence"), F.col("line_no").alias("line_number"))
    prose = V.table(spark, sf, "documents").where(F.contains("text", F.lit("@"))).select(
        F.lit("PROSE").alias("engine"), F.lit("Personal Data").alias("category"), F.lit(4).alias("severity"))
    u = FN.union_findings(V.findings(spark, sf), unsafe, prose)
    return u.groupBy("engine", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").alias("severity_sum"),
                                               F.count("confidence").alias("with_confidence"))


_ROOT_SQL = """strong AS (SELECT * FROM findings_v WHERE confidence >= 85),
grp AS (SELECT vuln_type, instruction, SUM(risk)::BIGINT AS risk_sum, COUNT(*) AS instances, MIN(seq) AS first_seq FROM strong GROUP BY ALL),
led AS (SELECT g.*, s.finding_id AS primary_id, s.confidence AS c, s.risk AS r,
   CAST(CASE WHEN g.vuln_type IN ('Missing Event Emission', 'Missing IDL Description') THEN 1 WHEN g.vuln_type = 'Missing Pause Mechanism' AND s.risk < 50000 THEN 2 ELSE s.severity END AS INTEGER) AS adjusted_severity,
   CAST(CASE WHEN g.vuln_type IN ('Missing Signer Validation', 'Authority Bypass') THEN 10 WHEN g.vuln_type = 'Integer Overflow/Underflow' THEN 20 ELSE 60 END AS INTEGER) AS effort
   FROM grp g JOIN strong s ON s.seq = g.first_seq),
ranked AS (SELECT vuln_type, instruction, primary_id, instances, adjusted_severity, effort,
   (least(risk_sum, 1200000) * c * adjusted_severity)::DOUBLE / 100 AS risk_score, adjusted_severity >= 4 AND effort <= 30 AS quick_win FROM led)"""


@query("root_causes", with_sql(FINDINGS_SQL, _ROOT_SQL, body="SELECT * FROM ranked"))
def _(spark, sf):
    return FN.rank_root_causes(V.findings(spark, sf), [])


@query("root_cause_members", with_sql(FINDINGS_SQL, body="SELECT vuln_type, instruction, finding_id, seq FROM findings_v WHERE confidence >= 85"))
def _(spark, sf):
    return FN.root_cause_members(V.findings(spark, sf), [])


@query("critical_path", with_sql(FINDINGS_SQL, _ROOT_SQL, body="SELECT primary_id, risk_score FROM ranked ORDER BY risk_score DESC, vuln_type, instruction LIMIT 5"))
def _(spark, sf):
    return FN.critical_path(V.findings(spark, sf), [])


# ---------------------------------------------------------------- scores
_N = lambda s: f"COUNT(*) FILTER (WHERE severity = {s})"
_LEVELS_SQL = ", ".join(f"{_N(v)} AS {k}_count" for k, v in SC.LEVELS.items())


@query("severity_counts", with_sql(FINDINGS_SQL, body=f"SELECT program, COUNT(*) AS total, {_LEVELS_SQL}, SUM(risk)::BIGINT AS risk_total FROM findings_v GROUP BY program"))
def _(spark, sf):
    return SC.severity_counts(V.findings(spark, sf), BY)


@query("severity_matrix", with_sql(FINDINGS_SQL, body="SELECT category, " + ", ".join(f"{_N(n)} AS sev_{n}" for n in range(1, 6)) + " FROM findings_v GROUP BY category"))
def _(spark, sf):
    return SC.severity_matrix(V.findings(spark, sf))


@query("category_share", with_sql(FINDINGS_SQL, body="SELECT category, COUNT(*) AS n, COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER ()::DOUBLE AS pct FROM findings_v GROUP BY category"))
def _(spark, sf):
    return SC.category_share(V.findings(spark, sf))


_FAMILIES = {"ast": (("Authentication", "Authorization"), 10), "account": (("Account Validation", "Account Management"), 10),
             "unsafe": (("Arithmetic",), 5), "pda": (("PDA Security",), 0), "validator": ((), 0)}


@query("family_status", with_sql(FINDINGS_SQL, body=" UNION ALL ".join(
    f"SELECT '{f}' AS family, COUNT(*) AS n, CASE WHEN COUNT(*) > {lim} THEN 'warn' ELSE 'pass' END AS status FROM findings_v WHERE "
    + (f"category IN ({', '.join(repr(c) for c in cats)})" if cats else "false") for f, (cats, lim) in _FAMILIES.items())))
def _(spark, sf):
    return SC.family_status(V.findings(spark, sf), _FAMILIES)


@query("top_types", with_sql(FINDINGS_SQL, body="SELECT vuln_type, COUNT(*) AS n FROM findings_v GROUP BY 1 ORDER BY n DESC, vuln_type LIMIT 10"))
def _(spark, sf):
    return SC.top_types(V.findings(spark, sf))


_ADVICE = {t: f"Fix {t.lower()} in {{n}} places" for t in V.TYPES[:4]}


@query("type_recommendations", with_sql(FINDINGS_SQL, "top AS (SELECT vuln_type, COUNT(*) AS n FROM findings_v GROUP BY 1 ORDER BY n DESC, vuln_type LIMIT 3)",
    body=f"SELECT vuln_type, replace({_CASE('vuln_type', _ADVICE)}, '{{n}}', n::VARCHAR) AS advice FROM top WHERE vuln_type IN ({', '.join(repr(t) for t in _ADVICE)})"))
def _(spark, sf):
    return SC.recommendations(SC.top_types(V.findings(spark, sf)), _ADVICE)


@query("capped_risk", with_sql(FINDINGS_SQL, REPORTS_SQL, body="""SELECT program, day, CAST(least(100, 40 * critical_count + 20 * high_count + 10 * medium_count + 5 * low_count) AS BIGINT) AS risk
FROM reports_v"""))
def _(spark, sf):
    c = lambda n: F.col(n + "_count")
    return V.reports(spark, sf).select("program", "day", SC.risk_score(c("critical"), c("high"), c("medium"), c("low")).alias("risk"))


_FIN_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SC.FINANCIAL_TENTHS.items()) + " ELSE 50 END"


@query("program_risk", with_sql(FINDINGS_SQL, *_CONS, f"""g AS (SELECT program, SUM(severity)::DOUBLE AS s, SUM({_FIN_SQL})::DOUBLE AS w, COUNT(*)::DOUBLE AS n,
  COUNT(*) FILTER (WHERE severity = 5) AS critical_count FROM s5 GROUP BY program),
h AS (SELECT program, critical_count, s * 2.0::DOUBLE / n AS technical, least(10.0::DOUBLE, w / 10.0::DOUBLE / n) AS financial FROM g),
i AS (SELECT *, least(10.0::DOUBLE, technical * 0.4::DOUBLE + financial * 0.6::DOUBLE) AS overall FROM h),
j AS (SELECT *, CAST(floor(greatest(0.0::DOUBLE, 100.0::DOUBLE - round(overall * 10.0::DOUBLE, 9))) AS INTEGER) AS score FROM i)""",
    body="""SELECT program, critical_count, round(technical, 4) AS technical, round(financial, 4) AS financial, round(overall, 4) AS overall, score,
 CASE WHEN score >= 90 AND critical_count = 0 THEN 'SAFE TO DEPLOY' WHEN critical_count > 0 THEN 'DO NOT DEPLOY' WHEN score < 60 THEN 'UNSAFE' ELSE 'REVIEW REQUIRED' END AS advice FROM j"""))
def _(spark, sf):
    r = SC.program_risk(consolidated(spark, sf), BY)
    return r.select("program", "critical_count", *[F.round(c, 4).alias(c) for c in ("technical", "financial", "overall")], "score", "advice")


@query("health_score", with_sql(FINDINGS_SQL, REPORTS_SQL, body="""SELECT program, strftime(ts, '%Y-%m-%d') AS day,
 CAST(greatest(0, 100 - SUM(CASE severity WHEN 5 THEN 15 WHEN 4 THEN 10 WHEN 3 THEN 5 WHEN 2 THEN 2 ELSE 0 END)) AS BIGINT) AS health FROM findings_v GROUP BY ALL"""))
def _(spark, sf):
    return SC.health_score(V.findings(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["program", "day"])


_UNSAFE_SQL = "unsafe_hits AS (" + " UNION ALL ".join(
    f"SELECT repo, '{c}' AS category, {w} AS w FROM code_lines WHERE regexp_matches(text, '{p}') AND NOT regexp_matches(text, '^\\s*(//|/\\*|\\*)') AND trim(text) <> ''"
    for c, w, p in (("RawPointer", 500, r"\.offset\("), ("TransmuteCall", 700, r"transmute\s*[:<(]"), ("UnsafeFunction", 800, r"\bunsafe\s+fn\s+\w+"))) + ")"


@query("safety_score", with_sql(V.CODE_SQL, V.LINES_SQL, _UNSAFE_SQL, body="""
SELECT repo, t.lines, CAST(floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - coalesce(p, 0)::DOUBLE / t.lines))) AS INTEGER) AS safety
FROM (SELECT repo, COUNT(*) AS lines FROM code_lines GROUP BY repo) t LEFT JOIN (SELECT repo, SUM(w)::BIGINT AS p FROM unsafe_hits GROUP BY repo) h USING (repo)"""))
def _(spark, sf):
    from auditloom.operators import scan, source as S
    from auditloom.rules.lines import LineRule, UNSAFE_FN
    lines = S.explode_lines(V.code(spark, sf), "content", ["repo"])
    rules = (LineRule("o", r"\.offset\(", "RawPointer", 5, ""), LineRule("t", r"transmute\s*[:<(]", "TransmuteCall", 5, ""),
             LineRule("f", UNSAFE_FN, "UnsafeFunction", 4, ""))
    hits = scan.scan_lines(S.drop_comments(lines), rules, "text", ["repo"])
    return SC.safety_score(hits, lines.groupBy("repo").agg(F.count(F.lit(1)).alias("lines")), ["repo"])


_METRIC = {"missing_signer": "vuln_type = 'Missing Signer Validation' AND severity = 5", "missing_owner": "vuln_type = 'Missing Owner Check' AND severity = 5",
           "missing_pda": "category = 'PDA Security' AND severity = 5", "missing_cpi_guard": "vuln_type = 'Arbitrary CPI' AND severity = 5",
           "weak_constraint": "k = 1", "reinit": "k = 2", "missing_close_guard": "k = 3", "token_hooks": "k < 60", "custom_constraints": "k >= 20"}


@query("constraint_score", with_sql(FINDINGS_SQL, "m AS (SELECT program, strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(
    f"COUNT(*) FILTER (WHERE {c}) AS {n}" for n, c in _METRIC.items()) + """,
  SUM(CASE severity WHEN 5 THEN 10 WHEN 4 THEN 6 WHEN 3 THEN 2 ELSE 1 END)::DOUBLE AS half FROM findings_v GROUP BY ALL)""",
    body="""SELECT program, day, CAST(floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - missing_signer * 15 - missing_owner * 12 - missing_pda * 10
 - missing_cpi_guard * 18 - weak_constraint * 8 - reinit * 20 - missing_close_guard * 10 + token_hooks * 5 + custom_constraints * 2 - half / 2.0::DOUBLE))) AS INTEGER) AS score FROM m"""))
def _(spark, sf):
    f = V.findings(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    by = ["program", "day"]
    m = f.groupBy(*by).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _METRIC.items()])
    return SC.constraint_score(m, f, by)


@query("latest_audit_score", with_sql(FINDINGS_SQL, REPORTS_SQL, body="""SELECT program, COUNT(*) AS audits,
 CAST(greatest(0, 100 - 25 * arg_max(critical_count, day) - 15 * arg_max(high_count, day) - 5 * arg_max(medium_count, day) - arg_max(low_count, day)) AS BIGINT) AS score,
 true AS has_records FROM reports_v GROUP BY program"""))
def _(spark, sf):
    return SC.latest_score(V.reports(spark, sf), "program", "day")


@query("registry_history", with_sql(FINDINGS_SQL, REPORTS_SQL, body="""SELECT program, day, 'audit' AS kind, total AS amount FROM reports_v WHERE program = '7'
UNION ALL SELECT program, strftime(ts, '%Y-%m-%d') AS day, 'exploit' AS kind, severity::BIGINT AS amount FROM findings_v WHERE program = '7' AND severity = 5"""))
def _(spark, sf):
    from auditloom.sources.registry import registry_history
    audits = V.reports(spark, sf).select("program", "day", F.lit("audit").alias("kind"), F.col("total").alias("amount"))
    exploits = V.findings(spark, sf).where("severity = 5").select("program", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                                                                  F.lit("exploit").alias("kind"), F.col("severity").cast("long").alias("amount"))
    return registry_history(audits.unionByName(exploits), "program", "7", "day")


@query("fallback_score", with_sql(FINDINGS_SQL, REPORTS_SQL, body="""SELECT program, day, CAST(CASE WHEN total % 3 = 0 THEN total
 ELSE greatest(0, 100 - 5 * critical_count - 2 * high_count - medium_count) END AS BIGINT) AS score FROM reports_v"""))
def _(spark, sf):
    stored = F.when(F.col("total") % 3 == 0, F.col("total"))
    return V.reports(spark, sf).select("program", "day", SC.fallback_score(
        stored, F.col("critical_count"), F.col("high_count"), F.col("medium_count")).alias("score"))


@query("vote_consensus", with_sql(VOTES_SQL, """g AS (SELECT finding_id, COUNT(*) AS votes, SUM(w) AS t, coalesce(SUM(w) FILTER (WHERE verdict = 'Confirmed'), 0) AS c,
  coalesce(SUM(w) FILTER (WHERE verdict = 'Rejected'), 0) AS r, SUM(w * conf_pct) AS wc FROM (SELECT *, CASE model WHEN 'system' THEN 8 ELSE 10 END AS w FROM votes_v) GROUP BY 1),
h AS (SELECT *, greatest(c, r)::DOUBLE / t AS a, wc::DOUBLE / t / 100 AS m,
   CASE WHEN c > r AND 10 * c >= 6 * t THEN 'Confirmed' WHEN r > c AND 10 * r >= 6 * t THEN 'Rejected' ELSE 'Uncertain' END AS verdict FROM g)""",
    body="""SELECT finding_id, votes, round(a, 6) AS agreement, round(m, 6) AS mean_confidence, verdict, verdict = 'Confirmed' AND wc >= 50 * t AS should_report FROM h"""))
def _(spark, sf):
    v = V.votes(spark, sf).withColumn("confidence", F.col("conf_pct") / 100.0)
    models = constant_rows(spark, [{"model": m, "weight": t / 10.0} for m, t in SC.MODEL_TENTHS.items()])
    c = SC.consensus(v, models)
    return c.select("finding_id", "votes", F.round("agreement", 6).alias("agreement"), F.round("mean_confidence", 6).alias("mean_confidence"),
                    "verdict", "should_report")


_ITEMS = {"Authority accounts enforce signer": "Authentication", "Arithmetic uses checked operations": "Arithmetic",
          "Price sources are validated": "Price Oracle", "Derived addresses have entropy": "PDA Security",
          "Accounts have owner validation": "Account Validation", "Closures are guarded": "Account Management",
          "Calls validate program id": "CPI Security", "No re-initialization": "Initialization",
          "Remaining accounts validated": "Remaining Accounts", "Accounts cannot be confused": "Account Confusion"}


@query("audit_checklist", with_sql(FINDINGS_SQL, *_CONS, body=" UNION ALL ".join(
    f"SELECT program, '{n}' AS item, NOT bool_or(category = '{c}') AS passed FROM s5 GROUP BY program" for n, c in _ITEMS.items())))
def _(spark, sf):
    return SC.checklist(consolidated(spark, sf), BY, _ITEMS)


@query("metric_stats", """SELECT event_type AS name, COUNT(*) AS n, SUM(v)::BIGINT AS total, MIN(v) AS lo, MAX(v) AS hi, round(SUM(v)::DOUBLE / COUNT(*), 4) AS mean
FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY 1""")
def _(spark, sf):
    m = V.table(spark, sf, "events").select(F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("value_ms"))
    return SC.metric_stats(m).withColumn("mean", F.round("mean", 4))


_SCORED_SQL = "scored AS (SELECT *, CAST(greatest(0, 100 - 5 * critical_count - 2 * high_count - medium_count) AS BIGINT) AS score FROM reports_v)"


def scored(spark, sf):
    return V.reports(spark, sf).withColumn("score", SC.fallback_score(
        F.lit(None).cast("long"), F.col("critical_count"), F.col("high_count"), F.col("medium_count")))


@query("service_totals", with_sql(FINDINGS_SQL, REPORTS_SQL, _SCORED_SQL, body="""SELECT COUNT(*) AS reports, COUNT(DISTINCT program) AS programs, SUM(total)::BIGINT AS findings,
 SUM(critical_count)::BIGINT AS critical, SUM(high_count)::BIGINT AS high, round(SUM(score)::DOUBLE / COUNT(*), 4) AS mean_score FROM scored"""))
def _(spark, sf):
    return SC.totals(scored(spark, sf)).withColumn("mean_score", F.round("mean_score", 4))


@query("worst_programs", with_sql(FINDINGS_SQL, REPORTS_SQL, _SCORED_SQL, body="SELECT program, MIN(score) AS worst FROM scored GROUP BY program ORDER BY worst, program LIMIT 20"))
def _(spark, sf):
    return scored(spark, sf).groupBy("program").agg(F.min("score").alias("worst")).orderBy("worst", "program").limit(20)


@query("triage_counts", """SELECT coalesce(CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'Fixed' WHEN l.toxic = 1 THEN 'Triaged' ELSE 'Ignored' END, 'open') AS status,
 COUNT(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(spark, sf):
    tri = V.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "Fixed").when(F.col("toxic") == 1, "Triaged").otherwise("Ignored").alias("status"))
    return SC.triage_counts(V.table(spark, sf, "documents"), tri, "doc_id")


@query("analysis_coverage", with_sql(FINDINGS_SQL, REPORTS_SQL, body="""SELECT program, day, round(on_n * 100.0::DOUBLE / 5, 4) AS coverage_pct,
 round(CASE WHEN on_n * 20 >= 80 THEN 0.95::DOUBLE ELSE on_n * 100.0::DOUBLE / 5 / 100 END, 4) AS confidence,
 CAST(least(100, base + CASE WHEN total > 10 THEN 10 ELSE 0 END + CASE WHEN critical_count > 0 THEN 20 ELSE 0 END + CASE WHEN high_count > 2 THEN 15 ELSE 0 END) AS BIGINT) AS enhanced_risk
FROM (SELECT *, (critical_count > 0)::INT + (high_count > 0)::INT + (medium_count > 0)::INT + (low_count > 0)::INT + (total > 5)::INT AS on_n,
   least(100, 40 * critical_count + 20 * high_count + 10 * medium_count + 5 * low_count) // 2 AS base FROM reports_v)"""))
def _(spark, sf):
    c = lambda n: F.col(n + "_count")
    r = V.reports(spark, sf).select("*", *[(c(n) > 0).alias("f_" + n) for n in SC.LEVELS], (F.col("total") > 5).alias("f_all"))
    base = F.floor(SC.risk_score(c("critical"), c("high"), c("medium"), c("low")) / 2)
    out = SC.coverage_summary(r, [*("f_" + n for n in SC.LEVELS), "f_all"], base, {
        "taint": (F.col("total") > 10, 10), "oracle": (c("critical") > 0, 20), "loan": (c("high") > 2, 15)})
    return out.select("program", "day", F.round("coverage_pct", 4).alias("coverage_pct"), F.round("confidence", 4).alias("confidence"), "enhanced_risk")


_RUNS_SQL = """runs AS (SELECT event_type AS name, event_id AS run, CAST(round(value * 100) AS BIGINT) AS centis, CAST(user_id AS BIGINT) AS files, event_id % 50 AS findings FROM events)"""


def bench_runs(spark, sf):
    return V.table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.col("event_id").alias("run"), F.round(F.col("value") * 100).cast("long").alias("seconds"),
        F.col("user_id").alias("files"), (F.col("event_id") % 50).alias("findings"))


@query("bench_stats", with_sql(_RUNS_SQL, body="""SELECT name, COUNT(*) AS runs, round(SUM(centis)::DOUBLE / COUNT(*), 4) AS mean_s, MIN(centis) AS min_s, MAX(centis) AS max_s,
 MAX(files) AS files, round(MAX(files) / (SUM(centis)::DOUBLE / COUNT(*)), 6) AS throughput FROM runs GROUP BY name"""))
def _(spark, sf):
    return SC.bench_stats(bench_runs(spark, sf)).withColumn("mean_s", F.round("mean_s", 4)).withColumn("throughput", F.round("throughput", 6))


@query("bench_compare", with_sql(_RUNS_SQL, "last AS (SELECT name, arg_max(centis, run) AS s, arg_max(findings, run) AS f FROM runs GROUP BY name)",
    body="""SELECT a.name AS a, b.name AS b, round(a.s::DOUBLE / b.s, 6) AS speedup, b.f - a.f AS findings_diff FROM last a JOIN last b ON b.name = 'view'"""))
def _(spark, sf):
    runs = bench_runs(spark, sf)
    pairs = runs.select(F.col("name").alias("a")).distinct().withColumn("b", F.lit("view"))
    return SC.bench_compare(runs, pairs).withColumn("speedup", F.round("speedup", 6))


_STATUS = ("verified", "failed", "undetermined")


@query("verification_summary", f"""SELECT o_orderpriority AS category, COUNT(*) AS total, COUNT(*) FILTER (WHERE s = 'verified') AS verified, COUNT(*) FILTER (WHERE s = 'failed') AS failed,
 COUNT(*) FILTER (WHERE s = 'undetermined') AS undetermined FROM (SELECT *, {V.choose_sql(_STATUS, 'o_custkey')} AS s FROM orders) GROUP BY 1""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), V.choose(_STATUS, F.col("o_custkey")).alias("status"))
    return SC.verification_summary(o, ["category"])


_RUN_EDGES_SQL = "run_edges AS (SELECT l_orderkey AS run_id, l_partkey AS edge_id, sha256(l_partkey || ':' || l_suppkey) AS hash FROM lineitem)"


def run_edges(spark, sf):
    return V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("edge_id"),
                                                 F.sha2(F.concat_ws(":", "l_partkey", "l_suppkey"), 256).alias("hash"))


@query("coverage_totals", with_sql(_RUN_EDGES_SQL, body="""SELECT COUNT(DISTINCT edge_id) AS edges, COUNT(DISTINCT hash) AS paths, COUNT(DISTINCT run_id) AS runs,
 round(COUNT(DISTINCT edge_id) * 100.0::DOUBLE / 65536, 4) AS coverage_pct FROM run_edges"""))
def _(spark, sf):
    return SC.coverage_rollup(run_edges(spark, sf), 65536)[0].withColumn("coverage_pct", F.round("coverage_pct", 4))


@query("coverage_first_run", with_sql(_RUN_EDGES_SQL, body="SELECT edge_id, MIN(run_id) AS first_run, COUNT(*) AS hits FROM run_edges GROUP BY 1"))
def _(spark, sf):
    return SC.coverage_rollup(run_edges(spark, sf), 65536)[1]


_STATS_SQL = r"""st AS (SELECT doc_id, COUNT(*) FILTER (WHERE regexp_matches(text, '^\s*pub \w+: ')) AS accounts, COUNT(*) FILTER (WHERE regexp_matches(text, '\bfn\s+(\w+)')) AS fns,
  COUNT(*) FILTER (WHERE regexp_matches(text, 'require|assert')) AS checks, COUNT(*) FILTER (WHERE regexp_matches(text, 'borrow_mut|\.balance = ')) AS muts,
  COUNT(*) FILTER (WHERE regexp_matches(text, 'Signer<|is_signer')) AS signers FROM code_lines GROUP BY doc_id)"""
_ANOM = lambda m, e, cat, num, den: (f"SELECT doc_id, '{m}' AS metric, '{cat}' AS category, {num}::DOUBLE / {den} AS o, {e}::DOUBLE AS e FROM st WHERE fns > 0")


@query("baseline_anomalies", with_sql(V.CODE_SQL, V.LINES_SQL, _STATS_SQL, "obs AS (" + " UNION ALL ".join((
    _ANOM("account_to_instruction_ratio", 2.5, "UnusualAccountPattern", "accounts", "fns"),
    _ANOM("check_to_mutation_ratio", 1.2, "StateInconsistency", "checks", "greatest(muts, 1)"),
    _ANOM("signer_check_frequency", 0.8, "AuthorizationBypass", "signers", "fns"))) + ")", body="""
SELECT doc_id, metric, category, round(o, 4) AS observed, round(abs(o - e) / e, 4) AS deviation, CAST(CASE WHEN abs(o - e) / e > 1.5 THEN 4 WHEN abs(o - e) / e > 1.0 THEN 3 ELSE 2 END AS INTEGER) AS severity,
 round(least(abs(o - e) / e / 2, 0.95::DOUBLE), 4) AS confidence FROM obs WHERE abs(o - e) / e > 0.75"""))
def _(spark, sf):
    from auditloom.operators.source import file_ratios
    a = SC.baseline_anomalies(file_ratios(V.code(spark, sf), "content", ["doc_id"]), ["doc_id"])
    return a.select("doc_id", "metric", "category", F.round("observed", 4).alias("observed"), F.round("deviation", 4).alias("deviation"), "severity",
                    F.round("confidence", 4).alias("confidence"))


_METHODS = tuple(SC.METHOD_WEIGHT)


@query("ensemble_scores", with_sql(FINDINGS_SQL, body=f"""SELECT seq, method, round(least(0.99::DOUBLE, confidence / 100.0::DOUBLE * ({_CASE('method', SC.METHOD_WEIGHT)})::DOUBLE
 * (CASE severity WHEN 5 THEN 1.2 WHEN 4 THEN 1.1 WHEN 3 THEN 1.0 WHEN 2 THEN 0.9 ELSE 0.8 END)::DOUBLE), 4) AS ensemble_score
FROM (SELECT *, {V.choose_sql(_METHODS, 'k')} AS method FROM findings_v)"""))
def _(spark, sf):
    f = V.findings(spark, sf).select("seq", "severity", (F.col("confidence") / 100.0).alias("confidence"), V.choose(_METHODS, F.col("k")).alias("method"))
    return SC.ensemble(f).select("seq", "method", F.round("ensemble_score", 4).alias("ensemble_score"))


_IV_SQL = "iv AS (SELECT l_partkey AS key, CAST(l_quantity AS BIGINT) - 10 AS lo, CAST(l_quantity AS BIGINT) - 10 + l_linenumber * 12 - 6 AS hi FROM lineitem)"


def intervals(spark, sf):
    q = F.col("l_quantity").cast("long").cast("decimal(38,0)") - 10
    return V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), q.cast("decimal(38,0)").alias("lo"),
                                                 (q + F.col("l_linenumber") * 12 - 6).cast("decimal(38,0)").alias("hi"))


@query("interval_hulls", with_sql(_IV_SQL, body="SELECT key, MIN(lo)::BIGINT AS lo, MAX(hi)::BIGINT AS hi, MAX(hi) > 18446744073709551615 OR MIN(lo) < 0 AS may_overflow, MIN(lo) < 0 AS may_underflow FROM iv WHERE lo <= hi GROUP BY key"))
def _(spark, sf):
    h = SC.interval_flags(SC.interval_hull(intervals(spark, sf), ["key"]))
    return h.withColumn("lo", F.col("lo").cast("long")).withColumn("hi", F.col("hi").cast("long"))


@query("interval_meets", with_sql(_IV_SQL, body="SELECT key, MAX(lo)::BIGINT AS lo, MIN(hi)::BIGINT AS hi, MAX(lo) > MIN(hi) AS is_empty FROM iv GROUP BY key"))
def _(spark, sf):
    h = SC.interval_meet(intervals(spark, sf), ["key"])
    return h.withColumn("lo", F.col("lo").cast("long")).withColumn("hi", F.col("hi").cast("long"))


@query("scan_stats", with_sql(V.CODE_SQL, V.LINES_SQL, r"""f AS (SELECT repo, path, line_no, text, coalesce(last_value(CASE WHEN regexp_matches(text, '\bfn\s+(\w+)') THEN regexp_extract(text, '\bfn\s+(\w+)', 1) END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'unknown') AS instruction FROM code_lines)""",
    body=r"""SELECT repo, COUNT(DISTINCT path) AS files, COUNT(DISTINCT instruction) AS instructions, COUNT(DISTINCT nullif(regexp_extract(text, '(\w+):\s*(Account|Signer|AccountInfo|UncheckedAccount)\b', 1), '')) AS accounts,
 COUNT(*) AS lines FROM f GROUP BY repo"""))
def _(spark, sf):
    from auditloom.operators import source as S
    l = S.enclosing_fn(V.code(spark, sf), "content", ["repo", "path"])
    name = F.nullif(F.regexp_extract("text", r"(\w+):\s*(Account|Signer|AccountInfo|UncheckedAccount)\b", 1), F.lit(""))
    per = l.groupBy("repo", "path", F.col("fn_name").alias("instruction"), name.alias("account")).agg(F.count(F.lit(1)).alias("lines"))
    return SC.scan_stats(per, ["repo"], "account")


# ---------------------------------------------------------------- evidence, economics, verdict
_EV_SQL = """ev AS (SELECT seq, vuln_type, category, CASE severity WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INFO' END AS sev,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'Found ' || vuln_type || ' in ' || instruction || CASE WHEN k % 5 = 0 THEN ', require a check' ELSE '' END END AS description,
  CASE WHEN k % 3 = 0 THEN 'attacker uses a flash loan and sandwich' WHEN k % 3 = 1 THEN 'attacker calls the handler twice' ELSE '' END AS attack,
  CASE WHEN k % 2 = 0 THEN 'fix' ELSE '' END AS fix, CASE WHEN k % 7 < 3 THEN 'loss' ELSE '' END AS impact, CASE WHEN k % 2 = 1 THEN risk // 100 ELSE 0 END AS var_usd,
  CASE WHEN k % 6 = 0 THEN 0.0::DOUBLE ELSE confidence / 100.0::DOUBLE END AS conf, CASE WHEN k % 9 = 0 THEN 'CWE-367' WHEN k % 9 = 1 THEN 'CWE-200' ELSE '' END AS cwe, line_number,
  CASE WHEN k % 8 = 0 THEN 'proof of concept text' ELSE '' END AS poc, CASE WHEN k % 11 = 0 THEN 'mitigated' ELSE '' END AS mitigation FROM findings_v)"""


def evidence_rows(spark, sf):
    f, k = V.findings(spark, sf), F.col("k")
    w = lambda c, a, b="": F.when(c, a).otherwise(b)
    return f.select(
        "seq", "vuln_type", "category", T.severity_label(F.col("severity")).alias("sev"),
        w(k % 4 == 0, "", F.concat(F.lit("Found "), "vuln_type", F.lit(" in "), "instruction", w(k % 5 == 0, ", require a check"))).alias("description"),
        F.when(k % 3 == 0, "attacker uses a flash loan and sandwich").when(k % 3 == 1, "attacker calls the handler twice").otherwise("").alias("attack"),
        w(k % 2 == 0, "fix").alias("fix"), w(k % 7 < 3, "loss").alias("impact"), F.when(k % 2 == 1, F.floor(F.col("risk") / 100)).otherwise(0).alias("var_usd"),
        F.when(k % 6 == 0, 0.0).otherwise(F.col("confidence") / 100.0).alias("conf"), F.when(k % 9 == 0, "CWE-367").when(k % 9 == 1, "CWE-200").otherwise("").alias("cwe"),
        "line_number", w(k % 8 == 0, "proof of concept text").alias("poc"), w(k % 11 == 0, "mitigated").alias("mitigation"))


_B = lambda c: f"({c})::INT"
_QUALITY_SQL = " + ".join(_B(c) for c in ("length(description) > 20", "length(attack) > 20", "fix <> ''", "impact <> ''", "var_usd > 0", "conf > 0", "cwe <> ''", "line_number > 0",
                                          "length(poc) > 10", "mitigation <> ''"))
_CLASS_SQL = "CASE " + " ".join("WHEN " + " OR ".join([f"contains(lower(vuln_type), '{w}')" for w in vt] + [f"contains(lower(description), '{w}')" for w in d]
    + [f"contains(category, '{w}')" for w in cat] + [f"cwe = '{c}'" for c in cwe]) + f" THEN '{n}'" for n, vt, d, cat, cwe in SC.CLASSES) + " ELSE 'LogicError' END"
_EV2_SQL = f"ev2 AS (SELECT *, CAST({_QUALITY_SQL} AS INTEGER) AS quality, {_CLASS_SQL} AS vuln_class FROM ev)"
_ECO_SQL = ("eco AS (SELECT *, real_var * 1000.0::DOUBLE / cost AS ratio, CASE WHEN mev THEN CASE WHEN real_var * 1000.0::DOUBLE / cost > 100000 THEN 'HIGH' ELSE 'MODERATE' END "
            "WHEN real_var * 1000.0::DOUBLE / cost > 1000000 THEN 'MODERATE' ELSE 'LOW' END AS exposure FROM (SELECT *, "
            "CAST(CASE WHEN var_usd > 0 THEN var_usd WHEN sev = 'CRITICAL' THEN 10000000 WHEN sev = 'HIGH' THEN 1000000 WHEN sev = 'MEDIUM' THEN 100000 ELSE 10000 END AS BIGINT) AS real_var, "
            "CASE vuln_class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SC.COST_THOUSANDTHS.items()) + " ELSE 10 END AS cost, "
            "vuln_class = 'OracleManipulation' OR regexp_matches(lower(attack), '" + "|".join(SC.MEV_WORDS) + "') AS mev FROM ev2))")


@query("evidence_quality", with_sql(FINDINGS_SQL, _EV_SQL, _EV2_SQL, body="SELECT seq, quality, vuln_class FROM ev2"))
def _(spark, sf):
    return SC.evidence(evidence_rows(spark, sf)).select("seq", "quality", "vuln_class")


@query("economic_exposure", with_sql(FINDINGS_SQL, _EV_SQL, _EV2_SQL, _ECO_SQL, body="SELECT seq, real_var, round(ratio, 4) AS ratio, exposure FROM eco"))
def _(spark, sf):
    return SC.economics(SC.evidence(evidence_rows(spark, sf))).select("seq", "real_var", F.round("ratio", 4).alias("ratio"), "exposure")


@query("multi_factor_verdict", with_sql(FINDINGS_SQL, _EV_SQL, _EV2_SQL, _ECO_SQL, """v1 AS (SELECT *, CASE WHEN sev = 'CRITICAL' AND quality >= 5 AND length(attack) > 20 THEN true
  WHEN sev = 'CRITICAL' AND quality >= 4 AND length(poc) > 10 THEN true WHEN sev = 'HIGH' AND quality >= 5 THEN true
  WHEN sev = 'HIGH' AND length(attack) > 20 AND conf >= 0.7 THEN true ELSE false END AS ag,
  (quality < 2 AND conf < 0.3 AND sev <> 'CRITICAL') OR (quality = 0 AND sev NOT IN ('CRITICAL', 'HIGH')) AS rej FROM eco),
v2 AS (SELECT *, CASE WHEN rej THEN false WHEN quality >= 4 THEN true WHEN quality >= 2 AND length(attack) > 20 THEN true ELSE conf >= 0.5 END AS cor FROM v1)""", body="""
SELECT seq, ag AS agrees, cor AS corroborated, CASE WHEN rej THEN 'REJECTED' WHEN ag OR cor THEN 'CONFIRMED' ELSE 'UNCERTAIN' END AS final_verdict,
  CAST(CASE WHEN rej THEN 2 WHEN ag AND cor THEN 5 WHEN ag OR cor THEN 4 ELSE 3 END AS INTEGER) AS votes_for,
  round(CASE WHEN rej THEN 15.0::DOUBLE ELSE least(99.0::DOUBLE, greatest(25.0::DOUBLE, quality * 5.0::DOUBLE + CASE WHEN conf > 0 THEN least(conf * 15.0::DOUBLE, 15.0::DOUBLE) ELSE 5 END
    + CASE WHEN cor THEN 20 ELSE 5 END + CASE sev WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 2 END + CASE WHEN ag THEN 5 ELSE -5 END)) END, 4) AS final_confidence,
  round(real_var * (1.0::DOUBLE - CASE WHEN ag THEN 0.0::DOUBLE ELSE greatest(0.2::DOUBLE, least(0.7::DOUBLE, least(10 - quality, 8) * 0.1::DOUBLE)) END), 2) AS adjusted_var,
  CASE WHEN rej THEN sev WHEN NOT ag AND cor AND sev IN ('LOW', 'MEDIUM') THEN 'HIGH' WHEN ag AND cor AND sev = 'HIGH' AND quality >= 7 THEN 'CRITICAL' ELSE sev END AS final_severity FROM v2"""))
def _(spark, sf):
    v = SC.verdict(SC.economics(SC.evidence(evidence_rows(spark, sf))))
    return v.select("seq", "agrees", "corroborated", "final_verdict", "votes_for", F.round("final_confidence", 4).alias("final_confidence"),
                    F.round("adjusted_var", 2).alias("adjusted_var"), "final_severity")


# ---------------------------------------------------------------- reports
@query("preferred_reports", with_sql(FINDINGS_SQL, REPORTS_SQL, """src AS (SELECT program || '_' || day || '_report.json' AS file, CASE WHEN total % 2 = 0 THEN 'production' ELSE 'audit' END AS dir, total FROM reports_v
  UNION ALL SELECT program || '_' || day || '_report.json', 'audit', total + 1000 FROM reports_v WHERE total % 3 = 0)""", body="""
SELECT file, dir, total FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY (dir = 'production') DESC, total) AS rn FROM src) WHERE rn = 1"""))
def _(spark, sf):
    from auditloom.sources.reports import prefer_source
    r = V.reports(spark, sf)
    file = F.concat("program", F.lit("_"), "day", F.lit("_report.json")).alias("file")
    a = r.select(file, F.when(F.col("total") % 2 == 0, "production").otherwise("audit").alias("dir"), "total")
    b = r.where("total % 3 = 0").select(file, F.lit("audit").alias("dir"), (F.col("total") + 1000).alias("total"))
    return prefer_source(a.unionByName(b), "file", "dir", "production", ["total"])


@query("report_findings", with_sql(FINDINGS_SQL, body="""SELECT program, vuln_type, COUNT(*) AS n, SUM(severity)::BIGINT AS s FROM findings_v GROUP BY ALL"""))
def _(spark, sf):
    from auditloom.sources.reports import explode_findings
    f = V.findings(spark, sf)
    one = f.select(F.col("program").alias("program_name"), F.concat("program", F.lit("_report.json")).alias("file"), F.col("program").alias("program_id"),
                   F.array(F.struct(F.col("finding_id").alias("id"), "category", F.col("vuln_type").alias("vulnerability_type"), "severity", "instruction")).alias("exploits"))
    e = explode_findings(one)
    return e.groupBy(F.col("program_name").alias("program"), "vuln_type").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").alias("s"))


# ---------------------------------------------------------------- ranges
_SPAN_SQL = """outer_v AS (SELECT c_custkey AS custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS lo,
  CAST(round(c_acctbal * 100) AS BIGINT) + CASE WHEN c_custkey % 100 = 7 THEN 100000 ELSE c_custkey % 7 * 300 - 100 END AS hi FROM customer),
points_v AS (SELECT s_suppkey AS suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS val, CAST(round(s_acctbal * 100) AS BIGINT) + s_suppkey % 5 * 100 - 50 AS until FROM supplier)"""


def spans(spark, sf):
    """(outer, inner): balances in cents as intervals, short ones, a few long ones, and empty ones."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    k = F.col("c_custkey")
    outer = V.table(spark, sf, "customer").select(k.alias("custkey"), cents("c_acctbal").alias("lo"), (cents("c_acctbal") + F.when(k % 100 == 7, 100_000).otherwise(k % 7 * 300 - 100)).alias("hi"))
    inner = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), cents("s_acctbal").alias("val"), (cents("s_acctbal") + F.col("s_suppkey") % 5 * 100 - 50).alias("until"))
    return outer, inner


@query("values_in_intervals", with_sql(_SPAN_SQL, body="SELECT suppkey, custkey FROM points_v JOIN outer_v ON val BETWEEN lo AND hi"))
def _(spark, sf):
    outer, inner = spans(spark, sf)
    return R.values_in(inner, "val", outer).select("suppkey", "custkey")


@query("intervals_in_intervals", with_sql(_SPAN_SQL, body="SELECT suppkey, custkey FROM points_v JOIN outer_v ON val <= until AND val >= lo AND until <= hi"))
def _(spark, sf):
    outer, inner = spans(spark, sf)
    return R.intervals_in(inner, "val", "until", outer).select("suppkey", "custkey")


# ---------------------------------------------------------------- extensions
@query("isolated_analyzers", """SELECT 'short' AS engine, COUNT(*) FILTER (WHERE n_chars < 200) AS findings, false AS failed FROM documents
UNION ALL SELECT 'marked', COUNT(*) FILTER (WHERE contains(text, '@')), false FROM documents UNION ALL SELECT 'breaks', 0, true UNION ALL SELECT 'unknown', 0, true""")
def _(spark, sf):
    """Two analyzers that work, one that fails on one row, one whose plan does not resolve."""
    from auditloom.ext import Registry
    docs = V.table(spark, sf, "documents")
    flaw = lambda df, name: df.select(F.lit(name).alias("category"), F.lit(3).alias("severity"), F.col("source").alias("program"))
    first = docs.agg(F.min("doc_id")).scalar()
    fails = F.when(F.col("doc_id") == first, F.raise_error(F.lit("cannot read this file"))).otherwise(F.lit("ok"))
    reg = Registry()
    reg.register_analyzer("short", lambda df: flaw(df.where("n_chars < 200"), "short"))
    reg.register_analyzer("breaks", lambda df: flaw(df.withColumn("source", F.concat("source", fails.cast("string"))), "breaks"))
    reg.register_analyzer("unknown", lambda df: df.select("no_such_column"))
    reg.register_analyzer("marked", lambda df: flaw(df, "marked"), applies_if=F.contains("text", F.lit("@")))
    found, outcomes = reg.run_isolated(docs)
    n = found.groupBy("engine").agg(F.count(F.lit(1)).alias("n"))
    return outcomes.join(n, "engine", "left").select("engine", F.coalesce("n", F.lit(0)).cast("long").alias("findings"), F.col("error").isNotNull().alias("failed"))


# ---------------------------------------------------------------- files
@query("report_files", with_sql(FINDINGS_SQL, body="""SELECT program AS program_id, COUNT(*) AS actual_exploits, COUNT(*) + 1 AS total_exploits, SUM(severity)::BIGINT AS severity_sum,
 COUNT(*) FILTER (WHERE severity = 5) AS proofs, 'p' || program AS solver, SUM(risk)::BIGINT AS risk_sum FROM findings_v GROUP BY program"""))
def _(spark, sf):
    """Reports written as JSON files, one a program, with fields that no schema knows, and read back."""
    from auditloom.plans.lineage import shared_dir
    from auditloom.sources import reports as RP
    f = V.findings(spark, sf)
    exploit = F.struct(F.col("finding_id").alias("id"), F.col("category"), F.col("vuln_type").alias("vulnerability_type"), F.col("severity"), F.struct(F.struct("risk").alias("loss")).alias("origin"))
    doc = f.groupBy("program").agg(F.collect_list(exploit).alias("exploits"), F.count_if(F.col("severity") == 5).alias("proofs")).select(
        F.col("program").alias("program_id"), (F.size("exploits") + 1).alias("total_exploits"), "exploits",
        F.struct(F.struct(F.concat(F.lit("p"), "program").alias("solver"), "proofs").alias("run")).alias("kani_report"))
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    RP.write_reports(doc, path, "program_id")
    r = RP.read_reports(spark, path)
    get = lambda m, k, p, t: F.variant_get(F.element_at(m, F.lit(k)), p, t)
    risk = F.aggregate("exploit_extras", F.lit(0).cast("long"), lambda a, m: a + get(m, "origin", "$.loss.risk", "long"))
    return r.select("program_id", F.col("actual_exploits").cast("long").alias("actual_exploits"), "total_exploits",
                    F.aggregate("exploits", F.lit(0).cast("long"), lambda a, x: a + x["severity"]).alias("severity_sum"),
                    get(F.col("extras"), "kani_report", "$.run.proofs", "long").alias("proofs"), get(F.col("extras"), "kani_report", "$.run.solver", "string").alias("solver"),
                    risk.alias("risk_sum"))


@query("written_findings", with_sql(FINDINGS_SQL, body="SELECT program, fmt, COUNT(*) AS n, SUM(severity)::BIGINT AS severity_sum, COUNT(DISTINCT finding_id) AS ids FROM findings_v, (SELECT unnest(['json', 'parquet']) AS fmt) GROUP BY ALL"))
def _(spark, sf):
    """Findings written in both formats, one folder a program, and read back."""
    from auditloom.plans.lineage import shared_dir
    from auditloom.sources import reports as RP
    base = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}"
    f, parts = V.findings(spark, sf).select("program", "finding_id", "severity", "category"), []
    for fmt in ("json", "parquet"):
        RP.write_findings(f, f"{base}/{fmt}", fmt)
        back = RP.read_findings(spark, f"{base}/{fmt}", "finding_id string, severity int, category string", fmt)
        parts.append(back.withColumn("fmt", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).groupBy("program", "fmt").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").alias("severity_sum"), F.countDistinct("finding_id").alias("ids"))


_TREE_SQL = """tree_v AS (SELECT p_brand AS repo, p_size AS f, p_partkey, '// ' || p_name || chr(10) || CASE WHEN p_partkey % 9 = 0 THEN 'declare_id!("' || p_brand || p_partkey || '");' ELSE p_type || ';' END AS line FROM part)"""


def source_tree(spark, sf) -> str:
    """A tree of files below the shared folder: a repository for each brand, a file for each size."""
    from auditloom.plans.lineage import shared_dir
    path, c = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", F.col
    body = F.when(c("p_partkey") % 9 == 0, F.concat(F.lit('declare_id!("'), "p_brand", c("p_partkey").cast("string"), F.lit('");'))).otherwise(F.concat("p_type", F.lit(";")))
    lines = V.table(spark, sf, "part").select(c("p_brand").alias("repo"), c("p_size").alias("file"), "p_partkey", F.concat(F.lit("// "), "p_name", F.lit("\n"), body).alias("value"))
    lines.repartition("repo", "file").sortWithinPartitions("repo", "file", "p_partkey").select("repo", "file", "value").write.partitionBy("repo", "file").text(path)
    return path


@query("corpus_files", with_sql(_TREE_SQL, body="""SELECT repo, COUNT(*) AS files, SUM(size)::BIGINT AS size, SUM(len(string_split(content, chr(10))) - 1)::BIGINT AS lines, MIN(sha256(content)) AS first_digest FROM (
SELECT repo, f, string_agg(line || chr(10), '' ORDER BY p_partkey) AS content, SUM(strlen(line) + 1) AS size FROM tree_v GROUP BY ALL) GROUP BY repo"""))
def _(spark, sf):
    from auditloom.sources.corpus import read_corpus
    files = read_corpus(spark, source_tree(spark, sf), "txt")
    repo = F.regexp_replace(F.replace("repo", F.lit("%23"), F.lit("#")), "^repo=", "")
    return files.groupBy(repo.alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.sum(F.size(F.split("content", "\n")) - 1).cast("long").alias("lines"),
                                                 F.min(F.sha2("content", 256)).alias("first_digest"))


@query("program_ids", with_sql(_TREE_SQL, body="""SELECT repo, arg_min(pid, f) AS program_id FROM (SELECT repo, 'file=' || f || '/' AS f, arg_min(repo || p_partkey, p_partkey) AS pid
FROM tree_v WHERE p_partkey % 9 = 0 GROUP BY ALL) GROUP BY repo"""))
def _(spark, sf):
    from auditloom.operators import source as S
    from auditloom.sources.corpus import read_corpus
    files = read_corpus(spark, source_tree(spark, sf), "txt")
    repo = F.regexp_replace(F.replace("repo", F.lit("%23"), F.lit("#")), "^repo=", "")
    return S.program_id(files.withColumn("repo", repo).withColumn("path", F.regexp_extract("path", "(file=[0-9]+/)", 1)), "content", ["repo"])


@query("interface_names", """SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: 'a_' || w) AS accounts, CASE WHEN p_size % 3 = 0 THEN [] ELSE [lower(split_part(p_type, ' ', 1)), split_part(p_type, ' ', 2)] END AS instructions FROM part""")
def _(spark, sf):
    from auditloom.sources.corpus import idl_names
    named = lambda names: F.transform(names, lambda w: F.struct(w.alias("name"), F.lit(True).alias("isMut")))
    doc = F.to_json(F.struct(F.lit("1.0").alias("version"), named(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("a_"), w))).alias("accounts"),
                             F.when(F.col("p_size") % 3 != 0, named(F.array(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.split_part("p_type", F.lit(" "), F.lit(2))))).alias("instructions")))
    return idl_names(V.table(spark, sf, "part").select("p_partkey", doc.alias("doc")), "doc", ["p_partkey"])


@query("user_rules", """SELECT doc_id, 'USER-1' AS rule_id, 4 AS severity FROM documents WHERE contains(text, 'http') AND NOT contains(text, '@')
UNION ALL SELECT doc_id, 'USER-2', 2 FROM documents WHERE regexp_matches(text, '[0-9]{3}')""")
def _(spark, sf):
    """Two rules of a user beside the catalogue, as an analyzer."""
    from auditloom.ext import Registry
    from auditloom.operators import scan
    from auditloom.rules.formula import Has, Matches, Rule
    reg = Registry()
    reg.register_rule(Rule("USER-1", "Link", "Text", 4, None, Has("http") & ~Has("@")))
    reg.register_rule(Rule("USER-2", "Number", "Text", 2, None, Matches("[0-9]{3}")))
    return scan.scan_rules(V.table(spark, sf, "documents"), reg.rules, "text", ["doc_id"]).select("doc_id", "rule_id", "severity")
