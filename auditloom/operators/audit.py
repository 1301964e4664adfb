"""From source files to risk: adapters that bring hits of the scans onto the finding schema, and the whole audit as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.functions.labels import engine_confidence
from auditloom.functions.text import strip_comments
from auditloom.operators import findings as FN, scan, scores as SC, source as S
from auditloom.rules.contract import UNIT_RULES
from auditloom.rules.formula import Rule
from auditloom.rules.lines import UNSAFE_CODE_RULES, LineRule


def from_hits(hits: DataFrame, engine: str, program: str | Column = "repo", path: str = "path", instruction: str | Column | None = "unit_name",
              line: str = "line_no", confidence: Column | int | None = None) -> DataFrame:
    """Hits of :func:`scan.scan_rules` or :func:`scan.scan_lines` as findings.

    The place of a hit (program, path, instruction, line) is filled from its own columns, so equal flaws in two places stay two
    findings.  The confidence is the rule's own, else that of the engine for the severity, else ``confidence``.  ``seq``
    orders equal findings and only depends on their place and rule.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    have = set(hits.columns)
    severity = F.col("severity").cast("int")
    sure = [engine_confidence(F.lit(engine), severity, F.lit(None).cast("double"), F.lit(None).cast("boolean")), F.lit(None if isinstance(confidence, Column) else confidence).cast("int")]
    if isinstance(confidence, Column):
        sure.append(confidence.cast("int"))
    if "rule_confidence" in have:
        sure.insert(0, F.round(F.col("rule_confidence") * 100).cast("int"))
    where = col(instruction).cast("string") if instruction is not None else F.lit("")
    return hits.select(
        F.concat(F.lit(f"{engine}-"), F.col("rule_id")).alias("finding_id"), F.lit(engine).alias("engine"), col(program).cast("string").alias("program"),
        F.col(path).alias("path"), F.col("category").alias("category"), (F.col("vuln_type") if "vuln_type" in have else F.col("category")).alias("vuln_type"),
        severity.alias("severity"), F.col("cwe").alias("cwe"), where.alias("instruction"), F.col(line).cast("int").alias("line_number"),
        F.coalesce(*sure).alias("confidence"), (F.col("note") if "note" in have else F.lit(None).cast("string")).alias("description"),
        F.xxhash64(col(program).cast("string"), F.col(path), F.col(line), F.col("rule_id")).alias("seq"))


def audit_findings(files: DataFrame, rules: Sequence[Rule] = tuple(UNIT_RULES), line_rules: Sequence[LineRule] = tuple(UNSAFE_CODE_RULES),
                   repo_type: Column | None = None, threshold: int = 0, per_category: int | None = None, per_type: int | None = None) -> DataFrame:
    """Consolidated findings of ``files`` (repo, path, content): unit rules and line rules, one schema, noise and repeats removed.

    Files do not move: units, lines and hits are made in their row; only findings are shuffled, by program and place.
    """
    keep = ["repo", "path"]
    units = S.attach_context(files, "content", keep).withColumn("code", strip_comments(F.col("code")))
    unit_hits = scan.scan_rules(units, rules, "code", [*keep, "unit_name", "line_no"], kind="unit_kind")
    lines = S.drop_comments(S.explode_lines(files, "content", keep))
    line_hits = scan.scan_lines(lines, line_rules, "text", [*keep, "line_no"])
    found = FN.union_findings(from_hits(unit_hits, "RULES", confidence=75), from_hits(line_hits, "GEI", instruction=None))
    return FN.consolidate(found, ["program", "path"], F.lit(None).cast("string") if repo_type is None else repo_type, threshold, per_category, per_type)


def batch_audit(files: DataFrame, **options) -> DataFrame:
    """Risk of every program of a corpus, also of those without findings."""
    programs = files.select(F.col("repo").alias("program")).distinct()
    return SC.program_risk(audit_findings(files, **options), ["program"], programs)
