"""Rule scans: a whole catalogue is one projection over the input, then one explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.rules.formula import Rule, spark_quote
from auditloom.rules.lines import LineRule


def _hits(tests: list[Column], facts: Column) -> Column:
    """Facts of the rules whose test holds; only hits become rows."""
    numbered = F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests, 1)])
    return F.transform(F.filter(numbered, lambda i: i.isNotNull()), lambda i: F.element_at(facts, i))


def _literal(v) -> str:
    if v is None:
        return "cast(null as string)"
    return spark_quote(v) if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)


def _hits_text(tests: list[str], facts: list[dict]) -> Column:
    """As :func:`_hits` for a large catalogue: one SQL expression, parsed once, instead of thousands of calls."""
    numbered = ", ".join(f"CASE WHEN {t} THEN {i} END" for i, t in enumerate(tests, 1))
    rows = ", ".join("named_struct(" + ", ".join(f"'{k}', {_literal(v)}" for k, v in f.items()) + ")" for f in facts)
    return F.expr(f"transform(filter(array({numbered}), i -> i is not null), i -> element_at(array({rows}), i))")


def scan_rules(df: DataFrame, rules: Sequence[Rule], text: str | dict[str, str], keep: list[str],
               kinds: Sequence[str] | None = None, kind: str | None = None) -> DataFrame:
    """Evaluate every rule on every row in one narrow pass.

    ``text`` names the column to search, or maps the names a rule uses to columns.  With ``kind``,
    the column holding the unit kind, a rule only sees the kinds it names; ``kinds`` opens more.
    """
    tests = []
    for r in rules:
        t = r.when.spark(text)
        if kind is not None:
            seen = ", ".join(spark_quote(k) for k in sorted({*r.kinds, *(kinds or ())}))
            t = f"{kind} IN ({seen}) AND {t}"
        tests.append(t)
    facts = [{"rule_id": r.id, "vuln_type": r.vuln_type, "category": r.category, "severity": r.severity, "cwe": r.cwe,
              "rule_confidence": -1.0 if r.confidence is None else r.confidence, "note": r.note} for r in rules]
    out = df.select(*keep, F.inline(_hits_text(tests, facts)))
    return out.withColumn("rule_confidence", F.nullif("rule_confidence", F.lit(-1.0)))


def scan_lines(lines: DataFrame, rules: Sequence[LineRule], text: str, keep: list[str]) -> DataFrame:
    """One row per (rule, line) whose pattern occurs in the line."""
    facts = [{"rule_id": r.id, "category": r.category, "severity": r.severity, "cwe": r.cwe} for r in rules]
    return lines.select(*keep, F.inline(_hits_text([f"rlike({text}, {spark_quote(r.pattern)})" for r in rules], facts)))


def rules_sql(view: str, rules: Sequence[Rule], text: str | dict[str, str], keep: str) -> str:
    """The same scan as SQL text, one branch per rule."""
    branch = lambda r: (f"SELECT {keep}, '{r.id}' AS rule_id, '{r.category}' AS category, {r.severity} AS severity "
                        f"FROM {view} WHERE {r.when.sql(text)}")
    return " UNION ALL ".join(branch(r) for r in rules)


def count_at_least(text: Column, tokens: list[str], n: int) -> Column:
    """At least ``n`` of the tokens occur (each counted once)."""
    total = F.lit(0)
    for t in tokens:
        total = total + F.contains(text, F.lit(t)).cast("int")
    return total >= n
