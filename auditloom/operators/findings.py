"""Finding tables: filters, duplicate removal, caps, ranking, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditloom.functions.labels import history
from auditloom.functions.text import severity_label, taxonomy

#: Common schema of findings; engines fill what they know.
FINDING_COLUMNS = {
    "finding_id": "string", "engine": "string", "program": "string", "path": "string", "category": "string",
    "vuln_type": "string", "severity": "int", "cwe": "string", "instruction": "string", "line_number": "int",
    "confidence": "int", "risk": "long", "description": "string", "seq": "long",
}


def union_findings(*parts: DataFrame) -> DataFrame:
    """Engine outputs on the common schema; columns an engine lacks become null."""
    def common(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in FINDING_COLUMNS.items()])
    out = common(parts[0])
    for p in parts[1:]:
        out = out.unionByName(common(p))
    return out


def enrich(df: DataFrame) -> DataFrame:
    """Taxonomy, label, reference incident and effort."""
    out = df.withColumn("taxonomy", taxonomy(F.col("vuln_type"), F.col("category"))).withColumn(
        "severity_label", severity_label(F.col("severity")))
    for name, col in history(F.col("taxonomy")).items():
        out = out.withColumn(name, col)
    return out


def join_dimension(df: DataFrame, dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Attach columns of a dimension (advice, owners, costs) with one row per key; unknown keys get nulls.

    Whether the dimension is broadcast is decided by its measured size.
    """
    return df.join(dim.select(key, *columns), key, "left")


def drop_mirrors(df: DataFrame, by: list[str], proven: str = "KANI-", mirrored: str = "SEC3-") -> DataFrame:
    """Drop rows of one engine that restate a property another engine already reports.

    The property of a mirrored row is its instruction without ``proof_``; of the other engine only
    the distinct properties are shuffled.  Rows that cannot be mirrors get keys of their own that
    match nothing, so they spread evenly instead of meeting at a null key.
    """
    props = df.where(F.startswith("finding_id", F.lit(proven))).select(
        *by, F.lower(F.substr("finding_id", F.lit(len(proven) + 1))).alias("_prop")).distinct()
    instr = F.lower("instruction")
    key = F.when(F.startswith("finding_id", F.lit(mirrored)) & F.startswith(instr, F.lit("proof_")), F.substr(instr, F.lit(7)))
    own = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("finding_id", "seq"), F.lit(4096)).cast("string"))
    return df.withColumn("_prop", F.coalesce(key, own)).join(props, [*by, "_prop"], "left_anti").drop("_prop")


def _true(test: Column) -> Column:
    """A test that does not hold when it is unknown: a row is only dropped for what it says."""
    return F.coalesce(test, F.lit(False))


def drop_synthetic(df: DataFrame) -> DataFrame:
    """Harness rows: instruction starts with ``proof_`` and there is no real line."""
    return df.where(~_true(F.startswith(F.lower("instruction"), F.lit("proof_")) & (F.col("line_number") <= 1)))


#: What an infrastructure repository cannot have.
NOISE_PREFIXES = ("SOL-", "KANI-", "SEC3-", "WACANA-", "CERTORA-", "TRD-", "TRIDENT-", "FDS-", "L3X-")
NOISE_CATEGORIES = ("Authentication", "Authorization", "PDA Security", "CPI Security", "Account Validation",
                    "Account Management", "Sysvar Security", "Initialization")


def suppress_for_profile(df: DataFrame, repo_type: Column) -> DataFrame:
    """Drop contract-only findings of repositories that hold no contract."""
    noise = (_true(F.col("finding_id").rlike("^(" + "|".join(NOISE_PREFIXES) + ")")) | _true(F.contains("category", F.lit("Anchor")))
             | _true(F.col("category").isin(*NOISE_CATEGORIES)))
    return df.where(~(_true(repo_type == "RustInfrastructure") & noise))


def min_confidence(df: DataFrame, threshold: int) -> DataFrame:
    """Rows at or above the threshold; an unknown confidence is not below it."""
    return df.where(~_true(F.col("confidence") < threshold))


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key.

    The rank filter is pushed below the shuffle by the optimizer, so each task sends at most
    ``n`` rows per key: a key holding a third of the data stays harmless.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dedup_best(df: DataFrame, by: list[str]) -> DataFrame:
    """Per (scope, type, instruction, line): highest confidence, earliest on a tie.

    A row that does not say where it is (a null in its key) is only the same as one that equals it in every column.
    """
    keys = [*by, "vuln_type", "instruction", "line_number"]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = F.when(~known, F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]))
    return top_rows(df.withColumn("_own", own), [*keys, "_own"], [F.desc("confidence"), F.asc("seq")], 1).drop("_own")


def dedup_fingerprint(df: DataFrame, fp: str, seq: str) -> DataFrame:
    """First row per fingerprint in sequence order."""
    return top_rows(df, [fp], [F.asc(seq)], 1)


def cap_per(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows per key, most severe and most certain first."""
    return top_rows(df, keys, [F.desc("severity"), F.desc("confidence"), F.asc("seq")], n)


def consolidate(df: DataFrame, by: list[str], repo_type: Column, threshold: int, per_category: int | None = None,
                per_type: int | None = None) -> DataFrame:
    """All noise filters in order.  Nothing is capped unless a number per category or type is given."""
    kept = drop_mirrors(df, by)
    kept = min_confidence(suppress_for_profile(drop_synthetic(kept), repo_type), threshold)
    kept = dedup_best(kept, by)
    if per_category is not None:
        kept = cap_per(kept, [*by, "category"], per_category)
    return kept if per_type is None else cap_per(kept, [*by, "vuln_type"], per_type)


#: Fixed values of the root-cause ranking.
RISK_LIMIT = 1_200_000
EFFORT = {"Missing Signer Validation": 10, "Authority Bypass": 10, "Integer Overflow/Underflow": 20}
DEFAULT_FIX_EFFORT = 60


def rank_root_causes(df: DataFrame, by: list[str], floor: int = 85) -> DataFrame:
    """One row per (scope, type, instruction): the first row leads, risk is summed and capped.

    Member ids are not packed into a list (a group may be huge); see :func:`root_cause_members`.
    """
    strong = df.where(F.col("confidence") >= floor)
    lead = F.struct("finding_id", "severity", "confidence", "risk")
    g = strong.groupBy(*by, "vuln_type", "instruction").agg(
        F.min_by(lead, "seq").alias("lead"), F.sum("risk").alias("risk_sum"), F.count(F.lit(1)).alias("instances"))
    t = F.col("vuln_type")
    sev = F.when(t.isin("Missing Event Emission", "Missing IDL Description"), 1).when(
        (t == "Missing Pause Mechanism") & (F.col("lead.risk") < 50_000), 2).otherwise(F.col("lead.severity"))
    effort = F.lit(DEFAULT_FIX_EFFORT)
    for name, e in EFFORT.items():
        effort = F.when(t == name, e).otherwise(effort)
    out = g.withColumn("adjusted_severity", sev).withColumn("effort", effort)
    score = F.least(F.col("risk_sum"), F.lit(RISK_LIMIT)) * F.col("lead.confidence") * F.col("adjusted_severity") / 100
    return out.select(*by, "vuln_type", "instruction", F.col("lead.finding_id").alias("primary_id"), "instances",
                      "adjusted_severity", "effort", score.alias("risk_score"),
                      ((F.col("adjusted_severity") >= 4) & (F.col("effort") <= 30)).alias("quick_win"))


def root_cause_members(df: DataFrame, by: list[str], floor: int = 85) -> DataFrame:
    """Long form of the ids aggregated per root cause."""
    return df.where(F.col("confidence") >= floor).select(*by, "vuln_type", "instruction", "finding_id", "seq")


def critical_path(df: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """Ids of the ``n`` root causes with the highest risk score (a top-k, not a full sort)."""
    r = rank_root_causes(df, by)
    return r.orderBy(F.desc("risk_score"), *by, "vuln_type", "instruction").limit(n).select(*by, "primary_id", "risk_score")


def query_findings(df: DataFrame, severity: str | None = None, category: str | None = None, text: str | None = None) -> DataFrame:
    """Interactive filter: severity by label or priority, category and free text by substring.

    The sort has an id behind the severity: five severities alone would make five sort ranges.
    """
    out = df
    if severity:
        out = out.where((F.lower("severity_label") == severity.lower()) | (F.lower("priority") == severity.lower()))
    if category:
        out = out.where(F.contains(F.lower("category"), F.lit(category.lower())))
    if text:
        hay = [F.contains(F.lower(c), F.lit(text.lower())) for c in ("vuln_type", "description", "finding_id")]
        out = out.where(hay[0] | hay[1] | hay[2])
    return out.orderBy(F.desc("severity"), F.asc("finding_id"))


def apply_config(df: DataFrame, min_severity: int = 1, allow: list[str] | None = None, deny: list[str] | None = None,
                 max_findings: int | None = None, order: list[Column] | None = None) -> DataFrame:
    out = df.where(F.col("severity") >= min_severity)
    if allow:
        out = out.where(F.col("category").isin(*allow))
    if deny:
        out = out.where(~F.col("category").isin(*deny))
    if max_findings is not None:
        if not order:
            raise ValueError("a limit needs an order that ends in a unique column")
        out = out.orderBy(*order).limit(max_findings)
    return out


