"""Scores and summaries.  Every aggregate here has a partial form, so hot keys combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = {"critical": 5, "high": 4, "medium": 3, "low": 2}


def level_counts(severity: Column) -> dict[str, Column]:
    return {f"{name}_count": F.count_if(severity == n) for name, n in LEVELS.items()}


def severity_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts per level, total and value at risk."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                               *[c.alias(n) for n, c in level_counts(F.col("severity")).items()],
                               F.sum("risk").alias("risk_total"))


def severity_matrix(df: DataFrame) -> DataFrame:
    """Category x severity with zeros; the columns are known, so no extra pass finds them."""
    s = F.col("severity")
    return df.groupBy("category").agg(*[F.count_if(s == n).alias(f"sev_{n}") for n in range(1, 6)])


def category_share(df: DataFrame) -> DataFrame:
    """Count per category and percent of all rows; the total is one scalar, not a window."""
    per = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1)))
    return per.select("category", "n", (F.col("n") * 100.0 / total.scalar()).alias("pct"))


def family_status(df: DataFrame, families: dict[str, tuple[tuple[str, ...], int]]) -> DataFrame:
    """Analyzer families over categories: count and ``warn`` above a limit."""
    one = df.agg(*[F.count_if(F.col("category").isin(*cats) if cats else F.lit(False)).alias(f) for f, (cats, _) in families.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("n"),
                              F.when(F.col(f) > limit, "warn").otherwise("pass").alias("status"))
                     for f, (_, limit) in families.items()])
    return one.select(F.inline(rows))


def top_types(df: DataFrame, n: int = 10) -> DataFrame:
    return df.groupBy("vuln_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "vuln_type").limit(n)


def recommendations(top: DataFrame, advice: dict[str, str], n: int = 3) -> DataFrame:
    """Advice for the leading types that have one, with the count filled in."""
    lead = top.orderBy(F.desc("n"), "vuln_type").limit(n)
    text = F.create_map(*[F.lit(x) for kv in advice.items() for x in kv])[F.col("vuln_type")]
    return lead.select("vuln_type", F.replace(text, F.lit("{n}"), F.col("n").cast("string")).alias("advice")).where("advice is not null")


def risk_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return F.least(F.lit(100), 40 * critical + 20 * high + 10 * medium + 5 * low)


#: Financial weight by category, in tenths.
FINANCIAL_TENTHS = {"Authentication": 95, "Authorization": 95, "Price Oracle": 90, "Economic": 90, "Liquidations": 85,
                    "Lending": 85, "Integer Overflow": 70}
DEFAULT_TENTHS = 50


def program_risk(df: DataFrame, by: list[str], programs: DataFrame | None = None, strict_compat: bool = False) -> DataFrame:
    """Technical, financial and overall risk, security score and advice.

    With ``programs`` given, those without findings appear with risk 0 (or, with
    ``strict_compat``, overall risk 10 as a score of 0).
    """
    w = F.lit(DEFAULT_TENTHS)
    for cat, t in FINANCIAL_TENTHS.items():
        w = F.when(F.col("category") == cat, t).otherwise(w)
    g = df.groupBy(*by).agg(F.sum("severity").alias("_s"), F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_n"),
                            F.count_if(F.col("severity") == 5).alias("critical_count"))
    if programs is not None:
        g = programs.select(*by).join(g, by, "left").fillna(0, ["_s", "_w", "_n", "critical_count"])
    n = F.col("_n")
    technical = F.when(n > 0, F.col("_s") * 2.0 / n).otherwise(F.lit(0.0))
    financial = F.when(n > 0, F.least(F.lit(10.0), F.col("_w") / 10.0 / n)).otherwise(F.lit(0.0))
    overall = F.when(n > 0, F.least(F.lit(10.0), F.col("technical") * 0.4 + F.col("financial") * 0.6)).otherwise(
        F.lit(10.0 if strict_compat else 0.0))
    score = F.floor(F.greatest(F.lit(0.0), 100.0 - F.round(F.col("overall") * 10.0, 9))).cast("int")
    advice = F.when((F.col("score") >= 90) & (F.col("critical_count") == 0), "SAFE TO DEPLOY").when(
        F.col("critical_count") > 0, "DO NOT DEPLOY").when(F.col("score") < 60, "UNSAFE").otherwise("REVIEW REQUIRED")
    return (g.withColumn("technical", technical).withColumn("financial", financial).withColumn("overall", overall)
            .withColumn("score", score).withColumn("advice", advice).drop("_s", "_w", "_n"))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def health_score(df: DataFrame, by: list[str]) -> DataFrame:
    s = F.col("severity")
    penalty = F.when(s == 5, 15).when(s == 4, 10).when(s == 3, 5).when(s == 2, 2).otherwise(0)
    return df.groupBy(*by).agg(F.greatest(F.lit(0), 100 - F.sum(penalty)).alias("health"))


#: Penalty per unsafe construct and line of code.
DENSITY = {"UnsafeBlock": 1000, "UnsafeFunction": 800, "FFICall": 600, "RawPointer": 500, "TransmuteCall": 700,
           "InlineAssembly": 900, "UnsafeTrait": 400}


def safety_score(hits: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Density of unsafe constructs; ``totals`` has ``lines`` per key; no lines -> 100."""
    w = F.lit(0)
    for cat, p in DENSITY.items():
        w = F.when(F.col("category") == cat, p).otherwise(w)
    pen = hits.groupBy(*by).agg(F.sum(w).alias("_p"))
    raw = 100.0 - F.coalesce(F.col("_p"), F.lit(0)) / F.col("lines")
    score = F.when(F.col("lines") == 0, 100).otherwise(F.floor(clamp(raw, 0.0, 100.0)).cast("int"))
    return totals.join(pen, by, "left").select(*by, "lines", score.alias("safety"))


#: Fixed values: (weight per construct), bonuses and per-finding penalties.
CONSTRAINT_PENALTY = {"missing_signer": 15, "missing_owner": 12, "missing_pda": 10, "missing_cpi_guard": 18,
                      "weak_constraint": 8, "reinit": 20, "missing_close_guard": 10}
CONSTRAINT_BONUS = {"token_hooks": 5, "custom_constraints": 2}


def constraint_score(metrics: DataFrame, findings: DataFrame, by: list[str]) -> DataFrame:
    """Weighted constraint metrics with per-finding penalties, clamped to 0..100."""
    s = F.col("severity")
    half = F.when(s == 5, 10).when(s == 4, 6).when(s == 3, 2).otherwise(1)
    pen = findings.groupBy(*by).agg(F.sum(half).alias("_half"))
    base = F.lit(100.0)
    for c, w in CONSTRAINT_PENALTY.items():
        base = base - F.col(c) * w
    for c, w in CONSTRAINT_BONUS.items():
        base = base + F.col(c) * w
    raw = base - F.coalesce(F.col("_half"), F.lit(0)) / 2.0
    return metrics.join(pen, by, "left").select(*by, F.floor(clamp(raw, 0.0, 100.0)).cast("int").alias("score"))


def latest_score(audits: DataFrame, key: str, ts: str) -> DataFrame:
    """Score of the newest audit per program; of audits at the same time, the one with most critical findings."""
    counts = F.struct("critical_count", "high_count", "medium_count", "low_count")
    last = audits.groupBy(key).agg(F.max_by(counts, F.struct(F.col(ts).alias("ts"), counts.alias("counts"))).alias("a"), F.count(F.lit(1)).alias("audits"))
    a = lambda c: F.col(f"a.{c}_count")
    return last.select(key, "audits", F.greatest(F.lit(0), 100 - 25 * a("critical") - 15 * a("high") - 5 * a("medium") - a("low")).alias("score"),
                       (F.col("audits") > 0).alias("has_records"))


def fallback_score(stored: Column, critical: Column, high: Column, medium: Column) -> Column:
    return F.coalesce(stored, F.greatest(F.lit(0), 100 - 5 * critical - 2 * high - medium))


#: Weight of each voter in tenths, and the agreement threshold.
MODEL_TENTHS = {"user": 10, "assistant": 10, "system": 8}


def consensus(votes: DataFrame, models: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """Weighted verdict per finding.

    ``models(model, weight)`` has one row per voter; voters it does not name weigh 1.0.  The votes
    themselves stay in their table: a finding may have any number of them.
    """
    if models is not None:
        votes = votes.join(models.select("model", F.col("weight").alias("_w")), "model", "left")
        w = F.coalesce(F.col("_w"), F.lit(1.0))
    else:
        w = F.lit(1.0)
    v = F.col("verdict")
    g = votes.groupBy("finding_id").agg(
        F.sum(w).alias("total"), F.sum(F.when(v == "Confirmed", w).otherwise(0.0)).alias("conf"),
        F.sum(F.when(v == "Rejected", w).otherwise(0.0)).alias("rej"),
        F.sum(F.col("confidence") * w).alias("wc"), F.count(F.lit(1)).alias("votes"))
    ratio = F.when(F.col("total") > 0, F.greatest("conf", "rej") / F.col("total")).otherwise(0.0)
    mean = F.when(F.col("total") > 0, F.col("wc") / F.col("total")).otherwise(0.0)
    ok = F.round(F.col("agreement"), 9) >= threshold
    verdict = F.when((F.col("conf") > F.col("rej")) & ok, "Confirmed").when((F.col("rej") > F.col("conf")) & ok, "Rejected").otherwise("Uncertain")
    return (g.withColumn("agreement", ratio).withColumn("mean_confidence", mean).withColumn("verdict", verdict)
            .withColumn("should_report", (F.col("verdict") == "Confirmed") & (F.round("mean_confidence", 9) >= 0.5))
            .select("finding_id", "votes", "agreement", "mean_confidence", "verdict", "should_report"))


def checklist(df: DataFrame, by: list[str], items: dict[str, str]) -> DataFrame:
    """Named properties per key, passed unless a finding of the category exists."""
    g = df.groupBy(*by).agg(*[F.bool_or(F.coalesce(F.col("category") == cat, F.lit(False))).alias(f"_c{i}")
                              for i, cat in enumerate(items.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("item"), (~F.col(f"_c{i}")).alias("passed")) for i, name in enumerate(items)])
    return g.select(*by, F.inline(rows))


def diversity(usages: DataFrame, by: list[str], external: tuple[str, ...] = ("Pyth", "Switchboard", "Chainlink")) -> DataFrame:
    """Distinct sources, any external one, all validated, and the resulting level."""
    g = usages.groupBy(*by).agg(F.countDistinct("kind").alias("sources"), F.bool_or(F.col("kind").isin(*external)).alias("external"),
                                F.bool_and(F.size("validations") > 0).alias("validated"))
    level = F.when(F.col("external") & F.col("validated"), "LOW").when(F.col("external") | F.col("validated"), "MEDIUM").otherwise("HIGH")
    return g.withColumn("risk_level", level)


def metric_stats(df: DataFrame) -> DataFrame:
    v = F.col("value_ms")
    return df.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                                  (F.sum(v) / F.count(F.lit(1))).alias("mean"))


def totals(reports: DataFrame) -> DataFrame:
    """Service totals over all reports."""
    return reports.agg(F.count(F.lit(1)).alias("reports"), F.countDistinct("program").alias("programs"), F.sum("total").alias("findings"),
                       F.sum("critical_count").alias("critical"), F.sum("high_count").alias("high"),
                       (F.sum("score") / F.count(F.lit(1))).alias("mean_score"))


def triage_counts(findings: DataFrame, triage: DataFrame, key: str) -> DataFrame:
    """Findings per triage status, ``open`` when none was recorded."""
    return (findings.select(key).join(triage.select(key, "status"), key, "left")
            .groupBy(F.coalesce("status", F.lit("open")).alias("status")).agg(F.count(F.lit(1)).alias("n")))


def coverage_summary(df: DataFrame, flags: list[str], base_risk: Column, uplift: dict[str, tuple[Column, int]]) -> DataFrame:
    """Share of enabled analyses, confidence in the result and risk raised by what they found."""
    on = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    out = df.withColumn("coverage_pct", on * 100.0 / len(flags))
    risk = base_risk
    for cond, add in uplift.values():
        risk = risk + F.when(cond, add).otherwise(0)
    return (out.withColumn("confidence", F.when(F.col("coverage_pct") >= 80, 0.95).otherwise(F.col("coverage_pct") / 100))
            .withColumn("enhanced_risk", F.least(F.lit(100), risk)))


def bench_stats(runs: DataFrame) -> DataFrame:
    """Mean, min and max duration per name; throughput = files of one run / mean duration."""
    return runs.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean_s"), F.min("seconds").alias("min_s"),
                                    F.max("seconds").alias("max_s"), F.max("files").alias("files")).withColumn(
        "throughput", F.when(F.col("mean_s") > 0, F.col("files") / F.col("mean_s")).otherwise(0.0))


def bench_compare(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Latest run of ``a`` against latest run of ``b`` for each pair of names."""
    last = runs.groupBy("name").agg(F.max_by(F.struct("seconds", "findings"), "run").alias("r"))
    a = last.select(F.col("name").alias("a"), F.col("r.seconds").alias("sa"), F.col("r.findings").alias("fa"))
    b = last.select(F.col("name").alias("b"), F.col("r.seconds").alias("sb"), F.col("r.findings").alias("fb"))
    return pairs.join(a, "a").join(b, "b").select(
        "a", "b", F.when(F.col("sb") > 0, F.col("sa") / F.col("sb")).alias("speedup"), (F.col("fb") - F.col("fa")).alias("findings_diff"))


def verification_summary(df: DataFrame, by: list[str]) -> DataFrame:
    s = F.col("status")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "verified").alias("verified"),
                               F.count_if(s == "failed").alias("failed"), F.count_if(s == "undetermined").alias("undetermined"))


def coverage_rollup(run_edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """(campaign totals, run that first reached each edge)."""
    total = run_edges.agg(F.countDistinct("edge_id").alias("edges"), F.countDistinct("hash").alias("paths"), F.countDistinct("run_id").alias("runs"))
    total = total.withColumn("coverage_pct", F.col("edges") * 100.0 / n_edges)
    first = run_edges.groupBy("edge_id").agg(F.min("run_id").alias("first_run"), F.count(F.lit(1)).alias("hits"))
    return total, first


#: Expected ratios of a program.
BASELINE = {"account_to_instruction_ratio": 2.5, "check_to_mutation_ratio": 1.2, "signer_check_frequency": 0.8}
BASELINE_CATEGORY = {"account_to_instruction_ratio": "UnusualAccountPattern", "check_to_mutation_ratio": "StateInconsistency",
                     "signer_check_frequency": "AuthorizationBypass"}


def baseline_anomalies(stats: DataFrame, keep: list[str], threshold: float = 0.75) -> DataFrame:
    """Ratios that deviate from the baseline; ``stats`` has one column per ratio."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("observed"), F.lit(b).alias("expected"),
                              F.lit(BASELINE_CATEGORY[m]).alias("category")) for m, b in BASELINE.items()])
    dev = F.abs(F.col("observed") - F.col("expected")) / F.col("expected")
    out = stats.select(*keep, F.inline(rows)).withColumn("deviation", dev).where(F.col("deviation") > threshold)
    sev = F.when(F.col("deviation") > 1.5, 4).when(F.col("deviation") > 1.0, 3).otherwise(2)
    return out.withColumn("severity", sev).withColumn("confidence", F.least(F.col("deviation") / 2, F.lit(0.95)))


METHOD_WEIGHT = {"CodeEmbedding": 0.25, "ControlFlowGNN": 0.30, "AnomalyDetection": 0.20, "PatternLearning": 0.25, "Ensemble": 1.0}
SEVERITY_BOOST = {5: 1.2, 4: 1.1, 3: 1.0, 2: 0.9, 1: 0.8}


def ensemble(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Confidence weighted by method and severity, best first."""
    w, b = F.lit(1.0), F.lit(1.0)
    for m, x in METHOD_WEIGHT.items():
        w = F.when(F.col("method") == m, x).otherwise(w)
    for s, x in SEVERITY_BOOST.items():
        b = F.when(F.col("severity") == s, x).otherwise(b)
    out = df.withColumn("ensemble_score", F.least(F.lit(0.99), F.col("confidence") * w * b))
    if threshold is not None:
        out = out.where(F.col("ensemble_score") >= threshold)
    return out


U64_MAX = 18446744073709551615


def interval_hull(df: DataFrame, key: list[str]) -> DataFrame:
    """Smallest interval covering all intervals of a key; empty ones (lo > hi) count for nothing."""
    return df.where("lo <= hi").groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def interval_meet(df: DataFrame, key: list[str]) -> DataFrame:
    """Common part of all intervals of a key; ``is_empty`` when there is none."""
    g = df.groupBy(*key).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return g.withColumn("is_empty", F.col("lo") > F.col("hi"))


def interval_flags(df: DataFrame) -> DataFrame:
    top = F.lit(str(U64_MAX)).cast("decimal(38,0)")
    return df.withColumn("may_overflow", (F.col("hi") > top) | (F.col("lo") < 0)).withColumn("may_underflow", F.col("lo") < 0)


def interval_contains(value: Column) -> Column:
    """Whether ``value`` lies in the row's interval; an empty one (lo > hi) holds nothing."""
    return (F.col("lo") <= value) & (value <= F.col("hi"))


def scan_stats(df: DataFrame, by: list[str], account: str | None = None) -> DataFrame:
    """Distinct files and instructions, lines, and with ``account`` the distinct accounts named; null names are none."""
    more = [F.countDistinct(account).alias("accounts")] if account else []
    return df.groupBy(*by).agg(F.countDistinct("path").alias("files"), F.countDistinct("instruction").alias("instructions"), *more,
                               F.sum("lines").alias("lines"))


#: Class by (words in type, words in description, words in category, CWE), in this order.
CLASSES: list[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = [
    ("Arithmetic", ("overflow", "underflow"), (), ("Arithmetic",), ("CWE-190", "CWE-191")),
    ("AccessControl", ("access", "authority", "owner", "signer"), (), ("Access",), ("CWE-284", "CWE-862", "CWE-863")),
    ("OracleManipulation", ("oracle", "price", "staleness"), ("oracle",), (), ()),
    ("CpiUnsafe", ("cpi",), ("cross-program", "invoke"), (), ()),
    ("PdaMismatch", ("pda",), ("program derived", "bump seed"), (), ()),
    ("ReentrancyLike", ("reentran",), ("reentr", "state inconsisten"), (), ("CWE-367",)),
    ("Initialization", ("init",), ("double init", "not initialized"), (), ()),
    ("AccountValidation", ("account",), ("type confusion", "account validation"), (), ()),
    ("DataExposure", ("exposure", "leak"), (), (), ("CWE-200",)),
]


def evidence(df: DataFrame) -> DataFrame:
    """Evidence quality 0..10 and vulnerability class."""
    txt = lambda c: F.coalesce(F.col(c), F.lit(""))
    present = [F.length(txt("description")) > 20, F.length(txt("attack")) > 20, txt("fix") != "", txt("impact") != "",
               F.coalesce(F.col("var_usd"), F.lit(0)) > 0, F.coalesce(F.col("conf"), F.lit(0.0)) > 0, txt("cwe") != "",
               F.coalesce(F.col("line_number"), F.lit(0)) > 0, F.length(txt("poc")) > 10, txt("mitigation") != ""]
    quality = sum((p.cast("int") for p in present), F.lit(0))
    has = lambda col, words: [F.contains(col, F.lit(w)) for w in words]
    vt, d = F.lower(txt("vuln_type")), F.lower(txt("description"))
    cls = None
    for name, words, desc, cats, cwes in CLASSES:
        tests = has(vt, words) + has(d, desc) + has(txt("category"), cats) + [txt("cwe") == c for c in cwes]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        cls = F.when(hit, name) if cls is None else cls.when(hit, name)
    return df.withColumn("quality", quality).withColumn("vuln_class", cls.otherwise("LogicError"))


#: Fixed values, amounts in cents so that both ratio operands are exact integers.
BASE_VAR = {"CRITICAL": 10_000_000, "HIGH": 1_000_000, "MEDIUM": 100_000}
DEFAULT_VAR = 10_000
COST_THOUSANDTHS = {"CpiUnsafe": 80, "OracleManipulation": 150, "ReentrancyLike": 120, "AccessControl": 5, "Arithmetic": 5,
                    "PdaMismatch": 20, "Initialization": 5}
DEFAULT_COST = 10
MEV_WORDS = ("frontrun", "sandwich", "flashloan", "flash loan", "mev", "bundle", "jito")


def economics(df: DataFrame) -> DataFrame:
    """Value at risk, cost, ratio and exposure tier; needs :func:`evidence` columns and ``sev``."""
    var, cost = F.lit(DEFAULT_VAR), F.lit(DEFAULT_COST)
    for s, x in BASE_VAR.items():
        var = F.when(F.col("sev") == s, x).otherwise(var)
    for c, x in COST_THOUSANDTHS.items():
        cost = F.when(F.col("vuln_class") == c, x).otherwise(cost)
    a = F.lower(F.coalesce("attack", F.lit("")))
    mev = F.col("vuln_class") == "OracleManipulation"
    for w in MEV_WORDS:
        mev = mev | F.contains(a, F.lit(w))
    out = df.withColumn("real_var", F.when(F.coalesce(F.col("var_usd"), F.lit(0)) > 0, F.col("var_usd")).otherwise(var).cast("long"))
    out = out.withColumn("cost_thousandths", cost).withColumn("ratio", F.col("real_var") * 1000.0 / F.col("cost_thousandths"))
    tier = F.when(mev, F.when(F.col("ratio") > 100_000, "HIGH").otherwise("MODERATE")).otherwise(
        F.when(F.col("ratio") > 1_000_000, "MODERATE").otherwise("LOW"))
    return out.withColumn("exposure", tier)


def verdict(df: DataFrame) -> DataFrame:
    """Agreement, rejection, final confidence, vote count and severity; needs evidence and economics columns."""
    q, sev, conf = F.col("quality"), F.col("sev"), F.coalesce(F.col("conf"), F.lit(0.0))
    txt = lambda c: F.coalesce(F.col(c), F.lit(""))
    attack, poc = F.length(txt("attack")) > 20, F.length(txt("poc")) > 10
    has_conf = conf > 0
    d = F.lower(txt("description"))
    hint = txt("mitigation") != ""
    for w in ("check", "validate", "require", "constraint"):
        hint = hint | F.contains(d, F.lit(w))
    weak = ~attack | (conf < 0.4) | (q < 3)
    agrees = (F.when((sev == "CRITICAL") & (q >= 5) & attack, True).when((sev == "CRITICAL") & (q >= 4) & poc, True)
              .when((sev == "HIGH") & (q >= 5), True).when((sev == "HIGH") & attack & has_conf & (conf >= 0.7), True)
              .when(weak, False).when(hint & (sev != "CRITICAL"), False).otherwise(False))
    rejected = ((q < 2) & (conf < 0.3) & (sev != "CRITICAL")) | ((q == 0) & ~sev.isin("CRITICAL", "HIGH"))
    out = df.withColumn("agrees", agrees).withColumn("rejected", rejected)
    ag, rej = F.col("agrees"), F.col("rejected")
    corroborated = F.when(rej, False).when(q >= 4, True).when((q >= 2) & attack, True).otherwise(has_conf & (conf >= 0.5))
    out = out.withColumn("corroborated", corroborated)
    cor = F.col("corroborated")
    score = (q * 5.0 + F.when(has_conf, F.least(conf * 15.0, F.lit(15.0))).otherwise(5.0) + F.when(cor, 20.0).otherwise(5.0)
             + F.when(sev == "CRITICAL", 10.0).when(sev == "HIGH", 7.0).when(sev == "MEDIUM", 4.0).otherwise(2.0)
             + F.when(ag, 5.0).otherwise(-5.0))
    cut = F.when(ag, F.lit(0.0)).otherwise(clamp(F.least(10 - q, F.lit(8)) * 0.1, 0.2, 0.7))
    return (out.withColumn("final_confidence", F.when(rej, 15.0).otherwise(clamp(score, 25.0, 99.0)))
            .withColumn("adjusted_var", F.col("real_var") * (1.0 - cut))
            .withColumn("votes_for", F.when(rej, 2).when(ag & cor, 5).when(ag | cor, 4).otherwise(3))
            .withColumn("final_verdict", F.when(rej, "REJECTED").when(ag | cor, "CONFIRMED").otherwise("UNCERTAIN"))
            .withColumn("final_severity", F.when(rej, sev).when(~ag & cor & sev.isin("LOW", "MEDIUM"), "HIGH")
                        .when(ag & cor & (sev == "HIGH") & (q >= 7), "CRITICAL").otherwise(sev)))
