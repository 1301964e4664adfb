import pytest
from pyspark.sql import functions as F

from auditloom.operators import findings as FN, scores as SC

COLS = "finding_id string, vuln_type string, category string, instruction string, line_number int, severity int, confidence int, risk long, seq long"


def frame(spark, *rows):
    """Rows as dicts over defaults."""
    base = dict(finding_id="SOL-1", vuln_type="T", category="C", instruction="f", line_number=3, severity=3, confidence=90, risk=10, seq=0)
    out = [{**base, "seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in COLS.split(", ")) for r in out], COLS)


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_tie_keeps_earliest(spark):
    assert seqs(FN.dedup_best(frame(spark, {"confidence": 80}, {}, {}), [])) == [1]


def test_triple_duplicate(spark):
    df = frame(spark, {}, {}, {}).withColumn("fp", F.lit("x"))
    assert seqs(FN.dedup_fingerprint(df, "fp", "seq")) == [0]


def test_category_flood(spark):
    rows = [{"severity": 1 + i % 5, "confidence": i} for i in range(12)]
    kept = FN.cap_per(frame(spark, *rows), ["category"], 10)
    best = sorted(range(12), key=lambda i: (-(1 + i % 5), -i))[:10]
    assert seqs(kept) == sorted(best)


def test_type_flood_over_categories(spark):
    df = frame(spark, *[{"category": "AB"[i % 2], "line_number": i} for i in range(7)])
    assert FN.cap_per(df, ["vuln_type"], 5).count() == 5


def test_mirror_and_synthetic(spark):
    df = frame(spark, {"finding_id": "KANI-ABC"}, {"finding_id": "SEC3-9", "instruction": "proof_abc"}, {"finding_id": "SEC3-8", "instruction": "proof_abd"},
               {"finding_id": "SOL-2", "instruction": "Proof_x", "line_number": 1})
    assert seqs(FN.drop_mirrors(df, [])) == [0, 2, 3]
    assert seqs(FN.drop_synthetic(df)) == [0, 1, 2]


def test_profile(spark):
    df = frame(spark, {"finding_id": "SOL-1"}, {"finding_id": "GEI-1"}, {"finding_id": "GEI-2", "category": "CPI Security"}, {"finding_id": "GEI-3", "category": "Anchor X"})
    assert seqs(FN.suppress_for_profile(df, F.lit("RustInfrastructure"))) == [1]
    assert seqs(FN.suppress_for_profile(df, F.lit("AnchorProgram"))) == [0, 1, 2, 3]


def test_consolidate_limits_before_shuffle(spark):
    df = frame(spark, *[{"line_number": i} for i in range(50)])
    assert FN.consolidate(df, [], F.lit("AnchorProgram"), 0).count() == 50
    assert FN.consolidate(df, [], F.lit("AnchorProgram"), 0, 10, 5).count() == 5
    plan = FN.cap_per(df, ["category"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # ranks are cut on the map side: a hot category sends ten rows per task


def test_program_risk(spark):
    df = frame(spark, {"severity": 5, "category": "Authentication"}, {"severity": 3, "category": "Other"}).withColumn("program", F.lit("p"))
    r = SC.program_risk(df, ["program"]).first()
    assert (round(r.technical, 6), round(r.financial, 6), round(r.overall, 6), r.score, r.advice) == (8.0, 7.25, 7.55, 24, "DO NOT DEPLOY")


def test_programs_without_findings(spark):
    df = frame(spark).withColumn("program", F.lit("p"))
    programs = spark.createDataFrame([("q",)], "program string")
    assert SC.program_risk(df, ["program"], programs).first().score == 100
    assert SC.program_risk(df, ["program"], programs, strict_compat=True).first().score == 0


def test_capped_risk_and_health(spark):
    assert spark.range(1).select(SC.risk_score(F.lit(1), F.lit(4), F.lit(0), F.lit(0))).first()[0] == 100
    df = frame(spark, *[{"severity": s} for s in (5, 4, 3, 2)]).withColumn("program", F.lit("p"))
    assert SC.health_score(df, ["program"]).first().health == 68


def test_checklist_without_findings(spark):
    df = frame(spark, {"category": None}).withColumn("program", F.lit("p"))
    items = {f"i{n}": f"c{n}" for n in range(10)}
    assert [r.passed for r in SC.checklist(df, ["program"], items).collect()] == [True] * 10


@pytest.mark.parametrize("votes,verdict,ratio,report", [
    ([("a", "Confirmed", .9), ("b", "Confirmed", .8), ("c", "Rejected", .6)], "Confirmed", 2 / 2.8, True),
    ([("a", "Confirmed", .9), ("b", "Rejected", .9), ("c", "Uncertain", .5)], "Uncertain", 1 / 2.8, False),
    ([("a", "Rejected", .9), ("b", "Rejected", .9), ("c", "Confirmed", .5)], "Rejected", 2 / 2.8, False),
    ([("unknown", "Confirmed", .4)], "Confirmed", 1.0, False)])
def test_consensus(spark, votes, verdict, ratio, report):
    v = spark.createDataFrame([("f", *x) for x in votes], "finding_id string, model string, verdict string, confidence double")
    models = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.8)], "model string, weight double")
    r = SC.consensus(v, models).first()
    assert (r.verdict, r.should_report) == (verdict, report) and abs(r.agreement - ratio) < 1e-9


def test_root_causes(spark):
    df = frame(spark, {"vuln_type": "Missing Signer Validation", "severity": 5, "confidence": 90, "risk": 1_000_000}, {"vuln_type": "Missing Signer Validation", "severity": 5, "risk": 900_000},
               {"vuln_type": "Missing Pause Mechanism", "severity": 4, "risk": 10}, {"confidence": 84})
    r = {x.vuln_type: x for x in FN.rank_root_causes(df, []).collect()}
    a, b = r["Missing Signer Validation"], r["Missing Pause Mechanism"]
    assert (a.instances, a.primary_id, a.effort, a.quick_win) == (2, "SOL-1", 10, True) and a.risk_score == 1_200_000 * .9 * 5
    assert (b.adjusted_severity, b.effort, b.quick_win) == (2, 60, False) and len(r) == 2


def test_interval_hull_and_meet(spark):
    df = spark.createDataFrame([("k", 10, 20), ("k", 15, 30), ("k", 5, 1)], "key string, lo long, hi long").select("key", F.col("lo").cast("decimal(38,0)").alias("lo"), F.col("hi").cast("decimal(38,0)").alias("hi"))
    assert tuple(SC.interval_hull(df, ["key"]).first())[1:] == (10, 30)
    m = SC.interval_meet(df.where("lo <= hi"), ["key"]).first()
    assert (m.lo, m.hi, m.is_empty) == (15, 20, False)
    top = spark.sql(f"select cast({SC.U64_MAX} as decimal(38,0)) + 1 hi, cast(-1 as decimal(38,0)) lo")
    assert tuple(SC.interval_flags(top).select("may_overflow", "may_underflow").first()) == (True, True)


def test_query_findings(spark):
    df = frame(spark, {"severity": 5}, {"severity": 2}, {"severity": 4, "category": "Authentication"}).withColumn("severity_label", F.when(F.col("severity") == 5, "CRITICAL").otherwise("LOW")).withColumn(
        "priority", F.when(F.col("severity") == 4, "critical").otherwise("low")).withColumn("description", F.lit("Some Text"))
    assert [r.severity for r in FN.query_findings(df, "critical").collect()] == [5, 4]
    assert seqs(FN.query_findings(df, None, "AUTH")) == [2] and FN.query_findings(df, text="some text").count() == 3


def test_unknown_values_are_kept(spark):
    df = frame(spark, {"instruction": None, "line_number": None}, {"category": None, "finding_id": None}, {"confidence": None}, {"confidence": 3})
    assert seqs(FN.drop_synthetic(df)) == [0, 1, 2, 3]
    assert 1 in seqs(FN.suppress_for_profile(df, F.lit("RustInfrastructure")))
    kept = seqs(FN.min_confidence(df, 50))
    assert 2 in kept and 3 not in kept
    assert seqs(FN.suppress_for_profile(df, F.lit(None).cast("string"))) == [0, 1, 2, 3]


def test_mirrors_by_whole_names(spark):
    long = "x" * 1500
    df = frame(spark, {"finding_id": f"KANI-{long}a"}, {"finding_id": "SEC3-1", "instruction": f"proof_{long}b"}, {"finding_id": "SEC3-2", "instruction": f"proof_{long}a"})
    assert seqs(FN.drop_mirrors(df, [])) == [0, 1]


def test_limits_need_an_order(spark):
    with pytest.raises(ValueError):
        FN.apply_config(frame(spark, {}), max_findings=1)


def test_interval_range(spark):
    rows = [(1, -5, 3), (2, 0, 2 ** 64 - 1), (3, 0, 2 ** 64)]
    df = spark.createDataFrame([(k, str(a), str(b)) for k, a, b in rows], "k int, lo string, hi string").select("k", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("lo", "hi")])
    assert [r.may_overflow for r in SC.interval_flags(df).orderBy("k").collect()] == [True, False, True]
    assert [r.x for r in df.select(SC.interval_contains(F.lit(3)).alias("x")).collect()] == [True, True, True]
    assert [r.x for r in df.select(SC.interval_contains(F.lit(-1)).alias("x")).collect()] == [True, False, False]
