"""Range joins, adapters, the batch audit, isolated analyzers and reports of unknown shape."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auditloom.ext import Registry
from auditloom.operators import audit as AU, findings as FN, ranges as R, scan, source as S
from auditloom.rules.contract import UNIT_RULES
from auditloom.sources.reports import read_reports


def test_values_in_intervals_equal_all_pairs(spark):
    r = random.Random(1)
    top = 2**64
    spans = [(k, a, a + r.choice([-1, 0, 1, 7, 100, 10**6, 2**53, top])) for k, a in enumerate(r.choice([r.randint(-50, 50), r.randint(0, top), 2**53 - 1]) for _ in range(80))]
    spans += [(900, None, 5), (901, 5, None), (902, -top, 2 * top), (903, 0, 2**31 - 1), (904, 1, 2**31), (905, 7, 7)]
    points = [(k, v) for k, v in enumerate([r.randint(-60, 200) for _ in range(40)] + [r.randint(0, top) for _ in range(40)] + [7, 2**31 - 1, 2**31, 2**53, 0, None])]
    d = lambda x: None if x is None else Decimal(x)
    iv = spark.createDataFrame([(k, d(a), d(z)) for k, a, z in spans], "k int, lo decimal(38,0), hi decimal(38,0)")
    pt = spark.createDataFrame([(k, d(v)) for k, v in points], "p int, v decimal(38,0)")
    got = [(x.p, x.k) for x in R.values_in(pt, "v", iv).collect()]
    assert sorted(got) == sorted((p, k) for p, v in points if v is not None for k, a, z in spans if a is not None and z is not None and a <= v <= z)
    inner = iv.select(F.col("k").alias("i"), F.col("lo").alias("a"), F.col("hi").alias("z"))
    got = [(x.i, x.k) for x in R.intervals_in(inner, "a", "z", iv).collect()]
    full = [s for s in spans if None not in s and s[1] <= s[2]]
    assert sorted(got) == sorted((i, k) for i, a, z in full for k, lo, hi in full if lo <= a and z <= hi)


def test_range_join_of_nothing_and_clashing_names(spark):
    iv = spark.createDataFrame([], "k int, lo long, hi long")
    assert R.values_in(spark.createDataFrame([(1,)], "v long"), "v", iv).count() == 0
    with pytest.raises(ValueError):
        R.values_in(spark.createDataFrame([(1,)], "k long"), "k", iv)


CODE = "pub fn withdraw(ctx: Context<W>, amount: u64) -> Result<()> {\n    let x = a + amount;\n    let p = ptr.offset(1);\n    Ok(())\n}\n"


def test_equal_flaws_in_five_places_stay_five(spark):
    files = spark.createDataFrame([(f"r{k}", f"src/{k}.rs", CODE) for k in range(5)], "repo string, path string, content string")
    units = S.attach_context(files, "content", ["repo", "path"])
    hits = scan.scan_rules(units, UNIT_RULES, "code", ["repo", "path", "unit_name", "line_no"], kind="unit_kind")
    n = hits.count()
    assert n >= 5 and n % 5 == 0
    kept = FN.consolidate(FN.union_findings(AU.from_hits(hits, "RULES", confidence=75)), ["program", "path"], F.lit(None).cast("string"), 0)
    assert kept.groupBy("program").count().where(f"count = {n // 5}").count() == 5
    # Rows that do not say where they are stay apart too, unless they are equal in every column.
    bare = FN.union_findings(hits.withColumn("description", F.col("repo")))
    assert FN.consolidate(bare, ["program"], F.lit(None).cast("string"), 0).count() == bare.distinct().count()


def test_batch_audit_has_clean_programs(spark):
    files = spark.createDataFrame([("bad", "a.rs", CODE), ("clean", "b.rs", "// nothing here\n")], "repo string, path string, content string")
    got = {x.program: x for x in AU.batch_audit(files).collect()}
    assert set(got) == {"bad", "clean"} and got["clean"].score == 100 and got["bad"].score < 100
    line = AU.audit_findings(files).where("engine = 'GEI'").first()
    assert (line.program, line.path, line.line_number, line.finding_id[:4]) == ("bad", "a.rs", 3, "GEI-") and line.confidence is not None


def test_a_failing_analyzer_fails_alone(spark):
    files = spark.createDataFrame([(f"r{k}", k) for k in range(20)], "repo string, n int")
    finding = lambda df: df.select(F.col("repo").alias("program"), F.lit(4).alias("severity"))
    reg = Registry()
    reg.register_analyzer("ok", finding, capabilities=["a"])
    reg.register_analyzer("row", lambda df: finding(df.withColumn("repo", F.when(F.col("n") == 7, F.raise_error(F.lit("row seven")).cast("string")).otherwise(F.col("repo")))), version="2")
    reg.register_analyzer("plan", lambda df: df.select("missing"))
    found, outcomes = reg.run_isolated(files)
    assert found.groupBy("engine").count().collect()[0].asDict() == {"engine": "ok", "count": 20}
    out = {x.engine: x for x in outcomes.collect()}
    assert (out["ok"].findings, out["ok"].error) == (20, None) and "row seven" in out["row"].error and out["row"].version == "2" and "missing" in out["plan"].error
    assert reg.run_isolated(files, "none")[0].count() == 0


def test_unknown_report_fields_keep_their_shape(spark, tmp_path):
    report = {"program_id": "P", "nested": {"a": [1, {"b": True}]}, "text": "t", "nothing": None, "exploits": [{"id": "1", "severity": 5, "trace": {"steps": [3, 4]}}, {"id": "2"}]}
    for name, body in {"x_report.json": json.dumps(report), "none.json": '{"program_id": "Q"}', "list.json": "[1]", "bad.json": "{"}.items():
        (tmp_path / name).write_text(body)
    r = read_reports(spark, str(tmp_path))
    get = lambda m, k, p, t: F.variant_get(F.element_at(m, F.lit(k)), p, t)
    x = r.where("program_id = 'P'").select(get(F.col("extras"), "nested", "$.a[1].b", "boolean").alias("b"), get(F.col("extras"), "text", "$", "string").alias("t"),
                                           F.sort_array(F.map_keys("extras")).alias("keys"), get(F.col("exploit_extras")[0], "trace", "$.steps[1]", "int").alias("step"),
                                           F.size(F.col("exploit_extras")[1]).alias("none")).first()
    assert (x.b, x.t, x["keys"], x.step, x.none) == (True, "t", ["nested", "nothing", "text"], 4, 0)
    assert r.where("program_id = 'Q'").select(F.size("extras").alias("n"), "actual_exploits").first() == (0, 0) and r.count() == 2


def test_pairs_of_one_bin_are_dealt_to_all_tasks(spark):
    """Few intervals in one file, all in one bin with all values: the work is their pairs, not their rows."""
    iv = spark.createDataFrame([(i, 0, 1000 + i % 3) for i in range(300)], "k int, lo long, hi long").coalesce(1)
    for n in (200, 1500):
        pt = spark.createDataFrame([(i, i % 1000) for i in range(n)], "p int, v long").coalesce(1)
        tasks = R.values_in(pt, "v", iv).groupBy(F.spark_partition_id()).count().collect()
        total = sum(r["count"] for r in tasks)
        assert total == 300 * n and max(r["count"] for r in tasks) < 0.5 * total
