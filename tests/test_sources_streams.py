import json

import pytest
from pyspark.sql import functions as F, types as T

from auditloom.ext import Registry
from auditloom.rules.formula import Has, Rule
from auditloom.sources.corpus import idl_names, read_corpus, skipped_files
from auditloom.sources.registry import registry_history
from auditloom.sources.reports import explode_findings, prefer_source, read_reports, write_findings
from auditloom.streaming import io, monitor as M, transactions as X


def test_corpus(spark, tmp_path):
    for p, text in {"r1/src/lib.rs": "fn a() {}", "r1/x.txt": "no", "r2/größe.rs": "ä", "r2/big.rs": "x" * 2000}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = {r.repo: r.content for r in read_corpus(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {"r1": "fn a() {}", "r2": "ä"}
    assert read_corpus(spark, str(tmp_path)).count() == 3
    assert [(r.repo, r.size) for r in skipped_files(spark, str(tmp_path), 1000).collect()] == [("r2", 2000)]
    assert read_corpus(spark, [str(tmp_path), str(tmp_path / "r1")]).count() == 3


def test_reports(spark, tmp_path):
    report = {"program_id": "P", "total_exploits": 9, "new_field": "kept", "exploits": [{"id": "1", "vulnerability_type": "T", "severity": 5}, {"id": "2", "severity": 2}]}
    for d, body in {"prod/vault_report.json": json.dumps(report), "audit/vault_report.json": json.dumps(report), "prod/bare.json": "{}", "prod/bad.json": "{nope"}.items():
        f = tmp_path / d
        f.parent.mkdir(exist_ok=True)
        f.write_text(body)
    r = read_reports(spark, str(tmp_path))
    assert {(x.source, x.program_name) for x in r.collect()} == {("prod", "vault"), ("audit", "vault"), ("prod", "bare")}
    best = prefer_source(r, "file", "source", "prod")
    assert {(x.file, x.source) for x in best.collect()} == {("vault_report.json", "prod"), ("bare.json", "prod")}
    v = best.where("program_name = 'vault'").first()
    assert (v.total_exploits, v.actual_exploits) == (9, 2)
    assert best.where("program_name = 'vault'").select(F.variant_get(F.element_at("extras", F.lit("new_field")), "$", "string")).first()[0] == "kept"
    f = explode_findings(best)
    assert [(x.id, x.vuln_type, x.severity) for x in f.orderBy("id").collect()] == [("1", "T", 5), ("2", None, 2)]
    for fmt in ("json", "parquet"):
        write_findings(f.withColumn("program", F.col("program_name")), str(tmp_path / "out" / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / "out" / fmt)).count() == 2


def test_idl_and_registry(spark):
    df = spark.createDataFrame([(1, '{"accounts": [{"name": "a"}], "instructions": [{"name": "i"}, {"name": "j"}]}'), (2, "{}")], "id int, doc string")
    a, b = idl_names(df, "doc", ["id"]).orderBy("id").collect()
    assert (a.accounts, a.instructions, b.accounts, b.instructions) == (["a"], ["i", "j"], [], [])
    rec = spark.createDataFrame([("p", 1), ("q", 2), ("p", 3)], "program string, ts int")
    assert [r.ts for r in registry_history(rec, "program", "p", "ts").collect()] == [3, 1]


BAL = "array<struct<account:string,mint:string,amount:decimal(20,0),decimals:int>>"
TX = f"signature string, accounts array<string>, compute_units long, pre_token_balances {BAL}, post_token_balances {BAL}"


def tx(spark, name="s", accounts=(), units=0, pre=(), post=()):
    from decimal import Decimal
    bal = lambda xs: [("a", m, Decimal(n), 6) for m, n in xs]
    return spark.createDataFrame([(name, list(accounts), units, bal(pre), bal(post))], TX)


def test_transaction_signals(spark):
    kinds = lambda **k: [r.threat_type for r in X.tx_signals(tx(spark, **k), ["signature"]).collect()]
    same = ("n", 7)
    assert kinds(pre=[("m", 2 * 10 ** 13), same], post=[("m", 2 * 10 ** 13 - 10 ** 12), same]) == []
    assert kinds(pre=[("m", 2 * 10 ** 13), same], post=[("m", 2 * 10 ** 13 - 10 ** 12 - 1), same]) == ["FlashLoanAttack"]
    assert kinds(pre=[("m", 100)], post=[("m", 10)]) == [] and kinds(pre=[("m", 100)], post=[("m", 9)]) == ["AbnormalTokenFlow"]
    assert kinds(accounts=[f"k{i}" for i in range(20)]) == [] and kinds(accounts=[f"k{i}" for i in range(21)]) == ["UnusualAccountPattern"]
    assert kinds(accounts=["a", "a"]) == ["ReentrancyAttempt"]
    assert kinds(units=1_200_000) == [] and kinds(units=1_200_001) == ["SuspiciousTimingPattern"]
    r = X.fold_signals(tx(spark, accounts=["a", "a"], units=2_000_000, pre=[("m", 100)], post=[("m", 9)]), ["signature"]).first()
    assert (r.threat_type, r.threat_level, r.confidence) == ("AbnormalTokenFlow", "Critical", 0.8) and r.explanation.count("; ") == 2
    assert "91 tokens (91% of balance)" in r.explanation
    assert X.fold_signals(tx(spark), ["signature"]).count() == 0


def test_user_signal_and_rule(spark):
    reg = Registry()
    reg.register_signal(F.when(F.col("compute_units") > 5, X.signal("Custom", 0.2, F.lit("units"))))
    assert [r.threat_type for r in X.tx_signals(tx(spark, units=6), [], reg.signals).collect()] == ["Custom"]
    reg.register_rule(Rule("U-1", "User", "User", 3, None, Has("bad")))
    files = spark.createDataFrame([("a.rs", "bad"), ("b.txt", "bad")], "path string, content string")
    from auditloom.operators.scan import scan_rules
    reg.register_analyzer("mine", lambda f: scan_rules(f, reg.rules, "content", ["path"]), F.endswith("path", F.lit(".rs")))
    reg.register_analyzer("broken", lambda f: f.select("no_such_column"))
    out = reg.run(files)
    assert [(r.engine, r.path, r.severity) for r in out.collect()] == [("mine", "a.rs", 3)] and "broken" in reg.failed
    assert reg.run(files, min_severity=4).count() == 0 and reg.run(files, capability="none").count() == 0


def test_metrics_and_tiers(spark):
    s = spark.createDataFrame([("v", 1, 1, 3000, 60, 60), ("v", 2, 1, 0, 250, 60)], "validator string, ts int, num_slots long, num_transactions long, num_non_vote_transactions long, sample_period_secs long")
    a, b = M.validator_metrics(s, ["validator"], "ts", F.lit(0)).orderBy("ts").collect()
    assert (a.skip_pct, a.stress_pct, a.lag_ms, a.tps) == (0.0, 60.0, 600.0, 50.0) and (b.skip_pct, b.lag_ms) == (50.0, 2000.0)
    t = spark.createDataFrame([(500.0, 72.0, 3.0), (1501.0, 60.0, 6.5)], "lag_ms double, stress_pct double, skip_pct double")
    assert sorted((r.metric, r.severity) for r in M.tier(t, [], ["lag_ms", "stress_pct", "skip_pct"]).collect()) == [("lag_ms", 5), ("skip_pct", 4), ("stress_pct", 3)]


def ticks(spark, rows):
    return spark.createDataFrame(rows, "key string, sec long, amount long").select("key", F.timestamp_seconds("sec").alias("ts"), "amount", F.col("sec").alias("event_id"))


def test_drain_window(spark):
    assert M.rapid_drain(ticks(spark, [("k", 0, 100), ("k", 119, 15)]), "key", "ts", "amount", 85).count() >= 1
    assert M.rapid_drain(ticks(spark, [("k", 0, 100), ("k", 240, 15)]), "key", "ts", "amount", 85).count() == 0


def test_spike_and_deviation(spark):
    for n, want in ((199, 0), (200, 1)):
        assert M.spike(ticks(spark, [("k", i, 1) for i in range(n)]), "ts", F.lit(True), 200).count() == want
    # average 100: five percent off passes, six does not
    for off, want in ((5, 0), (6, 1)):
        assert M.price_deviation(ticks(spark, [("k", 0, 100 - off), ("k", 1, 100 + off)]), "key", "ts", "amount").count() == want


def test_stream_drops_late_rows_and_equals_batch(spark, tmp_path):
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("amount", T.LongType()), T.StructField("event_id", T.LongType())])
    on_time = [("k", i * 10, 100) for i in range(90)]
    src = tmp_path / "in"
    ticks(spark, on_time).select(*schema.names).coalesce(1).write.parquet(str(src / "a"))
    ticks(spark, [("k", 100_000, 1)]).select(*schema.names).coalesce(1).write.parquet(str(src / "b"))
    # lateness is judged by the watermark of the batch before, so one more batch comes first
    ticks(spark, [("k", 100_001, 1)]).select(*schema.names).coalesce(1).write.parquet(str(src / "c"))
    ticks(spark, [("k", 5, 100)]).select(*schema.names).coalesce(1).write.parquet(str(src / "d"))
    import os
    for i, d in enumerate("abcd"):
        for f in (src / d).glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    s = io.read_tx_stream(spark, str(src / "*"), schema, max_per_trigger=1)
    q = (M.spike(s, "ts", F.lit(True), 1).writeStream.option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
         .format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, M.spike(ticks(spark, on_time), "ts", F.lit(True), 1).collect()))
    assert got == want


def test_alert_sink_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "id int, level int").write.parquet(str(tmp_path / "in"))
    s = io.read_tx_stream(spark, str(tmp_path / "in"), "id int, level int")
    targets = [str(tmp_path / "t1"), str(tmp_path / "t2")]
    for run in range(2):  # the second run starts over, as after a lost checkpoint
        io.alert_sink(s, 3, targets, str(tmp_path / f"cp{run}"), once=True).awaitTermination()
    for t in targets:
        assert sorted(r.id for r in spark.read.parquet(t).collect()) == [2, 3]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_program_gets_one_file(spark, tmp_path, fmt):
    rows = spark.range(600).select((F.col("id") % 300).cast("string").alias("program"), F.col("id").alias("seq")).repartition(6, "seq")
    write_findings(rows, str(tmp_path / "out"), fmt)
    files = [len(list(d.glob("part-*"))) for d in (tmp_path / "out").iterdir() if d.is_dir()]
    assert files == [1] * 300
    back = spark.read.format(fmt).schema("seq long, program string").load(str(tmp_path / "out"))
    assert sorted((x.program, x.seq) for x in back.collect()) == sorted((str(k % 300), k) for k in range(600))


def test_rows_of_a_common_program_are_dealt(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.lit(None)).alias("program"), F.col("id").alias("seq"))
    write_findings(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "program=hot").glob("part-*"))) > 1
    assert sorted(x.seq for x in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(4000))


def test_signals_read_the_accounts_once_and_uneven_balances(spark):
    """The accounts of a transaction are one use of the column, whatever they are computed from; positions of one side alone fire nothing."""
    df = tx(spark, accounts=["a", "a"], pre=[("m", 100), ("n", 5)], post=[("m", 9)])
    plan = df.select(X.default_signals().alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.splitlines()[0].count("accounts#") == 1
    got = [r.threat_type for r in X.tx_signals(df, ["signature"]).collect()]
    assert got == ["AbnormalTokenFlow", "ReentrancyAttempt"]
    assert [r.threat_type for r in X.tx_signals(tx(spark, pre=[("m", 5)], post=[("m", 5), ("n", 10 ** 14)]), []).collect()] == []


def test_reports_are_one_file_each_in_one_folder(spark, tmp_path):
    from auditloom.sources.reports import write_reports
    docs = spark.range(40).select(F.col("id").cast("string").alias("program_id"), F.lit(3).alias("total_exploits"))
    write_reports(docs, str(tmp_path / "r"), "program_id")
    files = [f for f in (tmp_path / "r").rglob("*.json") if f.stat().st_size]
    assert len(files) == 40 and {f.parent for f in files} == {tmp_path / "r"}
    assert {r.program_id for r in read_reports(spark, str(tmp_path / "r")).collect()} == {str(i) for i in range(40)}


def test_slices_of_many_files_come_one_a_trigger(spark, monkeypatch, tmp_path):
    """All tasks write a slice, and a trigger still gets exactly one."""
    monkeypatch.setattr(io, "ROWS_A_FILE", 100)
    df = spark.range(0, 2000, 1, 3).select("id", (F.col("id") % 3).alias("s"))
    path, files = io.in_triggers(df, [F.col("s") == k for k in range(3)])
    assert files > 1 and len(spark.read.parquet(path).inputFiles()) == 3 * files
    got = {}
    stream = io.read_tx_stream(spark, path, df.schema, max_per_trigger=files)
    q = stream.writeStream.foreachBatch(lambda b, n: got.update({n: sorted(tuple(r) for r in b.collect())})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {k: [(i, k) for i in range(k, 2000, 3)] for k in range(3)}
    path, files = io.in_triggers(df, [F.col("id") < 1900, F.col("id") >= 1900, F.lit(False)])
    assert files == 1 and spark.read.parquet(path).count() == 2000
