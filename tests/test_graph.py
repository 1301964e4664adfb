import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import graph as G, vectors as VC


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "label string, node string")


def test_paths_and_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "a"))
    got = {(r.label, r.node): (r.depth, r.path) for r in G.propagate(e, seeds(spark, ("L", "a"))).collect()}
    assert got == {("L", "a"): (0, "a"), ("L", "b"): (1, "a>b"), ("L", "d"): (1, "a>d"), ("L", "c"): (2, "a>b>c")}


def test_has_path(spark):
    e = edges(spark, ("main", "helper"))
    assert G.has_path(e, "main", "helper") and not G.has_path(e, "helper", "main")


def test_hub_equals_brute_force(spark):
    """One source holds most edges, so salting is active; the result must not change."""
    rnd = random.Random(7)
    pairs = {("hub", f"n{i}") for i in range(3000)} | {(f"n{rnd.randrange(3000)}", f"n{rnd.randrange(3000)}") for _ in range(1500)}
    adj = {}
    for s, d in pairs:
        adj.setdefault(s, []).append(d)
    best, front = {"hub": (0, "hub")}, ["hub"]
    while front:
        nxt = {}
        for s in front:
            for d in adj.get(s, []):
                if d not in best:
                    nxt[d] = min(nxt.get(d, "~"), best[s][1] + ">" + d)
        for d, p in nxt.items():
            best[d] = (p.count(">"), p)
        front = list(nxt)
    got = {r.node: (r.depth, r.path) for r in G.propagate(edges(spark, *pairs), seeds(spark, ("L", "hub"))).collect()}
    assert got == best


def test_flows(spark):
    sinks = spark.createDataFrame([("c", "TokenTransfer"), ("b", "ValidationBypass")], "node string, sink_kind string")
    r = G.propagate(edges(spark, ("a", "b"), ("b", "c")), seeds(spark, ("InstructionData", "a"), ("Other", "a")))
    assert {(x.label, x.node, x.severity) for x in G.flows(r, sinks).collect()} == {
        ("InstructionData", "c", "Critical"), ("Other", "c", "Low"), ("InstructionData", "b", "High"), ("Other", "b", "High")}


def test_backward(spark):
    e = edges(spark, ("src", "m::f"), ("m::f", "v"), ("v", "invoke_x"), ("invoke_x", "sink"))
    r = G.backward_flows(e, spark.createDataFrame([("sink", "StateWrite")], "node string, sink_kind string"), spark.createDataFrame([("src", "OracleData")], "node string, source_kind string")).collect()
    assert [(x.path, x.variables, x.severity) for x in r] == [("sink>invoke_x>v>m::f>src", "sink>v>src", "Medium")]


def cfg(spark, e, d, u):
    s = "func string, node int, var string"
    return (spark.createDataFrame([("f", *x) for x in e], "func string, src int, dst int"), spark.createDataFrame([("f", *x) for x in d], s), spark.createDataFrame([("f", *x) for x in u], s))


def test_liveness_chain(spark):
    e, d, u = cfg(spark, [(1, 2), (2, 3)], [(1, "x"), (2, "y")], [(2, "x"), (3, "y")])
    live = G.live_vars(e, d, u)
    assert {(r.node, r.var) for r in live.collect()} == {(2, "x"), (3, "y")}
    assert G.dead_defs(d, G.live_out(live, e)).count() == 0


def test_two_dead_definitions(spark):
    e, d, u = cfg(spark, [(1, 2)], [(1, "x"), (2, "y")], [])
    assert G.dead_defs(d, G.live_out(G.live_vars(e, d, u), e)).count() == 2


def test_reaching_with_loop_against_worklist(spark):
    rnd = random.Random(3)
    e = sorted({(rnd.randrange(12), rnd.randrange(12)) for _ in range(22)})
    d = sorted({(rnd.randrange(12), rnd.choice("xyz")) for _ in range(14)})
    kills = {}
    for n, v in d:
        kills.setdefault(n, set()).add(v)
    inn = {n: set() for n in range(12)}
    changed = True
    while changed:
        changed = False
        for s, t in e:
            out = {(v, o) for v, o in inn[s] if v not in kills.get(s, ())} | {(v, s) for v in kills.get(s, ())}
            if not out <= inn[t]:
                inn[t] |= out
                changed = True
    ef, df, _ = cfg(spark, e, d, [])
    got = {(r.node, r.var, r.def_node) for r in G.reaching_defs(ef, df).collect()}
    assert got == {(n, v, o) for n, s in inn.items() for v, o in s}


def test_uninitialized_and_chains(spark):
    e, d, u = cfg(spark, [(1, 2), (2, 3)], [(2, "x")], [(2, "x"), (3, "x")])
    rd = G.reaching_defs(e, d)
    assert [(r.node, r.var) for r in G.uninitialized(u, rd).collect()] == [(2, "x")]
    chains = G.def_use(u, rd)
    assert [(r.node, r.def_node) for r in chains.collect()] == [(3, 2)] and G.unused_defs(d, chains).count() == 0


def test_field_and_path_taint(spark):
    uses = spark.createDataFrame([("account.data.amount",), ("account.other",), ("account.data",)], "path string")
    taints = spark.createDataFrame([("account.data", "T")], "path string, label string")
    assert {r.path for r in G.field_taint(uses, taints, []).collect()} == {"account.data.amount", "account.data"}
    u = spark.createDataFrame([("x", ["a", "b"]), ("x", ["c"])], "var string, conditions array<string>").withColumn("k", F.array_join("conditions", "&"))
    s = spark.createDataFrame([("x", ["a"], "T")], "var string, conditions array<string>, label string")
    assert [r.k for r in G.path_taint(u, s, ["k"]).collect()] == ["a&b"]


def test_contexts(spark):
    df = spark.createDataFrame([([("m", "1"), ("f", "2"), ("g", "3")],)], "calls array<struct<caller:string,loc:string>>")
    assert df.select(G.context_key(F.col("calls"), 2)).first()[0] == "f@2 -> g@3"


def test_message_passing_against_loops(spark):
    from math import sin
    feats, e = {1: [1.0, 0, 0, 2.0], 2: [0, 1.0, 0, 0], 3: [0.5, 0, 3.0, 0]}, [(1, 2), (2, 3), (1, 3)]
    w = [[sin((i + j) * 0.1) * (2 / 128) ** 0.5 for j in range(64)] for i in range(64)]
    h = {n: f + [0.0] * 60 for n, f in feats.items()}
    for _ in range(2):
        agg = {n: [2 * x for x in h[n]] for n in h}
        for s, t in e:
            agg[t] = [a + b for a, b in zip(agg[t], h[s])]
        h = {n: [max(0.0, sum(p * q for p, q in zip(row, a))) for row in w] for n, a in agg.items()}
    mean = [sum(v[i] for v in h.values()) / 3 for i in range(64)]
    want = {n: (sum((a - b) ** 2 for a, b in zip(v, mean)) / 64) ** 0.5 for n, v in h.items()}
    nodes = spark.createDataFrame([("f", n, [float(x) for x in v]) for n, v in feats.items()] + [("g", 1, [9.0])], "func string, node int, features array<double>")
    ed = spark.createDataFrame([("f", *x) for x in e], "func string, src int, dst int")
    got = {r.node: r.deviation for r in G.rms_outliers(G.message_pass(nodes, ed), threshold=None).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def brute_embed(text):
    import re
    v = [0.0] * 128
    for i, t in enumerate(re.split(r"[^a-zA-Z0-9]", text)):
        v[7 * i % 128] += VC.TOKEN_WEIGHTS.get(t, 0.1)
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


@pytest.mark.parametrize("text", ["", "invoke owner", "a b " * 200, "close.*=.*without"])
def test_embedding(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(VC.embed(F.col("t"))).first()[0]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, brute_embed(text)))


def test_cross_similarity(spark):
    rnd = random.Random(1)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    vs, ps = [(i, vec()) for i in range(20)], [(f"p{i}", vec()) for i in range(9)] + [("zero", [0.0] * 8)]
    got = {(r.id, r.p): r.similarity for r in VC.cross_similarity(spark.createDataFrame(vs, "id int, vector array<double>"), spark.createDataFrame(ps, "p string, vector array<double>"), ["id"], "p").collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for i, v in vs:
        for n, p in ps:
            want = 0.0 if norm(p) == 0 else sum(a * b for a, b in zip(v, p)) / norm(v) / norm(p)
            assert abs(got[i, n] - want) < 1e-9
    assert len(got) == 200


def test_fixpoint_has_no_silent_end(spark):
    from auditloom.plans.fixpoint import closure
    from pyspark.sql import functions as F
    seeds = spark.createDataFrame([(0,)], "node int")
    step = lambda f: f.where("node < 12").select((F.col("node") + 1).alias("node"))
    assert closure(seeds, step, ["node"]).count() == 13
    with pytest.raises(RuntimeError):
        closure(seeds, step, ["node"], max_rounds=3)


# ---- calls and returns

def program(spark):
    """main passes a, other passes b to one helper; helper calls a second one; only a is tainted."""
    edges = [("main.a", "helper.p", "call", "main@1"), ("helper.ret", "main.r", "return", "main@1"),
             ("other.b", "helper.p", "call", "other@2"), ("helper.ret", "other.r", "return", "other@2"),
             ("helper.p", "inner.p", "call", "helper@3"), ("inner.p", "inner.ret", "flow", ""), ("inner.ret", "helper.ret", "return", "helper@3")]
    return spark.createDataFrame(edges, "src string, dst string, kind string, site string")


def nodes(df):
    return {r["node"] for r in df.collect()}


def test_a_label_returns_only_to_its_caller(spark):
    seeds = spark.createDataFrame([("x", "main.a")], "label string, node string")
    assert nodes(G.context_taint(program(spark), seeds, 2)) == {"main.a", "helper.p", "inner.p", "inner.ret", "helper.ret", "main.r"}
    # One site is not enough for two calls: the first is forgotten, so both callers may get it.
    assert "other.r" in nodes(G.context_taint(program(spark), seeds, 1))


def test_a_label_that_starts_in_the_helper_reaches_all_callers(spark):
    seeds = spark.createDataFrame([("x", "helper.ret")], "label string, node string")
    assert nodes(G.context_taint(program(spark), seeds, 2)) == {"helper.ret", "main.r", "other.r"}


def test_contexts_are_kept_apart(spark):
    seeds = spark.createDataFrame([("x", "main.a")], "label string, node string")
    found = G.context_taint(program(spark), seeds, 2).persist()
    assert nodes(G.tainted_in(found, [])) == {"main.a", "main.r"}
    assert nodes(G.tainted_in(found, ["main@1"])) == {"helper.p", "helper.ret"}
    assert nodes(G.tainted_in(found, ["main@1", "helper@3"])) == {"inner.p", "inner.ret"}
    assert nodes(G.tainted_in(found, ["other@2"])) == set()


def test_recursion_ends_and_seeds_may_have_a_context(spark):
    edges = spark.createDataFrame([("f.p", "f.p", "call", "f@1"), ("f.p", "f.ret", "flow", ""), ("f.ret", "f.ret", "return", "f@1"), ("f.ret", "g.r", "return", "g@2")],
                                  "src string, dst string, kind string, site string")
    seeds = spark.createDataFrame([("x", "f.p", ["g@2"])], "label string, node string, context array<string>")
    found = G.context_taint(edges, seeds, 2)
    assert {tuple(r["context"]) for r in found.where("node = 'f.p'").collect()} == {("g@2",), ("g@2", "f@1"), ("f@1", "f@1")}
    assert "g.r" in nodes(found)
    try:
        G.context_taint(edges, seeds, 0)
        raise AssertionError
    except ValueError:
        pass


# ---- pivot index

@pytest.mark.parametrize("above,pivots,block,spread", [(0.6, 128, 2048, 0.3), (0.6, 7, 5, 0.5), (0.9, 16, 3, 0.1), (0.0, 1, 50, 1.0)])
def test_similar_pairs_equal_brute_force(spark, above, pivots, block, spread):
    rnd = random.Random(pivots)
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    near = lambda c: [x + rnd.gauss(0, spread) for x in c]
    rows = [(k, near(rnd.choice(centres))) for k in range(300)] + [(300 + k, centres[0]) for k in range(120)] + [(900, [0.0] * 12), (901, None), (None, centres[1])]
    df = spark.createDataFrame(rows, "id int, vector array<float>").repartition(3)
    pats = df.where("id % 9 = 0 or id > 400").withColumnRenamed("id", "p")
    got = VC.similar_pairs(df, pats, "id", "p", above=above, pivots=pivots, block=block).collect()
    ps = [(r.p, r.vector) for r in pats.collect() if r.vector]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) if norm(a) * norm(b) else -1
    want = {(r.id, p): cos(r.vector, v) for r in df.collect() if r.vector for p, v in ps}
    found = {(r.id, r.p): r.similarity for r in got}
    assert len(found) == len(got)
    assert all(abs(found[k] - want[k]) < 1e-6 for k in found)
    assert {k for k, c in want.items() if c > above + 1e-6} <= set(found) <= {k for k, c in want.items() if c > above - 1e-6}


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "id int, vector array<double>")
    assert VC.similar_pairs(df, df.withColumnRenamed("id", "p"), "id", "p").count() == 0


def test_lines_only_of_files_like_the_pattern(spark):
    body = VC.PATTERNS["Missing Signer Check"]
    texts = {1: body, 2: "fn nothing() {}\n" * 30 + "authority is_signer", 3: None, 4: "", 5: "let total = price * amount;\n" * 9 + body, 6: ("x " * 128 + "\n") * 20 + body}
    files = spark.createDataFrame(list(texts.items()), "id int, text string")

    def similar(text):
        lines = text.split("\n")
        v = [sum(x) for x in zip(*([a * (1 + i / len(lines) * 0.5) for a in brute_embed(l)] for i, l in enumerate(lines)))]
        n = sum(x * x for x in v) ** 0.5
        return sum(a * b for a, b in zip(v, brute_embed(body))) / n if n else 0.0

    want = {k for k, t in texts.items() if t and similar(t) > 0.6}
    of = lambda df: {r.id: r for r in df.where("pattern = 'Missing Signer Check'").collect()}
    gate, got, every = of(VC.matching_files(files, "text", ["id"])), of(VC.gated_lines(files, "text", ["id"])), of(VC.best_line(files, "text", ["id"]))
    assert 1 in want and set(gate) == want and set(got) == want & set(every) and set(every) - want
    assert all(abs(gate[k].file_similarity - similar(texts[k])) < 1e-9 for k in want)
    assert (got[1].line_no, got[1].tier) == (1, "Critical")


def test_facts_in_functions_equal_rounds(spark, monkeypatch):
    from auditloom.plans import grouped
    rnd = random.Random(5)
    e = {(f"f{rnd.randrange(40)}", rnd.randrange(9), rnd.randrange(9)) for _ in range(500)}
    d, u = ({(f"f{rnd.randrange(40)}", rnd.randrange(9), rnd.choice("xyz")) for _ in range(n)} for n in (200, 150))
    s = "func string, node int, var string"
    e, d, u = spark.createDataFrame(sorted(e), "func string, src int, dst int"), spark.createDataFrame(sorted(d), s), spark.createDataFrame([*sorted(u), ("f1", None, "x"), (None, 1, "y")], s)
    jobs = lambda: [sorted(map(str, r.collect())) for r in (G.reaching_defs(e, d), G.live_vars(e, d, u))]
    small = jobs()
    # No rounds over all tasks where functions are small.
    monkeypatch.setattr(G, "closure", None)
    assert jobs() == small
    monkeypatch.undo()
    # Functions of more than a few rows go by rounds, the others stay in their tasks.
    for large in (0, 18):
        monkeypatch.setattr(grouped, "LARGE", large)
        assert jobs() == small
    assert "Row(func=None, node=1, var='y')" in small[1] and "Row(func='f1', node=None, var='x')" in small[1]


def test_whole_functions_are_cut_at_their_ends():
    import pyarrow as pa
    from auditloom.plans.grouped import _whole_functions
    funcs = [k // 7 for k in range(100)] + [99] * 40
    batches = pa.table({"func": funcs}).to_batches(max_chunksize=9)
    parts = [t.column("func").to_pylist() for t in _whole_functions(batches, 20)]
    assert sum(parts, []) == funcs and len(parts) > 3 and all(not set(a) & set(b) for a, b in zip(parts, parts[1:]))


def test_outliers_in_functions_equal_message_passing(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(f"f{k % 30}", k // 30, [rnd.random() * 3 for _ in range(4)]) for k in range(200)] + [("f1", 0, [1.0]), ("f2", None, [2.0]), (None, 1, [1.0]), ("g", 1, [9.0])]
    nodes = spark.createDataFrame(rows, "func string, node int, features array<double>")
    e = [(f"f{rnd.randrange(40)}", rnd.randrange(9), rnd.randrange(9)) for _ in range(400)] + [("f1", None, 1), ("f1", 1, None), (None, 1, 1)]
    edges = spark.createDataFrame(e, "func string, src int, dst int")
    found = lambda d: {(r.func, r.node): r.deviation for r in d.collect()}
    want = found(G.rms_outliers(G.message_pass(nodes, edges), None))
    for large in (20, 1000):
        got = found(G.graph_outliers(nodes.repartition("func"), edges.repartition("func"), threshold=None, large=large))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # Small functions move no messages over the network.
    monkeypatch.setattr(G, "message_pass", None)
    assert found(G.graph_outliers(nodes, edges)).keys() == {k for k, d in want.items() if d > 0.7}


def test_states_without_a_label_end(spark):
    """Nulls are a key like others, in rounds of many rows and in those of few."""
    seeds = spark.createDataFrame([(None, "main.a"), (None, "helper.ret")], "label string, node string")
    found = G.context_taint(program(spark), seeds, 2, max_rounds=20)
    assert nodes(found) == {"main.a", "helper.p", "inner.p", "inner.ret", "helper.ret", "main.r", "other.r"}
    from auditloom.plans import fixpoint
    ring = lambda f: f.select(F.explode(F.array((F.col("node") + 1) % 40, F.lit(None).cast("long"))).alias("node"))
    got = fixpoint.states(spark.range(40).where("id <> 3").select(F.col("id").alias("node")), ring, max_rounds=6)
    assert got.count() == 41 and got.where("node is null").first()["depth"] == 1


def test_rounds_of_many_rows_are_written_once(spark, monkeypatch):
    from auditloom.plans import fixpoint
    written = []
    monkeypatch.setattr(fixpoint, "cut_counted", lambda d, inner=fixpoint.cut_counted: written.append(1) or inner(d))
    e = edges(spark, *[(f"{'abc'[k]}{i}", f"{'bcd'[k]}{i}") for k in range(3) for i in range(20)], ("a0", "b0"))
    got = fixpoint.closure(spark.createDataFrame([(f"a{i}",) for i in range(20)], "node string"),
                           lambda f: f.join(e, f["node"] == e["src"]).select(F.col("dst").alias("node")).distinct(), ["node"])
    assert got.count() == 80 and len(written) == 5
