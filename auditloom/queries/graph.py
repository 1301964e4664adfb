"""Queries on graphs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import graph as G, vectors as VC
from auditloom.queries import views as V
from auditloom.queries.base import Area
from auditloom.queries.views import CFG_SQL, EDGES_SQL, SEEDS_SQL, with_sql

area = Area()
QUERIES, ORACLE, query = area.queries, area.oracle, area.query

_KINDS = ("InstructionData", "OracleData", "UncheckedAccount", "UserProvidedSeeds", "DeserializedData")
_SINKS = ("StateWrite", "TokenTransfer", "CPIInvoke", "ValidationBypass", "PDADerivation")
_REACH_SQL = """reach AS (
  SELECT label, node, 0 AS depth, node AS path FROM seeds_v
  UNION ALL
  SELECT label, dst, depth + 1, path || '>' || dst FROM (
    SELECT r.label, e.dst, r.depth, r.path, row_number() OVER (PARTITION BY r.label, e.dst ORDER BY r.path || '>') AS rn
    FROM reach r JOIN edges_v e ON e.src = r.node) WHERE rn = 1),
best AS (SELECT label, node, MIN(depth) AS depth, arg_min(path, (depth, path)) AS path FROM reach GROUP BY label, node)"""


@query("taint_propagation", with_sql(EDGES_SQL, SEEDS_SQL, _REACH_SQL, body="SELECT label, node, CAST(depth AS INTEGER) AS depth, path FROM best", recursive=True))
def _(spark, sf):
    return G.propagate(V.edges(spark, sf), V.seeds(spark, sf))


_SEG = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_KIND_SQL = "CASE label " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in zip(_SEG, _KINDS)) + " ELSE 'InstructionData' END"


def kind_of(label):
    out = F.lit("InstructionData")
    for s, k in zip(_SEG, _KINDS):
        out = F.when(label == s, k).otherwise(out)
    return out


_SEV_SQL = "CASE " + " ".join(f"WHEN " + (f"sink_kind = '{k}'" if s == "*" else f"kind = '{s}' AND sink_kind = '{k}'") + f" THEN '{v}'"
                              for (s, k), v in G.FLOW_SEVERITY.items()) + " ELSE 'Low' END"


@query("source_sink_flows", with_sql(EDGES_SQL, SEEDS_SQL, _REACH_SQL, f"""sinks AS (SELECT 'n' || n_nationkey AS node, {V.choose_sql(_SINKS, 'n_nationkey')} AS sink_kind FROM nation),
kinds AS (SELECT DISTINCT {_KIND_SQL} AS kind, node FROM best)""", body=f"""
SELECT kind, node, sink_kind, {_SEV_SQL} AS severity FROM kinds JOIN sinks USING (node)""", recursive=True))
def _(spark, sf):
    seeds = V.seeds(spark, sf).select(kind_of(F.col("label")).alias("label"), "node")
    sinks = V.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"),
                                                V.choose(_SINKS, F.col("n_nationkey")).alias("sink_kind"))
    f = G.flows(G.propagate(V.edges(spark, sf), seeds), sinks)
    return f.select(F.col("label").alias("kind"), "node", "sink_kind", "severity")


@query("backward_flows", with_sql(EDGES_SQL, """sinks AS (SELECT 'n' || n_nationkey AS node FROM nation),
back AS (SELECT node AS sink, node, 0 AS depth, node AS path FROM sinks
  UNION ALL SELECT sink, src, depth + 1, path || '>' || src FROM (
    SELECT b.sink, e.src, b.depth, b.path, row_number() OVER (PARTITION BY b.sink, e.src ORDER BY b.path || '>') AS rn FROM back b JOIN edges_v e ON e.dst = b.node) WHERE rn = 1),
best AS (SELECT sink, node, arg_min(path, (depth, path)) AS path FROM back GROUP BY ALL)""", body=f"""
SELECT sink, node AS source, path, {_SEV_SQL} AS severity FROM (SELECT b.sink, b.node, b.path, {V.choose_sql(_SINKS, "CAST(substring(b.sink, 2) AS INTEGER)")} AS sink_kind,
  {_KIND_SQL.replace('label', 'c.c_mktsegment')} AS kind FROM best b JOIN customer c ON b.node = 'c' || c.c_custkey)""", recursive=True))
def _(spark, sf):
    sinks = V.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"),
                                                V.choose(_SINKS, F.col("n_nationkey")).alias("sink_kind"))
    sources = V.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"),
                                                    kind_of(F.col("c_mktsegment")).alias("source_kind"))
    return G.backward_flows(V.edges(spark, sf), sinks, sources).select("sink", "source", "path", "severity")


@query("reachable_nodes", with_sql(EDGES_SQL, """r AS (SELECT 's' || s_suppkey AS node, 0 AS depth FROM supplier WHERE s_acctbal < 0
  UNION SELECT e.src, r.depth + 1 FROM r JOIN edges_v e ON e.dst = r.node)""", body="SELECT node, CAST(MIN(depth) AS INTEGER) AS depth FROM r GROUP BY node", recursive=True))
def _(spark, sf):
    back = V.edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = V.table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.reachable(back, start)


@query("call_contexts", """SELECT event_id, array_to_string(sites[greatest(len(sites) - 1, 1):len(sites)], ' -> ') AS context FROM (SELECT event_id,
 (['click@' || (event_id % 7), event_type || '@' || (user_id % 5), 'view@' || (event_id % 3), event_type || '@' || (event_id % 11)])[1:(event_id % 4) + 1] AS sites FROM events)""")
def _(spark, sf):
    site = lambda caller, n: F.struct(caller.alias("caller"), n.cast("string").alias("loc"))
    e, t = F.col("event_id"), F.col("event_type")
    chain = F.slice(F.array(site(F.lit("click"), e % 7), site(t, F.col("user_id") % 5), site(F.lit("view"), e % 3), site(t, e % 11)), F.lit(1), (e % 4 + 1).cast("int"))
    return V.table(spark, sf, "events").select("event_id", chain.alias("calls")).select("event_id", G.context_key(F.col("calls"), 2).alias("context"))


# Every part is a call site: function p_partkey // 4 passes its v1 to another one and gets that one's ret back as its v2.
_CALL_SQL = """fns AS (SELECT MAX(p_partkey) // 4 + 1 AS n FROM part),
sites_v AS (SELECT p_partkey AS site, p_partkey // 4 AS f, (p_partkey * 13 + p_size) % n AS g FROM part, fns),
call_edges AS (SELECT 'f' || f || '.v1' AS src, 'f' || g || '.v1' AS dst, 'call' AS kind, 's' || site AS site FROM sites_v
  UNION ALL SELECT 'f' || g || '.ret', 'f' || f || '.v2', 'return', 's' || site FROM sites_v
  UNION ALL SELECT DISTINCT 'f' || f || '.v1', 'f' || f || '.ret', 'flow', '' FROM sites_v WHERE f % 3 <> 0
  UNION ALL SELECT DISTINCT 'f' || f || '.v2', 'f' || f || '.out', 'flow', '' FROM sites_v),
call_seeds AS (SELECT DISTINCT 'l' || s_nationkey % 5 AS label, 'f' || (s_suppkey * 37) % n || '.v1' AS node FROM supplier, fns)"""


def call_graph(spark, sf):
    """(edges, seeds) of a program with one call site a part."""
    part = V.table(spark, sf, "part")
    n = part.agg((F.floor(F.max("p_partkey") / 4) + 1).cast("long")).scalar()
    var = lambda f, v: F.concat(F.lit("f"), f.cast("string"), F.lit(f".{v}"))
    f, g = F.col("f"), F.col("g")
    sites = part.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("site"), F.floor(F.col("p_partkey") / 4).alias("f"),
                        ((F.col("p_partkey") * 13 + F.col("p_size")) % n).alias("g"))
    edge = lambda src, dst, kind, site: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), site.alias("site"))
    calls = sites.select(F.inline(F.array(edge(var(f, "v1"), var(g, "v1"), G.CALL, F.col("site")), edge(var(g, "ret"), var(f, "v2"), G.RETURN, F.col("site")))))
    own = sites.select("f").distinct()
    flows = own.where(f % 3 != 0).select(F.inline(F.array(edge(var(f, "v1"), var(f, "ret"), G.FLOW, F.lit(""))))).unionByName(
        own.select(F.inline(F.array(edge(var(f, "v2"), var(f, "out"), G.FLOW, F.lit(""))))))
    seeds = V.table(spark, sf, "supplier").select(F.concat(F.lit("l"), (F.col("s_nationkey") % 5).cast("string")).alias("label"), var((F.col("s_suppkey") * 37) % n, "v1").alias("node"))
    return calls.unionByName(flows), seeds.distinct()


@query("context_taint", with_sql(_CALL_SQL, """states AS (SELECT label, node, CAST([] AS VARCHAR[]) AS ctx FROM call_seeds
  UNION SELECT label, dst, CASE WHEN kind = 'call' THEN list_append(ctx, site)[greatest(len(ctx), 1):] WHEN kind = 'return' AND len(ctx) > 0 THEN ctx[:len(ctx) - 1] ELSE ctx END
  FROM states JOIN call_edges ON src = node WHERE kind <> 'return' OR len(ctx) = 0 OR ctx[len(ctx)] = site)""", body="""
SELECT label, node, array_to_string(ctx, ' -> ') AS context FROM states""", recursive=True))
def _(spark, sf):
    edges, seeds = call_graph(spark, sf)
    return G.context_taint(edges, seeds, 2).select("label", "node", G.context_text(F.col("context")).alias("context"))


_FT_SQL = """uses_v AS (SELECT l_orderkey, l_partkey, 'b' || (l_suppkey % 40) || '.f' || (l_partkey % 5) || CASE WHEN l_linenumber % 2 = 0 THEN '.g' || (l_linenumber % 3) ELSE '' END AS path FROM lineitem),
taints_v AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'b' || (p_partkey % 60) WHEN 1 THEN 'b' || (p_partkey % 40) || '.f' || (p_size % 5) ELSE 'b' || (p_partkey % 40) || '.f' || (p_size % 5) || '.g1' END AS path,
  p_brand AS label FROM part)"""


@query("field_taint", with_sql(_FT_SQL, body="""SELECT DISTINCT u.path, t.label FROM (SELECT DISTINCT path FROM uses_v) u JOIN taints_v t ON u.path = t.path OR starts_with(u.path, t.path || '.')"""))
def _(spark, sf):
    s = lambda c: c.cast("string")
    l, p = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part")
    uses = l.select(F.concat(F.lit("b"), s(F.col("l_suppkey") % 40), F.lit(".f"), s(F.col("l_partkey") % 5),
                             F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(".g"), s(F.col("l_linenumber") % 3))).otherwise("")).alias("path")).distinct()
    b = lambda n: F.concat(F.lit("b"), s(F.col("p_partkey") % n))
    bf = F.concat(b(40), F.lit(".f"), s(F.col("p_size") % 5))
    n = F.col("p_size") % 3
    taints = p.select(F.when(n == 0, b(60)).when(n == 1, bf).otherwise(F.concat(bf, F.lit(".g1"))).alias("path"), F.col("p_brand").alias("label"))
    return G.field_taint(uses, taints, []).select("path", "label")


_PT_SQL = """u AS (SELECT DISTINCT (['x', 'y', 'z'])[l_partkey % 3 + 1] AS var, CASE l_linenumber % 3 WHEN 0 THEN [] WHEN 1 THEN ['a' || (l_suppkey % 4)] ELSE ['a' || (l_suppkey % 4), 'b' || (l_partkey % 4)] END AS conds FROM lineitem),
st AS (SELECT DISTINCT (['x', 'y', 'z'])[o_orderkey % 3 + 1] AS var, CASE o_custkey % 3 WHEN 0 THEN ['a' || (o_custkey % 4)] WHEN 1 THEN ['a' || (o_orderkey % 4), 'b' || (o_custkey % 4)] ELSE ['c1'] END AS conds,
   o_orderpriority AS label FROM orders)"""


@query("path_taint", with_sql(_PT_SQL, body="""SELECT DISTINCT array_to_string(u.conds, '&') AS conds, u.var, st.label FROM u JOIN st ON u.var = st.var AND len(st.conds) <= len(u.conds) AND u.conds[1:len(st.conds)] = st.conds"""))
def _(spark, sf):
    s = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    l, o = V.table(spark, sf, "lineitem"), V.table(spark, sf, "orders")
    n, empty = F.col("l_linenumber") % 3, F.array().cast("array<string>")
    uses = l.select(V.choose(("x", "y", "z"), F.col("l_partkey")).alias("var"), F.when(n == 0, empty).when(n == 1, F.array(s("a", "l_suppkey", 4)))
                    .otherwise(F.array(s("a", "l_suppkey", 4), s("b", "l_partkey", 4))).alias("conditions")).distinct().withColumn("conds", F.array_join("conditions", "&"))
    m = F.col("o_custkey") % 3
    states = o.select(V.choose(("x", "y", "z"), F.col("o_orderkey")).alias("var"), F.when(m == 0, F.array(s("a", "o_custkey", 4))).when(
        m == 1, F.array(s("a", "o_orderkey", 4), s("b", "o_custkey", 4))).otherwise(F.array(F.lit("c1"))).alias("conditions"), F.col("o_orderpriority").alias("label"))
    return G.path_taint(uses, states, ["conds"])


@query("merged_labels", """SELECT DISTINCT node, label FROM (SELECT l_suppkey AS node, l_returnflag AS label FROM lineitem UNION ALL SELECT l_suppkey, l_linestatus FROM lineitem)""")
def _(spark, sf):
    l = V.table(spark, sf, "lineitem")
    part = lambda c: l.select(F.col("l_suppkey").alias("node"), F.col(c).alias("label"))
    return G.merge_paths(part("l_returnflag"), part("l_linestatus"))


_RD_SQL = """rd AS (SELECT d.func, e.dst AS node, d.var, d.node AS def_node FROM cfg_defs d JOIN cfg_edges e ON e.func = d.func AND e.src = d.node
  UNION SELECT r.func, e.dst, r.var, r.def_node FROM rd r JOIN cfg_edges e ON e.func = r.func AND e.src = r.node
    WHERE NOT EXISTS (SELECT 1 FROM cfg_defs k WHERE k.func = r.func AND k.node = r.node AND k.var = r.var))"""
_LV_SQL = """lv AS (SELECT func, node, var FROM cfg_uses UNION SELECT l.func, e.src, l.var FROM lv l JOIN cfg_edges e ON e.func = l.func AND e.dst = l.node
    WHERE NOT EXISTS (SELECT 1 FROM cfg_defs k WHERE k.func = l.func AND k.node = e.src AND k.var = l.var)),
lo AS (SELECT DISTINCT l.func, e.src AS node, l.var FROM lv l JOIN cfg_edges e ON e.func = l.func AND e.dst = l.node)"""


def _reach(spark, sf):
    c = V.cfg(spark, sf)
    return c, G.reaching_defs(c["edges"], c["defs"])


def _live(spark, sf):
    c = V.cfg(spark, sf)
    return c, G.live_vars(c["edges"], c["defs"], c["uses"])


@query("reaching_definitions", with_sql(CFG_SQL, _RD_SQL, body="SELECT * FROM rd", recursive=True))
def _(spark, sf):
    return _reach(spark, sf)[1]


@query("live_variables", with_sql(CFG_SQL, _LV_SQL, body="SELECT * FROM lv", recursive=True))
def _(spark, sf):
    return _live(spark, sf)[1]


@query("dead_definitions", with_sql(CFG_SQL, _LV_SQL, body="SELECT func, node, var FROM cfg_defs EXCEPT SELECT func, node, var FROM lo", recursive=True))
def _(spark, sf):
    c, live = _live(spark, sf)
    return G.dead_defs(c["defs"], G.live_out(live, c["edges"]))


@query("live_intervals", with_sql(CFG_SQL, _LV_SQL, body="SELECT func, var, MIN(node) AS first_node, MAX(node) AS last_node FROM lv GROUP BY ALL", recursive=True))
def _(spark, sf):
    return G.live_intervals(_live(spark, sf)[1])


@query("uninitialized_uses", with_sql(CFG_SQL, _RD_SQL, body="SELECT func, node, var FROM cfg_uses EXCEPT SELECT func, node, var FROM rd", recursive=True))
def _(spark, sf):
    c, rd = _reach(spark, sf)
    return G.uninitialized(c["uses"], rd)


@query("def_use_chains", with_sql(CFG_SQL, _RD_SQL, body="SELECT u.func, u.node, u.var, r.def_node FROM cfg_uses u JOIN rd r USING (func, node, var)", recursive=True))
def _(spark, sf):
    c, rd = _reach(spark, sf)
    return G.def_use(c["uses"], rd)


@query("unused_definitions", with_sql(CFG_SQL, _RD_SQL, body="""SELECT func, node, var FROM cfg_defs EXCEPT
SELECT u.func, r.def_node, u.var FROM cfg_uses u JOIN rd r USING (func, node, var)""", recursive=True))
def _(spark, sf):
    c, rd = _reach(spark, sf)
    return G.unused_defs(c["defs"], G.def_use(c["uses"], rd))


_GNN_SQL = """feat AS (SELECT l_orderkey AS func, l_linenumber AS node, [SUM(l_quantity)::BIGINT / 100.0::DOUBLE, COUNT(*) / 10.0::DOUBLE, MAX(l_suppkey % 7) / 10.0::DOUBLE, MIN(l_partkey % 5) / 10.0::DOUBLE]
    AS f FROM lineitem GROUP BY 1, 2),
w AS (SELECT i, list_transform(range(0, 64), lambda j: sin((i + j) * 0.1::DOUBLE) * 0.125::DOUBLE) AS row FROM range(0, 64) t(i)),
h0 AS (SELECT func, node, f || list_transform(range(0, 60), lambda x: 0.0::DOUBLE) AS v FROM feat),
a1 AS (SELECT func, node, generate_subscripts(v, 1) AS d, unnest(v) * 2 AS x FROM h0 UNION ALL
  SELECT e.func, e.dst, generate_subscripts(v, 1), unnest(v) FROM h0 JOIN cfg_edges e ON e.func = h0.func AND e.src = h0.node),
g1 AS (SELECT func, node, list(x ORDER BY d) AS v FROM (SELECT func, node, d, SUM(x) AS x FROM a1 GROUP BY ALL) GROUP BY ALL),
h1 AS (SELECT func, node, list(greatest(0.0::DOUBLE, list_dot_product(v, row)) ORDER BY i) AS v FROM g1 CROSS JOIN w GROUP BY func, node),
a2 AS (SELECT func, node, generate_subscripts(v, 1) AS d, unnest(v) * 2 AS x FROM h1 UNION ALL
  SELECT e.func, e.dst, generate_subscripts(v, 1), unnest(v) FROM h1 JOIN cfg_edges e ON e.func = h1.func AND e.src = h1.node),
g2 AS (SELECT func, node, list(x ORDER BY d) AS v FROM (SELECT func, node, d, SUM(x) AS x FROM a2 GROUP BY ALL) GROUP BY ALL),
h2 AS (SELECT func, node, i, greatest(0.0::DOUBLE, list_dot_product(v, row)) AS x FROM g2 CROSS JOIN w),
dev AS (SELECT func, node, sqrt(SUM(d) / 64) AS deviation FROM (SELECT func, node, (x - AVG(x) OVER (PARTITION BY func, i)) ** 2 AS d, COUNT(*) OVER (PARTITION BY func, i) AS n FROM h2) WHERE n >= 3 GROUP BY ALL)"""


@query("graph_outliers", with_sql(CFG_SQL, _GNN_SQL, body="SELECT func, node, round(deviation, 4) AS deviation FROM dev WHERE deviation > 0.7"))
def _(spark, sf):
    l = V.table(spark, sf, "lineitem")
    feat = l.groupBy(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("node")).agg(F.array(
        F.sum("l_quantity").cast("long") / 100.0, F.count(F.lit(1)) / 10.0, F.max(F.col("l_suppkey") % 7) / 10.0, F.min(F.col("l_partkey") % 5) / 10.0).alias("features"))
    return G.graph_outliers(feat, V.cfg(spark, sf)["edges"]).withColumn("deviation", F.round("deviation", 4))


# ---------------------------------------------------------------- vectors
_W_SQL = "CASE t " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in VC.TOKEN_WEIGHTS.items()) + " ELSE 0.1 END"
_EMB_SQL = lambda src, key, text: f"""tok AS (SELECT {key}, generate_subscripts(ts, 1) - 1 AS i, unnest(ts) AS t FROM (SELECT {key}, string_split_regex({text}, '[^\\p{{L}}\\p{{N}}]') AS ts FROM {src})),
slot AS (SELECT {key}, (i * 7) % 128 AS d, SUM(({_W_SQL})::DOUBLE) AS x FROM tok GROUP BY ALL),
emb AS (SELECT {key}, d, x / sqrt(SUM(x * x) OVER (PARTITION BY {key})) AS x FROM slot)"""


@query("text_embeddings", with_sql(_EMB_SQL("documents", "doc_id", "text"), body="SELECT doc_id, CAST(d AS INTEGER) AS dim, round(x, 4) AS val FROM emb WHERE round(x, 4) <> 0"))
def _(spark, sf):
    e = VC.embed_text(V.documents(spark, sf), "text", ["doc_id"])
    return e.select("doc_id", F.posexplode(F.transform("vector", lambda x: F.round(x, 4))).alias("dim", "val")).where("val <> 0")


_DOC_SQL = ("ln AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, len(ls) AS n, unnest(ls) AS text FROM (SELECT doc_id, " + V.lines_sql("text") + " AS ls FROM documents))",
            _EMB_SQL("ln", "doc_id, line_no, n", "text"),
            "dv AS (SELECT doc_id, d, SUM(x * (1.0::DOUBLE + (line_no - 1)::DOUBLE / n * 0.5::DOUBLE)) AS x FROM emb GROUP BY ALL)",
            "du AS (SELECT doc_id, d, x / sqrt(SUM(x * x) OVER (PARTITION BY doc_id)) AS x FROM dv)")


@query("document_embeddings", with_sql(*_DOC_SQL, body="SELECT doc_id, CAST(d AS INTEGER) AS dim, round(x, 4) AS val FROM du WHERE round(x, 4) <> 0"))
def _(spark, sf):
    e = VC.embed_doc(V.documents(spark, sf), "text", ["doc_id"])
    return e.select("doc_id", F.posexplode(F.transform("vector", lambda x: F.round(x, 4))).alias("dim", "val")).where("val <> 0")


_COS = "list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[])"


@query("pattern_similarity", f"""SELECT v.vec_id, p.vec_id AS pattern, round({_COS}, 4) AS similarity, CASE WHEN {_COS} > 0.85 THEN 'Critical' WHEN {_COS} > 0.75 THEN 'High'
 ELSE 'Medium' END AS tier FROM embeddings v, embeddings p WHERE p.vec_id % 100 = 0 AND {_COS} > 0.6""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings", ["vec_id"]).select("vec_id", F.col("embedding").alias("vector"))
    pats = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "pattern")
    s = VC.similar_pairs(e, pats, "vec_id", "pattern")
    return s.select("vec_id", "pattern", F.round("similarity", 4).alias("similarity"), VC.tier(F.col("similarity")).alias("tier"))


_PAT_ROWS = ", ".join(f"('{n}', '{p}')" for n, p in VC.PATTERNS.items())
_BEST_SQL = ("ln AS (SELECT doc_id AS k, line_no, text FROM code_lines WHERE trim(text) <> '' AND NOT starts_with(trim(text), '//'))",
             "pats AS (SELECT * FROM (VALUES " + _PAT_ROWS + ") t(pattern, body))", _EMB_SQL("ln", "k, line_no", "text"),
             _EMB_SQL("pats", "pattern", "body").replace("tok AS", "ptok AS").replace("FROM tok", "FROM ptok").replace("slot AS", "pslot AS").replace("FROM slot", "FROM pslot").replace("emb AS", "pemb AS"),
             "sims AS (SELECT k, line_no, pattern, SUM(e.x * p.x) AS s FROM emb e JOIN pemb p USING (d) GROUP BY ALL HAVING SUM(e.x * p.x) > 0.5)")


@query("best_matching_lines", with_sql(V.CODE_SQL, V.LINES_SQL, *_BEST_SQL, body="""SELECT k AS doc_id, pattern, CAST(line_no AS INTEGER) AS line_no, round(s, 4) AS similarity FROM (
 SELECT *, row_number() OVER (PARTITION BY k, pattern ORDER BY round(s, 9) DESC, line_no) AS rn FROM sims) WHERE rn = 1"""))
def _(spark, sf):
    return VC.best_line(V.code(spark, sf), "content", ["doc_id"]).withColumn("similarity", F.round("similarity", 4))


@query("gated_matching_lines", with_sql(V.CODE_SQL, V.LINES_SQL, *_BEST_SQL, "fl AS (SELECT doc_id, line_no, COUNT(*) OVER (PARTITION BY doc_id) AS n, text FROM code_lines)",
    _EMB_SQL("fl", "doc_id, line_no, n", "text").replace("tok AS", "ftok AS").replace("FROM tok", "FROM ftok").replace("slot AS", "fslot AS").replace("FROM slot", "FROM fslot").replace("emb AS", "femb AS"),
    "fv AS (SELECT doc_id, d, SUM(x * (1.0::DOUBLE + (line_no - 1)::DOUBLE / n * 0.5::DOUBLE)) AS x FROM femb GROUP BY ALL)",
    "fu AS (SELECT doc_id, d, x / sqrt(SUM(x * x) OVER (PARTITION BY doc_id)) AS x FROM fv)",
    "gate AS (SELECT doc_id, pattern, SUM(f.x * p.x) AS fs FROM fu f JOIN pemb p USING (d) GROUP BY ALL HAVING SUM(f.x * p.x) > 0.3)", body="""
SELECT b.k AS doc_id, b.pattern, CAST(line_no AS INTEGER) AS line_no, round(s, 4) AS similarity, round(fs, 4) AS file_similarity,
 CASE WHEN fs > 0.85 THEN 'Critical' WHEN fs > 0.75 THEN 'High' WHEN fs > 0.6 THEN 'Medium' ELSE 'None' END AS tier
FROM (SELECT *, row_number() OVER (PARTITION BY k, pattern ORDER BY round(s, 9) DESC, line_no) AS rn FROM sims) b JOIN gate g ON g.doc_id = b.k AND g.pattern = b.pattern WHERE rn = 1"""))
def _(spark, sf):
    g = VC.gated_lines(V.code(spark, sf), "content", ["doc_id"], above=0.3)
    return g.select("doc_id", "pattern", "line_no", F.round("similarity", 4).alias("similarity"), F.round("file_similarity", 4).alias("file_similarity"), "tier")
