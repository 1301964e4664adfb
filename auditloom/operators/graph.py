"""Graph jobs on edge tables: taint, reachability, dataflow fixpoints, message passing.

Each fixpoint joins only the newest rows with the edges, aggregates candidates before the
shuffle, and writes every round to the shared checkpoint folder.  Hub nodes are salted.  Facts that
stay in their function are solved by function in tasks, see :mod:`~auditloom.plans.grouped`.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from auditloom.plans.fixpoint import closure, states
from auditloom.plans.grouped import LARGE, _codes, _whole_functions, flow_facts
from auditloom.plans.lineage import cut, cut_bucketed, cut_counted, forget
from auditloom.plans.skew import hot_keys, replicated, salted_join, with_salt

# Functions that run in tasks are pickled by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEP = ">"


def propagate(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(label, node, depth, path): labels flow along ``edges(src, dst)`` from ``seeds(label, node)``.

    One shortest path is kept per label and node, the lexicographically first among equals, so
    cycles end.  Repeated edges change nothing.  The edge table is bucketed by source once, so rounds do not shuffle it; hub
    sources, if there are any, are salted first.
    """
    keys = ["src"]
    table, name = cut_bucketed(edges.select("src", "dst"), keys)
    names = [name]
    hubs, n_hubs = cut_counted(hot_keys(table, ["src"]))
    if n_hubs:
        keys = ["src", "salt"]
        table, name = cut_bucketed(with_salt(table, hubs, ["src"], ["dst"]), keys)
        names.append(name)

    def step(front: DataFrame) -> DataFrame:
        f = front.withColumnRenamed("node", "src")
        f = replicated(f, hubs, ["src"]) if n_hubs else f
        return (f.join(table, keys).groupBy("label", F.col("dst").alias("node"))
                .agg(F.min(F.col("depth") + 1).alias("depth"), F.min(F.concat("path", F.lit(SEP), "dst")).alias("path")))

    start = seeds.select("label", "node").distinct().select("label", "node", F.lit(0).alias("depth"), F.col("node").alias("path"))
    try:
        return closure(start, step, ["label", "node"], max_rounds)
    finally:
        forget(edges.sparkSession, names)


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Nodes reachable from any node of ``start(node)``, itself included."""
    s = start.select(F.lit("*").alias("label"), "node")
    return propagate(edges, s, max_rounds).select("node", "depth")


def has_path(edges: DataFrame, source: str, target: str) -> bool:
    start = edges.sparkSession.createDataFrame([(source,)], "node string")
    return not reachable(edges, start).where(F.col("node") == target).isEmpty()


#: Severity by kind of source and kind of sink; ``*`` matches any source.
FLOW_SEVERITY = {
    ("InstructionData", "LamportsTransfer"): "Critical",
    ("InstructionData", "TokenTransfer"): "Critical",
    ("UncheckedAccount", "CPIInvoke"): "Critical",
    ("InstructionData", "StateWrite"): "High",
    ("InstructionData", "AuthorityCheck"): "High",
    ("UserProvidedSeeds", "PDADerivation"): "High",
    ("OracleData", "StateWrite"): "Medium",
    ("DeserializedData", "UncheckedArithmetic"): "Medium",
    ("*", "ValidationBypass"): "High",
}


def flow_severity(source: Column, sink: Column) -> Column:
    out = F.lit("Low")
    for (s, k), sev in reversed(FLOW_SEVERITY.items()):
        hit = sink == k if s == "*" else (source == s) & (sink == k)
        out = F.when(hit, sev).otherwise(out)
    return out


def flows(reached: DataFrame, sinks: DataFrame) -> DataFrame:
    """Labels that reach a sink, with severity; ``sinks(node, sink_kind)``, labels are source kinds."""
    return reached.join(sinks, "node").select("label", "node", "sink_kind", "depth", "path",
                                              flow_severity(F.col("label"), F.col("sink_kind")).alias("severity"))


def backward_flows(edges: DataFrame, sinks: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Sources found walking back from each sink, with the node path and its variables only."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = propagate(back, sinks.select(F.col("node").alias("label"), "node"), max_rounds)
    hit = seen.join(sources.select("node", "source_kind"), "node").join(
        sinks.select(F.col("node").alias("label"), "sink_kind"), "label")
    steps = F.split("path", SEP)
    variables = F.filter(steps, lambda s: ~F.contains(s, F.lit("::")) & ~F.startswith(s, F.lit("invoke")))
    return hit.select(F.col("label").alias("sink"), F.col("node").alias("source"), "path", F.array_join(variables, SEP).alias("variables"),
                      flow_severity(F.col("source_kind"), F.col("sink_kind")).alias("severity"))


def context_key(calls: Column, k: int) -> Column:
    """Key of a call chain: its last ``k`` sites as ``caller@location -> ..``."""
    n = F.size(calls)
    last = F.slice(calls, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
    return F.array_join(F.transform(last, lambda c: F.concat(c["caller"], F.lit("@"), c["loc"])), " -> ")


#: Kinds of edges between variables: inside a function, into a callee at a call site, and back out of it.
FLOW, CALL, RETURN = "flow", "call", "return"


def context_taint(edges: DataFrame, seeds: DataFrame, k: int = 2, max_rounds: int | None = None) -> DataFrame:
    """(label, node, context, depth): labels flow along ``edges(src, dst, kind, site)`` with the calls that lead to them.

    A context is the array of the last ``k`` call sites.  A call adds its site; a return goes only to the caller of the
    last site and takes it off.  So a label that enters a helper from one caller does not come out at another.  Where no site is known
    (a label that starts in the helper, or sites beyond the last ``k``) a return may go to any caller: nothing that can
    happen is lost.  ``seeds(label, node)`` start without a site; with a column ``context`` they start in it.

    There are at most nodes x sites^k states a label; a round moves only the new ones.
    """
    if k < 1:
        raise ValueError("a context needs at least one site")
    names = ["src", "dst", "kind", "site"]
    table, name = cut_bucketed(edges.select(*names), ["src"])
    context, site = F.col("context"), F.col("site")
    called = F.concat(context, F.array(site))
    after = (F.when(F.col("kind") == CALL, F.slice(called, F.greatest(F.size(called) - k + 1, F.lit(1)), F.lit(k)))
             .when((F.col("kind") == RETURN) & (F.size(context) > 0), F.slice(context, F.lit(1), F.size(context) - 1)).otherwise(context))
    matched = (F.col("kind") != RETURN) | (F.size(context) == 0) | (F.element_at(F.when(F.size(context) > 0, context).otherwise(F.array(site)), -1) == site)

    def step(front: DataFrame) -> DataFrame:
        met = front.withColumnRenamed("node", "src").join(table, "src").where(matched)
        return met.select("label", F.col("dst").alias("node"), after.alias("context"))

    start = seeds if "context" in seeds.columns else seeds.withColumn("context", F.array().cast("array<string>"))
    try:
        return states(start.select("label", "node", "context"), step, max_rounds)
    finally:
        forget(edges.sparkSession, [name])


def context_text(context: Column) -> Column:
    """A context of site names as one key."""
    return F.array_join(context, " -> ")


def tainted_in(found: DataFrame, context: list[str]) -> DataFrame:
    """(label, node) that hold in exactly this context."""
    return found.where(F.col("context") == F.array(*[F.lit(x) for x in context]).cast("array<string>")).select("label", "node")


def merge_paths(*states: DataFrame) -> DataFrame:
    """Label sets at a join point: a label holds if it holds on any incoming path."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.distinct()


def field_taint(uses: DataFrame, taints: DataFrame, keep: list[str]) -> DataFrame:
    """Labels of each field path: of the path itself, of the whole object, or of any proper prefix.

    ``uses`` and ``taints`` have a dotted ``path``; a taint without a dot is on the whole object.
    Only as many keys as the path is deep are looked up.
    """
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    known = taints.select(F.col("path").alias("_at"), "label").distinct()
    asked = uses.select(*keep, "path").distinct().select(*keep, "path", F.explode(prefixes).alias("_at"))
    return salted_join(asked, known, ["_at"], [*keep, "path"]).select(*keep, "path", "label").distinct()


def path_taint(uses: DataFrame, states: DataFrame, keep: list[str]) -> DataFrame:
    """As :func:`field_taint` on condition paths: ``conditions`` arrays, any prefix (the empty one too) counts."""
    c = F.col("conditions")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(c)), lambda n: F.array_join(F.slice(c, F.lit(1), n), "&"))
    known = states.select("var", F.array_join("conditions", "&").alias("_at"), "label").distinct()
    asked = uses.select(*keep, "var", "conditions").distinct().select(*keep, "var", "conditions", F.explode(prefixes).alias("_at"))
    return salted_join(asked, known, ["var", "_at"], [*keep, "conditions"]).select(*keep, "var", "label").distinct()


def reaching_defs(edges: DataFrame, defs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(func, node, var, def_node): definitions that reach a node's entry.

    A definition passes a node exactly when the node does not redefine its variable, so following
    single definitions along edges is the full fixpoint.
    """
    steps = edges.select("func", F.col("src").alias("node"), F.col("dst").alias("next"))
    found = flow_facts(steps, defs.select("func", "node", "var"), None, lambda e, k, _: _reaching_rounds(e, k, max_rounds))
    return found.withColumnRenamed("origin", "def_node")


def _reaching_rounds(edges: DataFrame, defs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(func, node, var, origin) in rounds over all tasks; ``edges(func, node, next)``."""
    e = cut(edges.distinct())
    kills = cut(defs.distinct())

    def step(front: DataFrame) -> DataFrame:
        alive = front.join(kills, ["func", "node", "var"], "left_anti")
        return alive.join(e, ["func", "node"]).select("func", F.col("next").alias("node"), "var", "origin").distinct()

    born = kills.join(e, ["func", "node"]).select("func", F.col("next").alias("node"), "var", F.col("node").alias("origin")).distinct()
    return closure(born, step, ["func", "node", "var", "origin"], max_rounds)


def live_vars(edges: DataFrame, defs: DataFrame, uses: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(func, node, var) live on entry: used there, or live on exit and not defined there."""
    back = edges.select("func", F.col("dst").alias("node"), F.col("src").alias("next"))
    return flow_facts(back, defs.select("func", "node", "var"), uses.select("func", "node", "var"), lambda e, k, u: _live_rounds(e, k, u, max_rounds))


def _live_rounds(back: DataFrame, defs: DataFrame, uses: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(func, node, var) in rounds over all tasks; ``back(func, node, next)`` leads to earlier nodes."""
    back = cut(back.distinct())
    kills = cut(defs.distinct())

    def step(front: DataFrame) -> DataFrame:
        out = front.join(back, ["func", "node"]).select("func", F.col("next").alias("node"), "var").distinct()
        return out.join(kills, ["func", "node", "var"], "left_anti")

    return closure(uses.distinct(), step, ["func", "node", "var"], max_rounds)


def live_out(live_in: DataFrame, edges: DataFrame) -> DataFrame:
    return live_in.join(edges.select("func", F.col("dst").alias("node"), "src"), ["func", "node"]).select(
        "func", F.col("src").alias("node"), "var").distinct()


def dead_defs(defs: DataFrame, out: DataFrame) -> DataFrame:
    """Definitions whose variable is not live on exit."""
    return defs.select("func", "node", "var").distinct().join(out, ["func", "node", "var"], "left_anti")


def uninitialized(uses: DataFrame, reaching: DataFrame) -> DataFrame:
    """Uses no definition reaches."""
    return uses.select("func", "node", "var").distinct().join(
        reaching.select("func", "node", "var").distinct(), ["func", "node", "var"], "left_anti")


def def_use(uses: DataFrame, reaching: DataFrame) -> DataFrame:
    """Each use with the definitions reaching it."""
    return uses.select("func", "node", "var").distinct().join(reaching, ["func", "node", "var"])


def unused_defs(defs: DataFrame, chains: DataFrame) -> DataFrame:
    """Definitions no use is reached by."""
    used = chains.select("func", F.col("def_node").alias("node"), "var").distinct()
    return defs.select("func", "node", "var").distinct().join(used, ["func", "node", "var"], "left_anti")


def live_intervals(live: DataFrame) -> DataFrame:
    return live.groupBy("func", "var").agg(F.min("node").alias("first_node"), F.max("node").alias("last_node"))


DIM = 64
_SCALE = (2.0 / (DIM + DIM)) ** 0.5
_ANGLE = 0.1


def _project(v: Column) -> list[Column]:
    """Sums of v[j]*cos(j/10) and v[j]*sin(j/10)."""
    dot = lambda f: F.aggregate(F.transform(v, lambda x, j: x * f(j * _ANGLE)), F.lit(0.0), lambda a, b: a + b)
    return [dot(F.cos).alias("c"), dot(F.sin).alias("s")]


def _vector_udfs():
    """Arrow functions on a node's two sums ``c, s``.

    They stand for 64 values, the ReLU of a linear map with weights sin((i+j)/10)*scale; as
    sin(a+b) = sin(a)cos(b) + cos(a)sin(b), the 64x64 map depends on nothing else.  The functions
    are built here, as closures, so workers need no copy of this package.
    """
    step = np.arange(DIM) * _ANGLE
    sin, cos, scale = np.sin(step), np.cos(step), _SCALE

    def values(c, s):
        return np.maximum(0.0, (np.outer(c, sin) + np.outer(s, cos)) * scale)

    def next_sums(c: pd.Series, s: pd.Series) -> pd.DataFrame:
        v = values(c, s)
        return pd.DataFrame({"c": v @ cos, "s": v @ sin})

    def embedding(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(list(values(c, s)))

    def rms(c: pd.Series, s: pd.Series, mean: pd.Series) -> pd.Series:
        off = values(c, s) - np.vstack(mean.to_numpy())
        return pd.Series(np.sqrt((off * off).mean(axis=1)))

    return (F.pandas_udf(next_sums, "struct<c:double,s:double>"), F.pandas_udf(embedding, "array<double>"), F.pandas_udf(rms, "double"))


def message_pass(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Nodes after rounds of (in-neighbour sum + 2 x self) -> linear map -> ReLU.

    ``nodes(func, node, features)`` with up to 64 features, ``edges(func, src, dst)``.  Because the
    map has rank two, a node's embedding is given by two sums ``c, s`` (see :func:`_vector_udfs`), and
    two numbers per edge are shuffled instead of sixty-four.
    """
    next_sums, _, _ = _vector_udfs()
    cur = nodes.select("func", "node", *_project(F.col("features")))
    for r in range(rounds):
        if r:
            # both branches below read the round's result; it is two numbers per node
            cur = cut(cur.select("func", "node", next_sums("c", "s").alias("p")).select("func", "node", "p.c", "p.s"))
        own = cur.select("func", "node", (F.col("c") * 2).alias("c"), (F.col("s") * 2).alias("s"))
        sent = cur.withColumnRenamed("node", "src").join(edges.select("func", "src", "dst"), ["func", "src"]).select(
            "func", F.col("dst").alias("node"), "c", "s")
        # a node only counts when it is in the node table: it always sends its own share
        cur = own.withColumn("_own", F.lit(1)).unionByName(sent.withColumn("_own", F.lit(0))).groupBy("func", "node").agg(
            F.sum("c").alias("c"), F.sum("s").alias("s"), F.max("_own").alias("_own")).where("_own = 1").drop("_own")
    return cur


def rms_outliers(nodes: DataFrame, threshold: float | None = 0.7, min_nodes: int = 3) -> DataFrame:
    """Distance of each node (``func, node, c, s``) from its graph's mean embedding.

    Graphs below ``min_nodes`` are skipped.  The node table is small (two sums per node), so it is
    kept once and expanded where needed.
    """
    _, embedding, rms = _vector_udfs()
    kept = cut(nodes)
    means = kept.select("func", embedding("c", "s").alias("e")).groupBy("func").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("e", F.lit(i))).alias(f"m{i}") for i in range(DIM)])
    means = means.where(F.col("n") >= min_nodes).select("func", F.array(*[F.col(f"m{i}") / F.col("n") for i in range(DIM)]).alias("mean"))
    out = kept.join(means, "func").select("func", "node", rms("c", "s", "mean").alias("deviation"))
    return out if threshold is None else out.where(F.col("deviation") > threshold)


def graph_outliers(nodes: DataFrame, edges: DataFrame, rounds: int = 2, threshold: float | None = 0.7, min_nodes: int = 3,
                   large: int = LARGE) -> DataFrame:
    """(func, node, deviation): :func:`rms_outliers` of :func:`message_pass`, with one shuffle by function.

    Messages never leave their function, so blocks of whole functions are worked through in tasks and no embedding is moved.
    Functions of more than ``large`` rows (nodes and edges) go through the two operators, which spread them over all tasks.
    A node without features counts as one of zeros; rows without a function have no graph.
    """
    of = F.col("func").isNotNull()
    own = nodes.where(of).select("func", "node", "features")
    sent = edges.where(of & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("func", "src", "dst")
    big, n_big = cut_counted(own.select("func").unionByName(sent.select("func")).groupBy("func").agg(F.count(F.lit(1)).alias("n"))
                             .where(F.col("n") > large).select("func"))
    part = lambda d, how: d.join(F.broadcast(big), "func", how) if n_big else d
    sums = [F.coalesce(x, F.lit(0.0)).alias(n) for x, n in zip(_project(F.col("features")), "cs")]
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    rows = part(own, "left_anti").select("func", F.col("node").alias("src"), F.lit(None).cast(kind["node"]).alias("dst"), *sums).unionByName(
        part(sent, "left_anti").select("func", F.col("src").cast(kind["node"]).alias("src"), F.col("dst").cast(kind["node"]).alias("dst"),
                                       F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("s")))
    # By a hash of its own: a union of sides that are dealt by function already would not be dealt again, but adaptive execution
    # may join the sides' partitions differently.
    out = rows.repartition(F.xxhash64("func")).sortWithinPartitions("func").mapInArrow(
        _outlier_solver(rounds, threshold, min_nodes), f"func {kind['func']}, node {kind['node']}, deviation double")
    if n_big:
        out = out.unionByName(rms_outliers(message_pass(part(own, "left_semi"), part(sent, "left_semi"), rounds), threshold, min_nodes))
    return out


def _outlier_solver(rounds: int, threshold: float | None, min_nodes: int):
    step = np.arange(DIM) * _ANGLE
    sin, cos, scale = np.sin(step), np.cos(step), _SCALE

    def values(c, s):
        return np.maximum(0.0, (np.outer(c, sin) + np.outer(s, cos)) * scale)

    def solve(t: pa.Table) -> list[pa.Array]:
        (func,), funcs = _codes(t.column("func"))
        (src, dst), names = _codes(t.column("src"), t.column("dst"))
        c, s = (t.column(x).to_numpy() for x in "cs")
        is_node, width = ~np.isnan(c), len(names) + 1
        place, at = np.unique(func[is_node] * width + src[is_node] + 1, return_inverse=True)
        c, s = (np.bincount(at, x[is_node], len(place)) for x in (c, s))
        ends = []
        for x in (src, dst):
            wanted = func[~is_node] * width + x[~is_node] + 1
            i = np.minimum(np.searchsorted(place, wanted), max(len(place) - 1, 0))
            ends.append((i, place[i] == wanted if len(place) else np.zeros(len(wanted), bool)))
        known = ends[0][1] & ends[1][1]
        a, z = (i[known] for i, _ in ends)
        for r in range(rounds):
            if r:
                v = values(c, s)
                c, s = v @ cos, v @ sin
            c, s = (2 * x + np.bincount(z, x[a], len(place)) for x in (c, s))
        f, n = place // width, place % width - 1
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]][:len(f)])
        size = np.diff(np.r_[first, len(f)])
        v = values(c, s)
        mean = np.add.reduceat(v, first) / size[:, None] if len(first) else v
        off = v - np.repeat(mean, size, axis=0)
        deviation = np.sqrt((off * off).mean(axis=1))
        keep = np.repeat(size, size) >= min_nodes
        if threshold is not None:
            keep &= deviation > threshold
        return [funcs.take(pa.array(f[keep])), names.take(pa.array(n[keep], mask=n[keep] < 0)), pa.array(deviation[keep])]

    def run(batches):
        for t in _whole_functions(batches):
            yield pa.RecordBatch.from_arrays(solve(t), names=["func", "node", "deviation"])

    return run


#: What an outlier of a node kind is called.
NODE_CLASS = {"CPICall": "ArbitraryCPI", "AccountAccess": "MissingOwnerCheck", "Conditional": "AnomalousControlFlow",
              "Loop": "ComplexReentrancy"}


def outlier_class(kind: Column) -> Column:
    out = F.lit("SuspiciousDataFlow")
    for k, c in NODE_CLASS.items():
        out = F.when(kind == k, c).otherwise(out)
    return out
