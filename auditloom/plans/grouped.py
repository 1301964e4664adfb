"""Fixpoints that stay inside a group: flow facts of functions, a block of whole functions at a time.

Facts never leave their function, so one shuffle by function is enough however many rounds a fixpoint takes.  A function of more
than ``LARGE`` rows is left to the rounds of :mod:`~auditloom.plans.fixpoint`, which spread it over all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from auditloom.plans.lineage import cut, cut_counted

# Functions that run in tasks are pickled by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows (edges, definitions, uses) up to which a function is solved in a task, and rows of whole functions solved at once.
LARGE, BLOCK = 200_000, 200_000
EDGE, KILL, SEED = 0, 1, 2


def flow_facts(edges: DataFrame, kills: DataFrame, seeds: DataFrame | None, rounds: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame],
               large: int | None = None) -> DataFrame:
    """Facts that flow along ``edges(func, node, next)`` until a row of ``kills(func, node, var)`` stops them.

    With ``seeds(func, node, var)`` facts are variables, and die on entering a node that kills them: (func, node, var).  Without, each
    kill starts a fact of its own behind its node, and facts die on leaving: (func, node, var, origin).
    ``rounds`` solves the same three tables for functions of more than ``large`` rows.
    """
    none = lambda c: F.lit(None).cast(kills.schema[c].dataType).alias(c)
    row = lambda d, kind, nxt, var: d.select("func", F.lit(kind).cast("byte").alias("kind"), "node", F.col(nxt).alias("next"), var)
    facts = row(edges, EDGE, "next", none("var")).unionByName(row(kills, KILL, "node", "var"))
    if seeds is not None:
        facts = facts.unionByName(row(seeds, SEED, "node", "var"))
    facts = cut(facts)
    big, n_big = cut_counted(facts.groupBy("func").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (LARGE if large is None else large)).select("func"))
    types = {f.name: f.dataType.simpleString() for f in facts.schema.fields}
    schema = f"func {types['func']}, node {types['node']}, var {types['var']}" + ("" if seeds is not None else f", origin {types['node']}")
    # As many large functions as fit into the input, each more than ``large`` rows.
    small = facts.join(F.broadcast(big), "func", "left_anti") if n_big else facts
    out = (small.where("func is not null and node is not null and next is not null").repartition("func").sortWithinPartitions("func")
           .mapInArrow(_solver(seeds is not None), schema))
    placed = "func is not null and node is not null"
    if n_big:
        of = lambda d: None if d is None else d.join(F.broadcast(big), "func", "left_semi")
        out = out.unionByName(rounds(of(edges), of(kills), of(None if seeds is None else seeds.where(placed))))
    if seeds is not None:
        # What has no place flows nowhere, but holds where it is.
        out = out.unionByName(seeds.where(f"not ({placed})").select("func", "node", "var").distinct())
    return out


def _whole_functions(batches, size: int = BLOCK) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            t = pa.Table.from_batches(held)
            f = t.column("func")
            first = pc.index(f, f[-1]).as_py()
            if first:
                yield t.slice(0, first)
                t = t.slice(first)
            held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Positions of the values in their dictionary (-1: null), which columns of one type share."""
    d = pa.concat_arrays([c for col in columns for c in col.chunks]).dictionary_encode()
    at = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(at, np.cumsum([len(c) for c in columns])[:-1]), d.dictionary


def _solver(seeded: bool):
    def solve(t: pa.Table) -> list[pa.Array]:
        kind = t.column("kind").to_numpy()
        (func,), funcs = _codes(t.column("func"))
        (node, nxt), nodes = _codes(t.column("node"), t.column("next"))
        (var,), variables = _codes(t.column("var"))
        n_var = len(variables) + 1
        at = np.concatenate([func * len(nodes) + node, func * len(nodes) + nxt])
        places, at = np.unique(at, return_inverse=True)
        here, there = np.split(at, 2)
        e, k = kind == EDGE, kind == KILL
        order = np.argsort(here[e], kind="stable")
        to = there[e][order]
        begin = np.searchsorted(here[e][order], np.arange(len(places) + 1))
        kills = np.unique(here[k & (var >= 0)] * n_var + var[k & (var >= 0)])

        def killed(place, v):
            j = np.minimum(np.searchsorted(kills, place * n_var + v), max(len(kills) - 1, 0))
            return kills[j] == place * n_var + v if len(kills) else np.zeros(len(place), bool)

        def moved(place, fact):
            n = begin[place + 1] - begin[place]
            first = np.repeat(begin[place] - np.cumsum(n) + n, n)
            return to[first + np.arange(len(first))], np.repeat(fact, n)

        if seeded:
            var_of = np.arange(-1, len(variables))
            s = kind == SEED
            front = here[s] * n_var + var[s] + 1
        else:
            own = np.unique(here[k] * n_var + var[k] + 1)
            var_of, origin = own % n_var - 1, own // n_var
            p, f = moved(origin, np.arange(len(own)))
            front = p * max(len(own), 1) + f
        width = max(len(var_of), 1)
        seen = front = np.unique(front)
        while len(front):
            p, f = front // width, front % width
            if not seeded:
                alive = ~killed(p, var_of[f])
                p, f = p[alive], f[alive]
            p, f = moved(p, f)
            if seeded:
                alive = ~killed(p, var_of[f])
                p, f = p[alive], f[alive]
            front = np.setdiff1d(np.unique(p * width + f), seen, assume_unique=True)
            seen = np.union1d(seen, front)
        p, f = seen // width, seen % width
        value = lambda dictionary, i: dictionary.take(pa.array(i, mask=i < 0))
        out = [funcs.take(pa.array(places[p] // len(nodes))), value(nodes, places[p] % len(nodes)), value(variables, var_of[f])]
        return out if seeded else [*out, value(nodes, places[origin[f]] % len(nodes))]

    names = ["func", "node", "var"] + ([] if seeded else ["origin"])

    def run(batches):
        for t in _whole_functions(batches):
            yield pa.RecordBatch.from_arrays(solve(t), names=names)

    return run
