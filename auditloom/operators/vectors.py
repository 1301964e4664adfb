"""Token-weight vectors and similarity."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from auditloom.functions.text import lines_of
from auditloom.plans.lineage import cut
from auditloom.plans.skew import salted_join
from auditloom.sources.tables import constant_rows

# Functions that run in tasks are pickled by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 128
STRIDE = 7
#: 55 undoes the stride: 7 * 55 = 1 (mod 128), so slot d is fed by tokens 55*d, 55*d+128, ..
UNSTRIDE = 55
NOT_WORD = r"[^\p{L}\p{N}]"

#: Weight of tokens; all others weigh 0.1.  Tokens are split on non-alphanumerics, so
#: entries with punctuation never match and are left out.
TOKEN_WEIGHTS = {"invoke": 0.9, "AccountInfo": 0.8, "UncheckedAccount": 0.85, "authority": 0.7, "owner": 0.75, "signer": 0.8,
                 "close": 0.7}
DEFAULT_WEIGHT = 0.1

#: Vulnerability patterns that texts are compared with.
PATTERNS = {
    "Missing Owner Check": "AccountInfo.*without.*owner",
    "Integer Overflow": "\\+.*\\-.*\\*.*without.*checked",
    "Account Confusion": "UncheckedAccount.*without.*CHECK",
    "Missing Signer Check": "authority.*!.*is_signer",
    "Arbitrary CPI": "invoke.*without.*require_keys_eq",
    "Insecure PDA Derivation": "seeds.*=.*\\[.*\\].*without.*bump",
    "Close Account Drain": "close.*=.*without.*has_one",
    "Re-Initialization": "init_if_needed",
}


def weight_of(token: Column) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for t, w in TOKEN_WEIGHTS.items():
        out = F.when(token == t, w).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, length: Column) -> Column:
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def _slots(weights: Column) -> Column:
    """Fold per-token weights into DIM slots; ``weights`` must be a materialised column or lambda value."""
    n = F.size(weights)
    def slot(d: Column) -> Column:
        first = F.pmod(d * UNSTRIDE, F.lit(DIM))
        at = F.when(first < n, F.sequence(first, n - 1, F.lit(DIM))).otherwise(F.array().cast("array<int>"))
        many = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(weights, i))
        # up to DIM tokens feed a slot at most once
        return F.when(n <= DIM, F.coalesce(F.get(weights, first), F.lit(0.0))).otherwise(many)
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), slot)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def embed(text: Column) -> Column:
    """Unit vector of a text: token i adds its weight to slot (7 i) mod 128."""
    weights = F.transform(F.split(text, NOT_WORD), lambda t: weight_of(t))
    raw = _bind(weights, lambda w: _slots(w))
    return _bind(raw, lambda v: _bind(norm(v), lambda n: unit(v, n)))


def embed_text(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, embed(F.col(text)).alias("vector"))


def embed_doc(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Unit vector of a document: line vectors weighted 1 + 0.5 * position / lines, all inside the row."""
    zero = F.array_repeat(F.lit(0.0), DIM)
    def total(lines: Column) -> Column:
        n = F.size(lines)
        parts = F.transform(lines, lambda l, i: F.struct(embed(l).alias("v"), (F.lit(1.0) + i / n * 0.5).alias("w")))
        return F.aggregate(parts, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, b: a + b * p["w"]))
    raw = _bind(lines_of(F.col(text)), total)
    return df.select(*keep, _bind(raw, lambda v: _bind(norm(v), lambda n: unit(v, n))).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def tier(similarity: Column) -> Column:
    return F.when(similarity > 0.85, "Critical").when(similarity > 0.75, "High").when(similarity > 0.6, "Medium").otherwise("None")


def cross_similarity(vecs: DataFrame, patterns: DataFrame, keep: list[str], label: str, vector: str = "vector",
                     normalised: bool = False) -> DataFrame:
    """Similarity of every vector with each pattern of a catalogue; both sides have ``vector``.

    ``normalised`` says that all vectors have length 1 or 0, so the product is the cosine.  The catalogue, a few
    rows written by people, becomes one array value read by every row: no join.  For pattern tables that grow with
    the data there is :func:`similar_pairs`.
    """
    measure = dot if normalised else cosine
    one = patterns.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(vector).alias("v")))).alias("ps"))
    pairs = F.transform("_ps", lambda p: F.struct(p["l"].alias(label), measure(F.col(vector), p["v"]).alias("similarity")))
    return vecs.withColumn("_ps", one.scalar()).select(*keep, F.inline(pairs))


#: Rows from which pivots are chosen, pivots, and vectors that meet at once in a task.
PIVOT_SAMPLE, PIVOTS, BLOCK = 4096, 128, 2048


def choose_pivots(vecs: DataFrame, vector: str, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Up to ``n`` unit vectors that lie far from each other, from a sample of at most ``sample`` rows (those with the smallest hash).

    Pivots only decide how much is left out early, never what is found.
    """
    rows = vecs.select(vector).distinct().orderBy(F.xxhash64(vector), vector).limit(sample).collect()
    x = _units([r[0] for r in rows])
    x = x[np.abs(x).sum(1) > 0] if len(x) else x
    if not len(x):
        return np.zeros((0, 0))
    best = x @ x[0]
    chosen = [0]
    while len(chosen) < min(n, len(x)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-9:
            break
        chosen.append(far)
        best = np.maximum(best, x @ x[far])
    return x[chosen]


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    if not len(x):
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def similar_pairs(vecs: DataFrame, patterns: DataFrame, ident: str, label: str, vector: str = "vector", above: float = 0.6, block: int = BLOCK,
                  pivots: int = PIVOTS) -> DataFrame:
    """(``ident``, ``label``, similarity) of all pairs with a cosine above ``above``, for tables of any size on both sides.

    A pivot index on the unit sphere.  Every vector belongs to the cell of its nearest pivot; a cell's range of angles to its pivot is
    known from one aggregate.  By the triangle inequality of angles, a pattern can only have partners in cells
    whose range comes within ``acos(above)`` of its own angle to their pivot, and is sent to these alone.  In a cell, vectors and
    patterns meet in blocks of at most about ``block`` rows, so a task multiplies two small matrices however full the cell is;
    a crowded cell has many blocks, which are salted.  Exact: nothing is left out that is above the threshold.

    Null vectors and vectors of length 0 are similar to nothing; vectors of one table must have one size.
    """
    if not 0 <= above < 1:
        raise ValueError("the threshold must be at least 0 and below 1")
    spark = vecs.sparkSession
    kinds = {c: t for c, t in [*vecs.dtypes, *patterns.dtypes]}
    both = (vecs.select(F.col(ident).alias("id"), F.col(vector).alias("v")), patterns.select(F.col(label).alias("id"), F.col(vector).alias("v")))
    left, right = (d.where(F.col("v").isNotNull() & (F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > 0)) for d in both)
    axes = choose_pivots(left, "v", pivots)
    out = f"{ident} {kinds[ident]}, {label} {kinds[label]}, similarity double"
    if not len(axes):
        return spark.createDataFrame([], out)
    reach = math.acos(above)

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = _units(b.column("v").to_pylist())
                c = np.clip(x @ axes.T, -1, 1)
                near = c.argmax(1)
                angle = np.arccos(c[np.arange(len(c)), near])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(angle)], names=["id", "v", "cell", "angle"])

    cells = cut(left.mapInArrow(place, f"id {kinds[ident]}, v {kinds[vector]}, cell int, angle double"))
    # At most ``pivots`` rows.
    ranges = {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in cells.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    used = sorted(ranges)
    lo, hi = (np.array([ranges[c][k] for c in used]) for k in (0, 1))

    def send(batches):
        for b in batches:
            if b.num_rows:
                angle = np.arccos(np.clip(_units(b.column("v").to_pylist()) @ axes[used].T, -1, 1))
                row, at = np.nonzero((angle - reach <= hi + 1e-9) & (angle + reach >= lo - 1e-9))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(np.array(used, np.int32)[at])], names=["id", "v", "cell"])

    def blocked(df: DataFrame, parts, side: str) -> DataFrame:
        numbered = df.withColumn("part", F.pmod(F.xxhash64("id", "v"), parts))
        return numbered.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias(f"rows_{side}")).withColumnRenamed("part", f"part_{side}")

    sent = cut(right.mapInArrow(send, f"id {kinds[label]}, v {kinds[vector]}, cell int"))
    size = spark.createDataFrame([(c, -(-n // block)) for c, (_, _, n) in ranges.items()], "cell int, parts long")
    queries = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    # Both lists have a row a cell.
    rows = blocked(cells.join(F.broadcast(size), "cell"), F.col("parts"), "a")
    asked = blocked(sent.join(F.broadcast(queries), "cell"), F.col("parts"), "b")
    met = salted_join(cut(rows), asked, ["cell"], ["part_a"])

    def multiply(batches):
        for b in batches:
            for a, z in zip(b.column("rows_a"), b.column("rows_b")):
                x, y = (_units(pc.struct_field(r.values, "v").to_pylist()) for r in (a, z))
                c = x @ y.T
                i, j = np.nonzero(c > above)
                ids = [pc.struct_field(r.values, "id").take(pa.array(k)) for r, k in ((a, i), (z, j))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(c[i, j])], names=[ident, label, "similarity"])

    return met.select("rows_a", "rows_b").mapInArrow(multiply, out)


def best_line(files: DataFrame, text: str, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Per (file, pattern): the line most similar to the pattern, the earliest on a tie (equal to nine digits)."""
    rows = [{"pattern": n, "body": b} for n, b in PATTERNS.items()]
    pats = constant_rows(files.sparkSession, rows).select("pattern", embed(F.col("body")).alias("vector"))
    lines = files.select(*keep, F.posexplode(lines_of(F.col(text))).alias("_p", "line")).where(
        (F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("//")))
    vecs = lines.select(*keep, (F.col("_p") + 1).alias("line_no"), embed(F.col("line")).alias("vector"))
    sims = cross_similarity(vecs, pats, [*keep, "line_no"], "pattern", normalised=True).where(F.col("similarity") > threshold)
    return sims.groupBy(*keep, "pattern").agg(F.max_by(F.struct("line_no", "similarity"), F.struct(F.round("similarity", 9), -F.col("line_no"))).alias("b")).select(
        *keep, "pattern", "b.line_no", "b.similarity")


def matching_files(files: DataFrame, text: str, keep: list[str], above: float = 0.6) -> DataFrame:
    """(``keep``, pattern, file_similarity, tier) of the files whose own vector is similar to a pattern of the catalogue; nothing is shuffled."""
    rows = [{"pattern": n, "body": b} for n, b in PATTERNS.items()]
    pats = constant_rows(files.sparkSession, rows).select("pattern", embed(F.col("body")).alias("vector"))
    sims = cross_similarity(embed_doc(files, text, keep), pats, keep, "pattern", normalised=True).where(F.col("similarity") > above)
    return sims.withColumnRenamed("similarity", "file_similarity").withColumn("tier", tier(F.col("file_similarity")))


def gated_lines(files: DataFrame, text: str, keep: list[str], above: float = 0.6, threshold: float = 0.5) -> DataFrame:
    """The best line of each pattern, in the files that are similar to the pattern as a whole.

    ``keep`` identifies a file.  Only lines of files with some similar pattern are compared.
    """
    gate = cut(matching_files(files, text, keep, above))
    some = files.join(gate.select(*keep).distinct(), keep, "left_semi")
    return best_line(some, text, keep, threshold).join(gate, [*keep, "pattern"])
