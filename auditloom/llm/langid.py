"""Language identification with hyperdimensional profiles.

Every letter of any script has its own random vector of +1 and -1, drawn from its code point.  A run of three letters is the product of
the letters' vectors, the first rotated by two places and the second by one, so order counts; runs of
other characters are one gap letter.  A text's vector is the sum over its runs; a language's prototype is the
sum of its texts' vectors at unit length.  A text gets the language whose prototype has the highest cosine.

Learning sums vectors inside each task, one row per language and coordinate leaves it.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was
learned; null languages are not learned from; ties go to the first language in order; texts of any length are
read whole; repeated rows are judged each for itself; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditloom.llm.common import map_arrow, map_texts, mix, pieces
from auditloom.llm.pretokens import APOS, NUMBER, OTHER, SPACE, WHITE, classes

DIM = 1024
#: Cells of a table of texts and runs, and runs, that are worked on at once.
CELLS, RUNS = 1 << 24, 1 << 12
#: Languages that a model may hold; more are an error, none is dropped.
MAX_LANGUAGES = 4096


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return ~np.isin(classes(), (NUMBER, OTHER, SPACE, WHITE, APOS))


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of each code point (0: gap), from its number alone: bits of a hash of the number and the coordinate."""
    part = np.arange(DIM // 64, dtype=np.uint64)
    bits = mix(mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11)) + part[None, :])
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts (zero without letters), and whether each has a letter."""
    lower = [t.lower() for t in texts]
    n = np.fromiter(map(len, lower), np.int64, len(lower))
    point = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    point = np.where(letters()[point], point, 0)
    doc = np.repeat(np.arange(len(lower) + 1), np.r_[n + 1, 1])  # a text's leading gap is its own
    first = np.r_[0, np.cumsum(n + 1)]
    keep = (point > 0) | np.r_[True, point[:-1] > 0]
    keep[first] = True
    point, doc = point[keep], doc[keep]
    known, sym = np.unique(point, return_inverse=True)
    size = len(known)
    code = (sym[:-2] * size + sym[1:-1]) * size + sym[2:]
    # Runs are counted at their middle letter; the gap after a text's last letter may be the next text's first.
    inner = point[1:-1] > 0
    code, owner = code[inner], doc[1:-1][inner]
    base = letter_vectors(known)
    two, one = np.roll(base, 2, 1), np.roll(base, 1, 1)
    out = np.zeros((len(texts), DIM), np.float32)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))

    def add(lo: int, hi: int) -> None:
        """Texts ``lo`` to ``hi``, halved until their table of runs is small."""
        runs, which = np.unique(code[ends[lo]:ends[hi]], return_inverse=True)
        if hi - lo > 1 and (hi - lo) * len(runs) > CELLS:
            add(lo, (lo + hi) // 2)
            add((lo + hi) // 2, hi)
            return
        table = np.bincount((owner[ends[lo]:ends[hi]] - lo) * len(runs) + which, minlength=(hi - lo) * len(runs)).reshape(hi - lo, -1)
        for k in range(0, len(runs), RUNS):
            r = runs[k:k + RUNS]
            bound = two[r // size**2] * one[r // size % size] * base[r % size]
            out[lo:hi] += table[:, k:k + RUNS].astype(np.float32) @ bound.astype(np.float32)

    if len(code):
        add(0, len(texts))
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1), np.diff(ends) > 0


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes at unit length."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for p in pieces(b, text):
                v, _ = vectors([t or "" for t in p.column(text).to_pylist()])
                names = np.array(p.column(lang).to_pylist(), object)
                for x in set(names):
                    total[x] = total.get(x, 0) + v[names == x].sum(0, dtype=np.float64)
        for x, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * DIM), pa.array(range(DIM), pa.int32()), pa.array(s)], names=["lang", "d", "v"])

    known = df.select(text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sums = map_arrow(known, run, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    got = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got = sorted(got, key=lambda r: r["lang"])
    proto = np.array([[x["v"] for x in r["v"]] for r in got], np.float32).reshape(len(got), DIM)
    # Rounded, so that the order in which tasks ended does not show.
    proto = np.round(proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9), 5)
    return [r["lang"] for r in got], proto.astype(np.float32)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score``, the cosine to the prototype, at least 0."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]):
        names, proto = sent.value
        v, some = vectors(texts)
        if not names:
            return [["und"] * len(texts), np.zeros(len(texts))]
        near = v @ proto.T
        best = near.argmax(1)
        score = np.where(some, np.clip(near[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
        return [[names[k] if s else "und" for k, s in zip(best, some)], score]

    return map_texts(df, keep, text, "lang_pred string, score double", work)
