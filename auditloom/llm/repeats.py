"""Removal of every passage of 400 bytes that also starts elsewhere, with suffixes sorted at chosen marks.

A window is 400 bytes of a text.  Its mark is the 64-byte gram in it with the smallest hash, the leftmost of equals, so two
equal windows have their marks at the same place and with the same gram, wherever they are.  Following windows share a mark; together
they cover a region of at most 736 bytes around it, about one region for every 170 bytes of text.  Only marks are sorted, not all
suffixes, and only marks with equal grams can have windows in common:

1. Grams and digests of regions are counted.  A region that occurs twice is repeated as a whole.  A gram with one region, or none
   that occurs once, is settled by that, and most grams occur once.
2. For other grams each distinct region goes to one task.  What follows the marks and what precedes them, read backwards, are
   sorted as suffixes by ``suffixes.deep_shallow``, and ``suffixes.meetings`` reads off both orders which windows two
   regions have in common.  A gram with more than ``HOT`` distinct regions (the edge of a passage in very many texts) would
   fill a task; its windows are counted one by one instead, again as a sum made in the tasks first.
3. Spans go back to their texts.  Only texts with a span move, once for any number of copies.

Windows never cross texts, and repeats are judged on the input.  Everything is exact but for 128-bit digests.  What is broadcast are
filters of grams (at most 16 MB each, see ``common.bit_filter``) and of texts (2^20 slots): what they let pass in error only moves.

Defined cases: null and empty texts and texts below 400 bytes have no window and keep all; copies of a text lose all of it; a text of any
length is used whole, in blocks that overlap; repeated rows and ids are texts like others; an empty table gives no rows; input columns keep
their names.  What is kept are bytes: a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from auditloom.llm.common import bit_filter, fresh, map_arrow, mix, passes, pieces
from auditloom.llm.suffixes import meetings
from auditloom.plans.lineage import Scratch, cut
from auditloom.plans.skew import salted_join

#: Bytes of a window, and of the gram that marks it (a power of two).
WINDOW, GRAM = 400, 64
#: Window starts worked on at once, region bytes sorted at once, and distinct regions of a gram that one task takes.
BLOCK, SORTED, HOT = 1 << 20, 1 << 22, 1 << 14
NARROW = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64(24)


@dataclass
class Marks:
    """Regions of a block: first and last window start and the mark of each, as places in ``raw``; ``row`` and ``shift`` lead to the text."""

    raw: bytes
    first: np.ndarray
    last: np.ndarray
    mark: np.ndarray
    gram: np.ndarray
    row: np.ndarray
    shift: np.ndarray

    def digests(self, window: int) -> np.ndarray:
        """128 bits of each region and of the mark's place in it."""
        view = memoryview(self.raw)
        each = [xxhash.xxh3_128_digest(view[a:b + window], seed=m - a) for a, b, m in zip(self.first.tolist(), self.last.tolist(), self.mark.tolist())]
        return np.frombuffer(b"".join(each), np.int64).reshape(-1, 2)


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, by doubling."""
    h, step = _BYTE[raw], 1
    while step < size:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    return mix(h)


def marks(texts: list[bytes], window: int, gram: int) -> Iterator[Marks]:
    """Marks of all windows of ``texts``, block by block."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for row, t in enumerate(texts):
        for at in range(0, len(t) - window + 1, BLOCK):
            parts.append((row, at, t[at:at + BLOCK + window - 1]))
            size += len(parts[-1][2])
            if size >= BLOCK:
                yield _block(parts, window, gram)
                parts, size = [], 0
    if parts:
        yield _block(parts, window, gram)


def _block(parts: list[tuple[int, int, bytes]], window: int, gram: int) -> Marks:
    raw = b"".join(p for _, _, p in parts)
    with np.errstate(over="ignore"):
        h = grams(np.frombuffer(raw, np.uint8), gram)
    # The upper 40 bits of a hash, then the place: the smallest number is the leftmost smallest hash.
    key = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
    w = window - gram + 1
    full = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max)
    full[:len(key)] = key
    grid = full.reshape(-1, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(after[:len(h) - w + 1], before[w - 1:len(h)])
    mark = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in parts])
    start = np.cumsum(sizes) - sizes
    # Window starts of each part, without those that would reach into the next one.
    n = sizes - window + 1
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    part = np.repeat(np.arange(len(parts)), n)
    mark = mark[at]
    new = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | (part[1:] != part[:-1])])
    end = np.r_[new[1:], len(at)] - 1
    rows, shifts = np.array([r for r, _, _ in parts]), np.array([s for _, s, _ in parts])
    return Marks(raw, at[new], at[end], mark[new], h[mark[new]], rows[part[new]], (shifts - start)[part[new]])


def _each(batches, size: int):
    for b in batches:
        for p in pieces(b, "text", size):
            yield [t or b"" for t in p.column("text").to_pylist()]


def regions(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``gram``, ``r1``, ``r2`` (digest of the region) and how often it occurs."""
    def run(batches):
        for some in _each(batches, BLOCK):
            for m in marks(some, window, gram):
                d = m.digests(window)
                yield pa.RecordBatch.from_arrays([pa.array(m.gram.view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["gram", "r1", "r2"])

    return map_arrow(texts, run, "gram long, r1 long, r2 long").groupBy("gram", "r1", "r2").agg(F.count(F.lit(1)).alias("n"))


def places(texts: DataFrame, window: int, gram: int, again: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """Where regions with a repeated gram are: ``key`` of the text, first and last window start; with the ``region`` itself,
    once a block, and the mark's place in it where the gram's regions differ."""
    sc = texts.sparkSession.sparkContext
    again, mixed = sc.broadcast(again), sc.broadcast(mixed)

    def run(batches):
        for some in _each(batches, BLOCK):
            keys = [hashlib.md5(t).digest() for t in some]
            for m in marks(some, window, gram):
                keep = np.flatnonzero(passes(again.value, m.gram))
                m = Marks(m.raw, *(x[keep] for x in (m.first, m.last, m.mark, m.gram, m.row, m.shift)))
                if not len(keep):
                    continue
                d = m.digests(window)
                # Following single windows that are all alike, as in a text of one letter, are one row.
                alone = m.first == m.last
                same = (d[1:] == d[:-1]).all(1) & alone[1:] & alone[:-1] & (m.first[1:] == m.first[:-1] + 1) & (m.row[1:] == m.row[:-1])
                head = np.flatnonzero(np.r_[True, ~same])
                last = m.last[np.r_[head[1:], len(d)] - 1]
                differ = passes(mixed.value, m.gram[head])
                once = np.zeros(len(head), bool)
                once[np.unique(d[head], axis=0, return_index=True)[1]] = True
                shown = differ & once
                view = [m.raw[a:b + window] if s else None for a, b, s in zip(m.first[head].tolist(), m.last[head].tolist(), shown.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[r] for r in m.row[head].tolist()], pa.binary()), pa.array((m.first[head] + m.shift[head]).astype(np.int32)),
                     pa.array((last + m.shift[head]).astype(np.int32)), pa.array(m.gram[head].view(np.int64)), pa.array(d[head, 0]), pa.array(d[head, 1]),
                     pa.array((m.mark - m.first)[head].astype(np.int32)), pa.array(view, pa.binary())],
                    names=["key", "first", "last", "gram", "r1", "r2", "mark", "region"])

    return map_arrow(texts, run, "key binary, first int, last int, gram long, r1 long, r2 long, mark int, region binary")


def sorted_regions(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``rows`` (gram, r1, r2, n, mark, region): the windows of regions that occur once which others have, as ranges from the first one on."""
    def settle(held: list[tuple]):
        left = [x[:m][::-1] for _, _, _, m, x in held]
        right = [x[m:] for _, _, _, m, x in held]
        out = []
        for (r1, r2, n, mark, _), found in zip(held, meetings(left, right, window, gram)):
            if n == 1 and found:
                out.append((r1, r2, [mark - hi for _, hi in found], [mark - lo for lo, _ in found]))
        cols = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["r1", "r2", "lo", "hi"])

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("gram", "r1", "r2", "n", "mark", "region"))):
                if g != last and size > SORTED:
                    yield settle(held)
                    held, size = [], 0
                last = g
                held.append(tuple(row))
                size += len(row[-1])
        if held:
            yield settle(held)

    one_task = rows.repartition("gram").sortWithinPartitions("gram").select("gram", "r1", "r2", "n", "mark", "region")
    return map_arrow(one_task, run, "r1 long, r2 long, lo array<int>, hi array<int>")


def counted_windows(rows: DataFrame, window: int) -> DataFrame:
    """As :func:`sorted_regions`, for grams with too many regions for a task: every window is a row."""
    def run(batches):
        for b in batches:
            for r1, r2, n, mark, x in zip(*(b.column(c).to_pylist() for c in ("r1", "r2", "n", "mark", "region"))):
                view, k = memoryview(x), len(x) - window + 1
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:a + window], seed=mark - a) for a in range(k)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(k, r1)), pa.array(np.full(k, r2)), pa.array(np.full(k, n)),
                     pa.array(np.arange(k, dtype=np.int32))], names=["w1", "w2", "r1", "r2", "n", "at"])

    each = map_arrow(rows.select("r1", "r2", "n", "mark", "region"), run, "w1 long, w2 long, r1 long, r2 long, n long, at int")
    often = each.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("w1", "w2")
    return (salted_join(each.where("n = 1"), often, ["w1", "w2"], ["r1", "r2", "at"]).groupBy("r1", "r2")
            .agg(F.collect_list("at").alias("lo")).select("r1", "r2", "lo", F.col("lo").alias("hi")))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def cleaned(df: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Each distinct text that has a repeated passage: ``key``, ``n_removed``, ``n_spans``, ``spans`` (start, end, start, end ...) and ``kept`` bytes."""
    texts = df.select(F.col(text).cast("binary").alias("text"))
    with Scratch(df.sparkSession) as own:
        counts = own.cut(regions(texts, window, gram))
        by_gram = own.cut(counts.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
                          .where("n > 1"))
        open_ = by_gram.where("kinds > 1 and single > 0").select("gram", "kinds")
        size = by_gram.agg(F.count(F.lit(1)), F.count_if(F.expr("kinds > 1 and single > 0"))).first()
        again, mixed = (bit_filter(d.select(F.col("gram").alias("key")), n) for d, n in zip((by_gram, open_), size))
        found = own.cut(places(texts, window, gram, again, mixed))
        shown = (salted_join(found.where(F.col("region").isNotNull()), open_, ["gram"], ["r1"]).groupBy("gram", "r1", "r2", "kinds", "mark")
                 .agg(F.min("region").alias("region")).join(counts, ["gram", "r1", "r2"]))
        parts = [sorted_regions(shown.where(F.col("kinds") <= hot), window, gram)]
        if open_.where(F.col("kinds") > hot).limit(1).count():
            parts.append(counted_windows(shown.where(F.col("kinds") > hot), window))
        whole = counts.where("n > 1").select("r1", "r2", F.lit(None).cast("array<int>").alias("lo"), F.lit(None).cast("array<int>").alias("hi"))
        for p in parts:
            whole = whole.unionByName(p)
        flagged = own.cut(whole)
        at = found.select("key", "first", "last", "r1", "r2").distinct()
        spans = salted_join(at, flagged, ["r1", "r2"], ["key", "first"])
        ranges = F.when(F.col("lo").isNull(), F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))).otherwise(
            F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct((F.col("first") + x["lo"]).alias("a"), (F.col("first") + x["hi"]).alias("b"))))
        # The starts of repeated windows in one text: no more than the text has marks, and the text itself is one row.
        marked = own.cut(spans.groupBy("key").agg(F.flatten(F.collect_list(ranges)).alias("starts")))
        slot = F.pmod(F.xxhash64("key"), F.lit(NARROW)).alias("slot")
        needed = (df.select(text_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("slot", slot)
                  .join(F.broadcast(marked.select(slot).distinct()), "slot", "left_semi").groupBy("key").agg(F.min("text").alias("text")))
        return cut(_shortened(needed.join(marked, "key"), window))


def _shortened(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for p in pieces(b, "text", BLOCK):
                out = []
                for t, starts in zip(p.column("text").to_pylist(), p.column("starts").to_pylist()):
                    spans: list[int] = []
                    for a, z in sorted((x["a"], x["b"] + window) for x in starts):
                        if spans and a <= spans[-1]:
                            spans[-1] = max(spans[-1], z)
                        else:
                            spans += [a, z]
                    edges = [0, *spans, len(t)]
                    kept = b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2]))
                    out.append((len(t) - len(kept), len(spans) // 2, spans, kept))
                cols = list(zip(*out)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([p.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["key", "n_removed", "n_spans", "spans", "kept"])

    schema = "key binary, n_removed long, n_spans long, spans array<int>, kept binary"
    return map_arrow(rows.select("key", F.col("text").cast("binary").alias("text"), "starts"), run, schema)


def without_repeats(df: DataFrame, keep: list[str], text: str = "text", digest: bool = False, **sizes: int) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` of each row with ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and the ``kept`` bytes, or only their SHA-256 (hex); and the new columns' names."""
    new = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    key, own, *names = fresh(df.columns, "key", "own", *new)
    names = dict(zip(new, names))
    shape = (lambda c: F.sha2(c, 256)) if digest else (lambda c: c)
    found = cleaned(df, text, **sizes).select(
        F.col("key").alias(key), *[F.col(c).alias(names[c]) for c in new[1:4]], shape(F.col("kept")).alias(names["kept"]))
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(*keep, text_key(F.col(text)).alias(key), F.octet_length(whole).cast("long").alias(names["n_bytes"]), shape(whole).alias(own))
    out = salted_join(rows, found, [key], [names["n_bytes"], *keep], "left")
    zero = lambda c: F.coalesce(F.col(names[c]), F.lit(0)).cast("long").alias(names[c])
    return out.select(*keep, names["n_bytes"], zero("n_removed"), zero("n_spans"), F.coalesce(F.col(names["spans"]), F.array().cast("array<int>")).alias(names["spans"]),
                      F.coalesce(F.col(names["kept"]), F.col(own)).alias(names["kept"])), names
