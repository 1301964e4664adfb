"""Collocations: frequent phrases of two to five words, by marginalising the counts of the longest windows.

Texts are cut into pieces and words inside the tasks.  Every word starts one window: itself and up to four following words of
its piece, as five lead columns that are padded with the empty string where the piece ends.  Only these longest windows are
counted.  A ROLLUP over language and the five columns then sums them to the counts of all shorter prefixes: that of ``w1, w2`` is
the number of windows that begin so, and as every word of a piece begins one, this counts every occurrence.  No n-gram
of a lower order is ever made.

Windows that cannot matter are shortened before they are counted: a phrase of at least ``least`` occurrences has
only word pairs with as many, so a window is padded from its first rarer pair on.  Pairs are counted by 64-bit hash, and the frequent
ones become a filter of at most 16 MB; what it lets pass in error only makes windows longer than needed.  So most rows that meet in
the shuffle are single words or frequent phrases.

A candidate's cuts are joined with the counts of their two parts; hot parts are salted.  Products are decimals of 38 digits:
exact up to some 10^11 words a language.  A candidate inside a longer one with the same count is dropped; it suffices
to look one word further, as every phrase between the two has the same count too.

Defined cases: a null text is empty; a null language is ``und``; texts and pieces of any length are used whole; equal rows
count as often as they occur; ties end by phrase in byte order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from auditloom.llm.common import bit_filter, map_arrow, mix, passes, pieces
from auditloom.plans.lineage import cut, cut_counted
from auditloom.plans.skew import salted_join

LONGEST = 5
LEAST, TOP = 100, 2000
PIECE = 1 << 23
#: Distinct pairs that a task keeps before it passes them on.
PAIRS = 1 << 21
_CUT, _GAP = 10, 32
FOLD = bytes(b + 32 if 65 <= b <= 90 else _CUT if b in b".,;:!?" or 10 <= b <= 13 else _GAP if b == 9 else b for b in range(256))
COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Number of each word, number of its piece, and the distinct words; pieces never cross texts."""
    raw = np.frombuffer(b"\n".join([*texts, b""]).translate(FOLD), np.uint8)
    inside = (raw != _CUT) & (raw != _GAP)
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    # Word bytes lie one after the other in a buffer of their own, so that arrow can number the words.
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=ends[1:])
    column = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])]).dictionary_encode()
    return np.asarray(column.indices).astype(np.int64), np.cumsum(raw == _CUT)[start], column.dictionary.to_pylist()


def by_language(batches) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
    for b in batches:
        for p in pieces(b, "text", PIECE):
            groups: dict[str, list[bytes]] = {}
            for lang, t in zip(p.column("lang").to_pylist(), p.column("text").cast(pa.binary()).to_pylist()):
                groups.setdefault(lang, []).append(t or b"")
            for lang, texts in groups.items():
                yield lang, *words(texts)


def pair_keys(lang: str, word: np.ndarray, piece: np.ndarray, names: list[bytes]) -> np.ndarray:
    """64 bits of each pair of following words; 0 where a piece ends."""
    salt = xxhash.xxh64_intdigest(lang)
    h = np.array([xxhash.xxh64_intdigest(w, salt) for w in names], np.uint64)[word] if len(word) else np.zeros(0, np.uint64)
    key = np.zeros(len(h), np.uint64)
    key[:-1] = np.where(piece[1:] == piece[:-1], mix(h[:-1] * np.uint64(3) + h[1:]) | np.uint64(1), 0)
    return key


def frequent_pairs(docs: DataFrame, least: int) -> np.ndarray:
    """Filter of the word pairs that occur ``least`` times in a language."""
    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for got in by_language(batches):
            k = pair_keys(*got)
            keys, counts = merge(np.r_[keys, k[k > 0]], np.r_[counts, np.ones(int((k > 0).sum()), np.int64)])
            if len(keys) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    often = map_arrow(docs, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    return bit_filter(*cut_counted(often))


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def windows(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """``lang``, five lead columns and the number of each window in a part of a task."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        for lang, word, piece, names in by_language(batches):
            if not len(word):
                continue
            key = pair_keys(lang, word, piece, names)
            linked = (key > 0) & passes(sent.value, key)
            lead = np.full((LONGEST, len(word)), -1, np.int64)
            lead[0] = word
            going = np.ones(len(word), bool)
            for k in range(1, LONGEST):
                going = going & np.r_[linked[k - 1:], np.zeros(k - 1, bool)]
                at = np.flatnonzero(going)
                lead[k, at] = word[at + k]
            # A window's number is built word by word, so that it never needs more than 64 bits.
            number = word
            for k in range(1, LONGEST):
                at = np.flatnonzero(lead[k] >= 0)
                longer = np.unique(number[at] * len(names) + lead[k, at], return_inverse=True)[1]
                number = number.copy()
                number[at] = longer + number.max(initial=0) + 1
            _, first, n = np.unique(number, return_index=True, return_counts=True)
            values = pa.array([*names, b""], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]).take(pa.array(np.zeros(len(first), np.int64))), *(values.take(pa.array(np.where(x < 0, len(names), x))) for x in lead[:, first]),
                 pa.array(n)], names=["lang", *COLUMNS, "n"])

    return map_arrow(docs, run, f"lang string, {', '.join(f'{c} string' for c in COLUMNS)}, n long")


def counted(docs: DataFrame, least: int) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``f`` of every phrase with ``least`` occurrences; size 0 has the words of a language."""
    top = cut(windows(docs, frequent_pairs(docs, least)).groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n")))
    rolled = lambda rows, cols: rows.rollup("lang", *cols).agg(F.sum("n").alias("f"), (len(cols) - F.bit_count(F.grouping_id())).alias("size"))
    # Windows of one word have no longer prefix, so they are rolled up over that word alone.
    longer, single = rolled(top.where("w2 <> ''"), COLUMNS), rolled(top.where("w2 = ''"), COLUMNS[:1])
    for c in COLUMNS[1:]:
        single = single.withColumn(c, F.lit(None).cast("string"))
    whole = F.coalesce(F.array_position(F.array(*COLUMNS), ""), F.lit(0)) == 0
    part = lambda sums: sums.where("size >= 0 and lang is not null").where(whole).select("lang", "size", F.concat_ws(" ", *COLUMNS).alias("phrase"), "f")
    low = part(longer).where("size < 2").unionByName(part(single)).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return part(longer).where("size > 1").unionByName(low).where((F.col("size") == 0) | (F.col("f") >= least))


def mine(df: DataFrame, text: str = "text", part: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    docs = df.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    found = cut(counted(docs, least))
    total = found.where("size = 0").select("lang", F.col("f").alias("n"))
    phrases = found.where("size > 0")
    split = F.split("phrase", " ")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), split.alias("words"))
    join = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    part_count = lambda c, f: phrases.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    # A salted join reads its larger side several times, so each result is written.
    rows = cut(salted_join(cut(cuts), part_count("head", "l"), ["lang", "head"], ["phrase", "k"]))
    rows = cut(salted_join(rows, part_count("tail", "r"), ["lang", "tail"], ["phrase", "k"]))
    rows = salted_join(rows, total, ["lang"], ["phrase", "k"])
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(1000 * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})")
    best = (rows.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    inner = candidates.where("size > 2").select(
        "lang", "a", F.explode(F.array(join(F.lit(1), F.col("size") - 1), join(F.lit(2), F.col("size") - 1))).alias("phrase")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (best.join(inner, ["lang", "phrase", "a"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
