"""Benchmark passages in training texts, found with one FM-index per shard of texts.

A shard is a bounded slice of a task's rows.  Its words become symbols (words of no test phrase are one
gap), a suffix array gives the Burrows-Wheeler transform, and a wavelet matrix answers ranks on it.  All
test phrases are searched backwards at the same time; occurrences are located by walking to sampled
suffix positions; and the word intervals of one text are merged into spans to be removed.  Stretches of
known words that are shorter than the shortest phrase cannot hold one and stay out of the index.

Test phrases are a stated query set.  They are cut into blocks of bounded size; each block is broadcast
and searched in all rows in the same pass, so neither the driver nor a task holds the whole set at once.

Defined cases: null and empty texts have no words; items without words have no phrase; an item without an
id counts under the id ``""``; equal ids are one item; phrases that several items share count for each;
texts of any length are one row; repeated rows are judged each for itself; empty tables give no rows or
no hits; only named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditloom.llm.common import fresh, map_arrow, pieces
from auditloom.plans.lineage import cut

#: Words in a phrase, characters of items in a block, bytes of text in a shard, blocks searched before the rows are written.
WINDOW = 13
BLOCK_CHARS = 4_000_000
SHARD = 1 << 22
BLOCKS_PER_PASS = 8
SAMPLE = 8
#: Fixed value: what a word is, after lower-casing A-Z.
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """Distinct phrases of a block of items as symbol rows, and which items hold them.  Symbols start at 2."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 2) for x in words(text)]
            for k in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[k:k + window]), set()).add(name)
        rows = sorted(found, key=len)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.rows[k, :len(r)] = r
        self.items = [sorted(found[r]) for r in rows]
        self.shortest = int(self.size.min()) if rows else 0


class FmIndex:
    """Of a sequence of symbols of at least 1 in runs that each end with symbol 0, which is never searched."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.counts = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        at = bwt
        for k in range(self.bits - 1, -1, -1):
            bit = at >> k & 1
            ones = np.r_[0, np.cumsum(bit)]
            self.levels.append(ones)
            self.zeros.append(n - int(ones[-1]))
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        self.bwt = bwt
        sampled = (order % SAMPLE == 0) | (bwt == 0)  # run starts too: no walk crosses a gap
        self.sampled, self.order, self.place = sampled, order[sampled], np.cumsum(sampled) - 1

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the transform."""
        lo, hi = np.zeros_like(i), i
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> self.bits - 1 - k & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def search(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of every phrase, by backward search of all that are still found."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.bwt), np.int64)
        step, live = 0, np.arange(len(rows))
        while len(live := live[(hi[live] > lo[live]) & (size[live] > step)]):
            s = rows[live, size[live] - 1 - step]
            lo[live], hi[live] = self.counts[s] + self.rank(s, lo[live]), self.counts[s] + self.rank(s, hi[live])
            step += 1
        return lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text position of rows of the suffix array, by steps back to a sampled one."""
        i, steps, out = i.copy(), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        while len(live):
            there = self.sampled[i[live]]
            done = live[there]
            out[done] = self.order[self.place[i[done]]] + steps[done]
            live = live[~there]
            s = self.bwt[i[live]]
            i[live] = self.counts[s] + self.rank(s, i[live])
            steps[live] += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling.  Every 0 counts as a symbol of its own, in order of place, so rounds end at the longest run."""
    n = len(text)
    gap = text == 0
    rank = np.where(gap, np.cumsum(gap) - 1, text + int(gap.sum()))
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[:-step] = rank[step:]
        key = rank * (max(n, int(rank.max())) + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def find(texts: list[bytes], phrases: Phrases) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; and for every occurrence its first word (counted over all texts), its phrase, its length."""
    get, one = phrases.vocab.get, repeat(1)
    ids: list[int] = []
    n_words = []
    for t in texts:
        w = words(t)
        n_words.append(len(w))
        ids.extend(map(get, w, one))
        ids.append(1)
    symbols = np.array(ids, np.int64)
    none = np.zeros(0, np.int64)
    known = symbols > 1
    edge = np.flatnonzero(np.diff(np.r_[False, known, False]))
    start, end = edge[::2], edge[1::2]
    long = end - start >= max(1, phrases.shortest)
    start, end = start[long], end[long]
    if not len(start) or not phrases.shortest:
        return n_words, none, none, none
    size = end - start + 1  # with the gap behind
    place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text = np.where(known[place], symbols[place] - 1, 0)
    text[np.cumsum(size) - 1] = 0
    index = FmIndex(text, len(phrases.vocab) + 1)
    lo, hi = index.search(phrases.rows - 1, phrases.size)
    hit = np.flatnonzero(hi > lo)
    n = hi[hit] - lo[hit]
    rows = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    which = np.repeat(hit, n)
    return n_words, place[index.locate(rows)], which, phrases.size[which]


def merge(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(df: DataFrame, keep: list[str], text: str, state: tuple[str, str, str], phrases, first: bool, last: bool) -> DataFrame:
    """One block of phrases against all rows; adds to the word intervals and items found so far."""
    n_words, hits, items = state
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [c for c in keep if c != text] if last and text not in keep else list(dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in out), f"`{n_words}` long, `{hits}` array<int>, `{items}` array<string>"])

    def run(batches):
        for b in batches:
            for p in pieces(b, text, SHARD):
                texts = [t or b"" for t in p.column(text).cast(pa.binary()).to_pylist()]
                n, at, which, size = find(texts, phrases.value)
                begin = np.cumsum(np.array([0, *n], np.int64) + 1) - 1
                of = np.searchsorted(begin, at, "right") - 1
                spans = [[] if first else list(zip(x[::2], x[1::2])) for x in (p.column(hits).to_pylist() if not first else n)]
                named = [set() if first else set(x) for x in (p.column(items).to_pylist() if not first else n)]
                for d, a, k, s in zip(of.tolist(), (at - begin[of]).tolist(), which.tolist(), size.tolist()):
                    spans[d].append((a, a + s))
                    named[d].update(phrases.value.items[k])
                yield pa.RecordBatch.from_arrays(
                    [*(p.column(c) for c in out), pa.array(n, pa.int64()), pa.array([[x for s in merge(v) for x in s] for v in spans], pa.list_(pa.int32())),
                     pa.array([sorted(v) for v in named], pa.list_(pa.string()))], names=[*out, n_words, hits, items])

    return map_arrow(df, run, schema)


def blocks(benchmark: DataFrame, item: str, text: str):
    """Items in blocks of bounded size, streamed to the driver one at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        if r[1]:
            block.append((r[0] or "", r[1].encode()))
            size += len(r[1])
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def scan(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW) -> tuple[DataFrame, tuple[str, str, str]]:
    """Columns ``keep`` with: number of words, merged word intervals that phrases cover (start, end, start, ...), items found.

    Also returns the names of these three, which avoid those of the input.
    """
    state = tuple(fresh(df.columns, "n_words", "hits", "items"))
    sc = df.sparkSession.sparkContext
    todo = [sc.broadcast(Phrases(b, window)) for b in blocks(benchmark, item, item_text)]
    out = df.select(*dict.fromkeys([*keep, text]))
    for k, p in enumerate(todo):
        out = _search(out, keep, text, state, p, k == 0, k == len(todo) - 1)
        if (k + 1) % BLOCKS_PER_PASS == 0:
            out = cut(out)
    return out.select(*keep, *state), state


def n_hit(hits: str) -> Column:
    """Words inside the intervals."""
    h = F.col(hits)
    return F.aggregate(F.transform(h, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)


def contaminated(n_words: str, hits: str) -> Column:
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(n_words))


def char_spans(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Code point spans of word intervals."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in zip(hits[::2], hits[1::2])]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    done, parts = 0, []
    for a, b in spans:
        parts.append(text[done:a])
        done = b
    return "".join([*parts, text[done:]])


_LOWER = {c: c + 32 for c in range(65, 91)}


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", size: str | None = None) -> DataFrame:
    """Rows that are not contaminated, in their columns, with covered spans cut out of their text (and ``size`` put right)."""
    found, (n_words, hits, items) = scan(df, benchmark, df.columns, text)
    left = found.where(~contaminated(n_words, hits)).drop(n_words, items)
    spots = [c for c in left.columns if c not in (hits,)]
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}

    def run(batches):
        for b in batches:
            for p in pieces(b, text):
                texts, found = p.column(text).to_pylist(), p.column(hits).to_pylist()
                for k, h in enumerate(found):
                    if h:
                        texts[k] = without(texts[k], char_spans(texts[k], h))
                cols = {c: p.column(c) for c in spots} | {text: pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = map_arrow(left, run, ", ".join(f"`{c}` {kinds[c]}" for c in spots))
    return out.withColumn(size, F.length(text).cast(kinds[size])) if size else out
