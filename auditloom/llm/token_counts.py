"""Exact token counts of every prefix of a text.

For each piece a dynamic program over its bytes finds, for every prefix, the last token of that prefix's
encoding: the token whose predecessor's last token stays beside it when the two are encoded together.
The count of a prefix is the count before that last token plus one, so one pass over a piece gives the
exact counts of all its prefixes, and sums over the pieces those of all prefixes of a text.  Where a
prefix would be cut into pieces differently than the whole text (behind a run of white space, inside
a contraction or a special token) its count is put right from the same tables.  Questions about budgets
and truncation are then look-ups.

Defined cases: null and empty texts have 0 bytes and tokens; a text of any length is one row and counted
whole; repeated rows are counted each for itself; an empty table gives no rows; only the named columns are
read, so further columns cannot clash.  Special tokens inside a text count one each.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm import pretokens
from auditloom.llm.bpe import Vocabulary, load, merges_vocabulary, spread
from auditloom.llm.common import map_texts

#: Pieces, and pairs of neighbouring tokens, that a worker remembers; beyond it that memory starts anew.
CACHE_PIECES = 400_000
CACHE_PAIRS = 1_000_000


class PrefixCounter:
    """Counts of all prefixes of pieces and texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, special: dict[str, int]):
        self.v = vocabulary
        self.special = sorted(special, key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, self.special))) if special else None
        whole, n = vocabulary.merge_many(vocabulary.tokens)
        #: Tokens that a text can end in: those that are their own encoding.
        self.usable = {t: i for i, t in enumerate(vocabulary.tokens) if n[i] == 1}
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.counts, self.start, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _beside(self, a: int, b: int) -> bool:
        """Whether the encoding of both together is the two."""
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.v.merge_one(self.v.tokens[a] + self.v.tokens[b]) == [a, b]
        return ok

    def piece(self, text: str) -> list[int]:
        """Token count of each prefix of a piece, by code point, the empty one left out."""
        data, usable, beside = text.encode(), self.usable, self._beside
        size, longest = len(data), self.v.longest
        last, count, begin = [0] * (size + 1), [0] * (size + 1), 0
        for i in range(1, size + 1):
            # Exactly one start fits, so the order is free: that of the token before first, then later ones, then earlier.
            for j in chain(range(begin, i), range(begin - 1, max(0, i - longest) - 1, -1)):
                t = usable.get(data[j:i])
                if t is not None and (j == 0 or beside(last[j], t)):
                    last[i], count[i], begin = t, count[j] + 1, j
                    break
        if size == len(text):
            return count[1:]
        return [count[i] for i in range(1, size + 1) if i == size or data[i] & 0xC0 != 0x80]

    def _of(self, pieces: list[str]) -> np.ndarray:
        """Position of every piece in the memory, learning new ones."""
        if len(self.at) > CACHE_PIECES:
            self.clear()
        if new := sorted(set(pieces).difference(self.at)):
            found = [self.piece(p) for p in new]
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.r_[self.start, len(self.counts) + np.cumsum(n) - n]
            self.n = np.r_[self.n, n]
            self.counts = np.concatenate([self.counts, *[np.array(f, np.int32) for f in found]])
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def segments(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of all prefixes, the empty one first, of texts without special tokens."""
        joined, starts, ends = pretokens.cut(texts)
        cuts = [*starts.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        size = np.diff(cuts)
        inner = np.ones(len(pieces), bool)
        border = np.searchsorted(starts, ends)
        inner[border] = False
        # A run of white space before a word is cut before its last character; a prefix that ends
        # with the run is not.  Short contractions are one piece, but their apostrophe alone is not.
        white = np.fromiter((p.isspace() for p in pieces), bool, len(pieces)) & inner
        run = np.flatnonzero(white[:-1] & inner[1:])
        runs = [pieces[k] + pieces[k + 1][0] for k in run]
        quote = [k for k, p in enumerate(pieces) if p in ("'re", "'ve", "'ll")]
        halves = [p for k in quote for p in ("'", pieces[k][1])]
        which = self._of([*pieces, *runs, *halves])
        main, of_run, of_half = which[:len(pieces)], which[len(pieces):len(pieces) + len(runs)], which[len(pieces) + len(runs):]
        total = self.counts[self.start + self.n - 1]
        before = np.where(inner, total[main], 0)
        before = np.cumsum(before) - before
        flat = self.counts[spread(self.start[main], size)] + np.repeat(before, size)
        flat[starts[run + 1]] = before[run] + total[of_run]
        if quote:
            flat[starts[quote] + 1] = before[quote] + total[of_half].reshape(-1, 2).sum(1)
        out, at, done = [], 0, 0
        for e, b in zip(ends.tolist(), before[border].tolist()):
            out.append(np.r_[0, flat[at:e] - done].astype(np.int32))
            at, done = e + 1, b
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of all prefixes of whole texts, by code point, the empty one first."""
        if not self.split or not any(s in t for t in texts for s in self.special):
            return self.segments(texts)
        parts, found = [], []
        for t in texts:
            parts.append(self.split.split(t))
            found.append(self.split.findall(t))
        plain = iter(self.segments([s for p in parts for s in p]))
        out = []
        for p, f in zip(parts, found):
            row = next(plain)
            for k, s in enumerate(f):
                base = int(row[-1])
                before = base - int(self.segments([p[k]])[0][-1])
                inside = self.segments([p[k] + s[:-1]])[0][len(p[k]) + 1:] + before
                row = np.concatenate([row, inside, [base + 1], next(plain)[1:] + base + 1])
            out.append(row.astype(np.int32))
        return out


@functools.lru_cache(maxsize=2)
def counter(data: bytes) -> PrefixCounter:
    return PrefixCounter(*merges_vocabulary(data))


def count_tokens(df: DataFrame, path: str, keep: list[str], text: str = "text", budget: int = 1024, prefixes: bool = False) -> DataFrame:
    """Columns ``keep``, ``n_bytes``, ``n_tokens``, ``fitting_chars`` (the longest prefix within ``budget`` tokens)
    and, if asked for, ``prefix_tokens``: the count of every prefix, the empty one first."""
    sent = df.sparkSession.sparkContext.broadcast(load(path))

    def work(texts: list[str]):
        rows = counter(sent.value).texts(texts)
        fit = [int(np.flatnonzero(r <= budget)[-1]) for r in rows]
        out = [[len(t.encode()) for t in texts], [int(r[-1]) for r in rows], fit]
        if prefixes:
            n = np.fromiter(map(len, rows), np.int32, len(rows))
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(rows))))
        return out

    return map_texts(df, keep, text, "n_bytes long, n_tokens long, fitting_chars long" + ", prefix_tokens array<int>" * prefixes, work)
