"""Byte-level BPE: encode whole texts to ids with byte offsets, and decode ids to bytes.

Pieces come from :mod:`auditloom.llm.pretokens`.  A piece that was met before takes its ids from a
bounded cache; all new pieces of a batch are merged together, one merge per piece and step, on flat
arrays.  Long pieces are merged one by one with a heap.

Defined cases: null and empty texts have no ids; a text of any length is one row and is never cut;
repeated rows are encoded each for itself; an empty table gives no rows; only the named columns of the
input are read, so further columns cannot clash.  Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from auditloom.llm import pretokens
from auditloom.llm.common import map_arrow, map_texts

#: Pieces whose ids a worker remembers; beyond it the cache starts anew.
CACHE_PIECES = 200_000
#: Bytes above which a piece is merged by the heap.
LONG = 64
NONE = np.int64(1) << 40


class Vocabulary:
    """Token bytes by id, and which pairs of ids merge: ``merged`` holds (rank, id) per pair."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.bytes_to_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.news = np.array([i for _, i in pairs.values()], np.int64)[order]
        self.by_rank = np.zeros(int(self.ranks.max()) + 1, np.int64)
        self.by_rank[self.ranks] = self.news
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.longest = int(self.length.max())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """Merges of one piece, the lowest rank first, the leftmost among equals; n log n."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = pairs[p][1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (q := (ids[x], ids[y])) in pairs:
                    heapq.heappush(heap, (pairs[q][0], x, q))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has.  Every step merges one pair in every open piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(tok), NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(tok[inner], tok[inner + 1])
        done_tok, done_word = [], []
        while len(tok):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(tok)])
            open_ = np.repeat(least < NONE, length)
            if not open_.all():
                done_tok.append(tok[~open_])
                done_word.append(word[~open_])
                least = np.repeat(least, length)[open_]
                tok, word, rank = tok[open_], word[open_], rank[open_]
            else:
                least = np.repeat(least, length)
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            tok[at] = self.by_rank[rank[at]]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # every merge before has removed one
            tok, word, rank = tok[keep], word[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                pair = (i + 1 < len(tok)) & (word[np.minimum(i + 1, len(tok) - 1)] == word[i])
                rank[i] = NONE
                i = i[pair]
                rank[i] = self.rank(tok[i], tok[i + 1])
        tok, word = np.concatenate([*done_tok, tok]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return tok[order], np.bincount(word, minlength=len(pieces))

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        todo, where = [], []
        for k, p in enumerate(pieces):
            b = p.encode()
            if (whole := self.ids.get(b)) is not None:
                out[k] = np.array([whole], np.int64)
            elif len(b) > LONG:
                out[k] = np.array(self.merge_one(b), np.int64)
            else:
                todo.append(b)
                where.append(k)
        if todo:
            ids, n = self.merge_many(todo)
            for k, x in zip(where, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                out[k] = x
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids in a row; the bytes of an id never depend on its neighbours."""
        n = self.length[ids]
        return self.flat[spread(self.start[ids], n)]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] of them, then those of the next."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def ranks_vocabulary(data: bytes) -> Vocabulary:
    """From lines of base64 token and rank: two ids merge when their joined bytes are a token."""
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    tokens = [t for t, _ in sorted(ids.items(), key=lambda x: x[1])]
    pairs = {}
    for t, i in ids.items():
        for k in range(1, len(t)):
            if (a := ids.get(t[:k])) is not None and (b := ids.get(t[k:])) is not None:
                pairs[a, b] = (i, i)
    return Vocabulary(tokens, pairs)


def merges_vocabulary(data: bytes) -> tuple[Vocabulary, dict[str, int]]:
    """From a JSON file of vocabulary and merges, and its special tokens.  Bytes are written there as printable characters."""
    model = (j := json.loads(data))["model"]
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = {k: i for k, i in model["vocab"].items() if all(c in shown for c in k)}
    tokens = [bytes(shown[c] for c in k) for k, _ in sorted(vocab.items(), key=lambda x: x[1])]
    pairs = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
    return Vocabulary(tokens, pairs), {t["content"]: t["id"] for t in j.get("added_tokens", [])}


@functools.lru_cache(maxsize=2)
def _ranks(data: bytes) -> Vocabulary:
    return ranks_vocabulary(data)


class Encoder:
    """Encodes texts with a cache of pieces.  The cache is two flat arrays and a dictionary of positions."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.n, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: set[str]) -> None:
        new = sorted(pieces)
        found = self.v.encode_pieces(new)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(n) - n]
        self.n = np.r_[self.n, n]
        self.ids = np.concatenate([self.ids, *found])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each text has, and the end of each id in its text's bytes."""
        joined, starts, ends = pretokens.cut(texts)
        cuts = [*starts.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.at) > CACHE_PIECES:
            self.clear()
        if new := set(pieces).difference(self.at):
            self.learn(new)
        which = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        border = np.searchsorted(starts, ends)
        n = self.n[which]
        n[border] = 0
        ids = self.ids[spread(self.start[which], n)]
        per_text = np.diff(np.r_[0, np.cumsum(n)[border]])
        end = np.cumsum(self.v.length[ids])
        before = np.cumsum(per_text) - per_text
        size = np.r_[0, end][before + per_text] - np.r_[0, end][before]
        return ids, per_text, end - np.repeat(np.cumsum(size) - size, per_text)


def _lists(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values.astype(np.int32), kind))


def load(path: str) -> bytes:
    """A vocabulary file, read once on the driver; a few MB at most, so it may be broadcast."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary file of over 64 MB is not broadcast")
    return data


_ENCODERS: dict[int, Encoder] = {}


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, ``ids`` and ``ends``: the ids of the whole text, and where each ends in its UTF-8 bytes."""
    sent = df.sparkSession.sparkContext.broadcast(load(path))

    def work(texts: list[str]):
        key = hash(sent.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(_ranks(sent.value))
        ids, n, ends = _ENCODERS[key].encode(texts)
        return [_lists(ids, n, pa.int32()), _lists(ends, n, pa.int32())]

    return map_texts(df, keep, text, "ids array<int>, ends array<int>", work)


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of the ids; null ids give empty bytes."""
    sent = df.sparkSession.sparkContext.broadcast(load(path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        v = _ranks(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                col = p.column(ids)
                n = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
                flat = np.asarray(pc.list_flatten(col), np.int64)
                size = np.add.reduceat(np.r_[v.length[flat], 0], np.minimum(np.cumsum(n) - n, len(flat))) * (n > 0)
                ends = np.r_[0, np.cumsum(size)]
                data = pa.Array.from_buffers(pa.binary(), p.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(v.decode(flat).tobytes())])
                yield pa.RecordBatch.from_arrays([*[p.column(c) for c in keep], data], names=[*keep, "decoded"])

    return map_arrow(df.select(*dict.fromkeys([*keep, ids])), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded binary"]))


def ids_digest(ids: str = "ids"):
    """Lowercase hex sha256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256)
