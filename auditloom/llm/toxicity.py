"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of two parts: an embedding of the word, if it is among the words known from at least
``KNOWN_IN`` texts of the sample, and the mean of embeddings of its character trigrams, in a hashed table of fixed size.  Two gated recurrent layers read a window in both directions,
attention pools their states, and a logistic unit gives the window's score.  Windows of ``WINDOW`` words start
every ``STRIDE`` words and the last one ends with the text, so every word of a text is scored; the text's
score is that of its worst window.

The model is fitted on the driver, on a bounded sample: at most ``SAMPLE_ROWS`` labelled rows of each label, those with the
smallest hash of their id, with at most ``SAMPLE_WINDOWS`` windows each, spread over the whole text.  From a toxic text the
window is learned that stands out most, first by word odds and then by the network itself; toxic texts without
anything that stands out are left out, as labels hold errors.

Defined cases: null, empty and wordless texts score 0; texts of any length are one row; repeated rows score
alike; without labels of both kinds every score is 0; an empty table gives no rows; only the named columns
are read.  Rows with a null label or id are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditloom.llm.common import map_arrow, map_texts, mix
from auditloom.llm.bpe import spread
from auditloom.llm.contamination import words

WINDOW, STRIDE = 32, 24
SAMPLE_ROWS, SAMPLE_WINDOWS = 1200, 24
KNOWN_IN, CHAR_SLOTS, DIM, HIDDEN = 3, 1 << 18, 12, 8
RUNS = (3, 4, 5)
CACHE_WORDS = 150_000
#: A word or run speaks for toxicity when it is in such a share of the toxic texts and by this log odds more often than in others.
EVIDENCE_SHARE, EVIDENCE_ODDS = 0.02, 4.0
#: Pull of the embeddings towards 0, and the share of words left out of a training window.
DECAY, DROP = 1e-4, 0.1
#: Recurrent matrices of both directions: update, reset, candidate.
GATES = 3 * HIDDEN


def window_starts(n: int) -> list[int]:
    """Where the windows of a text of n words start."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def features(new: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word (0 if it is not known), the slots of its character runs in a row, and how many it has."""
    size = np.fromiter(map(len, new), np.int64, len(new)) + 2
    raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in new), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(new)), size)
    code, slots, of = np.zeros(len(raw), np.uint64), [], []
    for k in range(max(RUNS)):
        code = code[:len(raw) - k] << np.uint64(8) | raw[k:]
        if k + 1 in RUNS:
            inside = word[:len(code)] == word[k:]
            slots.append((mix(code[inside] + np.uint64(k)) % np.uint64(CHAR_SLOTS)).astype(np.int64))
            of.append(word[:len(code)][inside])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.fromiter((known.get(w, 0) for w in new), np.int64, len(new)), np.concatenate(slots)[order], np.bincount(of, minlength=len(new))


class Network:
    """Parameters and both passes."""

    def __init__(self, known: list[bytes], word_odds: np.ndarray, char_odds: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
        self.known = {w: k + 1 for k, w in enumerate(known)}
        # Embeddings start at 0 but for one coordinate, the log odds of what was seen in toxic texts.
        word, char = np.zeros((len(known) + 1, DIM), np.float32), np.zeros((CHAR_SLOTS, DIM), np.float32)
        word[1:, 0], char[:, 0] = word_odds, char_odds
        self.p = {"word": word, "char": char, "a": f(2 * HIDDEN), "u": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: f(DIM, GATES), "U" + d: f(HIDDEN, GATES), "b" + d: np.zeros(GATES, np.float32)}

    def inputs(self, slot: np.ndarray, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, ends = self.p["word"][slot], np.cumsum(n)
        for k in range(0, len(n), 8192):  # in parts: the gathered rows are many times the result
            part = slice(k, k + 8192)
            first = ends[k] - n[k]
            chars = np.add.reduceat(self.p["char"][slots[first:ends[part][-1]]], ends[part] - n[part] - first, axis=0)
            out[part] += chars / np.sqrt(n[part])[:, None].astype(np.float32)
        return out

    def run(self, gates: dict[str, np.ndarray], index: np.ndarray, real: np.ndarray, trace: bool = False):
        """Window logits.  ``gates``: input part of the gates per distinct word, the last row for padding."""
        size, steps = index.shape
        states = np.zeros((size, steps, 2 * HIDDEN), np.float32)
        kept: dict = {}
        for d, order, cols in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            h, U, G = np.zeros((size, HIDDEN), np.float32), self.p["U" + d], gates[d]
            for t in order:
                x, hu = G[index[:, t]], h @ U
                zr = 1 / (1 + np.exp(-(x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
                if trace:
                    kept[d, t] = (h, hu, z, r, c)
                h = c + z * (h - c)
                states[:, t, cols] = h
        weight = np.where(real, states @ self.p["a"], -1e9)
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("ij,ijk->ik", weight, states)
        logit = pooled @ self.p["u"] + self.p["c"]
        return (logit, states, weight, pooled, kept) if trace else logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of the gates, with a last row for padding."""
        x = np.vstack([x, np.zeros((1, DIM), np.float32)])
        return {d: x @ self.p["W" + d] + self.p["b" + d] for d in "fb"}

    def gradients(self, feats, index: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        slot, slots, n = feats
        x = np.vstack([self.inputs(slot, slots, n), np.zeros((1, DIM), np.float32)])
        gates = {d: x @ self.p["W" + d] + self.p["b" + d] for d in "fb"}
        logit, states, weight, pooled, kept = self.run(gates, index, real, trace=True)
        g: dict[str, np.ndarray] = {}
        e = (1 / (1 + np.exp(-logit)) - y) / len(y)
        g["u"], g["c"] = pooled.T @ e, e.sum(keepdims=True)
        d_pool = e[:, None] * self.p["u"]
        d_weight = np.einsum("ik,ijk->ij", d_pool, states)
        d_att = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["a"] = np.einsum("ij,ijk->k", d_att, states)
        d_states = weight[:, :, None] * d_pool[:, None, :] + d_att[:, :, None] * self.p["a"]
        d_x = np.zeros_like(x)
        steps = index.shape[1]
        for d, order, cols in (("f", range(steps - 1, -1, -1), slice(0, HIDDEN)), ("b", range(steps), slice(HIDDEN, 2 * HIDDEN))):
            U = self.p["U" + d]
            d_gate, dU = np.zeros_like(gates[d]), np.zeros_like(U)
            dh = np.zeros((len(index), HIDDEN), np.float32)
            for t in order:
                h, hu, z, r, c = kept[d, t]
                dh = dh + d_states[:, t, cols]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hu[:, 2 * HIDDEN:] * r * (1 - r)
                d_hu = np.hstack([dz, dr, dc * r])
                np.add.at(d_gate, index[:, t], np.hstack([dz, dr, dc]))
                dU += h.T @ d_hu
                dh = dh * z + d_hu @ U.T
            g["U" + d], g["W" + d], g["b" + d] = dU, x.T @ d_gate, d_gate.sum(0)
            d_x += d_gate @ self.p["W" + d].T
        d_x = d_x[:-1]
        g["word"] = (slot, d_x)
        g["char"] = (slots, np.repeat(d_x / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
        return g


def pack(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, index of words by window (padding is one past the last), which places are real."""
    vocab: dict[bytes, int] = {}
    rows = [[vocab.setdefault(w, len(vocab)) for w in x] for x in windows]
    index = np.full((len(rows), WINDOW), len(vocab), np.int64)
    for k, r in enumerate(rows):
        index[k, :len(r)] = r
    return list(vocab), index, index < len(vocab)


def fit(texts: list[tuple[list[list[bytes]], int]], epochs: int = 9, seed: int = 7) -> Network | None:
    """From windows and label of each text.  None unless there are both labels."""
    texts = [(w, y) for w, y in texts if w]
    if len({y for _, y in texts}) < 2:
        return None
    r = np.random.default_rng(seed)
    vocab, index, real = pack([v for w, _ in texts for v in w])
    number = {w: k for k, w in enumerate(vocab)}
    _, slots, runs = features(vocab, {})
    begin = np.cumsum(runs) - runs
    # In how many texts of each label every word and every run of characters is.
    n_word, n_char = np.zeros((2, len(vocab))), np.zeros((2, CHAR_SLOTS))
    total = np.zeros(2)
    for w, y in texts:
        own = np.unique([number[x] for v in w for x in v])
        n_word[y, own] += 1
        n_char[y, np.unique(slots[spread(begin[own], runs[own])])] += 1
        total[y] += 1

    def odds(n: np.ndarray) -> np.ndarray:
        o = np.log((n[1] + 0.1) / (total[1] + 1)) - np.log((n[0] + 0.1) / (total[0] + 1))
        return np.where((n[1] >= max(KNOWN_IN, EVIDENCE_SHARE * total[1])) & (o >= EVIDENCE_ODDS), (o - EVIDENCE_ODDS + 1) / 3, 0)

    word_odds, char_odds = odds(n_word), odds(n_char)
    worth = np.append(np.maximum(word_odds, np.maximum.reduceat(char_odds[slots], begin)), 0)
    known = np.flatnonzero(n_word.sum(0) >= KNOWN_IN)
    net = Network([vocab[k] for k in known], word_odds[known], char_odds, seed)
    feats = features(vocab, net.known)
    value = worth[index].max(1)
    # Labels hold errors: a text labelled toxic with nothing in it that speaks for it is not learned from.
    first = np.cumsum([0, *[len(w) for w, _ in texts]])
    use = [not y or value[a:b].max() > 0 for (_, y), a, b in zip(texts, first, first[1:])]
    use = use if any(u and y for u, (_, y) in zip(use, texts)) else [True] * len(texts)
    rows = np.repeat(use, np.diff(first))
    texts = [(len(w), y) for (w, y), u in zip(texts, use) if u]
    index, real, value = index[rows], real[rows], value[rows]
    label, first = np.repeat([y for _, y in texts], [n for n, _ in texts]), np.cumsum([0, *[n for n, _ in texts]])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        best = np.array([a + int(np.argmax(value[a:b])) for a, b in zip(first, first[1:])])
        pos = best[label[best] == 1]
        neg = np.flatnonzero(label == 0)
        hard = best[label[best] == 0]
        neg = np.r_[hard, r.choice(neg, min(len(neg), 8 * len(pos)), replace=False)]
        rows = r.permutation(np.r_[np.repeat(pos, 4), neg])
        for a in range(0, len(rows), 128):
            k = rows[a:a + 128]
            used, small = np.unique(index[k], return_inverse=True)
            small = small.reshape(len(k), WINDOW)
            drop = r.random(small.shape) < DROP
            pads = used[-1] == len(vocab)
            used = used[:-1] if pads else used
            small = np.where(drop, len(used), small)
            n = feats[2][used]
            g = net.gradients((feats[0][used], feats[1][spread(begin[used], n)], n), small, real[k] & ~drop, label[k].astype(np.float32))
            step += 1
            for q, d in g.items():
                if q in ("word", "char"):  # only the rows that were touched
                    at, inverse = np.unique(d[0], return_inverse=True)
                    total_d = np.zeros((len(at), DIM), np.float32)
                    np.add.at(total_d, inverse, d[1])
                    total_d += DECAY * net.p[q][at]
                    v2[q][at] += total_d * total_d
                    net.p[q][at] -= 0.0003 * total_d / (np.sqrt(v2[q][at]) + 1e-4)
                    continue
                m[q] = 0.9 * m[q] + 0.1 * d
                v2[q] = 0.99 * v2[q] + 0.01 * d * d
                net.p[q] -= (0.02 * (m[q] / (1 - 0.9**step)) / (np.sqrt(v2[q] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if epoch >= 3:
            value = scores(net, feats, index, real)
    value = scores(net, feats, index, real)
    top = np.array([value[a:b].max() for a, b in zip(first, first[1:])])
    y = np.array([l for _, l in texts])
    # Move the zero to where the sample's texts are told apart best, and there nearer to the toxic side: whole texts have more windows.
    order = np.sort(top)
    cuts = np.r_[order[0] - 1, 0.9 * order[1:] + 0.1 * order[:-1]]
    wrong = [np.mean((top > c)[y == 0]) + np.mean((top <= c)[y == 1]) for c in cuts]
    least = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-9)
    widest = least[np.argmax([(order[k] - order[k - 1]) if k else 0 for k in least])]
    net.p["c"] = net.p["c"] - np.float32(cuts[widest])
    return net


def scores(net: Network, feats, index: np.ndarray, real: np.ndarray) -> np.ndarray:
    gates = net.gates(net.inputs(*feats))
    return np.concatenate([net.run(gates, index[k:k + 4096], real[k:k + 4096]) for k in range(0, len(index), 4096)])


class Scorer:
    """Scores texts with a cache of the words' gate inputs."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.gates = {d: np.zeros((0, GATES), np.float32) for d in "fb"}

    def texts(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        if len(self.at) > CACHE_WORDS:
            self.clear()
        split = [words(t) for t in texts]
        if new := sorted({w for x in split for w in x}.difference(self.at)):
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            fresh = self.net.gates(self.net.inputs(*features(new, self.net.known)))
            self.gates = {d: np.vstack([self.gates[d], fresh[d][:-1]]) for d in "fb"}
            self.pad = {d: fresh[d][-1:] for d in "fb"}
        if not any(split):
            return out
        gates = {d: np.vstack([self.gates[d], self.pad[d]]) for d in "fb"}
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.at.__getitem__, (w for x in split for w in x)), np.int64, int(n.sum()))
        begin = np.cumsum(n) - n
        starts, owner = [], []
        for k, (b, m) in enumerate(zip(begin.tolist(), n.tolist())):
            s = window_starts(m)
            starts += [b + x for x in s]
            owner += [k] * len(s)
        starts, owner = np.array(starts), np.array(owner)
        place = starts[:, None] + np.arange(WINDOW)
        real = place < (begin + n)[owner][:, None]
        index = np.where(real, flat[np.minimum(place, len(flat) - 1)], len(self.at))
        logit = np.concatenate([self.net.run(gates, index[k:k + 2048], real[k:k + 2048]) for k in range(0, len(index), 2048)])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, logit)
        full = n > 0
        out[full] = 1 / (1 + np.exp(-np.clip(worst[full], -30, 30)))
        return out


def sample(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[list[list[bytes]], int]]:
    """Windows and label of the bounded sample, cut on the executors."""
    ranked = labels.where(F.col(ids).isNotNull() & F.col(label).isin(0, 1)).select(F.col(ids).alias("id"), F.col(label).cast("int").alias("y")).distinct()
    order = [F.xxhash64("id"), "id"]
    picked = ranked.where("y = 0").orderBy(*order).limit(SAMPLE_ROWS).union(ranked.where("y = 1").orderBy(*order).limit(SAMPLE_ROWS))
    rows = docs.select(F.col(ids).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").dropDuplicates(["id"])

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                w = words((t or "").encode())
                s = window_starts(len(w))
                s = [s[int(k)] for k in np.linspace(0, len(s) - 1, min(len(s), SAMPLE_WINDOWS))] if s else []
                out.append([b" ".join(w[a:a + WINDOW]).decode(errors="replace") for a in s])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(out, pa.list_(pa.string()))], names=["id", "y", "windows"])

    kind = docs.schema[ids].dataType.simpleString()
    got = map_arrow(rows, run, f"id {kind}, y int, windows array<string>").collect()
    one: dict[bytes, bytes] = {}  # each distinct word once in memory
    return [([[one.setdefault(w, w) for w in x.encode().split()] for x in r["windows"]], r["y"]) for r in sorted(got, key=lambda r: r["id"])]


_SCORERS: dict[int, Scorer] = {}


def score(df: DataFrame, net: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score``, 0 to 1."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    def work(texts: list[str]):
        if sent.value is None:
            return [np.zeros(len(texts))]
        key = id(sent.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(sent.value)
        return [_SCORERS[key].texts([t.encode() for t in texts])]

    return map_texts(df, keep, text, "score double", work)
