"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans.  Tokens with a digit or an @ are then labelled by a random field: features of
the token, potentials between neighbours, and potentials between distant tokens of the same text that are
equal (the same characters) or similar (the same seven or more digits, also over neighbouring tokens, or the same name before an @).
All of them are tied to one node that stands for what they name, so links grow with the tokens, not with their pairs,
and evidence is two links from any other occurrence however many lie between.  Tokens of base spans are fixed to their kind,
and so is their node; loopy message passing carries that to the others until messages stop changing, and a token that is
then surely of a kind becomes a span of its own.  A node without a base span has no kind by itself: tokens that say nothing
leave it as it is.  Base spans stay as they are.

Weights come from pseudo-likelihood: every token given the labels of its neighbours, with the base spans as labels.
Equal situations of all texts are counted on the executors, so only distinct ones reach the driver: a combination of
features with at most one label of each of four neighbours and its own, whatever the number of texts.

Defined cases: null and empty texts have no spans; texts of any length are searched whole; repeated rows are judged
each for itself; an empty table gives no rows (and no spans are added where nothing was learned); only the named
columns are read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import ast
import re
import string
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditloom.llm.common import map_arrow, map_texts, pieces

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: Patterns only start where a run of their first characters does: a later start in the run cannot match either, and long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*")
LOCAL = string.ascii_letters + string.digits + "._%+-"
GAP = re.compile(r"[\x20().-]{1,3}")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Probability from which a token is added, change at which messages have come to rest, weight that fixes base tokens.
SURE, REST, FIXED = 0.9, 1e-3, 12.0
#: Rounds after each of which the step is halved again, so that messages that swing come to rest too.
FULL_STEPS = 200
#: Log weight of what cannot be.
NEVER = -1e6
#: Prior of the agreement potentials.
AGREE = 6.0
N_LABELS = 1 + len(KINDS)
N_FEATURES = 27


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in back[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of ``EMAIL``, found from each ``@`` to the left, so that a run without one is never tried."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start, step = at, 32
        while start > done:
            low = max(done, start - step)
            short = len(text[low:start].rstrip(LOCAL))
            start = low + short
            if short:
                break
            step *= 2
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Tokens:
    """Tokens of a text with features, chain neighbours and skip links."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.span = [m.span() for m in TOKEN.finditer(text)]
        n = len(self.span)
        words = [text[a:b] for a, b in self.span]
        digits = [NOT_DIGIT.sub("", w) for w in words]
        self.next = [bool(GAP.fullmatch(text, self.span[k][1], self.span[k + 1][0])) for k in range(n - 1)]
        self.label = [0] * n
        ends = [e for _, e in self.span]
        for kind, a, b in reversed(base):
            k = bisect_right(ends, a)
            while k < n and self.span[k][0] < b:
                self.label[k] = kind + 1
                k += 1
        # Digits of the whole chain of a token, and whether it starts with a plus.
        group, whole, plus = 0, [], []
        while group < n:
            end = group
            while end < n - 1 and self.next[end]:
                end += 1
            whole += ["".join(digits[group:end + 1])] * (end + 1 - group)
            plus += [words[group].startswith("+")] * (end + 1 - group)
            group = end + 1
        self.features = [self._features(text, k, words[k], digits[k], whole[k], plus[k]) for k in range(n)]
        self.same = self._groups(words)
        equal = set(map(tuple, self.same))
        self.like = [g for g in self._groups([w.partition("@")[0].lower() + "@" if "@" in w else d if len(d) >= 7 else None for w, d in zip(words, whole)])
                     if tuple(g) not in equal]

    @staticmethod
    def _groups(keys: list[str | None]) -> list[list[int]]:
        """Tokens with the same key, where there are two or more."""
        by: dict[str, list[int]] = {}
        for k, key in enumerate(keys):
            if key is not None and len(key) > 4:
                by.setdefault(key, []).append(k)
        return [g for g in by.values() if len(g) > 1]

    def _features(self, text: str, k: int, w: str, d: str, whole: str, plus: bool) -> tuple[int, ...]:
        parts, n = w.rstrip(".-").split("."), len(d)
        quad = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
        before = text[self.span[k][0] - 1:self.span[k][0]]
        yes = [
            True, "@" in w, "@" in w and "." in w.partition("@")[2].rstrip("."), quad, quad and all(len(p) <= 3 and int(p) <= 255 for p in parts),
            any(c.isalpha() for c in w), n > 0 and any(c.isalpha() for c in w), w.startswith("+"),
            n == 1, n == 2, n == 3, n == 4, 5 <= n <= 6, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n >= 20,
            13 <= n <= 19 and luhn(d), "-" in w, "." in w, k > 0 and self.next[k - 1], k < len(self.next) and self.next[k],
            before in ("=", '"', "'", "#") and before != "", 13 <= len(whole) <= 19 and luhn(whole), plus and 9 <= len(whole) <= 15,
            len(whole) > n, w.startswith("@") or w.endswith("@")]
        return tuple(i for i, y in enumerate(yes) if y)


def most(number: list[int]) -> int:
    """The most frequent kind by label, the first of several; 0 if there is none."""
    best = max(range(1, N_LABELS), key=number.__getitem__)
    return best if number[best] else 0


def situations(texts: list[str]) -> dict[tuple, int]:
    """How often each (features, label left, right, of equal tokens, of similar tokens, own label) occurs; each label is a tuple of one or none."""
    seen: dict[tuple, int] = {}
    for t in texts:
        k = Tokens(t, base_spans(t))
        near = [[[] for _ in range(4)] for _ in k.label]
        for a, go in enumerate(k.next):
            if go:
                near[a + 1][0].append(k.label[a])
                near[a][1].append(k.label[a + 1])
        for groups, slot in ((k.same, 2), (k.like, 3)):
            for g in groups:
                number = [0] * N_LABELS
                for a in g:
                    number[k.label[a]] += 1
                for a in g:
                    number[k.label[a]] -= 1
                    near[a][slot].append(most(number))
                    number[k.label[a]] += 1
        for f, x, y in zip(k.features, near, k.label):
            s = (f, *[tuple(sorted(v)) for v in x], y)
            seen[s] = seen.get(s, 0) + 1
    return seen


class Field:
    """Weights: features by label, neighbour potentials, and agreement of equal and similar tokens by label."""

    def __init__(self):
        self.unary = np.zeros((N_FEATURES, N_LABELS))
        self.chain = np.zeros((N_LABELS, N_LABELS))
        # Repeats are rare in some corpora: without evidence their potentials stay at this prior.
        self.same = np.array([0.0, *[AGREE] * len(KINDS)])
        self.like = self.same.copy()

    def fit(self, seen: list[tuple[tuple, int]], steps: int = 400) -> Field:
        m = len(seen)
        if not m:
            return self
        X, left, right = np.zeros((m, N_FEATURES)), np.zeros((m, N_LABELS)), np.zeros((m, N_LABELS))
        same, like, y = np.zeros((m, N_LABELS)), np.zeros((m, N_LABELS)), np.zeros(m, int)
        for k, ((f, a, b, s, l, own), _) in enumerate(seen):
            X[k, list(f)] = 1
            y[k] = own
            for table, labels in ((left, a), (right, b), (same, s), (like, l)):
                for v in labels:
                    table[k, v] += 1
        n = np.log1p(np.array([c for _, c in seen], float))
        target = np.eye(N_LABELS)[y]
        P = (self.unary, self.chain, self.same, self.like)
        prior = [p.copy() for p in P]
        m1, m2 = [np.zeros_like(p) for p in P], [np.zeros_like(p) for p in P]
        for step in range(1, steps + 1):
            z = X @ self.unary + left @ self.chain + right @ self.chain.T + same * self.same + like * self.like
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            e = (p - target) * n[:, None] / n.sum()
            G = (X.T @ e, left.T @ e + e.T @ right, (e * same).sum(0), (e * like).sum(0))
            for q, g, a, b, rest in zip(P, G, m1, m2, prior):
                g = g + 1e-3 * (q - rest)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def marginals(self, tokens: list[Tokens]) -> list[np.ndarray]:
        """Label probabilities of the tokens of many texts, by loopy message passing over all at once."""
        size = np.cumsum([0, *[len(t.label) for t in tokens]])
        nodes = size[-1] + sum(len(t.same) + len(t.like) for t in tokens)
        unary = np.zeros((nodes, N_LABELS))
        src, dst, pot, of = [], [], [], []
        node = int(size[-1])
        # Of a token given its node, so that a node gains nothing from tokens that say nothing.
        equal, similar = (m - np.log(np.exp(m).sum(0)) for m in (np.diag(self.same), np.diag(self.like)))
        for i, (t, o) in enumerate(zip(tokens, size.tolist())):
            for k, f in enumerate(t.features):
                unary[o + k] = self.unary[list(f)].sum(0)
                if t.label[k]:
                    unary[o + k, t.label[k]] += FIXED
            links = [(o + a, o + a + 1, self.chain) for a, go in enumerate(t.next) if go]
            for groups, table in ((t.same, equal), (t.like, similar)):
                for g in groups:
                    links += [(o + a, node, table) for a in g]
                    if kind := most(np.bincount([t.label[a] for a in g], minlength=N_LABELS).tolist()):
                        unary[node] = NEVER
                        unary[node, kind] = 0
                    node += 1
            for a, b, table in links:
                src += [a, b]
                dst += [b, a]
                pot += [table, table.T]
            of += [i] * (2 * len(links))
        belief = unary.copy()
        if src:
            src, dst, pot, of = np.array(src), np.array(dst), np.array(pot), np.array(of)
            message = np.zeros((len(src), N_LABELS))
            live, n = np.arange(len(src)), 0
            while len(live):
                x = (belief[src[live]] - message[live ^ 1])[:, :, None] + pot[live]
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
                change = 0.5 ** (1 + n // FULL_STEPS) * (new - new.max(1, keepdims=True) - message[live])
                message[live] += change
                np.add.at(belief, dst[live], change)
                # Texts whose messages have come to rest are done.
                moving = np.zeros(len(tokens), bool)
                moving[of[live[np.abs(change).max(1) > REST]]] = True
                live = live[moving[of[live]]]
                n += 1
        belief = belief[:size[-1]]
        p = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
        p = p / p.sum(1, keepdims=True) if len(p) else p
        return [p[a:b] for a, b in zip(size, size[1:])]


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    some = [k for k, t in enumerate(texts) if TOKEN.search(t)]
    tokens = [Tokens(texts[k], base[k]) for k in some]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, t, p in zip(some, tokens, field.marginals(tokens)):
        kind = p.argmax(1)
        for i in np.flatnonzero((kind > 0) & (p.max(1) >= SURE)).tolist():
            if t.label[i]:
                continue
            a, b = t.span[i]
            b -= len(texts[k][a:b]) - len(texts[k][a:b].rstrip(".-%_"))
            last = added[k][-1] if added[k] else None
            if last and last[0] == kind[i] - 1 and i and t.next[i - 1] and last[2] >= t.span[i - 1][1]:
                added[k][-1] = (last[0], last[1], b)
            else:
                added[k].append((int(kind[i]) - 1, a, b))
    return list(zip(base, added))


def learn(df: DataFrame, text: str = "text") -> Field:
    rows = df.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for p in pieces(b, "text"):
                seen.update(situations(p.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([repr(s) for s in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    got = map_arrow(rows, run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return Field().fit([(ast.literal_eval(r["s"]), r["n"]) for r in sorted(got, key=lambda r: r["s"])])


def shown(spans: list[tuple[int, int, int]]) -> list[str]:
    return [f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)]


def spans(df: DataFrame, field: Field, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, ``base`` and ``spans`` (all): arrays of ``kind:start:end`` by kind and start."""
    sent = df.sparkSession.sparkContext.broadcast(field)

    def work(texts: list[str]):
        found = find(texts, sent.value)
        return [[shown(b) for b, _ in found], [shown(b + a) for b, a in found]]

    return map_texts(df, keep, text, "base array<string>, spans array<string>", work)


def mask(df: DataFrame, field: Field, text: str = "text", size: str | None = None) -> DataFrame:
    """All rows and columns with every span in ``text`` replaced by its kind, as ``<EMAIL>``; nulls stay null."""
    sent = df.sparkSession.sparkContext.broadcast(field)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for b in batches:
            for p in pieces(b, text):
                texts = p.column(text).to_pylist()
                out = []
                for t, (base, added) in zip(texts, find([t or "" for t in texts], sent.value)):
                    done, parts = 0, []
                    for a, e, k in sorted((a, e, k) for k, a, e in base + added):
                        if a >= done:
                            parts += [t[done:a], f"<{KINDS[k].upper()}>"]
                        done = max(done, e)
                    out.append(t if t is None else "".join([*parts, t[done:]]))
                cols = {c: p.column(c) for c in kinds} | {text: pa.array(out, pa.string())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = map_arrow(df, run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    return out.withColumn(size, F.length(text).cast(kinds[size])) if size else out
