"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from auditloom.llm import collocations
from auditloom.llm.common import bit_filter, passes

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for t, lang in rows:
        for p in re.split("[.,;:!?\n-\r]", (t or "").translate(LOWER)):
            w = re.findall("[^ \t]+", p)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f.update((lang or "und", *w[i:i + k]) for i in range(len(w) - k + 1))
    best = {}
    kept = {x: a for x, a in f.items() if len(x) > 2 and a >= least}
    for x, a in kept.items():
        cuts = [(1000 * a * n[x[0]] // (f[x[:k]] * f[x[0], *x[k:]]), k) for k in range(2, len(x))]
        score, k = min(cuts)
        best[x] = (score, a, f[x[:k]], f[x[0], *x[k:]])
    inside = {(x[0], *x[i:i + m]) for x, a in kept.items() for m in range(2, len(x) - 1) for i in range(1, len(x) - m + 1)
              if f[(x[0], *x[i:i + m])] == a}
    out = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(x[1:]).encode(), l, r) for x, (s, a, l, r) in best.items() if x[0] == lang and x not in inside)
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(mine[:top], 1)]
    return sorted(out)


def sample():
    r = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma", "d\x00", "é", "#", "zeta-1", "'", " ", "AB"]
    rows = [(None, "en"), ("", None), ("one", None), ("  \t . , \n\n", "en"), ("x " * 400, "fr"), ("A b! " * 300, "de"), ("q\x0bq\x0cq\rq", "de")]
    for k in range(120):
        t = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n"]) for _ in range(r.randint(0, 40)))
        rows.append((t + r.choice(["", "alpha beta gamma d\x00 é", " ALPHA  Beta\tgamma"]), r.choice(["en", "en", "de", None])))
    return rows + rows[:30]


@pytest.mark.parametrize("least,top,piece,pairs", [(5, 2000, collocations.PIECE, collocations.PAIRS), (3, 7, 300, 20), (1, 2000, 300, 20), (100, 50, 1 << 20, 4)])
def test_mine_equals_brute_force(spark, monkeypatch, least, top, piece, pairs):
    monkeypatch.setattr(collocations, "PIECE", piece)
    monkeypatch.setattr(collocations, "PAIRS", pairs)
    rows = sample()
    docs = spark.createDataFrame([(t, p, 1, "w") for t, p in rows], "text string, lang string, n long, w1 string").repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(docs, least=least, top=top).collect())
    assert got == brute(rows, least, top)


def test_empty_tables(spark):
    for rows in ([], [(None, None)]):
        assert collocations.mine(spark.createDataFrame(rows, "text string, lang string"), least=1).count() == 0


def test_filter_has_every_key(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63, 5000)
    bits = bit_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"), len(keys))
    assert passes(bits, keys).all() and passes(bits, np.arange(1000, 100000)).mean() < 0.1
