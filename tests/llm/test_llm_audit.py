"""Filter interaction audit and its tries against plain loops."""

import random
import re
from collections import Counter
from itertools import permutations

from auditloom.llm import filter_audit
from auditloom.llm.tries import RadixTrie, shared

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^ \t-\r]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        fails.append((i, lang or "", {k for k, v in f.items() if v}))
    out, shapley = Counter(), Counter()
    for order in map("".join, permutations("ABCDE")):
        for i, part, f in fails:
            gone = False
            for step, x in enumerate(order, 1):
                at = (part, order, step)
                out[at, "kept"] += not gone and x not in f
                out[at, "redundant"] += gone and x in f
                out[at, "unique_fails"] += f == {x}
                hit = not gone and x in f
                out[at, "removed"] += hit
                out[at, "good_lost"] += hit and i in good
                out[at, "toxic_lost"] += hit and i in toxic
                shapley[part, x] += hit
                gone = gone or x in f
    parts = {p for _, p, _ in fails}
    return {(p, o, s, *[out[(p, o, s), c] for c in COUNTS[:-1]], shapley[p, o[s - 1]])
            for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def sample():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeAé#") if r.random() < 0.1 else r.choice("abcde") for _ in range(r.randint(1, 6)))
    long = " ".join(word() for _ in range(400))
    texts = [None, "", "", long, long[:700], long[:701], long + "x", "Z" + long, "same " * 300, "a\x0bb\x1cc d", "ÀÉ" * 10, "#"]
    rows = [(k, texts[k % len(texts)], ["en", None, "", "de"][k % 4]) for k in range(40)]
    rows += [(3, long, "en"), (3, long, "en"), (None, long, "en"), (None, "only here", "fr"), (None, "only here", "fr")]
    rows += [(100 + k, " ".join(word() for _ in range(r.randint(150, 260))), "es") for k in range(30)]
    r.shuffle(rows)
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, [(i, int(q), int(t)) for i, q, t in labels]


def test_audit_equals_brute_force(spark, monkeypatch):
    rows, labels = sample()
    docs = spark.createDataFrame([(i, t, p, 1, "x") for i, t, p in rows], "doc_id long, text string, lang string, mask int, key string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for bucket, trie in ((filter_audit.BUCKET, filter_audit.TRIE), (50, 10)):  # one level of prefixes, and all
        monkeypatch.setattr(filter_audit, "TRIE", trie)
        got = filter_audit.audit(docs, marks, bucket=bucket).collect()
        assert {(r["part"], r["filter_order"], r["step"], *[r[c] for c in COUNTS]) for r in got} == brute(rows, labels)
        assert len(got) == 600 * 5


def test_adaptive_prefixes_part_long_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARE", 1)
    texts = ["p" * 100 + c * 500 for c in "abcd"] * 3 + ["q"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    levels = filter_audit.crowded(docs.select(docs.text.cast("binary").alias("text")), bucket=1000)
    assert [n for n, _ in levels] == [8, 64, 512, 4096] and [len(f) for _, f in levels] == [1, 1, 4, 4]
    got = {r["id"] for r in filter_audit.smallest(docs, "doc_id", "text", bucket=1000).collect()}
    assert got == {0, 1, 2, 3, 12}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_radix_trie():
    r = random.Random(1)
    trie, want = RadixTrie(), {}
    for _ in range(3000):
        t, i = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))), r.choice([None, r.randint(0, 99)])
        trie.insert(t, i)
        known = want.setdefault(t, i)
        want[t] = i if known is None else known if i is None else min(i, known)
    assert list(trie.terminals()) == sorted(want.items())


def test_shared_prefix():
    r = random.Random(2)
    for _ in range(2000):
        a = bytes(r.choice(b"ab") for _ in range(r.randint(0, 5))) * r.randint(1, 30)
        b = a[:r.randint(0, len(a))] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 5)))
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert shared(a, b) == n and shared(a, b, n // 2) == n
