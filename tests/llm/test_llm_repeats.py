"""Repeated passages and suffix sorting against brute force."""

import random
from collections import Counter

import pytest

from auditloom.llm import repeats
from auditloom.llm.suffixes import BlindTrie, deep_shallow, meetings


def strings(r, n, letters=b"ab"):
    base = bytes(r.choice(letters) for _ in range(200))
    return [base[:r.randint(0, 200)] + bytes(r.choice(letters) for _ in range(r.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("shallow", [0, 8, 64, 1000])
def test_deep_shallow_sorts(shallow):
    r = random.Random(shallow)
    s = strings(r, 800) + strings(r, 100, b"\x00\x01") + [b""] * 3
    got = deep_shallow(s, shallow)
    assert sorted(got) == list(range(len(s))) and [s[i] for i in got] == sorted(s)


def test_blind_trie_below_a_common_prefix():
    r = random.Random(9)
    s = [b"x" * 30 + t for t in strings(r, 300)]
    trie = BlindTrie(s, 30)
    for i in range(len(s)):
        trie.insert(i)
    assert [s[i] for i in trie.sorted()] == sorted(s)


def test_meetings_equal_all_pairs():
    r = random.Random(11)
    for _ in range(60):
        pair = {(bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))), b"gg" + bytes(r.choice(b"ab") for _ in range(r.randint(0, 6)))) for _ in range(25)}
        left, right = (list(x) for x in zip(*pair))
        same = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        want = [{k for j in range(len(left)) if j != i for k in range(8 - same(right[i], right[j]), same(left[i], left[j]) + 1)} for i in range(len(left))]
        assert [{k for a, z in f for k in range(a, z + 1)} for f in meetings(left, right, 8, 2)] == want


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[i:i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        hit = [False] * len(t)
        for i in range(len(t) - window + 1):
            if n[t[i:i + window]] > 1:
                hit[i:i + window] = [True] * window
        out.append((len(t), sum(hit), sum(b and not a for a, b in zip([False, *hit], hit)), bytes(c for c, h in zip(t, hit) if not h)))
    return out


def passages(seed, n=60):
    r = random.Random(seed)
    line = lambda k: "".join(r.choice("abcdeé ") for _ in range(k))
    shared = [line(r.randint(15, 90)) for _ in range(8)]
    texts = [None, "", "a", "a" * 19, "a" * 20, "ab" * 200, "abc" * 30, "z" * 100, shared[0], shared[0], shared[0][:25]]
    for _ in range(n):
        t = line(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, len(t))
            cut = r.choice([0, 0, 1, 7])
            t = t[:a] + p[cut:len(p) - r.choice([0, 0, 1, 5])] + t[a:]
        texts.append(t)
    return texts + texts[-5:] + [texts[-1] + "x", "y" + texts[-2]]


@pytest.mark.parametrize("gram,hot,block,held", [(4, 4096, repeats.BLOCK, repeats.SORTED), (8, 2, 64, 100), (16, 1, 200, 1 << 22)])
def test_without_repeats_equals_brute_force(spark, monkeypatch, gram, hot, block, held):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "SORTED", held)
    texts = passages(gram)
    docs = spark.createDataFrame([(k if k % 7 else None, k, t) for k, t in enumerate(texts)], "doc_id long, key long, text string").repartition(3)
    out, n = repeats.without_repeats(docs, ["key", "doc_id"], window=20, gram=gram, hot=hot)
    got = {r["key"]: (r[n["n_bytes"]], r[n["n_removed"]], r[n["n_spans"]], bytes(r[n["kept"]])) for r in out.collect()}
    assert out.count() == len(texts)
    assert [got[k] for k in range(len(texts))] == brute(texts, 20)


def test_real_sizes_and_empty_table(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(120))
    texts = [" ".join(word() for _ in range(60)) + passage[r.randint(0, 60):len(passage) - r.randint(0, 60)] + " ".join(word() for _ in range(300)) for _ in range(8)]
    texts += [passage[:400], passage[:399] + "#", "same line\n" * 100, None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out, n = repeats.without_repeats(docs, ["doc_id"])
    got = {r["doc_id"]: (r[n["n_bytes"]], r[n["n_removed"]], r[n["n_spans"]], bytes(r[n["kept"]])) for r in out.collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 400)
    empty, _ = repeats.without_repeats(docs.limit(0), ["doc_id"], digest=True)
    assert empty.count() == 0
