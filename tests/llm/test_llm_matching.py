"""Near-duplicates, contamination and URL rules against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from auditloom.llm import contamination, neardup, urls
from auditloom.llm.queries import URL_RULES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def sentence(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(n))


# ---- contamination

@pytest.fixture(scope="module")
def passages():
    r = random.Random(5)
    return [(1, sentence(r, 40)), (2, "Short item here"), (3, None), (4, ""), (5, sentence(r, 13)), (1, sentence(r, 20)), (None, sentence(r, 15))]


@pytest.fixture(scope="module")
def polluted(passages):
    r = random.Random(6)
    out = [(0, None), (1, ""), (2, "!!! ..."), (3, "SHORT item, here!"), (4, "short item there")]
    for k in range(60):
        t = sentence(r, r.randint(1, 120)).split()
        if k % 2:
            w = (passages[r.choice([0, 4, 5, 6])][1]).split()
            a = r.randint(0, max(0, len(w) - 12))
            t[r.randint(0, len(t)):0] = [x.upper() for x in w[a:a + r.randint(10, 16)]] * r.randint(1, 3)
        out.append((5 + k, ", ".join(t)))
    return out + [(5, out[6][1]), (None, out[8][1])]


def expected(text, items):
    w = words(text)
    hit, found = set(), set()
    for name, t in items:
        q = words(t)
        for k in range(max(1, len(q) - 12) if q else 0):
            x = q[k:k + 13]
            for a in range(len(w) - len(x) + 1):
                if w[a:a + len(x)] == x:
                    hit.update(range(a, a + len(x)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), sorted(found)


def test_fm_index_finds_all(spark, passages, polluted, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x") for i, t in polluted], "doc_id long, text string, items string")
    bench = spark.createDataFrame(passages, "item_id long, text string")
    for size in (contamination.BLOCK_CHARS, 60):  # one block of phrases, and many
        monkeypatch.setattr(contamination, "BLOCK_CHARS", size)
        out, (n, h, i) = contamination.scan(docs, bench, ["doc_id", "text"])
        got = out.withColumn("hit", contamination.n_hit(h)).collect()
        assert len(got) == len(polluted)
        for r in got:
            assert (r[n], r["hit"], r[i]) == expected(r["text"], passages)


def test_suffix_array_and_locate():
    r = np.random.default_rng(1)
    text = r.integers(0, 4, 400)
    text[-1] = 0
    index = contamination.FmIndex(text, 4)
    rows = r.integers(1, 4, (50, 5))
    lo, hi = index.search(rows, np.full(50, 5))
    for q, a, b in zip(rows, lo, hi):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(396) if (text[k:k + 5] == q).all()]


def test_decontaminate_cuts_and_drops(spark, passages, polluted):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in polluted], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(passages, "item_id long, text string")
    got = contamination.decontaminate(docs, bench, size="n_chars").collect()
    keep = [t for _, t in polluted if not (lambda n, h: h and 20 * h >= n)(*expected(t, passages)[:2])]
    assert len(got) == len(keep)
    assert all(expected(r["text"], [p for p in passages if len(words(p[1])) >= 13])[1] == 0 for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    out, (_, h, _i) = contamination.scan(docs, none, ["doc_id"])
    assert out.first()[h] == []
    assert contamination.scan(docs.limit(0), none, ["doc_id"])[0].count() == 0


# ---- near-duplicates

def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    s = [shingle_set(t) for _, t in rows]
    of = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
            of = [of[a] if x == of[b] else x for x in of]
    return of


@pytest.fixture(scope="module")
def copies():
    r = random.Random(9)
    rows = []
    for _ in range(12):
        base = sentence(r, r.randint(60, 200)).split()
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "changed" + str(r.random())
            rows.append(" ".join(w))
    rows += [rows[0]] * 5 + [rows[3].upper(), rows[3].replace(" ", "\n"), None, "", " \n", "one", "one", "one two", "same " * 300]
    return list(enumerate(rows)) + [(0, rows[0]), (None, rows[0]), (None, "alone with no id")]


def test_classes(spark, copies):
    df = spark.createDataFrame([(i, t, "k") for i, t in copies], "doc_id long, text string, key string")
    out, cls = neardup.with_class(df, ["doc_id", "text"])
    got = out.collect()
    assert len(got) == len(copies)
    of = brute_classes(copies)
    least = {c: min((i for (i, _), o in zip(copies, of) if o == c and i is not None), default=None) for c in of}
    want = {(i, t): least[o] for (i, t), o in zip(copies, of)}
    for r in got:
        t = r["text"]
        assert r[cls] == (want[r["doc_id"], t] if t and t.strip() else r["doc_id"])


def test_keep_one(spark, copies):
    df = spark.createDataFrame([(i, t, "k") for i, t in copies], "doc_id long, text string, key string")
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    blank = [x for x in copies if not (x[1] or "").strip()]
    of = [o for o, (_, t) in zip(brute_classes(copies), copies) if (t or "").strip()]
    assert len(rows) == len(set(of)) + len(blank)


def test_copies_with_unequal_line_counts(spark):
    """One line of a copy comes 500 times: the sets of shingles stay alike, their weights do not."""
    r = random.Random(12)
    rows = []
    for _ in range(20):
        w = [f"w{r.randrange(10**9)}" for _ in range(104)]
        rows += [" ".join(w), " ".join(w[:40] + w[40:64] * 500 + w[64:]), " ".join(w[:40] + w[40:64] * 90 + w[64:] + ["more", "words"])]
    copies = list(enumerate(rows))
    of = brute_classes(copies)
    assert len(set(of)) == 20
    out, cls = neardup.with_class(spark.createDataFrame(copies, "doc_id long, text string"), ["doc_id"])
    assert {x["doc_id"]: x[cls] for x in out.collect()} == {i: of.index(of[i]) for i, _ in copies}


def test_register_agreement_estimates_similarity():
    r = random.Random(2)
    a = sentence(r, 900).split()
    b = [w if r.random() > 0.02 else "zz" for w in a]
    h, doc, n = neardup.shingles([" ".join(a).encode(), " ".join(b).encode()])
    reg = neardup.registers(h, doc, n, 2)
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert abs((reg[0] == reg[1]).mean() - len(x & y) / len(x | y)) < 0.15


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.with_class(none, ["doc_id"])[0].count() == 0
    assert neardup.keep_one(none).count() == 0


# ---- urls

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "http://com/en/", "https://xcom/en/", "http://b.net/de/1", "http://example.net/de/81#x",
        "http://www.example.net?x=/de/8", "ftp://org/es/a://b", "http://a.org/es", "http://free.host/x", "http://linker.host/x"]


def test_rules(spark):
    html = '<a href="http://a.org/es/1">x</a> <img src=//B.net/pic>'
    df = spark.createDataFrame([(k, u, html if k % 2 else None, "v") for k, u in enumerate(URLS)] + [(4, URLS[4], html, None)], "page_id long, url string, html string, verdict string")
    out, n = urls.judge(df, URL_RULES, ["page_id", "url"])
    got = out.collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        u = r["url"] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r[n["host"]], r[n["path"]]) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (r[n["rule"]], r[n["verdict"]]) == max(fits)[1:]
        else:
            assert r[n["rule"]] is None and r[n["verdict"]] in ("allow", "block")


def test_ranks_against_matrix(spark):
    edges = [("a.x", "b.x", 2), ("b.x", "c.x", 1), ("c.x", "a.x", 1), ("a.x", "c.x", 1), ("d.x", "c.x", 3)]
    seeds = [("trust", "a.x", 1.0), ("distrust", "c.x", 1.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(
        spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "kind string, node string, mass double")).collect()}
    names = ["a.x", "b.x", "c.x", "d.x"]
    for kind, seed in ((0, 0), (1, 2)):
        m = np.zeros((4, 4))
        for s, d, k in edges:
            s, d = names.index(s), names.index(d)
            m[(s, d) if kind == 0 else (d, s)] += k
        m /= np.maximum(m.sum(1, keepdims=True), 1e-9)
        start = np.eye(4)[seed]
        v = start
        for _ in range(urls.ROUNDS):
            v = (1 - urls.RESTART) * v @ m + urls.RESTART * start
        for k, x in enumerate(names):
            assert got.get(x, (0, 0))[kind] == pytest.approx(v[k], abs=1e-9)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(none, URL_RULES, ["page_id"])[0].count() == 0
