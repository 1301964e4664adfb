"""Quality rules, personal data, language, toxicity and language models."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest

from auditloom.llm import langid, lm, pii, quality, toxicity
from auditloom.llm.common import table
from auditloom.llm.queries import QUERIES
from auditloom.plans.lineage import shared_dir

SF = "/root/testdata/sf0.01"


# ---- quality

def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = {}
    for k in range(len(w) - 2):
        win.setdefault(tuple(w[k:k + 3]), []).append(k)
    rep = {k + j for v in win.values() if len(v) > 1 for k in v for j in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


TEXTS = [None, "", " \t\r\n", "one", "a b", "a b c a b c", "a b a b a b a b", "é ü x\x0by\fz", "#|<>&%$* #", "x\n\nx\n x\nx\r\n",
         "the of and " * 40, ("Zeile und der die das nicht\n" * 9), "wort " * 60000]


def test_base_counts(spark):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice("a b c de fg\n the of # 9 É".split(" ")) for _ in range(r.randint(1, 90))) for _ in range(80)]
    df = spark.createDataFrame([(k, t, "en" if k % 3 else None, 7) for k, t in enumerate(texts)] + [(0, texts[5], "de", 7)], "doc_id long, text string, lang string, n_words int")
    out, n = quality.judge(df)
    got = out.collect()
    assert out.columns[:4] == df.columns and len(got) == len(texts) + 1
    for x in got:
        c = brute_counts(x["text"])
        assert tuple(x[n[k]] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == c
        assert x[n["base_failed"]] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (x[n["kept"]] and x[n["base_failed"]])


def test_divergence_by_hand(spark):
    out, n = quality.judge(table(spark, SF, "documents"))
    rows = [x for x in out.collect()]
    hist = lambda t: np.array([sum(f" {w} " in f" {x} " for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")) for w in quality.COMMON_WORDS], float)
    by = {}
    for x in rows:
        if not x[n["base_failed"]] and x["lang"]:
            by[x["lang"]] = by.get(x["lang"], 0) + hist(x["text"])
    refs = [v / v.sum() for v in by.values()]

    def js(p, q):
        m = (p + q) / 2
        k = lambda a: sum(u * math.log2(u / v) for u, v in zip(a, m) if u > 0)
        return math.sqrt(max(0, (k(p) + k(q)) / 2))

    for x in rows[::25]:
        h = hist(x["text"])
        if h.sum() >= quality.MIN_COMMON:
            assert x[n["word_distance"]] == pytest.approx(min(js(h / h.sum(), q) for q in refs), abs=1e-9)
        else:
            assert x[n["word_distance"]] is None


def test_quality_keeps_good_documents(spark):
    out, n = quality.judge(table(spark, SF, "documents"))
    got = out.join(table(spark, SF, "labels"), "doc_id").where(f"not {n['base_failed']}").groupBy("quality").agg({n["kept"]: "count"}).collect()
    good = out.join(table(spark, SF, "labels"), "doc_id").where(f"not {n['base_failed']} and quality = 1 and not {n['kept']}").count()
    bad = out.join(table(spark, SF, "labels"), "doc_id").where(f"not {n['base_failed']} and quality = 0 and not {n['kept']}").count()
    assert got and good == 0 and bad > 0


def test_quality_of_nothing(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string"))[0].count() == 0


# ---- personal data

def independent(t):
    """The base rules once more, by whole-string scans of the pattern engine."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t):
        if max(map(int, m[0].split("."))) <= 255:
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return [f"{k}:{a}:{b}" for k, a, b in out]


PII_TEXTS = [None, "", "no data", "a@b.c x@y z@q-.w..e", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.4 0000001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112",
             "+49 (30) 1234-5678 +1 2 +12345678901234567", "é😀 4111111111111111 x +1 (528) 555-3435"]


def test_base_spans(spark):
    r = random.Random(4)
    texts = PII_TEXTS + ["".join(r.choice("0123456789.+-@ ()ab") for _ in range(r.randint(1, 120))) for _ in range(200)]
    texts += [x["text"] for x in table(spark, SF, "documents").limit(300).collect()]
    df = spark.createDataFrame([(k, t, "b") for k, t in enumerate(texts)] + [(3, texts[3], "b")], "doc_id long, text string, base string")
    got = pii.spans(df, pii.learn(df), ["doc_id", "text"]).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        assert x["base"] == independent(x["text"] or "")
        assert set(x["base"]) <= set(x["spans"])


def test_labels_spread_to_repeats():
    field = pii.Field().fit(list(pii.situations([f"Call +49 30 {1000000 + k} or mail p{k}@mail.example.com, ip 10.0.0.{k}, order {k * 7}" for k in range(60)]).items()))
    t = "Mail bob.smith@mail.example.com now. Then again bob.smith@mail please. Order 12345. Call +49 (30) 1234-5678, that is 493012345678."
    base, added = pii.find([t], field)[0]
    assert [t[a:b] for _, a, b in base] == ["bob.smith@mail.example.com", "+49 (30) 1234-5678"]
    assert [t[a:b] for _, a, b in added] == ["bob.smith@mail", "493012345678"]


def test_labels_reach_all_repeats():
    field = pii.Field().fit(list(pii.situations([f"Call +49 30 {1000000 + k} or mail p{k}@mail.example.com, ip 10.0.0.{k}, order {k * 7}" for k in range(60)]).items()))
    text = "Mail bob.smith@mail.example.com now." + " Again bob.smith@mail please." * 60 + " Call +49 (30) 1234-5678." + " That is 493012345678 again." * 60
    base, added = pii.find([text], field)[0]
    assert [text[a:b] for _, a, b in base] == ["bob.smith@mail.example.com", "+49 (30) 1234-5678"]
    assert [text[a:b] for _, a, b in added] == ["bob.smith@mail"] * 60 + ["493012345678"] * 60
    # Tokens that are slightly against it, with the potentials at their prior.
    field = pii.Field()
    field.unary[0, 0] = 1.0
    tokens = pii.Tokens(" and ".join(["+4930-1234567"] * 40), [(3, 0, 13)])
    assert (field.marginals([tokens])[0][:, 4] >= pii.SURE).all()


def test_every_text_is_learned_from(spark, monkeypatch):
    """One text in 12 000 has a situation of its own; the rest are of one kind."""
    seen = []
    monkeypatch.setattr(pii.Field, "fit", lambda self, got: seen.extend(got) or self)
    rows = [(f"order {k}",) for k in range(100000, 112000)] + [("Call +49 (30) 1234-5678 or 493012345678",)] + [("same mail a@b.example",)] * 500
    pii.learn(spark.createDataFrame(rows, "text string"))
    want = pii.situations([t for t, in rows])
    assert dict(seen) == want and sum(want.values()) > 12500


def test_mask(spark):
    df = spark.createDataFrame([(1, "to a@b.cd from 1.2.3.4!", 3), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in pii.mask(df, pii.learn(df), size="n_chars").collect()}
    assert got == {1: ("to <EMAIL> from <IP>!", 21), 2: (None, None), 3: ("", 0)}


def test_pii_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.spans(none, pii.learn(none), ["doc_id"]).count() == 0


# ---- language

def test_language_held_out(spark):
    got = QUERIES["op8_hyperdimensional_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) >= 0.97 * len(got) > 200
    assert all(0 <= x["score"] <= 1 for x in got)


def test_language_edge_cases(spark):
    train = spark.createDataFrame([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.fit(train)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the dog"), (5, "die katze"), (6, "the dog " * 50000)], "doc_id long, text string")
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(df, model, ["doc_id"]).collect()}
    assert model[0] == ["de", "en"] and got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "en"}
    assert {x["lang_pred"] for x in langid.identify(df, langid.fit(train.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_binding_keeps_order():
    v, _ = langid.vectors(["abc abc", "cba cba", "abc abc abc"])
    assert v[0] @ v[2] > 0.8 and abs(v[0] @ v[1]) < 0.5


# ---- toxicity

@pytest.fixture(scope="module")
def marked():
    r = random.Random(8)
    word = lambda: "".join(r.choice("lanerotis") for _ in range(r.randint(2, 7)))
    out = []
    for k in range(500):
        w, y = [word() for _ in range(r.randint(20, 200))], int(k % 3 == 0)
        for _ in range(4 * y):
            w.insert(r.randrange(len(w)), r.choice(["zidiox", "qmoruk", "vekpu" + word(), "vekpu" + word()]))
        out.append((" ".join(w), y))
    return out


def test_toxicity_held_out(marked):
    parts = [([w[a:a + toxicity.WINDOW] for a in toxicity.window_starts(len(w))], y) for t, y in marked[:350] for w in [t.encode().split()]]
    net = toxicity.fit(parts)
    got = toxicity.Scorer(net).texts([t.encode() for t, _ in marked[350:]] + [b"", b"!!"])
    y = np.array([y for _, y in marked[350:]])
    assert ((got[:-2] >= 0.5) == y).mean() >= 0.95 and got[-2:].tolist() == [0, 0]


def test_gradients_are_right():
    words = [b"alpha", b"beta", b"gam", b"delta"]
    net = toxicity.Network(words, np.array([1.0, 0, 0, 0]), np.zeros(toxicity.CHAR_SLOTS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocab, index, real = toxicity.pack([[b"alpha", b"gam", b"beta"], [b"delta", b"delta"]])
    feats, y = toxicity.features(vocab, net.known), np.array([1.0, 0.0])

    def loss():
        z = net.run(net.gates(net.inputs(*feats)), index, real)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = net.gradients(feats, index, real, y)
    for q in ("Wf", "Ub", "bf", "a", "u", "c"):
        at = tuple(0 for _ in net.p[q].shape)
        net.p[q][at] += 1e-3
        up = loss()
        net.p[q][at] -= 2e-3
        assert (up - loss()) / 2e-3 == pytest.approx(g[q][at], rel=0.05, abs=2e-4)
        net.p[q][at] += 1e-3


def test_toxicity_query(spark):
    got = QUERIES["op4_bigru_toxicity"](spark, SF).collect()
    assert len(got) == 1000 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    net = toxicity.fit(toxicity.sample(docs, spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")))
    assert [x["score"] for x in toxicity.score(docs, net, ["doc_id"]).collect()] == [0, 0]


# ---- language models

def test_losses_by_hand(spark):
    r = random.Random(3)
    rows = [(k if k else None, " ".join(r.choice(["aa", "bb", "Cc", "x#", "d" * 20]) for _ in range(r.randint(0, 30)))) for k in range(40)] + [(50, None), (3, "aa bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs, spark.createDataFrame([(k,) for k in range(10)] + [(3,), (None,)], "doc_id long"))
    known = model[0]
    assert set(known) == {b"aa", b"bb", b"Cc", b"x#", b"d" * 20}

    def table_of(texts):
        t = np.zeros((lm.VOCABULARY, lm.VOCABULARY))
        for x in texts:
            ids = [known[w.encode()] for w in (x or "").split()]
            for a, b in zip([lm.START, *ids], ids):
                t[a, b] += 1
        return t

    tables = [table_of([t for i, t in rows if i is not None and i < 10]), table_of([t for _, t in rows])]
    for x in lm.score(docs, model, ["doc_id", "text"]).collect():
        ids = [known[w.encode()] for w in (x["text"] or "").split()]
        want = []
        for t in tables:
            p = (t.sum(0) + 1) / (t.sum() + lm.VOCABULARY)
            want.append(-np.mean([math.log((t[a, b] + lm.PRIOR * p[b]) / (t[a].sum() + lm.PRIOR)) for a, b in zip([lm.START, *ids], ids)]) if ids else 0)
        assert (x["target_loss"], x["background_loss"]) == pytest.approx(tuple(want), abs=1e-4)


def test_whole_vocabulary_by_hand(spark):
    """More words than the table has symbols, most of them rare and alike in shape; and texts the models have not seen."""
    r = random.Random(8)
    names = [f"w{k:05d}" for k in range(9000)]
    rows = [(k, " ".join(r.choice(names[:3] if r.random() < 0.4 else names) for _ in range(r.randint(0, 300)))) for k in range(150)] + [(3, "w00001 w08999"), (None, "x y")]
    new = [(900, "w00001 never seen w00002 w00001 w08999 w08998"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs, spark.createDataFrame([(k,) for k in range(40)], "doc_id long"))
    n_words = len({w for _, t in rows for w in t.split()})
    assert n_words > lm.VOCABULARY

    def tables(texts):
        pair, word, given = {}, {}, {}
        for x in texts:
            s = x.split()
            for a, b in zip([None, *s], s):
                for d, k in ((pair, (a, b)), (word, b), (given, a)):
                    d[k] = d.get(k, 0) + 1
        return pair, word, given

    models = [tables([t for i, t in rows if i is not None and i < 40]), tables([t for _, t in rows])]
    got = lm.score(docs, model, ["doc_id", "text"]).collect() + lm.score(spark.createDataFrame(new, "doc_id long, text string"), model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) + len(new)
    for x in got:
        s, want = (x["text"] or "").split(), []
        for pair, word, given in models:
            p = lambda b: (word.get(b, 0) + 1) / (sum(word.values()) + n_words)  # noqa: B023, E731
            want.append(-sum(math.log((pair.get((a, b), 0) + lm.PRIOR * p(b)) / (given.get(a, 0) + lm.PRIOR)) for a, b in zip([None, *s], s)) / max(1, len(s)))
        assert x["n_words"] == len(s)
        assert (x["target_loss"], x["background_loss"]) == pytest.approx(tuple(want), abs=1e-4)


def test_language_model_tells_quality(spark):
    got = QUERIES["op2_cross_entropy_difference"](spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    good, bad = ([x["score"] for x in got if x["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_language_model_writes_no_ngrams(spark):
    """Fitting and scoring leave no table of n-grams, and a frame of its own is scored as the counted one is; ids of another type, or repeated, are marked alike."""
    r = random.Random(5)
    names = [f"w{k:05d}" for k in range(5000)]
    rows = [(k % 400 if k % 7 else None, " ".join(r.choice(names[:5] if r.random() < 0.5 else names) for _ in range(r.randint(0, 40)))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in shared.glob("*")}
    out = []
    for kind in ("long", "int"):
        model = lm.fit(docs, spark.createDataFrame([(k,) for k in range(0, 400, 3)] + [(None,)], f"doc_id {kind}"))
        for df in (docs, docs.select("*")):
            out.append(sorted((str(x["doc_id"]), x["text"], x["n_words"], round(x["target_loss"], 5), round(x["background_loss"], 5)) for x in lm.score(df, model, ["doc_id", "text"]).collect()))
    for other in out[1:]:
        for a, b in zip(out[0], other, strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-4)
    assert {p.name for p in shared.glob("*")} == before


def test_no_target(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    model = lm.fit(docs, docs.select("doc_id").limit(0))
    assert [x["score"] for x in lm.score(docs, model, ["doc_id"]).collect()] == [0, 0]
    assert lm.score(docs.limit(0), lm.fit(docs.limit(0), docs.select("doc_id")), ["doc_id"]).count() == 0


# ---- the pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as c
    from auditloom.plans.lineage import cut

    docs = table(spark, SF, "documents")
    cols, before = docs.columns, {x["doc_id"]: x["text"] for x in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        after = {x["doc_id"]: x["text"] for x in docs.collect()}
        assert docs.columns == cols and set(after) <= set(before)
        if name in ("quality rules", "near-duplicates"):
            assert len(after) < len(before) and all(after[k] == before[k] for k in after)
        if name == "personal data":
            assert set(after) == set(before)
            assert all(not independent(t) for t in after.values())
        before = after
    last = c.STAGES[-1][1](spark, docs, SF).collect()
    assert {x["doc_id"] for x in last} == set(before) and all(x["round_trip"] and x["n_tokens"] == len(x["ids"]) for x in last)
    assert all(x["ids_sha256"] == hashlib.sha256(" ".join(map(str, x["ids"])).encode()).hexdigest() for x in last)


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "word " * 80, "xx", None, 3)] + [(2, " ".join(f"w{k}" for k in range(99)), "en", "s", 1)] * 3,
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in c.STAGES:
            out = stage(spark, out, SF)
        out.collect()


# ---- long runs, many short texts

def test_patterns_are_those_of_the_contract():
    email, token = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[A-Za-z0-9._%+@-]*[0-9@][A-Za-z0-9._%+@-]*")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("a@.1-% +é") for _ in range(r.randint(0, 30)))
        assert pii.emails(t) == [m.span() for m in email.finditer(t)]
        assert [m.span() for m in pii.TOKEN.finditer(t)] == [m.span() for m in token.finditer(t)]
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in ip.finditer(t)]


@pytest.mark.parametrize("text", ["a" * 5_000_000 + " @", "1" * 5_000_000, "a@" * 500_000, "1." * 500_000, "x" * 100 + "@" + "a-" * 1_000_000])
def test_long_runs_take_linear_time(text):
    start = time.time()
    pii.base_spans(text)
    sum(1 for _ in pii.TOKEN.finditer(text))
    assert time.time() - start < 20


def plain_vector(text):
    """Letter by letter: a gap at both ends, gaps are one."""
    of = langid.letters()
    out = np.zeros(langid.DIM)
    run = [0]
    for c in text.lower() + " ":
        p = ord(c) if of[ord(c)] else 0
        if p or run[-1]:
            run.append(p)
    v = {p: langid.letter_vectors(np.array([p]))[0].astype(int) for p in set(run)}
    for a, b, c in zip(run, run[1:], run[2:]):
        if b:
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    n = np.linalg.norm(out)
    return out / n if n else out


def test_language_vectors_equal_a_plain_loop(monkeypatch):
    texts = ["", "a", "Hello, World", "  x  y ", "été à l'ÎLE", "привет мир", "你好世界", "γειά σου Κόσμε", "12 34", "مرحبا", "a" * 50]
    for cells, runs in ((langid.CELLS, langid.RUNS), (8, 3)):
        monkeypatch.setattr(langid, "CELLS", cells)
        monkeypatch.setattr(langid, "RUNS", runs)
        got, some = langid.vectors(texts)
        assert np.allclose(got, [plain_vector(t) for t in texts], atol=1e-5)
        assert list(some) == [any(langid.letters()[ord(c)] for c in t.lower()) for t in texts]
    points = np.array([ord("a"), ord("ж"), ord("你"), ord("ä"), 0])
    v = langid.letter_vectors(points).astype(int)
    assert (np.abs(v @ v.T - np.eye(5) * langid.DIM) < 200).all()


def test_many_short_texts_of_a_large_script_stay_small():
    r = random.Random(5)
    texts = ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(50)) for _ in range(10_000)]
    tracemalloc.start()
    v, some = langid.vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert v.shape == (10_000, langid.DIM) and some.all() and peak < 1e9
