"""Byte-level BPE and token counts against the public libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditloom.llm import bpe, pretokens, token_counts

RANKS, MERGES = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
EDGE = [None, "", " ", "\n\n", "don't 'tis we'll I've 're", "a  b   c\n\n d", "x" * 5000, "日本語 テキスト ١٢٣", "😀😀 é\u00a0\u2003z", "<|endoftext|> a<|endoftext|>", "''s 's's", "\r\n\t "]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    letters = list("abrestvldm''  \n\t1 2!?é 中'😀==--")
    return EDGE + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(150)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def frame(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[4], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing column


def test_transition_functions_are_few_and_associative():
    then, values, _, n, _ = pretokens._tables()
    t = then.reshape(n, n)
    for f in range(n):
        for g in range(n):
            assert (values[t[f, g]] == values[g][values[f]]).all()


def test_encode_as_the_library(frame, reference):
    got = bpe.encode(frame, RANKS, ["doc_id", "text"]).collect()
    assert len(got) == frame.count()
    for r in got:
        t = r["text"] or ""
        assert r["ids"] == reference.encode_ordinary(t)
        assert (r["ends"][-1] if r["ids"] else 0) == len(t.encode())


def test_decode_gives_the_bytes_back(frame, reference):
    ids = bpe.encode(frame, RANKS, ["doc_id", "text"])
    for r in bpe.decode(ids, RANKS, ["text", "ids"]).withColumn("digest", bpe.ids_digest()).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["digest"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
    assert bytes(bpe.decode(ids.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), RANKS, ["doc_id"]).first()["decoded"]) == b""


def test_counts_at_every_prefix(frame):
    lib = Tokenizer.from_file(MERGES)
    number = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    for r in token_counts.count_tokens(frame, MERGES, ["text"], budget=5, prefixes=True).collect():
        t = r["text"] or ""
        if len(t) < 200:
            assert r["prefix_tokens"] == [number(t[:k]) for k in range(len(t) + 1)], t
        assert r["n_bytes"] == len(t.encode()) and r["n_tokens"] == number(t)
        assert r["fitting_chars"] == max(k for k, n in enumerate(r["prefix_tokens"]) if n <= 5)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, RANKS, ["doc_id"]).count() == 0
    assert token_counts.count_tokens(none, MERGES, ["doc_id"]).count() == 0
