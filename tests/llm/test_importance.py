"""Importance resampling against plain n-grams."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import importance, queries

SCHEMA = "doc_id long, text string"


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20):
    """(id, n_words, n_features, weight, score, rank) as the contract words it."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, text in docs:
        n, found = plain_features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_states_are_moved_as_bytes_would():
    rng = random.Random(1)
    texts = [rng.randbytes(n) for n in (0, 1, 5, 63, 64, 65, 130, 1000, 5000)]
    states = np.array([zlib.crc32(t) for t in texts], np.uint32)
    for tail in (b"", b" a", b" " * 63, bytes(64), bytes(range(200)), rng.randbytes(4097)):
        got = importance.moved(states, np.full(len(texts), len(tail))) ^ np.uint32(zlib.crc32(tail))
        assert got.tolist() == [zlib.crc32(t + tail) for t in texts]


@pytest.mark.parametrize("small", [False, True])
def test_features_of_a_stream(monkeypatch, small):
    """Heads of any content, blocks and kept words of any size, words longer than a block: the same buckets."""
    rng = random.Random(2)
    vocabulary = ["a", "bb", "Grüße", "日本", "x" * 70, "naïve", "end"] + [f"w{k}" for k in range(300)]
    texts = ["", None, "one", "two words", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120))) for _ in range(60)), "y" * 3000 + " z"]
    if small:
        monkeypatch.setattr(importance, "BLOCK_WORDS", 7)
        monkeypatch.setattr(importance, "KEPT_WORDS", 20)
        monkeypatch.setattr(importance, "BLOCK_BYTES", 50)
    raw = [None if t is None else t.encode() for t in texts]
    want = Counter((row, zlib.crc32(f.encode()) % 10000) for row, t in enumerate(texts) for f in plain_features(t)[1])
    for head in ([], [w.encode() for w in vocabulary[:40]]):
        pairs = [a * importance.BASE + b for a in range(len(head)) for b in range(0, len(head), 3)]
        n_words: list[int] = []
        got = Counter()
        for buckets, rows in importance.Features(head, pairs).of(raw, n_words):
            got.update(zip(rows.tolist(), buckets.tolist(), strict=True))
        assert got == want and n_words == [plain_features(t)[0] for t in texts]


def corpus(rng):
    words = ["the", "of", "Wort", "ÉTÉ", "x1", "-", "日本", "don't", "_", "A"] + [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 19, 20, 21, 60, 300)))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(None, "null id " * 30), (None, None), (7, "repeated id " * 20)] + [(500, "equal row " * 25)] * 60 + [(501, None), (502, "")]
    return docs, ["the target of w1 w2 w3", "ÉTÉ w5 don't", None, ""]


def test_resampling_against_plain_ngrams(spark, monkeypatch):
    monkeypatch.setattr(importance, "HEAD_WORDS", 40)
    docs, target = corpus(random.Random(3))
    df = spark.createDataFrame(docs, SCHEMA).withColumn("n_words", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(6)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in importance.resample(df, bench, percent=30).collect()), key=str)
    assert got == plain(docs, target, percent=30)
    taken = importance.drawn(df, bench, percent=30)
    assert taken.columns == df.columns
    assert {r["doc_id"] for r in taken.collect()} == {r[0] for r in got if r[5] and r[0] is not None}


def test_no_target_and_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(1, "some words here " * 10), (2, None)], SCHEMA)
    assert importance.resample(none, docs).count() == 0
    got = sorted((tuple(r) for r in importance.resample(docs, none, percent=100).collect()), key=str)
    assert got == plain([(1, "some words here " * 10), (2, None)], [], percent=100)


def test_bytes_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"\xff\xfe words of")), (2, bytearray(b"plain \xc3"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = {r["id"]: r["n_features"] for r in importance.weigh(docs, docs).collect()}
    assert got == {1: 6, 2: 3}


def test_query_against_plain_ngrams(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    want = plain(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])
    out = queries.QUERIES["op12_importance_resampling"](spark, sf)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == want and any(r[5] for r in got)
