"""Removal of repeated strings against all windows, and suffix arrays against sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import lyndon, queries, repeats

SCHEMA = "doc_id long, text string"
N = repeats.LENGTH


def plain(docs):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) by counting all windows."""
    raw = [(i, t if isinstance(t, bytes) else (t or "").encode()) for i, t in docs]
    count = Counter(d[k : k + N] for _, d in raw for k in range(len(d) - N + 1))
    out = []
    for i, d in raw:
        gone = bytearray(len(d))
        for k in range(len(d) - N + 1):
            if count[d[k : k + N]] > 1:
                gone[k : k + N] = b"\1" * N
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_arrays_against_sorting():
    rng = random.Random(1)
    for _ in range(200):
        strings = []
        for _ in range(rng.randrange(1, 8)):
            most = rng.choice((1, 2, 3, 5, 200))
            strings.append([rng.randrange(1, most + 1) for _ in range(rng.randrange(60))] + [0])
        starts = np.cumsum([0, *map(len, strings)])[:-1]
        got = lyndon.suffix_array(np.array(sum(strings, [])), starts)
        for s, b in zip(strings, starts.tolist(), strict=True):
            assert (got[b : b + len(s)] - b).tolist() == sorted(range(len(s)), key=lambda k, s=s: s[k:])


def test_groups_are_lyndon_prefixes():
    """After the first phase groups are in the order of the longest Lyndon prefixes, and pointers lead to smaller suffixes."""
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))] + [0]
        n = len(s)
        group, prev = lyndon.grouped(np.array(s), np.array([0]))
        after = [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) for i in range(n)]
        lyn = [s[i : after[i]] for i in range(n)]
        assert [sorted(range(n), key=lambda i: (lyn[i], i))] == [sorted(range(n), key=lambda i: (group[i], i))]
        assert all((group[i] == group[j]) == (lyn[i] == lyn[j]) for i in range(n) for j in range(n))
        assert prev.tolist() == [max((j for j in range(i) if lyn[j] < lyn[i]), default=n) for i in range(n)]


def test_equal_windows_have_one_anchor():
    rng = random.Random(3)
    common = bytes(rng.choices(b"abcd ", k=420))
    for junk in (b"x" * 500, bytes(rng.choices(b"abcd ", k=700))):
        seen: dict[bytes, tuple[int, bytes]] = {}
        for data in (junk + common + junk, common, b"q" + common + bytes(range(256)), b"ab" * 400, b"a" * 900):
            first, more, anchor = repeats.stretches(data, [(0, len(data))])
            covered = [w for a, m in zip(first.tolist(), more.tolist(), strict=True) for w in range(a, a + m + 1)]
            assert covered == list(range(len(data) - N + 1))
            for a, m, p in zip(first.tolist(), more.tolist(), anchor.tolist(), strict=True):
                for w in range(a, a + m + 1):
                    assert 0 <= p - w <= N - repeats.GRAM
                    assert seen.setdefault(data[w : w + N], (p - w, data[p : p + repeats.GRAM])) == (p - w, data[p : p + repeats.GRAM])


def test_windows_of_a_group():
    rng = random.Random(4)
    groups = []
    for _ in range(40):
        base = bytes(rng.choices(b"ab" if rng.random() < 0.3 else bytes(range(256)), k=300))
        groups.append([bytes(rng.choices(b"ab", k=rng.randrange(30))) + base[rng.randrange(60) : 240 + rng.randrange(60)] + bytes(rng.choices(b"c", k=rng.randrange(30))) for _ in range(rng.randrange(1, 6))])
    for group, got in zip(groups, repeats.repeated_windows(groups), strict=True):
        count = Counter(d[k : k + N] for d in group for k in range(len(d) - N + 1))
        assert got == [[k for k in range(len(d) - N + 1) if count[d[k : k + N]] > 1] for d in group]


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghéß") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (35, 45, 60, 120)]
    docs = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, "q" * 1000]
    for _ in range(60):  # a passage with different words around: a key of many stretches
        docs.append(f"{text(rng.randrange(30))} {passages[3]} {text(rng.randrange(30))}")
    for _ in range(25):
        docs.append(" ".join(rng.choice([text(20), *passages[:3]]) for _ in range(3)))
    base = [word() for _ in range(300)]
    for _ in range(12):
        near = list(base)
        for k in rng.sample(range(300), 4):
            near[k] = word()
        docs.append(" ".join(near))
    docs += [text(200)] * 40 + [text(100), "twice " + passages[0] + " in one " + passages[0]]
    rows = list(enumerate(docs))
    return rows + [(None, text(90)), (3, docs[-1]), (3, docs[-1])]


@pytest.mark.parametrize("most", [repeats.MOST, 3])
def test_removal_against_all_windows(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(repeats, "MOST", most)
    rows = corpus(random.Random(5))
    spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("row", F.lit("x")).withColumn("spans", F.lit(2)).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = plain(rows)
    got = repeats.removed(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {s for _, _, r, s, _ in want} >= {0, 1, 2} and any(0 < r < n for _, n, r, _, _ in want)


def test_no_texts_and_bytes_that_are_not_utf8(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/none")
    assert repeats.removed(spark.read.parquet(f"{tmp_path}/none")).count() == 0
    rng = random.Random(6)
    passage = rng.randbytes(260)
    raw = [(1, b"\xff\xfe" + passage + b" a"), (2, passage[30:] + rng.randbytes(300)), (3, rng.randbytes(500))]
    spark.createDataFrame([(i, bytearray(d)) for i, d in raw], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text")).write.parquet(f"{tmp_path}/raw")
    docs = spark.read.parquet(f"{tmp_path}/raw")
    assert sorted((tuple(r) for r in repeats.removed(docs).collect()), key=str) == plain(raw)
    kept = {r["id"]: bytes(r["kept"]) for r in repeats.removed(docs, kept_bytes=True).collect()}
    assert kept[1] == raw[0][1][:32] + b" a" and kept[3] == raw[2][1]


def test_spans_merged_against_plain():
    import pyarrow as pa

    rng = random.Random(8)
    lists = [[(rng.randrange(3000), rng.randrange(N, repeats.SPAN)) for _ in range(rng.choice((0, 1, 2, 5, 20)))] for _ in range(200)]
    lists += [[(0, N), (N, N)], [(2**31 - N - 1, N)], [(0, N + 1), (0, N)], [(N + 1, N), (0, N)]]
    want = []
    for spans in lists:
        gone = sorted({p for a, n in spans for p in (range(a, a + n) if a < 10_000 else ())})
        plain = [(a, b + 1) for a, b in repeats.runs(gone)]
        want.append(plain + [(a, a + n) for a, n in spans if a >= 10_000])
    kind = pa.list_(pa.int64())
    packed = pa.array([[a * repeats.SPAN + n for a, n in spans] for spans in lists], kind)
    whole = pa.record_batch([pa.array(range(len(lists))), packed], names=["row", "spans"])
    batches = [whole.slice(0, 50), whole.slice(50, 1), whole.slice(51), whole.slice(0, 0)]
    got = [(r["row"], [(s["a"], s["b"]) for s in r["spans"]]) for b in repeats.merged(iter(batches)) for r in b.to_pylist()]
    assert got == list(enumerate(want))


def test_a_copy_has_one_span(spark, tmp_path):
    rng = random.Random(9)
    copy = "".join(rng.choices("abcdefgh ", k=5000))
    rows = [(1, copy), (2, copy), (3, copy[:2000] + "#" * 150 + copy[3000:]), (4, "".join(rng.choices("abcdefgh ", k=900)))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/docs")
    found = repeats.spans(spark.read.parquet(f"{tmp_path}/docs")).collect()
    got = sorted(sorted((s["a"], s["b"]) for s in r["spans"]) for r in found)
    assert got == sorted([[(0, 5000)], [(0, 5000)], [(0, 2000), (2150, 4150)]])


def test_long_texts_are_taken_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "TEXT_BLOCK", 1000)
    import pyarrow as pa

    rng = random.Random(7)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (5000, 0, 199, 1000, 1001, 30, 2500)]
    covered = {k: [] for k in range(len(texts))}
    for data, bounds in repeats._pieces(range(len(texts)), pa.array(texts, pa.binary())):
        for row, at, a, b in bounds:
            assert data[a:b] == texts[row][at : at + b - a]
            covered[row] += range(at, at + max(0, b - a - N + 1))
    assert all(covered[k] == list(range(max(0, len(t) - N + 1))) for k, t in enumerate(texts))


def test_query_against_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    want = plain([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    got = queries.QUERIES["op13_suffix_array_dedup"](spark, sf)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == want
