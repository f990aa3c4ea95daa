"""The manifest and its proofs against plain trees."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberlake.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """All levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H("".join(now[k : k + 8])) for k in range(0, len(now), 8)])
    return levels


def plain_proof(levels, k):
    """(before, after) of each level."""
    out = []
    for now in levels[:-1]:
        r = k // 8 * 8
        out.append(("".join(now[r:k]), "".join(now[k + 1 : r + 8])))
        k //= 8
    return out


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(row)
    names = sorted(by, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for n in names:
        by[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[n] = plain_tree([plain_leaf(r) for r in by[n]])
    top = plain_tree([trees[n][-1][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for k, row in enumerate(by[n]):
            path = plain_proof(trees[n], k) + plain_proof(top, i)
            low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            own = plain_leaf((*row[:4], low(row[4])) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else row)
            for a, b in path:
                own = H(a + own + b)
            out.append((row[0], plain_leaf(row), trees[n][-1][0], top[-1][0], H("".join(a + b for a, b in path)), own, own == top[-1][0]))
    return out


def corpus(rng, n):
    langs = ["en"] * 20 + ["de"] * 5 + ["fr", None, "日本", "EN"]
    rows = [(rng.randrange(n), rng.choice(("src0", None, "")), rng.choice(langs), rng.choice((None, 7)), rng.choice((None, "", "Ein Wort", "x", "ÄB y", f"Text {k}"))) for k in range(n)]
    rows += [(None, "s", "en", 1, "T"), (None, None, None, None, None)] + [(5, "src0", "en", 4, "same")] * (n // 3) + [(9, "src0", "xx", 4, "alone")]
    return rows


@pytest.mark.parametrize("n", [1, 60, 900])
def test_manifest_against_plain_trees(spark, n):
    rows = corpus(random.Random(n), n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("a.b", F.lit("x")).repartition(5)
    got = [tuple(r) for r in merkle.tampered_manifest(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_empty_manifest(spark):
    out = merkle.tampered_manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_some_leaves_in_small_partitions(spark):
    """Any leaves can be opened, in partitions that aren't aligned; each fetches the least union once."""
    rows = [(k, "s", ("en", "de", None)[k % 3], k, f"Text {k}") for k in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = merkle.build(docs, [F.col(c) for c in merkle.FIELDS], F.col("lang"))
    want = {r[0]: r for r in plain(rows)}
    opened = made.leaves.filter("id % 5 = 1")
    got = merkle.prove(made, opened, block=37).collect()
    assert len(got) == 140 and all(r["verified"] and (r["leaf"], r["root"], r["proof_sha256"]) == (want[r["id"]][1], want[r["id"]][3], want[r["id"]][4]) for r in got)
    forged = merkle.prove(made, opened.withColumn("changed", F.when(F.col("id") == 6, F.lit("0" * 64))), block=37).collect()
    assert [r["id"] for r in forged if not r["verified"]] == [6]
    assert {r["name"]: r["width"] for r in made.trees.collect()} == {None: 233, "de": 233, "en": 234}


def test_missing_nodes_are_the_least():
    """All that is asked for can't be derived, and with it the root can."""
    rng = random.Random(3)
    for width in (1, 2, 8, 9, 64, 65, 300):
        levels = plain_tree([H(str(k)) for k in range(width)])
        for n in (1, 3, width):
            known = rng.sample(range(width), min(n, width))
            asked = merkle.missing(known, width)
            below = {(level, k // 8**level) for k in known for level in range(len(levels))}
            siblings = {(level, x) for level, k in below if level < len(levels) - 1 for x in range(k // 8 * 8, min(k // 8 * 8 + 8, len(levels[level])))}
            assert sorted(asked) == sorted(siblings - below)
            branch = merkle.Branch({k: levels[0][k] for k in known}, width, {(level, k): levels[level][k] for level, k in asked})
            assert branch.root == levels[-1][0]
            assert all(branch.proof(0, k) == "".join(a + b for a, b in plain_proof(levels, k)) for k in known)


def test_query_has_all_rows(spark):
    out = queries.QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert {r[-1] for r in want} == {True, False}
