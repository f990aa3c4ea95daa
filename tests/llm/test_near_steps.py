"""What keeps near-dedup's cost in proportion to its texts: each sketched once, no text shuffled, no key dealt in vain."""

from __future__ import annotations

import random

import pytest
from test_nearcopies import changed, kept_and_wanted, words_of

from emberlake.llm import nearcopies


@pytest.fixture
def tables(monkeypatch):
    """The number of rows of each table that is written, by its tag."""
    found, real = {}, nearcopies.written

    def counted(df, tag, **options):
        out = real(df, tag, **options)
        found.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "written", counted)
    return found


def test_a_text_is_sketched_once_however_often_it_comes(spark, tables):
    df = spark.createDataFrame([(k, f"text {k % 7} of a few words more") for k in range(70)] + [(70, None), (71, "")], "doc_id long, text string").repartition(3)
    assert nearcopies.keep_one(df).count() == 8
    assert tables["sketches"] == [8]


@pytest.mark.parametrize("most", [4096, 0])
def test_texts_are_picked_out_where_they_are(spark, monkeypatch, most):
    """By bitmaps, whatever Spark's own limit for a broadcast; without them the same rows come by a shuffle."""
    monkeypatch.setattr(nearcopies, "BITMAPS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(k, "a b c d e f g" if k % 2 else f"other text {k}", -k) for k in range(60)], "doc_id long, text string, `a.b` long").repartition(5)
        got = nearcopies.keep_one(df)
        assert sorted(tuple(r) for r in got.collect()) == sorted([(k, f"other text {k}", -k) for k in range(0, 60, 2)] + [(1, "a b c d e f g", -1)])
        assert got.columns == df.columns
        assert ("Exchange hashpartitioning" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_of_alike_texts_are_not_dealt_again_and_again(spark, tables, monkeypatch):
    """Many texts at 0.74 of each other and some at 0.8: more hashes don't part them, so their pairs are compared in blocks."""
    rng = random.Random(13)
    for name, bound in {"ALL_PAIRS": 2, "FIRST_PAIRS": 2, "PAIRS_A_TEXT": 0, "BLOCK_MEMBERS": 16}.items():
        monkeypatch.setattr(nearcopies, name, bound, raising=False)
    base = words_of(rng, 400)
    texts = [changed(rng, base, 6) for _ in range(100)]
    texts += [changed(rng, t, 3) for t in texts[:30]]
    kept, want = kept_and_wanted(spark, texts)
    assert kept == want and len(want) < 101
    assert len(tables["members"]) <= 2
