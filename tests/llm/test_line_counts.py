"""What counts as recurring in line dedup."""

from __future__ import annotations

import random

from emberlake.llm import templates


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(n))


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: r["n_dropped"] for r in templates.dropped_lines(df).collect()}


def test_lines_of_one_form_in_one_text_stay(spark):
    rng = random.Random(1)
    capitals = [f"The capital of {letters(rng, 1)} is {letters(rng, 1)}" for _ in range(12)]
    body = "\n".join(letters(rng, 12) for _ in range(20))
    others = [letters(rng, 12) + "\nThe capital of " + letters(rng, 1) + " is " + letters(rng, 1) for _ in range(8)]
    alone = dropped(spark, ["\n".join([*capitals, body]), *others])  # 9 texts with the form, 20 lines of it
    assert set(alone.values()) == {0}
    others += [letters(rng, 12) + "\nThe capital of " + letters(rng, 1) + " is " + letters(rng, 1)]
    assert dropped(spark, ["\n".join([*capitals, body]), *others]) == {0: 12, **dict.fromkeys(range(1, 10), 1)}


def test_equal_lines_of_mostly_digits_go(spark):
    rng = random.Random(2)
    texts = []
    for k in range(12):
        lines = [letters(rng, 12), "Page 3 of  10", letters(rng, 12), f"Page {k} of 40", letters(rng, 12), "Tel: 555 1234 Fax: 555 1235", f"{k} {k + 1} total 7 8 9"]
        texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in templates.drop_recurring(df).collect()}
    drop = lambda t: "\n".join(x for x in t.split("\n") if not x.startswith("Tel") and x != "Page 3 of  10")
    assert got == {k: drop(t) for k, t in enumerate(texts)}
