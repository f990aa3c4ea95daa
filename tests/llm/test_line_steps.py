"""What keeps line dedup cheap: lines become rows first, and plain lines are read once and left as they are."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from emberlake.llm import templates


def test_lines_become_rows_before_they_are_masked(spark, monkeypatch):
    """Before, both readings of the texts worked on arrays of lines, which Spark doesn't compile, and counted words twice a line."""
    plans = {}

    def noted(df, tag, **options):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return made(df, tag, **options)

    made = templates.written
    monkeypatch.setattr(templates, "written", noted)
    docs = spark.createDataFrame([(k, f"one two three {w} five\nother") for k, w in enumerate("abcdefghijkl")], "doc_id long, text string")
    assert {r["n_dropped"] for r in templates.dropped_lines(docs).collect()} == {2}
    for tag in ("line-keys", "named"):
        assert "posexplode(split(" in plans[tag] and "transform(split(" not in plans[tag]
        assert plans[tag].count("octet_length(replace(") == 1


def test_masked_lines_are_those_of_plain_words(spark):
    rng = random.Random(9)
    parts = ["a", "bc", "é", "\U0001f600", "<*>", "<", "x7", "0", "٣", "９", " ", " ", "  ", "\t", "\x0b", "\f", "\r", "\xa0", "\x85", " ", "\x00", "-"]
    texts = ["\n".join("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(20)) for _ in range(60)] + ["", " ", "a  b", " a", "a ", "a\tb", "a b"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")

    def masked(line):
        return " ".join("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))

    want = sorted((k, line, masked(line)) for t in texts for k, line in enumerate(t.split("\n")) if masked(line))
    rows = templates.masked_lines(docs, "text").select("*", templates.masked(F.col("line")).alias("whole"), templates.n_tokens(F.col("x")).alias("n")).collect()
    assert sorted((r["line_no"], r["line"], r["x"]) for r in rows) == want
    assert all(r["x"] == r["whole"] and r["n"] == len(r["x"].split(" ")) for r in rows)
    assert all(r["odd"] for r in rows if r["x"] != r["line"] or "<*>" in r["x"])
