"""op8 leaves whole shard files behind."""

from __future__ import annotations

import hashlib

from emberlake.llm import materialise, queries


def test_op8_writes_its_shards(spark):
    got = queries.op8_token_shards(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == ["first_slot", "n_records", "path", "sha256", "shard"]
    rows = sorted(got.collect())
    assert [r["shard"] for r in rows] == list(range(len(rows))) and rows
    for r in rows:
        data = open(r["path"].removeprefix("file://").removeprefix("file:"), "rb").read()
        assert len(data) == r["n_records"] * 2 * materialise.LENGTH
        assert hashlib.sha256(data).hexdigest() == r["sha256"]
