from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlake.llm import materialise, mixing, sharding

LEVELS = {"lang": F.col, "source": F.col}


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(("en", "en", "en", "de", None))
        rows.append((k, " ".join("w" for _ in range(rng.randrange(0, 40))), lang, rng.choice(("hot", "hot", "hot", "a", "b")), 0))
    rows += [(7, "w w w", "en", "hot", 0), (None, "w w", "en", "a", 0), (9001, None, "de", "a", 0), (9002, "w " * 5000, "de", "b", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"leaf": F.lit(1), "key": F.lit("k"), "room": F.lit(0), "n": F.lit(0)})


def plain_mix(rows, weights, share, max_epochs, seed):
    """How often each row is taken, by sorting every leaf; of equal rows as many as fit."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    leaves = defaultdict(list)
    for r in rows:
        leaves[(r[2] or "(none)", r[3])].append((r[0], r[1] or ""))
    totals = {k: float(sum(len(t.split()) for _, t in v)) for k, v in leaves.items()}
    budgets = mixing.leaf_budgets(totals, weights, sum(totals.values()) * share, max_epochs)
    out = Counter()
    for leaf, members in leaves.items():
        whole = int(budgets[leaf] / totals[leaf] + 1e-6) if totals[leaf] else 0
        room = int(budgets[leaf] - whole * totals[leaf] + 1e-6)
        key = lambda i, t: int(md5(f"{seed}/{whole}/" + md5(f"{'(none)' if i is None else i}/{md5(t)}"))[:15], 16)  # noqa: E731, B023
        used, open_ = 0, room > 0
        for i, t in sorted(members, key=lambda m: key(*m)):
            used += len(t.split())
            open_ = open_ and used <= room
            out[(i, len(t.split()), leaf)] += whole + open_
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1.0), (0.9, 2.0), (2.5, 4.0), (1.0, 1.0)])
def test_mix_against_sorted_leaves(spark, share, epochs):
    rows, df = corpus(spark)
    weights = [{"en": 0.3, "de": 0.6, "(none)": 0.1}, {"hot": 0.2, "a": 0.5, "b": 0.3}]
    taken = mixing.choose(df, levels(), weights, share=share, max_epochs=epochs, seed=7).collect()
    got = Counter()
    for r in taken:
        got[(r["doc_id"], r["__tokens"], tuple(r["__leaf"]))] += r["__epochs"]
    assert dict(got) == plain_mix(rows, weights, share, epochs, 7)
    mixed = mixing.mix(df, levels(), weights, share=share, max_epochs=epochs, seed=7)
    assert mixed.columns == df.columns and mixed.count() == sum(got.values())


def test_mix_of_an_empty_table(spark):
    _, df = corpus(spark, 5)
    assert mixing.choose(df.limit(0), levels(), [{}, {}], share=1.0).count() == 0
    with pytest.raises(ValueError):
        mixing.choose(df, levels(), [{}, {}])


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = {("en", "a"): 10.0, ("en", "b"): 100.0, ("de", "a"): 100.0, ("de", "b"): 100.0}
    got = mixing.leaf_budgets(leaves, [{}, {}], 100, 1)
    assert got == {("en", "a"): 10.0, ("en", "b"): 40.0, ("de", "a"): 25.0, ("de", "b"): 25.0}  # en keeps its half
    got = mixing.leaf_budgets({**leaves, ("en", "b"): 15.0}, [{}, {}], 100, 1)
    assert got == {("en", "a"): 10.0, ("en", "b"): 15.0, ("de", "a"): 37.5, ("de", "b"): 37.5}


def test_rows_without_an_id_fill_the_budget(spark):
    one = [(None, "w " * (1 + k % 7), "en", "a", 0) for k in range(1000)]
    same = [(None, "w w w", "de", "a", 0)] * 900 + [(5, "x y", "de", "a", 0)] * 100
    df = spark.createDataFrame(one + same, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    taken = mixing.choose(df, levels(), [{}, {}], share=0.5)
    got = {r["lang"]: (r["n"], r["tokens"]) for r in taken.groupBy("lang").agg(F.count("*").alias("n"), F.sum("__tokens").alias("tokens")).collect()}
    want = plain_mix(one + same, [{}, {}], 0.5, 1.0, 7)
    assert {k: v[0] for k, v in got.items()} == {lang: sum(n for (_, _, leaf), n in want.items() if leaf[0] == lang) for lang in ("en", "de")}
    assert 400 < got["en"][0] < 600 and got["de"][1] > 0.45 * 2900
    assert taken.columns == [*df.columns, "__leaf", "__tokens", "__epochs"]


def test_budgets_of_many_leaves(spark):
    """Sources as fine as host names: budgets are joins, nothing is capped."""
    leaves = spark.range(40_000).select(F.array(F.concat(F.lit("d"), (F.col("id") % 3).cast("string")), F.col("id").cast("string")).alias("leaf"), (F.col("id") % 97).alias("n"))
    weights = [{"d0": 0.7, "d1": 0.3, "d2": 0.0}, {"7": 50.0, "1": 0.5}]
    got = {tuple(r["leaf"]): r["given"] for r in mixing.budgets(leaves, weights, 600_000.0, 1.0).collect()}
    want = mixing.leaf_budgets({tuple(r["leaf"]): float(r["n"]) for r in leaves.collect()}, weights, 600_000.0, 1.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_budgets_refuse_weights_out_of_bounds(spark):
    leaves = spark.createDataFrame([(["a"], 1)], "leaf array<string>, n long")
    for w in (-1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            mixing.budgets(leaves, [{"a": w}], 1.0, 1.0)


@pytest.mark.parametrize("budget", [10.0, 250.0])
def test_weights_of_any_size(spark, budget):
    """The heaviest is filled first, and what it lacks goes to the next, however light."""
    leaves = spark.createDataFrame([(["a"], 100), (["b"], 100), (["c"], 100), (["d"], 100)], "leaf array<string>, n long")
    weights = [{"a": 1e300, "b": 1e-300, "c": 1e-12, "d": 0.0}]
    got = {r["leaf"][0]: r["given"] for r in mixing.budgets(leaves, weights, budget, 1.0).collect()}
    want = {"a": 10.0, "b": 0.0, "c": 0.0, "d": 0.0} if budget == 10.0 else {"a": 100.0, "b": 50.0, "c": 100.0, "d": 0.0}
    assert got == pytest.approx(want)
    many = spark.createDataFrame([([str(k)], 10) for k in range(50)], "leaf array<string>, n long")
    even = mixing.budgets(many, [{str(k): 1.7e308 for k in range(50)}], 100.0, 1.0).collect()
    assert all(r["given"] == pytest.approx(2.0) for r in even)


@example([(1.0, 1.5), (5e-324, 1.0)], 2.0)
@given(st.lists(st.tuples(st.floats(0, 5), st.floats(0, 100)), max_size=8), st.floats(0, 500))
def test_split_budget(children, budget):
    given_ = mixing.split_budget(budget, children)
    assert all(-1e-9 <= g <= c + 1e-6 for g, (_, c) in zip(given_, children, strict=True))
    room = sum(c for w, c in children if w > 0)
    assert sum(given_) == pytest.approx(min(budget, room), rel=1e-6, abs=1e-6)


def test_lookup_table():
    names = [f"s{k}" for k in range(10)]
    table = sharding.lookup_table(names, 2039)
    counts = Counter(table)
    assert sorted(counts) == list(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 2039)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.2 * 2039
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_assign(spark):
    df = spark.createDataFrame([(k, "x") for k in range(2000)] + [(None, "y"), (5, "again")], "doc_id long, shard string")
    placed = sharding.assign(df)
    table = sharding.lookup_table(sharding.SHARDS)
    slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % sharding.TABLE_SIZE
    got = placed.collect()
    assert len(got) == 2002
    assert all(r["slot"] == slot(r["doc_id"]) and r["shard"] == table[r["slot"]] for r in got)
    assert sharding.shares(placed).agg(F.sum("n_rows")).first()[0] == 2002
    assert sharding.assign(df.limit(0)).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_permutation_is_a_bijection(n, key):
    assert sorted(materialise.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def plain_slot(number, n, key):
    """The Feistel network in whole numbers, walked back into range."""
    half, mask = max(1, ((n - 1).bit_length() + 1) // 2), (1 << 64) - 1
    keys = [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") for r in range(materialise.ROUNDS)]
    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for k in keys:
            x = (right ^ k) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 31) * 0x94D049BB133111EB & mask
            left, right = right, left ^ (x ^ x >> 29) & ((1 << half) - 1)
        number = left << half | right
        if number < n:
            return number


@pytest.fixture(scope="module")
def token_files(spark, tmp_path_factory):
    """Documents in several files of many small row groups."""
    rng = random.Random(2)
    words = ("alpha", "beta", "Grüße", "日本")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) for _ in range(300)] + [None, "", "x " * 4000, "same", "same"]
    df = spark.createDataFrame([(None if k % 50 == 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"record": F.lit(1), "file": F.lit(2), "ids": F.lit(3)})
    path = str(tmp_path_factory.mktemp("tokens"))
    df.repartition(3).write.option("parquet.block.size", 4096).option("parquet.page.row.count.limit", 10).mode("overwrite").parquet(path)
    return path


def plain_stream(texts):
    encode = materialise.tokenizer(materialise.VOCABULARY).encode_ordinary
    return [t for text in texts for t in [*encode(text or ""), materialise.END]]


def plain_records(ids, length):
    ids = ids + [materialise.END] * (-len(ids) % length)
    return [ids[k : k + length] for k in range(0, len(ids), length)]


LENGTH, PER_SHARD = 64, 50


def shards(docs, folder, **how):
    made = materialise.token_stream(docs, portion=100, **how)
    return materialise.write_shards(materialise.training_order(made, LENGTH, PER_SHARD), folder, LENGTH, PER_SHARD).orderBy("shard").collect()


def test_token_shards_hold_the_permuted_stream(spark, tmp_path, token_files):
    docs = spark.read.parquet(token_files)
    in_order = docs.select("text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    records = plain_records(plain_stream([r["text"] for r in in_order]), LENGTH)
    want = [None] * len(records)
    for k, record in enumerate(records):
        want[plain_slot(k, len(records), materialise.KEY)] = record
    folder = f"file://{tmp_path}/shards"
    files = shards(docs, folder)
    assert [f["shard"] for f in files] == list(range(-(-len(records) // PER_SHARD)))
    assert all(f["first_slot"] == f["shard"] * PER_SHARD for f in files) and sum(f["n_records"] for f in files) == len(records)
    for f in files:
        assert hashlib.sha256(open(f["path"].removeprefix("file://"), "rb").read()).hexdigest() == f["sha256"]
    assert materialise.read_records(folder, 0, len(records) + 5, LENGTH, PER_SHARD) == want
    assert materialise.read_records(folder, 45, 20, LENGTH, PER_SHARD) == want[45:65]  # resumed, across two shards


def test_token_shards_do_not_depend_on_the_split(spark, tmp_path, token_files):
    seen = set()
    for k, (size, n) in enumerate((("128m", "4"), ("20k", "3"), ("6k", "7"))):
        old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")}
        try:
            for c, v in zip(old, (size, "0", n), strict=True):
                spark.conf.set(c, v)
            docs = spark.read.parquet(token_files)
            by_file, by_id = (tuple((f["shard"], f["sha256"]) for f in shards(docs, f"file://{tmp_path}/{k}-{name}", order_by=order)) for name, order in (("file", None), ("id", ["doc_id"])))
            seen.add((by_file, by_id))
        finally:
            for c, v in old.items():
                spark.conf.set(c, v)
    assert len(seen) == 1
    everything = [(r["doc_id"], r["text"]) for r in docs.collect()]
    md5 = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    ordered = sorted(everything, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, md5(r[1])))
    n = len(plain_records(plain_stream([t for _, t in ordered]), LENGTH))
    first = plain_records(plain_stream([t for _, t in ordered]), LENGTH)[0]
    assert materialise.read_records(f"file://{tmp_path}/2-id", plain_slot(0, n, materialise.KEY), 1, LENGTH, PER_SHARD) == [first]


def test_token_shards_of_an_empty_table(spark, tmp_path, token_files):
    docs = spark.read.parquet(token_files).filter("doc_id < 0")
    assert shards(docs, f"file://{tmp_path}/none") == [] == shards(docs, f"file://{tmp_path}/none", order_by=["doc_id"])


def test_long_texts_are_tokenised_in_parts():
    rng = random.Random(3)
    text = "".join(rng.choice(("word", " ", "  ", "\n", "'s", " 12", "é", "!?")) for _ in range(4000))
    parts = list(materialise._parts(text, 50))
    encode = materialise.tokenizer(materialise.VOCABULARY).encode_ordinary
    assert "".join(parts) == text and len(parts) > 50
    assert [t for p in parts for t in encode(p)] == encode(text)
