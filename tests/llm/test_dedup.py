from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from emberlake.llm import ctph, simhash, templates
from emberlake.llm.components import component_labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    """Documents 0, 1, ... with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    return df.withColumns({"id": F.lit("x"), "fp": F.lit(1.5), "component_id": F.lit("y"), "line": F.lit(0), "leaf": F.lit(0)})


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """The least index reachable through prints at two bits or fewer, by comparing all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def prose(rng, n):
    return " ".join(rng.choice(("Alpha", "beta", "gamma,", "delta", "epsilon", "zeta", "Ärger", "eta")) + str(rng.randrange(30)) for _ in range(n))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "one two", "ONE two", "one  two three", "é É x y"]
    for _ in range(12):
        base = prose(rng, rng.choice((20, 150, 400)))
        texts += [base, base, base + " tail", base.replace("beta", "other", 1), base.upper()]
    texts.append(prose(rng, 40_000))  # longer than a block
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [plain_simhash(t) for t in texts]
    assert [got[k][0] for k in range(len(texts))] == prints
    assert [got[k][1] for k in range(len(texts))] == plain_components(prints)
    kept = simhash.keep_one(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_components(prints)))
    assert kept.columns == docs(spark, texts).columns


def test_simhash_chains_and_hubs(spark):
    rng = random.Random(2)
    prints = [0]
    for _ in range(40):  # a path: each print two bits from the one before
        prints.append(prints[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints += [1 << k for k in range(64)] + [rng.getrandbits(64) for _ in range(60)]
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "id long, fp long")
    labels = {r["node"]: r["label"] for r in component_labels(simhash.ball_links(df)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    groups = plain_components(prints)
    for a in range(len(prints)):
        for b in range(a):
            same = labels.get(signed[a], signed[a]) == labels.get(signed[b], signed[b])
            assert same == (groups[a] == groups[b])


def test_simhash_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "x y z w")], "doc_id long, text string")
    assert sorted(((r["id"] or -1), r["component_id"]) for r in simhash.near_duplicates(df).collect()) == [(-1, 3), (2, 2), (3, 3), (3, 3)]
    assert simhash.keep_one(df).count() == 4  # nothing tells the rows of id 3 apart, and the null id stays
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.ball_links(df, 3)


def edited(texts, k):
    text, following = texts[k] or "", texts[(k + 1) % len(texts)] or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_ctph_against_plain_loop(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice((1, 5, 80, 600))) for _ in range(60)] + [None, "", "x", "ab" * 4000, "same", "same", "日本" * 50]
    rng.shuffle(texts)
    got = {r["id"]: r for r in ctph.compare_with_edits(docs(spark, texts).repartition(5)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for k, text in enumerate(texts):
        other, following = edited(texts, k), texts[(k + 1) % len(texts)] or ""
        sig = ctph.signature(text or "")
        assert got[k]["n_chars"] == len(text or "")
        assert got[k]["edited_sha256"] == __import__("hashlib").sha256(other.encode()).hexdigest()
        assert got[k]["fingerprint"] == ctph.encoded(sig)
        assert got[k]["edited_fingerprint"] == ctph.encoded(ctph.signature(other))
        assert got[k]["near_edited"] == ctph.likeness(sig, ctph.signature(other))
        assert got[k]["near_next"] == ctph.likeness(sig, ctph.signature(following))


def test_ctph_distance_is_the_edit_distance():
    def indel(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in "ab")
        assert len(a) + len(b) - 2 * ctph._common(a, b) == indel(a, b)


def test_ctph_tells_halves_from_strangers():
    rng = random.Random(5)
    near, far = [], []
    for _ in range(40):
        a, b = prose(rng, 300), prose(rng, 300)
        near.append(ctph.likeness(ctph.signature(a), ctph.signature(edited([a, b], 0))))
        far.append(ctph.likeness(ctph.signature(a), ctph.signature(b)))
    assert min(near) > 0.25 > max(far)
    assert ctph.likeness(ctph.signature("abc"), ctph.signature("abc")) == 1


def test_ctph_small_tables(spark):
    one = docs(spark, ["only one"])
    assert ctph.compare_with_edits(one).count() == 1
    assert ctph.compare_with_edits(one.limit(0)).count() == 0
    assert ctph.compare_with_edits(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, "c")], "doc_id long, text string")).count() == 4
    assert {r["id"]: r["fingerprint"] for r in ctph.fingerprints(one).collect()} == {0: ctph.encoded(ctph.signature("only one"))}


def plain_templates(texts, least, similarity):
    """The texts after line dedup, by dictionaries."""
    from collections import defaultdict

    def masked(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))

    seen, spelt = defaultdict(set), defaultdict(set)
    for t in texts:
        for line in (t or "").split("\n"):
            if masked(line):
                seen[masked(line)].add(t)
                spelt[tuple(line.split())].add(t)
    leaf = lambda w: (len(w), w[:3])
    fixed = lambda w: sum(x != "<*>" for x in w)
    support, leaves = defaultdict(set), defaultdict(set)
    for w, ts in seen.items():
        leaves[leaf(w)] |= ts
        for k, token in enumerate(w[3:], 3):
            support[leaf(w), k, token] |= ts

    def template(w):
        made = tuple(x if k < 3 or (x != "<*>" and len(support[leaf(w), k, x]) >= least) else "<*>" for k, x in enumerate(w))
        return made if fixed(made) >= similarity * len(w) else w

    often = defaultdict(set)
    for w, ts in seen.items():
        if len(leaves[leaf(w)]) >= least and fixed(w) >= similarity * len(w):
            often[template(w)] |= ts

    def goes(line):
        w = masked(line)
        if fixed(w) < similarity * len(w):
            return len(spelt[tuple(line.split())]) >= least
        return bool(w) and len(often.get(template(w), ())) >= least

    return [None if t is None else "\n".join(x for x in t.split("\n") if not goes(x)) for t in texts]


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(n))


def corpus(rng):
    texts = []
    for k in range(60):
        body = [letters(rng, 12) for _ in range(6)]
        body.insert(rng.randrange(6), f"User {k} signed in from host h{k} at noon")
        body.insert(0, "All rights  reserved.")
        body.append(f"{k} {k + 1} total 7 8 9")
        if k % 2:
            body.append(f"Posted in forum by {rng.choice('abcdefghijklmnopqrstuvwxyz')}x on some old day")
        texts.append("\n".join(body))
    shared = [f"User {k} signed in from host x{k} at noon\nAll rights  reserved." for k in range(3)]  # of nothing but recurring lines
    return texts + [texts[0]] * 20 + shared + [None, "", "\n\n", "All rights  reserved.", "lonely line"]


def test_line_dedup_against_dictionaries(spark):
    texts = corpus(random.Random(6))
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in templates.drop_recurring(df, chars_col="n_chars").collect()}
    want = plain_templates(texts, templates.MIN_TEXTS, templates.SIMILARITY)
    assert [got[k]["text"] for k in range(len(texts))] == want
    assert sum(a != b for a, b in zip(texts, want, strict=True)) >= 60
    assert all(got[k]["n_chars"] == len(want[k]) for k in range(len(texts)) if want[k] is not None)
    assert "total" in want[0] and "total" in want[1]  # rows of numbers stay
    assert want[80:83] == [""] * 3 and want[86] == ""
    assert "signed in" not in "".join(want[:60]) and "some old day" not in "".join(want[:60])
    assert templates.drop_recurring(df).columns == df.columns
    clashing = templates.drop_recurring(df.withColumns({"text_id": F.lit(1), "line_id": F.lit(2), "raw_id": F.lit(3), "all": F.lit(4)}))
    assert {r["doc_id"]: r["text"] for r in clashing.collect()} == dict(enumerate(want)) and "text_id" in clashing.columns
    digest = {r["id"]: r for r in templates.dropped_lines(df).collect()}
    n_lines = lambda t: len(t.split("\n"))
    assert all(r["n_dropped"] == n_lines(texts[k]) - (n_lines(want[k]) if want[k] or not r["n_dropped"] else 0) for k, r in digest.items() if texts[k] is not None)


def test_line_dedup_empty_table(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert templates.drop_recurring(empty).count() == 0
    assert templates.dropped_lines(empty).count() == 0
