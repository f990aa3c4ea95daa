"""Near-dedup of the pipeline against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from emberlake.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_groups(texts):
    """The least index reachable through Jaccard coefficients of 0.8 or more, by comparing all pairs."""

    def made(text):
        w = (text or "").split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, label = [made(t) for t in texts], list(range(len(texts)))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " ", "one two", "one two", "one three"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice((40, 120, 300)))]
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.03, 0.06):
            near = list(base)
            for k in rng.sample(range(len(base)), max(1, int(share * len(base)))):
                near[k] = word()
            texts.append(" ".join(near))
    shared = [word() for _ in range(200)]  # many texts around one passage, at 0.6 or less
    texts += [" ".join(shared + [word() for _ in range(100)]) for _ in range(40)]
    return texts


def test_near_copies_against_all_pairs(spark):
    texts = corpus(random.Random(1))
    df = spark.createDataFrame([(k, t, "en", "src0", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = corpus_pipeline.unique(spark, df, "")
    want = sorted(set(plain_groups(texts)))
    assert len(texts) - len(want) >= 60
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert kept.columns == df.columns


def test_one_row_stays_whatever_its_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "x y z"), (3, "x y z"), (2, "p q"), (None, "p q")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in nearcopies.keep_one(df).collect()) == [(-1, "a b c"), (2, "p q"), (3, "x y z")]
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def changed(rng, base, n, within=None):
    out = list(base)
    for k in rng.sample(range(*(within or (0, len(base)))), n):
        out[k] = words_of(rng, 1)[0]
    return out


def star(rng, n, length=200):
    """One text and copies of it, each with words of its own changed: near to the first, not to each other."""
    base = words_of(rng, length)
    return [base, *(changed(rng, base, 4) for _ in range(n))]


def chain(rng, n, length=200):
    """Each text near to the one before alone, or nearly so."""
    out = [words_of(rng, length)]
    for k in range(n - 1):
        now = list(out[-1])
        begin = k * 10 % (length - 10)
        now[begin : begin + 10] = words_of(rng, 10)
        out.append(now)
    return out


def kept_and_wanted(spark, texts):
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in nearcopies.keep_one(df).collect()), sorted(set(plain_groups(texts)))


def test_large_groups_against_all_pairs(spark):
    """A star, a chain and a dense group at once, none of which any pair holds together."""
    rng = random.Random(11)
    dense = words_of(rng, 100)
    texts = star(rng, 199) + chain(rng, 100) + [changed(rng, dense, 1) for _ in range(500)] + [words_of(rng, 60) for _ in range(50)]
    rng.shuffle(texts)
    kept, want = kept_and_wanted(spark, texts)
    assert kept == want and len(want) < 60


def test_hubs_and_new_keys_find_what_all_pairs_find(spark, monkeypatch):
    """With small bounds every key is large: hubs are drawn and keys dealt anew, and no link is lost."""
    rng = random.Random(12)
    monkeypatch.setattr(nearcopies, "ALL_PAIRS", 6)
    monkeypatch.setattr(nearcopies, "FIRST_PAIRS", 4)
    monkeypatch.setattr(nearcopies, "PAIRS_A_TEXT", 0)
    shared = words_of(rng, 150)
    unlike = [shared + words_of(rng, 90) for _ in range(40)]
    kept, want = kept_and_wanted(spark, star(rng, 40) + unlike + chain(rng, 20))
    assert kept == want and 40 < len(want) < 60


def test_any_column_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c", 2, 3), (2, "a b c", 2, 3)], ["doc_id", "text", "a.b", "row"])
    got = nearcopies.keep_one(df)
    assert got.columns == df.columns and [r[2] for r in got.collect()] == [2]
