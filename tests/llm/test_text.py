from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import licenses, pieces, quality, toxicity

WORD = r"[^\x20\x09-\x0D]"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"id": F.lit("x"), "n_words": F.lit("y"), "m": F.lit(0), "score": F.lit(9), "license": F.lit(1), "found": F.lit(1)})


def plain_counts(text):
    text = text or ""
    w = re.findall(WORD + "+", text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [None, "", "   ", "a", "a b", "a b c", "a b c a b c", "x " * 70, "a b c d a b c e b c d", "l\nl\n\n \nl", "p|q<r>#", "é è z \x1f y"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(120))) for _ in range(40)]
    texts += ["\r\n".join(f"the word {k} of and to line" for k in range(2000)), "the and of " + "plain text of words here " * 3000]
    got = quality.score(docs(spark, texts)).orderBy("id").collect()
    for text, r in zip(texts, got, strict=True):
        n, chars, symbols, dup, repeated = plain_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated), text and text[:80]
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdicts(spark):
    rng = random.Random(2)
    clean = " ".join(rng.choice(("the", "of", "house", "river", "and", "walked", "stone", "light")) + rng.choice(("", "", ",", "s")) for _ in range(90))
    bad = {"symbols": " ".join(w + "%%%" for w in clean.split()), "capitals": clean.upper(), "bars": clean.replace(" ", " | ")}
    lines = [" ".join(clean.split()[k : k + 9]) for k in range(0, 90, 9)]
    bad |= {"bullets": "\n".join(f"- {x}" for x in lines), "broken off": "\n".join(f"{x} ..." for x in lines), "short": clean.replace(" ", "\n"), "no stop words": re.sub(r"\b(the|of|and)\w*", "stone", clean)}
    good = [clean, clean.replace("the", "The"), "\n".join(lines)]
    df = docs(spark, [*good, *bad.values()])
    assert [r["kept"] for r in quality.score(df).orderBy("id").collect()] == [True] * 3 + [False] * 7
    kept = quality.keep_good(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2] and kept.columns == df.columns
    assert quality.keep_good(df.limit(0)).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.score(df, rules=[]).collect())
    plan = quality.score(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def plain_license(text):
    best, n = None, set()
    known = licenses.template_bigrams(licenses.TEMPLATES)
    sentences = re.split(r"[.!?:;][^A-Za-z0-9\x20\x09-\x0D]*[\x20\x09-\x0D]+", text)
    windows = {" ".join(sentences[k : k + n]) for k in range(len(sentences)) for n in (1, 2, 3)}
    units = {*text.split("\n"), *re.split(r"\n[^A-Za-z0-9\n]*\n", text), text, *windows}
    for unit in units:
        w = licenses._plain_words(unit)
        grams = set(zip(w, w[1:], strict=False))
        found = []
        for name, _, template in known:
            other = {tuple(g.split(" ")) for g in template}
            if grams and (dice := 2 * len(grams & other) / (len(grams) + len(other))) >= licenses.LEAST:
                found.append((dice, name))
        if found:
            n.add(unit)
            top = max(found)[0]
            best = max(best or (0, 0, "", ""), (top, len(grams), "/".join(sorted({name for dice, name in found if dice >= top - licenses.MARGIN})), unit))
    return best, len(n)


def test_license_anchors_lose_no_match():
    """Without any anchor, no unit reaches the coefficient: the words around the anchors of each template are the best that is left."""
    hold = licenses.anchors(licenses.TEMPLATES, licenses.LEAST)
    for name, _, grams in licenses.template_bigrams(licenses.TEMPLATES):
        free = [g for g in grams if not any(a in g for a in hold)]
        assert 2 * len(free) / (len(grams) + len(free)) < licenses.LEAST, name


def test_each_notice_has_its_own_licence(spark):
    """Standard notices, with a changed word and a copyright line, under their own names; what two licences share under both."""
    gnu = lambda what, sign, name, version: f"Copyright (C) 2021 Nobody\n\nThis {what} is free software{sign} you can redistribute it and/or modify\nit under the terms of the GNU {name} as published by\nthe Free Software Foundation{',' if sign == ':' else ';'} either version {version} of the License, or\n(at your option) any later version.\n\nmore"
    cc = lambda name: f"The text is free. This work is licensed under a Creative Commons {name} 4.0 International License. Enjoy."
    opening = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    two = opening + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    three = two + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    cases = {
        gnu("program", ":", "Affero General Public License", 3): "AGPL-3.0",
        gnu("program", ":", "General Public License", 3): "GPL-3.0",
        gnu("program", ";", "General Public License", 2): "GPL-2.0",
        gnu("library", ":", "Lesser General Public License", 3): "LGPL-3.0",
        gnu("library", ";", "Lesser General Public License", "2.1"): "LGPL-2.1",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "GPL-2.0-only",
        cc("Attribution-NonCommercial-ShareAlike"): "CC-BY-NC-SA-4.0",
        cc("Attribution-ShareAlike"): "CC-BY-SA-4.0",
        cc("Attribution-NoDerivatives"): "CC-BY-ND-4.0",
        cc("Attribution-NonCommercial-NoDerivatives"): "CC-BY-NC-ND-4.0",
        cc("Attribution"): "CC-BY-4.0",
        opening: "BSD-2-Clause/BSD-3-Clause",
        two: "BSD-2-Clause",
        three: "BSD-3-Clause",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    }
    got = licenses.scan(docs(spark, list(cases))).orderBy("id").collect()
    assert [r["license"] for r in got] == list(cases.values())


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    wrapped = "\n".join(re.findall(r".{1,60}(?: |$)", mit))
    texts = [None, "", "plain prose without a notice", "some text\nLicensed under the Apache License, Version 2.0.", f"intro\n\n{wrapped}\n\nmore text", "LICENSED UNDER CC BY-NC 4.0", "Licensed under CC BY 4.0.", "all rights reserved", "This work is licensed under the GNU General Public License, version 2.", "word " * 3000, mit.replace("person", "people")]
    header = ["Copyright 2020 Nobody", "", *wrapped.split("\n"), "", "The above copyright notice and this permission notice shall be included in all copies or", "substantial portions of the Software."]
    inline = "Our toolkit is free for all of you, and it is small. Licensed under the Apache License, Version 2.0. Please send patches to the list; they are read on Mondays."
    texts += ["\n".join(f" * {x}".rstrip() for x in header) + "\n */\nint main() { return 0; }", inline, f"{inline} {inline}", "Anyone may use it. " + licenses.TEMPLATES["Apache-2.0"][1] + " " + licenses.TEMPLATES["Apache-2.0"][2] + " That is all there is to say."]
    got = licenses.scan(docs(spark, texts)).orderBy("id").collect()
    for text, r in zip(texts, got, strict=True):
        best, n = plain_license(text or "")
        assert r["n_notices"] == n
        assert (r["license"], r["unit"]) == ((best[2], best[3]) if best else (None, None))
        assert best is None or r["dice"] == pytest.approx(best[0], abs=1e-6)
    assert [r["license"] for r in got] == [None, None, None, "Apache-2.0", "MIT", "CC-BY-NC-4.0", "CC-BY-4.0", "proprietary", "GPL-2.0", None, "MIT", "MIT", "Apache-2.0", "Apache-2.0", "Apache-2.0"]
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


TEXTS = ["", " ", "  two  spaces ", "\n\n line\r\n", "▁literal▁", "naïve café 日本語 😀 \u0000�", "a" * 3000, "Hello world, hello world.", "tab\tand   many     spaces", "<s> <0x41> </s>"]


def test_pieces_round_trip(spark):
    df = docs(spark, [*TEXTS, None])
    coded = pieces.encode(df)
    back = {r["id"]: r["text"] for r in pieces.decode(coded).collect()}
    assert back == dict(enumerate([*TEXTS, ""]))
    assert all(r["lossless"] for r in pieces.round_trip(df).collect())
    assert pieces.encode(df.limit(0)).count() == 0


def test_pieces_do_not_depend_on_batches(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("sampling", "segments", "reproducible", "words")) for _ in range(rng.randrange(1, 200))) for _ in range(80)]
    one = {r["id"]: r["piece_ids"] for r in pieces.encode(docs(spark, texts).coalesce(1)).collect()}
    many = {r["id"]: r["piece_ids"] for r in pieces.encode(docs(spark, texts).repartition(7)).collect()}
    other = {r["id"]: r["piece_ids"] for r in pieces.encode(docs(spark, texts), seed=1).collect()}
    assert one == many and one != other
    assert len({tuple(pieces.lattice(pieces.MODEL).sample(["reproducible segmentation"], [k], 0.2)[0]) for k in range(50)}) > 10


def test_pieces_follow_the_lattice():
    """Sampled segmentations of a short text occur as often as their probabilities say; all of them are listed."""
    lat, text = pieces.lattice(pieces.MODEL), "then"
    spelt = {lat.bytes[k].decode("utf-8", "ignore"): k for k in range(lat.n) if lat.bytes[k] and k not in lat.byte_id}

    def ways(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in spelt:
                for tail in ways(rest[n:]):
                    yield (spelt[rest[:n]], *tail)

    weight = {w: float(np.exp(sum(lat.logp[k] for k in w))) for w in ways(" " + text)}
    total, n = sum(weight.values()), 20_000
    ids, counts = lat.sample([text] * n, list(range(n)))
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(got) <= set(weight)
    for w, p in weight.items():
        share = p / total
        assert abs(got[w] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def toxic_corpus(rng, n):
    common = [f"wort{k}" for k in range(300)]
    rows = []
    for k in range(n):
        words = [rng.choice(common) for _ in range(60)]
        toxic = rng.random() < 0.15
        if toxic:
            words[:4] = [rng.choice(("nasty", "vile", "grubel")) + rng.choice(("", "ung", "heit")) for _ in range(4)]
            rng.shuffle(words)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rows = toxic_corpus(random.Random(4), 1200)
    spark.createDataFrame([(a, b) for a, b, _ in rows] + [(5000, None), (5001, ""), (None, "nasty vile")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(a, c) for a, _, c in rows if a % 2] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 3
    held = [(got[a]["predicted"], c) for a, _, c in rows if got[a]["held_out"]]
    hit = sum(p and c for p, c in held)
    assert len(held) > 200
    assert hit / sum(c for _, c in held) > 0.9 and hit / sum(p for p, _ in held) > 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"]


def test_toxicity_never_reads_held_out_labels(spark, tmp_path):
    rows = toxic_corpus(random.Random(5), 400)
    spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    scores = []
    for k, flip in enumerate((False, True)):
        held = lambda a: zlib.crc32(str(a).encode()) % 4 == 2
        labels = spark.createDataFrame([(a, 1 - c if flip and held(a) else c) for a, _, c in rows], "doc_id long, toxic int")
        model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels, ~toxicity.held_out(F.col("id")))
        scores.append(json.dumps([model["features"], np.round(model["weights"], 9).tolist()]))
    assert scores[0] == scores[1]


def test_toxicity_without_examples(spark):
    df = docs(spark, ["a b c", None])
    model = toxicity.train(df, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"), F.lit(True))
    assert all(r["predicted"] == 0 for r in toxicity.score(df, model).collect())
    assert toxicity.score(df.limit(0), model).count() == 0


def test_nnpu_step_goes_back_where_the_risk_is_negative():
    positive, unlabelled = [[0]] * 20, [[0]] * 2 + [[1]] * 38
    weights, bias = toxicity.fit(positive, unlabelled, 2, 0.5)  # a prior far above the share that P explains
    assert np.isfinite(weights).all() and np.isfinite(bias) and weights[0] > weights[1]
