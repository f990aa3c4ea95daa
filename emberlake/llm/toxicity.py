"""Toxicity by non-negative positive-unlabelled learning.

A logistic model in numpy is fitted to confirmed toxic texts (P) and unlabelled texts (U) with a risk estimate that is
corrected by the class prior: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)). Where the second part falls below zero,
the step goes back on it, so the model can't fit the unlabelled texts as clean. Labels other than "toxic" are read for
the prior alone. A text's features are which words and word beginnings (3 to 8 letters) it has, each counted once.

The fit reads bounded samples (``MOST_POSITIVE``, ``MOST_UNLABELLED`` texts, by a hash of the id); its features are counted
on executors, and the driver gets the chosen features and their places in the sample. Scoring is one pass over all texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import decoded, discard, table, written

MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000
MOST_FEATURES = 5_000
#: A feature is in this share of the positive sample at least (and in two texts), and this often as common as in the other.
LEAST_SHARE = 0.01
LEAST_LIFT = 1.5
BEGINNINGS = range(3, 9)
STEPS, RATE, DECAY = 300, 0.1, 1e-3
THRESHOLD = 0.3
#: Tokens whose features a task keeps; when so many are kept, it starts anew.
KEPT_TOKENS = 200_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def token_features(token: str) -> list[int]:
    """Numbers for the letters of a lower-case token and for its beginnings; none without letters."""
    import xxhash

    word = _NOT_LETTERS.sub("", token)
    if not word:
        return []
    return [xxhash.xxh64_intdigest("=" + word) >> 1] + [xxhash.xxh64_intdigest("^" + word[:k]) >> 1 for k in BEGINNINGS if k <= len(word)]


class _Features:
    """The wanted features of texts, with the recent tokens' ones at hand."""

    def __init__(self, wanted: dict[int, int] | None):
        self.wanted, self.known = wanted, {}

    def token(self, token: str) -> list[int]:
        if len(self.known) >= KEPT_TOKENS:
            self.known.clear()
        found = token_features(token)
        if self.wanted is not None:
            found = [self.wanted[f] for f in found if f in self.wanted]
        self.known[token] = found
        return found

    def text(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for token in set((text or "").lower().split()):
            found = self.known.get(token)
            if found is None:
                found = self.token(token)
            if found:
                out.update(found)
        return out


def _count(batches: Iterator) -> Iterator:
    """Texts that have each feature, a row for each feature, class and task's portion."""
    from collections import Counter

    import pyarrow as pa

    made = _Features(None)
    for batch in batches:
        counts = (Counter(), Counter())
        for text, positive in zip(decoded(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[positive].update(made.text(text))
        for positive, found in enumerate(counts):
            if found:
                yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array([positive] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["feature", "positive", "n"])


def _places(features: list[int], batches: Iterator) -> Iterator:
    import pyarrow as pa

    made = _Features({f: k for k, f in enumerate(features)})
    for batch in batches:
        yield pa.record_batch([batch.column(1), pa.array([sorted(made.text(t)) for t in decoded(batch.column(0))], pa.list_(pa.int32()))], names=["positive", "features"])


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at random by a hash of the id, and never over twice as many; all rows if they are few."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1_000_000)) < int(1_000_000 * most / n)).limit(2 * most)


def sparse(rows: list) -> tuple:
    """Lists of feature places as (row of each, place of each, number of rows)."""
    import numpy as np

    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.empty(0, np.int64)
    return np.repeat(np.arange(len(rows)), sizes), flat, len(rows)


def step(theta, p: tuple, u: tuple, prior: float):
    """The gradient that a step goes down, over weights and bias: that of the corrected risk, prior * R_P(+) + R_U(-) - prior * R_P(-),
    or, where the part for the unlabelled, R_U(-) - prior * R_P(-), is below zero, the opposite of that part's."""
    import numpy as np

    n_features = len(theta) - 1
    logits = lambda m: np.bincount(m[0], weights=theta[m[1]], minlength=m[2]) + theta[-1]
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    zp, zu = logits(p), logits(u)
    if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
        gp, gu = -prior * (sigmoid(-zp) + sigmoid(zp)) / p[2], sigmoid(zu) / u[2]
    else:
        gp, gu = prior * sigmoid(zp) / p[2], -sigmoid(zu) / u[2]
    by_feature = np.bincount(p[1], weights=gp[p[0]], minlength=n_features) + np.bincount(u[1], weights=gu[u[0]], minlength=n_features)
    return np.append(by_feature, gp.sum() + gu.sum())


def fit(positive: list, unlabelled: list, n_features: int, prior: float) -> tuple[list[float], float]:
    """Weights and bias from lists of feature places, by full-batch Adam steps on the non-negative risk."""
    import numpy as np

    p, u = sparse(positive), sparse(unlabelled)
    theta, first, second = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = -2.0
    if not p[2] or not u[2]:
        return theta[:-1].tolist(), float(np.log(prior / (1 - prior)))
    for t in range(1, STEPS + 1):
        grad = step(theta, p, u, prior) + DECAY * np.append(theta[:-1], 0.0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:-1].tolist(), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> dict:
    """The model: features, weights and bias. ``usable``: which ids may be learnt from, over a column ``id``.

    ``prior`` is the share of toxic texts, above 0 and below 1; by default that of the usable labels, or, where these are
    all alike or none, (toxic + 1/2) / (labels + 1).

    Rows of ``labels`` with a null id or label count as no label; of several labels of an id, the greatest counts.
    Without toxic examples or without texts the score is the prior alone. Of features of one value the smaller number is
    chosen first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & usable)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & usable)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        share = known.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("*").alias("n")).first()
        prior = share["toxic"] / share["n"] if 0 < share["toxic"] < share["n"] else (share["toxic"] + 0.5) / (share["n"] + 1)
    if not 0 < prior < 1:
        raise ValueError("prior is above 0 and below 1")
    p_ids = _sampled(known.filter("toxic = 1").select("id"), MOST_POSITIVE)
    u_ids = _sampled(rows.select("id"), MOST_UNLABELLED).distinct()
    picked = p_ids.select("id", F.lit(1).alias("positive")).unionByName(u_ids.select("id", F.lit(0).alias("positive")))
    # both lists of ids are bounded by the samples' sizes; an id that repeats gives one of its texts
    one = rows.join(F.broadcast(picked), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    sample = written(one.select("text", "positive"), "toxic-sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.mapInArrow(_count, "feature long, positive int, n long").groupBy("feature").agg(*(F.sum(F.when(F.col("positive") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate("up")))
    rate, base = F.col("p") / max(n_p, 1), (F.col("u") + 1) / (n_u + 1)
    best = counts.filter((F.col("p") >= max(2, LEAST_SHARE * n_p)) & (rate > LEAST_LIFT * base)).orderBy((rate * F.log(rate / base)).desc(), "feature").limit(MOST_FEATURES)
    features = [r["feature"] for r in best.select("feature").collect()]
    places = sample.mapInArrow(functools.partial(_places, features), "positive int, features array<int>").collect() if features else []
    discard(sample)
    weights, bias = fit([r["features"] for r in places if r["positive"]], [r["features"] for r in places if not r["positive"]], len(features), prior)
    return {"features": features, "weights": weights, "bias": bias, "prior": prior}


def _score(model: dict, batches: Iterator) -> Iterator:
    import math

    import pyarrow as pa

    made, weights, bias = _Features({f: k for k, f in enumerate(model["features"])}), model["weights"], model["bias"]
    for batch in batches:
        sums = [bias + math.fsum(weights[k] for k in made.text(t)) for t in decoded(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array([0.5 * (1 + math.tanh(z / 2)) for z in sums], pa.float64())], names=["id", "score"])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, score, predicted) for each row of ``docs``; null and empty texts have the score of no feature.

    Bytes that are not UTF-8 are no letters; null and repeated ids keep their rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(functools.partial(_score, model), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("id")))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted")
