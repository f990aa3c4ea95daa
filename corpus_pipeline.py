"""The corpus pipeline: documents in, sampled token sequences out. Counted as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import mixing, nearcopies, pieces, quality, queries, templates
from emberlake.llm.common import discard, table, written

#: The mix takes so many of the tokens that reach it, each document once.
SHARE = 0.8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (7): rejected documents go; rows are judged one by one, whatever their ids. Null and empty texts go."""
    return quality.keep_good(docs)


def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (3): lines of recurring templates go; every document stays, one of nothing but such lines with no word left.

    Null texts stay null; equal texts lose the same lines; rows with null or repeated ids stay.
    """
    return templates.drop_recurring(docs, chars_col="n_chars")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup (1): of each group of near copies, five-word shingles at 0.8, the document of the least id stays.

    SimHash balls give candidates, and bands of least hashes those that no ball reaches; all are compared by their
    shingles. Null ids come last, of rows with one id any one stays, and texts without a word are copies of each other.
    """
    return nearcopies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources (5): each leaf's prefix of a seeded order, up to its budget. Null names are one name; rows with null
    or repeated ids have places by their texts; of equal rows any are taken."""
    return mixing.mix(docs, queries.levels(), queries.WEIGHTS, share=SHARE, max_epochs=1.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding (4): sampled piece ids of each document; a null text counts as empty, which is one piece."""
    return pieces.encode(docs).select(F.col("id").alias("doc_id"), F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality rules", good),
    ("line dedup", without_templates),
    ("simhash near-dedup", unique),
    ("mixing sources", mixed),
    ("sentencepiece encoding", encoded),
]

#: SQL can't express the sampled segmentation; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; an empty table gives no rows. A stage's table is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = written(after, f"stage{k}")
            discard(docs, after)  # and what the stage's result was read from
            after = kept
        docs = after
    return docs
