"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import ctph, importance, licenses, manifest_sql, materialise, merkle, mixing, oracles, pieces, quality, repeats, repeats_sql, sharding, simhash, templates, toxicity
from emberlake.llm.common import discard, new_path, table, written


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.dropped_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def levels() -> dict[str, Column]:
    """The tree of the corpus: a source belongs to the domain of its number."""
    return {
        "domain": F.when(F.col("source").rlike("^src[0-9]$"), "web").when(F.col("source").rlike("^src1[0-4]$"), "forum").when(F.col("source").isNotNull(), "books"),
        "lang": F.col("lang"),
        "source": F.col("source"),
    }


#: Of domains, languages and sources; sources are equal.
WEIGHTS = [{"web": 0.5, "forum": 0.3, "books": 0.2}, {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1}, {}]


#: Of the corpus's tokens, and how often a text is taken at most.
SHARE, EPOCHS = 0.8, 2.0


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.choose(table(spark, sf_dir, "documents"), levels(), WEIGHTS, share=SHARE, max_epochs=EPOCHS)
    return taken.select("doc_id", F.array_join("__leaf", "/").alias("leaf"), F.col("__tokens").alias("n_tokens"), F.col("__epochs").alias("epochs"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "n_chars")).select("doc_id", "slot", "shard", "n_chars")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards into a new folder of the shared one and returns a row for each; they are written once, whatever reads the rows."""
    stream = materialise.token_stream(table(spark, sf_dir, "documents"))
    out = written(materialise.write_shards(materialise.training_order(stream), new_path(spark, "shards")), "shards-written")
    discard(stream)
    return out


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, sf_dir)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_shards": op8_token_shards,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": oracles.line_dedup(),
    "op5_mixing": oracles.mixing(WEIGHTS, SHARE, EPOCHS),
    "op6_sharding": oracles.shard_placement(),
    "op7_quality_rules": oracles.quality_rules(),
    "op9_license_scan": oracles.license_scan(),
    "op11_merkle_manifest": manifest_sql.manifest(),
    "op13_suffix_array_dedup": repeats_sql.removal(),
}
