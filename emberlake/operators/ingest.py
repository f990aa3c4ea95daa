"""The ingest decision: quota, key, envelope, schema. One verdict for each request, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import keys
from emberlake.operators import envelope, registry


def attributed(requests: DataFrame, api_keys: DataFrame, key: str = "api_key", received_at: str = "received_at") -> DataFrame:
    """``requests`` with ``project_id``: of the key whose prefix and secret match and that isn't revoked; else null.

    The stored hash is SHA-256 of the secret, as Spark has no memory-hard hash. Keys are a dimension with one row a
    prefix; Spark broadcasts it by its size.
    """
    parts = requests.withColumn("__key", keys.api_key_parts(F.col(key)))
    known = api_keys.select(F.col("prefix").alias("__prefix"), F.col("hash").alias("__hash"), F.col("project_id").alias("__project"), F.col("revoked_at").alias("__revoked"))
    valid = (F.col("__key.prefix") == F.col("__prefix")) & (keys.fingerprint(F.col("__key.secret")) == F.col("__hash")) & (F.col("__revoked").isNull() | (F.col(received_at) < F.col("__revoked")))
    return parts.join(known, valid, "left").withColumn("project_id", F.col("__project")).drop("__key", "__prefix", "__hash", "__project", "__revoked")


def decided(requests: DataFrame, api_keys: DataFrame, schemas: DataFrame, allowed: str | None = None) -> DataFrame:
    """``requests`` (value, api_key, received_at, coordinates) with ``status``, ``errors``, ``project_id`` and ``event``.

    ``allowed`` names a boolean column of a quota; without it no request is over its quota.
    """
    known = envelope.parsed(attributed(requests, api_keys), client=True)
    checked = known.withColumns({"type": F.col("event.type"), "payload": F.col("event.payload")})
    checked = registry.validated(checked, schemas)
    status = F.when(~F.col(allowed) if allowed else F.lit(False), 429).when(F.col("project_id").isNull(), 401).when(F.size("issues") > 0, 400).when(~F.col("registered"), 422).when(F.size("violations") > 0, 400).otherwise(202)
    out = checked.withColumn("status", status)
    none = F.array().cast(envelope.ISSUES)
    errors = F.when((F.col("status") == 400) & (F.size("issues") > 0), F.col("issues")).when(F.col("status") == 400, F.col("violations")).otherwise(none)
    return out.withColumn("errors", errors).drop("issues", "violations", "registered", "type", "payload")


def ingest(requests: DataFrame, api_keys: DataFrame, schemas: DataFrame, allowed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted events, stamped, and rejected requests with their status and errors."""
    verdicts = decided(requests, api_keys, schemas, allowed)
    return envelope.stamped(verdicts.filter("status = 202")), verdicts.filter("status != 202").drop("event")
