"""Schemas of the event log, the raw store, the views and the dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def struct(text: str) -> T.StructType:
    """A schema from "name type, name type": made without a session, so that modules can be imported before one starts."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOG = struct("key string, value string, topic string, partition int, offset long")
EVENT = struct("event_id string, project_id string, schema_version int, type string, occurred_at timestamp, received_at timestamp, payload string, session_id string, actor_id string, source string")
RAW = struct("project_id string, time_bucket string, occurred_at timestamp, event_id string, type string, received_at timestamp, payload string, session_id string, actor_id string, source string")
COUNTS = struct("project_id string, time_bucket string, event_type string, count long")
LEADERBOARD = struct("project_id string, period string, player_id string, score double")
FUNNEL_STATE = struct("project_id string, actor_id string, event_type string, first_seen_at timestamp")
RETENTION_STATE = struct("project_id string, actor_id string, active_period date")
DEAD_LETTER = T.StructType(
    [
        *struct("originalValue string, originalEvent string").fields,
        T.StructField("error", struct("kind string, reason string")),
        *struct("attempts int, failedAt timestamp").fields,
        T.StructField("source", struct("topic string, partition int, offset string, key string")),
    ]
)
PROJECTS = struct("id string, name string, created_at timestamp")
API_KEYS = struct("id string, project_id string, prefix string, hash string, created_at timestamp, revoked_at timestamp")
EVENT_SCHEMAS = struct("id string, project_id string, event_type string, json_schema string, created_at timestamp, updated_at timestamp")
