"""Parsing and validation of events: JSON text to typed columns and a list of all issues.

Fields are read from a VARIANT, whose types are tested before any value is: nothing is coerced, and nothing throws on
dirty input. JSON with a repeated key counts as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import keys, time
from emberlake.functions.binding import bound
from emberlake.schema import SCHEMA_VERSION

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CLIENT_FIELDS = ("type", "occurredAt", "payload", "sessionId", "actorId", "source")
FIELDS = ("eventId", "projectId", "schemaVersion", "receivedAt", *CLIENT_FIELDS)
ISSUES = "array<struct<field:string,reason:string>>"


def kind(v: Column, path: str) -> Column:
    """The type of a field as text, null if the field is absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_number(of: Column) -> Column:
    return of.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def issue(bad: Column, field: str, reason: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))


def _read(v: Column, fields: tuple[str, ...]) -> Column:
    """Every field's kind and value, looked up once: texts as they are, the version as a number, the payload as JSON."""
    as_read = {"schemaVersion": lambda f: F.try_variant_get(v, f, "double"), "payload": lambda f: F.to_json(F.try_variant_get(v, f, "variant"))}
    text = lambda f: F.try_variant_get(v, f, "string")
    each = lambda name: F.struct(kind(v, f"$.{name}").alias("of"), as_read.get(name, text)(f"$.{name}").alias("value")).alias(name)
    return F.struct(*map(each, fields))


def _text(f: Column, field: str, required: bool) -> tuple[Column, list[Column]]:
    of, value = f["of"], f["value"]
    found = [issue(of != "STRING", field, "Expected string"), issue((of == "STRING") & (value == ""), field, "String must contain at least 1 character(s)")]
    return F.when(of == "STRING", value), found + [issue(of.isNull(), field, "Required")] * required


def _time(f: Column, field: str, required: bool) -> tuple[Column, list[Column]]:
    of, value = f["of"], f["at"]
    found = [issue(of != "STRING", field, "Expected string"), issue((of == "STRING") & value.isNull(), field, "Invalid datetime")]
    return F.when(of == "STRING", value), found + [issue(of.isNull(), field, "Required")] * required


def _with_times(r: Column, fields: tuple[str, ...]) -> Column:
    """The fields as read, times parsed."""
    timed = lambda name: F.struct(r[name]["of"].alias("of"), time.parse_iso(r[name]["value"]).alias("at"))
    return F.struct(*((timed(name) if name in ("receivedAt", "occurredAt") else r[name]).alias(name) for name in fields))


def _checked(r: Column, client: bool) -> tuple[dict[str, Column], list[Column]]:
    out, issues = {}, []

    def take(name: str, field: tuple[Column, list[Column]]) -> None:
        out[name] = field[0]
        issues.extend(field[1])

    if not client:
        take("event_id", _text(r["eventId"], "eventId", True))
        issues.append(issue((r["eventId"]["of"] == "STRING") & ~out["event_id"].rlike(UUID), "eventId", "Invalid uuid"))
        take("project_id", _text(r["projectId"], "projectId", True))
        of, number = r["schemaVersion"]["of"], r["schemaVersion"]["value"]
        whole = is_number(of) & (number == F.floor(number)) & (number > 0) & (number < 2**31)
        issues.append(issue(of.isNotNull() & ~F.coalesce(whole, F.lit(False)), "schemaVersion", "Expected positive integer"))
        out["schema_version"] = F.when(of.isNull(), SCHEMA_VERSION).when(whole, number.cast("int"))
        take("received_at", _time(r["receivedAt"], "receivedAt", True))
    take("type", _text(r["type"], "type", True))
    take("occurred_at", _time(r["occurredAt"], "occurredAt", not client))
    of = r["payload"]["of"]
    issues.append(issue(~of.startswith("OBJECT"), "payload", "Expected object"))
    out["payload"] = F.when(of.startswith("OBJECT"), r["payload"]["value"]).when(of.isNull(), "{}")
    for name, field in (("session_id", "sessionId"), ("actor_id", "actorId"), ("source", "source")):
        take(name, _text(r[field], field, False))
    return out, issues


def parsed(rows: DataFrame, value: str = "value", client: bool = False) -> DataFrame:
    """``rows`` with ``event`` (a struct, null if invalid) and ``issues`` (all of them, empty if valid).

    An envelope with unknown keys is invalid; of a client's input (``client``) unknown keys are ignored.
    """
    names = CLIENT_FIELDS if client else FIELDS
    # each step is bound once: the parsed text, the fields looked up in it, the times among them, the issues
    out = bound(rows, "__v", F.try_parse_json(value))
    out = bound(out, "__fields", _read(F.col("__v"), names))
    out = bound(out, "__read", _with_times(F.col("__fields"), names))
    fields, found = _checked(F.col("__read"), client)
    if not client:
        unknown = F.size(F.array_except(F.json_object_keys(value), F.array(*map(F.lit, FIELDS)))) > 0
        found.append(issue(unknown, "(root)", "Unrecognized key(s) in object"))
    root = ~F.coalesce(F.schema_of_variant("__v"), F.lit("")).startswith("OBJECT")
    none = F.array(F.struct(F.lit("(root)").alias("field"), F.lit("Expected object").alias("reason")))
    out = bound(out, "issues", F.when(root, none).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull())))
    out = bound(out, "event", F.when(F.size("issues") == 0, F.struct(*(c.alias(n) for n, c in fields.items()))))
    return out.drop("__v", "__fields", "__read")


def stamped(client_events: DataFrame, project_id: str = "project_id", received_at: str = "received_at", coordinates: tuple[str, ...] = ("topic", "partition", "offset")) -> DataFrame:
    """Client events (column ``event``) as full events: server fields are set, a missing time is the time of receipt.

    The id is a hash of the record's coordinates, so a task that runs again gives the same id.
    """
    e = F.col("event")
    return client_events.select(
        keys.uuid_of(*map(F.col, coordinates)).alias("event_id"),
        F.col(project_id).alias("project_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        e["type"].alias("type"),
        F.coalesce(e["occurred_at"], F.col(received_at)).alias("occurred_at"),
        F.col(received_at).alias("received_at"),
        F.coalesce(e["payload"], F.lit("{}")).alias("payload"),
        *(e[c].alias(c) for c in ("session_id", "actor_id", "source")),
    )


def split(rows: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid events (flat, with the record's coordinates) and invalid records with their issues: nothing is blocked."""
    return parted(parsed(rows, value), value)


def parted(checked: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``split`` of rows that were parsed: who reads both sides writes ``checked`` before, as each reads it anew."""
    kept = (c for c in checked.columns if c not in (value, "issues", "event"))
    good = checked.filter("event is not null").select(*kept, "event.*")
    return good, checked.filter("event is null").drop("event")
