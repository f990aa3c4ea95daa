from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlake.operators import deadletter, envelope, ingest, registry

BASE = {"eventId": "0f1d2c3b-0000-4000-8000-00000000002a", "projectId": "arcade-7", "schemaVersion": 3, "type": "lap_done", "occurredAt": "2024-02-29T23:59:58.500Z", "receivedAt": "2024-03-01T00:00:01.000Z", "payload": {"lap": 12, "car": "blue"}}


def values(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "offset long, value string").withColumns({"topic": F.lit("t"), "partition": F.lit(0), "key": F.lit(None).cast("string")})


def fields(spark, texts, client=False):
    got = envelope.parsed(values(spark, texts), client=client).orderBy("offset").collect()
    return [sorted({i["field"] for i in r["issues"]}) for r in got], got


def change(**of):
    return json.dumps({k: v for k, v in (BASE | of).items() if v is not ...})


def test_valid_envelopes(spark):
    good = [change(), change(sessionId="s", actorId="a", source="sdk"), change(occurredAt="2024-02-29T20:00:00-04:00"), change(schemaVersion=11), change(payload=...), change(schemaVersion=...), change(schemaVersion=1.0)]
    issues, got = fields(spark, good)
    assert issues == [[]] * len(good)
    assert got[4]["event"]["payload"] == "{}"
    assert got[5]["event"]["schema_version"] == 1


def test_invalid_envelopes(spark):
    bad = {
        "eventId": change(eventId="lap-12"),
        "occurredAt": change(occurredAt="29.2.2024, 23:59"),
        "receivedAt": change(receivedAt=...),
        "projectId": change(projectId=""),
        "type": change(type=""),
        "(root)": change(extra=1),
        "payload": change(payload=None),
        "sessionId": change(sessionId=None),
        "source": change(source=3),
    }
    issues, got = fields(spark, [*bad.values(), *(change(schemaVersion=v) for v in (0, -1, 1.5, "1")), "this-is-not-json", "[1]", None, '{"type":"a","type":"b"}'])
    assert issues[: len(bad)] == [[k] for k in bad]
    assert issues[len(bad) : len(bad) + 4] == [["schemaVersion"]] * 4
    assert issues[len(bad) + 4 :] == [["(root)"]] * 4
    assert all(r["event"] is None for r in got)


def test_client_input_lists_every_bad_field(spark):
    issues, got = fields(spark, ['{"type":"t","eventId":7,"stray":1}', '{"occurredAt":"not-a-date"}', '{"type":123}'], client=True)
    assert issues == [[], ["occurredAt", "type"], ["type"]]
    assert got[0]["event"]["payload"] == "{}"


SCHEMA = {"type": "object", "properties": {"level": {"type": "integer"}}, "required": ["level"]}


def violations(spark, schema, payload):
    return [(x["field"], x["reason"]) for x in spark.range(1).select(registry.compiled(schema, F.lit(json.dumps(payload))).alias("x")).first()["x"]]


def test_payload_schemas(spark):
    assert violations(spark, SCHEMA, {"level": 5}) == []
    assert violations(spark, SCHEMA, {"level": 5.0, "more": 1}) == []
    assert [f for f, _ in violations(spark, SCHEMA, {"level": "not-an-int"})] == ["level"]
    assert violations(spark, SCHEMA, {}) == [("level", "is required")]
    rich = {"type": "object", "additionalProperties": False, "properties": {"a": {"enum": ["x", 1, None]}, "b": {"type": "array", "items": {"type": "number", "minimum": 0}, "maxItems": 2}, "c": {"type": "object", "properties": {"d": {"type": "string", "pattern": "^k", "minLength": 2}}}}}
    assert violations(spark, rich, {"a": "x", "b": [1, 2.5], "c": {"d": "kk"}}) == []
    assert violations(spark, rich, {"a": None}) == []
    bad = {"a": "y", "b": [1, -1, 3], "c": {"d": "z"}, "e": 1}
    assert sorted(f for f, _ in violations(spark, rich, bad)) == ["(root)", "a", "b", "b[1]", "c.d", "c.d"]


KEYWORD_CASES = [
    ({"anyOf": [{"type": "string"}, {"type": "integer", "minimum": 3}]}, ["x", 3], [2, None, 1.5]),
    ({"oneOf": [{"multipleOf": 3}, {"multipleOf": 5}]}, [9, 10], [15, 7]),
    ({"allOf": [{"minLength": 2}, {"pattern": "^a"}]}, ["ab", 5], ["a", "bc"]),
    ({"not": {"type": "null"}}, [0, "x"], [None]),
    ({"multipleOf": 0.5}, [1.5, 2], [0.7]),
    ({"uniqueItems": True}, [[1, 2, "1"], []], [[1, 2, 1], [{"a": 1}, {"a": 1}]]),
    ({"contains": {"const": 7}}, [[1, 7], "x"], [[1], []]),
    ({"const": {"a": [1, 2], "b": None}}, [{"b": None, "a": [1, 2]}], [{"a": [2, 1], "b": None}, {"a": [1, 2]}]),
    ({"enum": [[1], {"k": "v"}, "s"]}, [[1], {"k": "v"}, "s"], [[2], {"k": "w"}, 1]),
    ({"additionalProperties": {"type": "integer"}, "properties": {"n": {"type": "string"}}}, [{"n": "x", "m": 1}, {}], [{"m": "x"}, {"n": 1}]),
    ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"a": 1, "b": 2, "c": 3}]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"ab": 1}, {}], [{"A": 1}]),
    ({"dependentRequired": {"card": ["name"]}}, [{"card": 1, "name": 2}, {"name": 1}], [{"card": 1}]),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, [{"a": 1, "b": 1}, {"c": 1}], [{"a": 1}, {"b": 1}]),
    ({"$defs": {"even": {"multipleOf": 2}}, "properties": {"n": {"$ref": "#/$defs/even"}}}, [{"n": 4}, {}], [{"n": 3}]),
    ({"items": {"items": {"type": "integer"}}}, [[[1], [2, 3]], [[]]], [[[1], ["x"]]]),
    ({"properties": {"a": False}}, [{"b": 1}], [{"a": 1}]),
    ({"format": "date-time"}, ["2024-02-29T23:59:58.5Z", 5], ["2024-02-30 10:00", "2024-13-01T00:00:00Z"]),
    ({"format": "email"}, ["a@b.example"], ["a b@c", "a@"]),
    ({"format": "ipv4"}, ["10.0.255.1"], ["10.0.256.1", "1.2.3"]),
    ({"format": "uri"}, ["https://x.example/a"], ["no scheme"]),
]


def test_schema_keywords(spark):
    from pyspark.sql import Row

    for schema, good, bad in KEYWORD_CASES:
        rows = [Row(k=k, payload=json.dumps(x)) for k, x in enumerate([*good, *bad])]
        got = spark.createDataFrame(rows).select("k", F.size(registry.compiled(schema, F.col("payload"))).alias("n")).collect()
        assert [r["n"] > 0 for r in sorted(got)] == [False] * len(good) + [True] * len(bad), schema


def test_items_are_named_by_their_places(spark):
    assert violations(spark, {"properties": {"b": {"items": {"properties": {"c": {"type": "integer"}}}}}}, {"b": [{"c": 1}, {"c": "x"}]}) == [("b[1].c", "must be integer")]


def test_more_schemas_than_a_plan_holds(spark):
    """Every event meets its own schema, whether one plan holds all of them or many do."""
    pairs = [(f"p{k}", json.dumps({"properties": {"n": {"minimum": k}}})) for k in range(40)]
    schemas = spark.createDataFrame([(p, "t", s) for p, s in pairs] + [("p0", "u", pairs[3][1])], "project_id string, event_type string, json_schema string")
    events = spark.createDataFrame([(f"p{k}", "t", json.dumps({"n": n})) for k in range(42) for n in (k - 1, k)] + [("p0", "u", '{"n": 2}'), (None, None, None)], "project_id string, type string, payload string")
    order = lambda df: sorted(((r["project_id"] or "", r["type"] or "", r["payload"] or "", r["registered"], len(r["violations"])) for r in df.collect()))
    one = order(registry.validated(events, schemas))
    assert one == order(registry.validated(events, schemas, plan_schemas=6))
    assert sum(n for *_, n in one) == 41 and sum(not r[3] for r in one) == 5


def test_unsupported_keywords_are_refused():
    for bad in ({"oneOf": []}, {"type": "date"}, {"properties": {"a": {"format": "colour"}}}, {"patternProperties": {}}, {"items": {"$ref": "#"}}, {"$ref": "https://x.example"}, {"multipleOf": 0}, [1]):
        with pytest.raises(ValueError):
            registry.check_schema(bad)


def dims(spark):
    secret = F.sha2(F.lit("secret"), 256)
    ts = lambda s: F.lit(s).cast("timestamp")
    keys = spark.createDataFrame([("1", "game-1", "cas_a", None), ("2", "game-1", "cas_old", "2026-01-01 00:00:00")], "id string, project_id string, prefix string, revoked string")
    keys = keys.select("id", "project_id", "prefix", secret.alias("hash"), F.col("revoked").cast("timestamp").alias("revoked_at"))
    schemas = spark.createDataFrame([("1", "game-1", "level_complete", json.dumps(SCHEMA))], "id string, project_id string, event_type string, json_schema string").withColumns({"created_at": ts("2026-01-01"), "updated_at": ts("2026-01-01")})
    return keys, schemas


def test_verdicts(spark):
    cases = [
        (None, '{"type":"level_complete","payload":{"level":1}}', True, 401, []),
        ("cas_a.wrong", '{"type":"level_complete","payload":{"level":1}}', True, 401, []),
        ("cas_old.secret", '{"type":"level_complete","payload":{"level":1}}', True, 401, []),
        ("cas_a.secret", '{"payload":{"level":1}}', True, 400, ["type"]),
        ("cas_a.secret", '{"type":"level_complete","payload":{"level":1}}', True, 202, []),
        ("cas_a.secret", '{"type":"level_complete","payload":{"level":"x"}}', True, 400, ["level"]),
        ("cas_a.secret", '{"type":"mystery"}', True, 422, []),
        (None, "junk", False, 429, []),
    ]
    stamp = datetime(2026, 5, 30, tzinfo=timezone.utc)
    df = spark.createDataFrame([("t", 0, k, key, value, ok, stamp) for k, (key, value, ok, *_) in enumerate(cases)], "topic string, partition int, offset long, api_key string, value string, allowed boolean, received_at timestamp")
    keys, schemas = dims(spark)
    got = ingest.decided(df, keys, schemas, "allowed").orderBy("offset").collect()
    assert [r["status"] for r in got] == [c[3] for c in cases]
    assert [[e["field"] for e in r["errors"]] for r in got] == [c[4] for c in cases]
    good, bad = ingest.ingest(df, keys, schemas, "allowed")
    event = good.collect()
    assert len(event) == 1 and bad.count() == len(cases) - 1
    assert event[0]["occurred_at"] == event[0]["received_at"] and event[0]["project_id"] == "game-1"
    assert [r["event_id"] for r in ingest.ingest(df, keys, schemas, "allowed")[0].collect()] == [event[0]["event_id"]]


def test_registry_upsert_and_projects(spark):
    _, schemas = dims(spark)
    newer = schemas.withColumns({"json_schema": F.lit("{}"), "updated_at": F.lit("2026-02-01").cast("timestamp")})
    assert [r["json_schema"] for r in registry.register(schemas, newer).collect()] == ["{}"]
    projects = spark.createDataFrame([("other",)], "id string")
    kept, rejected = registry.known_projects(schemas, projects)
    assert kept.count() == 0 and rejected.count() == 1
    assert registry.listed(schemas, "game-1").count() == 1


def test_dead_letters(spark):
    good, bad = envelope.split(values(spark, [change(), "this-is-not-json", change()]))
    assert good.count() == 2
    letter = deadletter.of_invalid(bad, F.current_timestamp()).first()
    assert (letter["error"]["kind"], letter["attempts"], letter["originalValue"], letter["originalEvent"]) == ("validation", 1, "this-is-not-json", None)
    failed = deadletter.of_failed(good, F.lit(change()), "down", F.current_timestamp())
    again = deadletter.replayable(failed.unionByName(deadletter.of_invalid(bad, F.current_timestamp()))).collect()
    assert [r["key"] for r in again] == [BASE["projectId"]] * 2 and json.loads(again[0]["value"])["eventId"] == BASE["eventId"]
    assert deadletter.message_key(failed).first()["key"] == BASE["projectId"]
    assert {r["kind"]: r["n"] for r in deadletter.triage(failed.unionByName(deadletter.of_invalid(bad, F.current_timestamp()))).collect()} == {"persistence": 2, "validation": 1}
