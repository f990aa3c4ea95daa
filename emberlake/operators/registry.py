"""The schema registry: upsert, lookup, and JSON Schemas compiled into Spark predicates.

Each different schema text is turned into an expression over a VARIANT payload, and an event meets only the expression
of its own schema. A plan holds a limited number of expressions: where the registry has more, events are dealt by schema
into as many parts as are needed, each with a plan of its own. Keywords that can't be compiled are refused at registration.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from emberlake.functions.binding import let
from emberlake.operators import dedup
from emberlake.operators.envelope import ISSUES, is_number
from emberlake.sources import shared

#: A plan holds the predicates of about so many schemas.
PLAN_SCHEMAS = 200
IGNORED = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "$defs", "readOnly", "writeOnly", "deprecated"}
NUMBERS = {"minimum": lambda x, k: x < k, "maximum": lambda x, k: x > k, "exclusiveMinimum": lambda x, k: x <= k, "exclusiveMaximum": lambda x, k: x >= k, "multipleOf": lambda x, k: x / k != F.floor(x / k)}
TEXTS = {"minLength": lambda x, k: F.length(x) < k, "maxLength": lambda x, k: F.length(x) > k, "pattern": lambda x, k: ~x.rlike(k), "format": lambda x, k: ~x.rlike(FORMATS[k])}
SIZES = {"minItems": lambda x, k: F.size(x) < k, "maxItems": lambda x, k: F.size(x) > k}
KEYS = {"minProperties": lambda x, k: F.size(x) < k, "maxProperties": lambda x, k: F.size(x) > k}
LISTS, ONE = ("anyOf", "oneOf", "allOf"), ("not", "if", "then", "else", "items", "contains", "propertyNames")
KEYWORDS = {"type", "properties", "required", "additionalProperties", "dependentRequired", "enum", "const", "uniqueItems", "$ref", *NUMBERS, *TEXTS, *SIZES, *KEYS, *LISTS, *ONE}
TYPES = {"object", "array", "string", "number", "integer", "boolean", "null"}
#: What a text of each format looks like.
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(Z|[+-]\d{2}:\d{2})$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$",
    "email": r"^[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "hostname": r"^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$",
}


def register(schemas: DataFrame, new: DataFrame) -> DataFrame:
    """The latest schema of each project and event type."""
    return dedup.last_write(schemas.unionByName(new), ["project_id", "event_type"], ["updated_at", "id"])


def known_projects(rows: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known projects, and the others."""
    ids = projects.select(F.col("id").alias("project_id"))
    return rows.join(ids, "project_id", "left_semi"), rows.join(ids, "project_id", "left_anti")


def listed(schemas: DataFrame, project_id: str) -> DataFrame:
    return schemas.filter(F.col("project_id") == project_id).orderBy("event_type")


def _resolved(schema: Mapping, root: Mapping, where: str, seen: tuple[str, ...]) -> tuple[Mapping, tuple[str, ...]]:
    """The schema that a local ``$ref`` points at; a reference that leads back to itself has no finite predicate."""
    while "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen:
            raise ValueError(f"{where}: {ref} refers to itself")
        if not ref.startswith("#"):
            raise ValueError(f"{where}: only references inside the schema are supported")
        seen, schema = (*seen, ref), root
        for step in ref.lstrip("#").split("/")[1:]:
            if not isinstance(schema, Mapping) or step not in schema:
                raise ValueError(f"{where}: {ref} is not there")
            schema = schema[step]
    return schema, seen


def check_schema(schema: object, where: str = "#", root: Mapping | None = None, seen: tuple[str, ...] = ()) -> Mapping:
    """The schema itself; ValueError names the first keyword or value that isn't supported."""
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, Mapping):
        raise ValueError(f"{where}: a schema is an object, true or false")
    root = schema if root is None else root
    own, (schema, seen) = schema, _resolved(schema, root, where, seen)
    if isinstance(schema, bool):
        return own
    if unknown := set(schema) - KEYWORDS - IGNORED:
        raise ValueError(f"{where}: keywords {sorted(unknown)} are not supported")
    kinds = schema.get("type", [])
    if bad := set([kinds] if isinstance(kinds, str) else kinds) - TYPES:
        raise ValueError(f"{where}: types {sorted(bad)} are unknown")
    if schema.get("format", "date") not in FORMATS:
        raise ValueError(f"{where}: format {schema['format']} is not supported")
    if schema.get("multipleOf", 1) <= 0:
        raise ValueError(f"{where}: multipleOf is above 0")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    below = lambda s, name: check_schema(s, f"{where}/{name}", root, seen)
    for name, s in schema.get("properties", {}).items():
        if not re.fullmatch(r"[^'\"\[\]\\]+", name):
            raise ValueError(f"{where}: property {name!r} can't be addressed")
        below(s, name)
    if "additionalProperties" in schema:
        below(schema["additionalProperties"], "*")
    for word in ONE:
        if word in schema:
            below(schema[word], word)
    for word in LISTS:
        for k, s in enumerate(schema.get(word, [])):
            below(s, f"{word}/{k}")
        if word in schema and not schema[word]:
            raise ValueError(f"{where}: {word} is empty")
    return own


def _is(of: Column, v: Column, name: str) -> Column:
    number = F.try_variant_get(v, "$", "double")
    return {
        "object": of.startswith("OBJECT"),
        "array": of.startswith("ARRAY"),
        "string": of == "STRING",
        "boolean": of == "BOOLEAN",
        "null": of == "VOID",
        "number": is_number(of),
        "integer": is_number(of) & (number == F.floor(number)),  # by value: 1.0 is an integer
    }[name]


def _equals(of: Column, v: Column, value: object) -> Column:
    if value is None:
        return of == "VOID"
    if isinstance(value, bool):
        return (of == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return is_number(of) & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return (of == "STRING") & (F.try_variant_get(v, "$", "string") == value)
    # objects and arrays by their JSON, in which a variant's keys are in order; numbers inside them by how they are written
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(False))


class _Compiler:
    """Rules of one schema, as columns."""

    def __init__(self, root: Mapping):
        self.root = root

    def fits(self, schema: Mapping | bool, v: Column, seen: tuple[str, ...]) -> Column:
        """Whether the value fits, without saying why not; an absent value does."""
        rules, arrays = self.rules(schema, v, F.lit(""), seen)
        return ~_any([bad for bad, *_ in rules] + [F.size(a) > 0 for a in arrays])

    def found(self, schema: Mapping | bool, v: Column, path: Column, seen: tuple[str, ...] = ()) -> Column:
        """All violations as an array of structs (field, reason)."""
        rules, arrays = self.rules(schema, v, path, seen)
        own = [F.when(F.coalesce(bad, F.lit(False)), F.struct(at.alias("field"), F.lit(reason).alias("reason"))) for bad, at, reason in rules]
        none = F.lit(None).cast("struct<field:string,reason:string>")
        return F.concat(F.filter(F.array(*own, none), lambda x: x.isNotNull()).cast(ISSUES), *arrays)

    def rules(self, schema: Mapping | bool, v: Column, path: Column, seen: tuple[str, ...]) -> tuple[list[tuple[Column, Column, str]], list[Column]]:
        """Rules (condition that breaks it, field, reason) and arrays of violations of items; ``v`` is the value, null if it
        is absent (then nothing applies)."""
        out: list[tuple[Column, Column, str]] = []
        arrays: list[Column] = []
        if not isinstance(schema, bool):
            schema, seen = _resolved(schema, self.root, "#", seen)
        if isinstance(schema, bool):
            return ([] if schema else [(v.isNotNull(), path, "boolean schema is false")]), []
        of = F.schema_of_variant(v)
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        items, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
        is_array, is_object = of.startswith("ARRAY"), of.startswith("OBJECT")
        shown = F.when(path == "", F.lit("(root)")).otherwise(path)
        at = lambda name: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
        below = lambda name: F.try_variant_get(v, f"$['{name}']", "variant")

        def rule(bad: Column, reason: str, field: Column = shown) -> None:
            out.append((v.isNotNull() & bad, field, reason))

        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            rule(~_any([_is(of, v, name) for name in names]), f"must be {' or '.join(names)}")
        if "const" in schema:
            rule(~_any([_equals(of, v, schema["const"])]), "must be equal to constant")
        if "enum" in schema:
            rule(~_any([_equals(of, v, value) for value in schema["enum"]]), "must be equal to one of the allowed values")
        for kinds, able, value in ((NUMBERS, is_number(of), number), (TEXTS, of == "STRING", text), (SIZES, is_array, items), (KEYS, is_object, fields)):
            for word in kinds:
                if word in schema:
                    rule(able & kinds[word](value, schema[word]), f"{word} {schema[word]}")
        if schema.get("uniqueItems"):
            rule(is_array & (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items)), "must NOT have duplicate items")
        if "contains" in schema:
            rule(is_array & ~F.exists(items, lambda x: self.fits(schema["contains"], x, seen)), "must contain a valid item")
        if "items" in schema:
            own = F.transform(items, lambda x, k: self.found(schema["items"], x, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), seen))
            arrays.append(F.when(v.isNotNull() & is_array, F.flatten(own)).otherwise(F.array().cast(ISSUES)))
        for name in schema.get("required", []):
            rule(is_object & below(name).isNull(), "is required", at(name))
        for name, others in schema.get("dependentRequired", {}).items():
            for other in others:
                rule(is_object & below(name).isNotNull() & below(other).isNull(), f"is required with {name}", at(other))
        known = schema.get("properties", {})
        more = schema.get("additionalProperties", True)
        others = F.filter(F.map_keys(fields), lambda k: ~k.isin(list(known))) if known else F.map_keys(fields)
        if more is False:
            rule(is_object & (F.size(others) > 0), "must NOT have additional properties")
        elif more is not True:
            rule(is_object & F.exists(others, lambda k: ~self.fits(more, F.try_element_at(fields, k), seen)), "additional properties must match")
        if "propertyNames" in schema:
            name_of = lambda k: F.try_variant_get(F.to_variant_object(F.array(k)), "$[0]", "variant")
            rule(is_object & F.exists(F.map_keys(fields), lambda k: ~self.fits(schema["propertyNames"], name_of(k), seen)), "property names must match")
        for name, part in known.items():
            rules, lists = self.rules(part, below(name), at(name), seen)
            out += rules
            arrays += lists
        for part in schema.get("allOf", []):
            rules, lists = self.rules(part, v, path, seen)
            out += rules
            arrays += lists
        if "anyOf" in schema:
            rule(~_any([self.fits(s, v, seen) for s in schema["anyOf"]]), "must match a schema in anyOf")
        if "oneOf" in schema:
            rule(functools.reduce(Column.__add__, (self.fits(s, v, seen).cast("int") for s in schema["oneOf"])) != 1, "must match exactly one schema in oneOf")
        if "not" in schema:
            rule(self.fits(schema["not"], v, seen), "must NOT be valid")
        if "if" in schema:
            holds = self.fits(schema["if"], v, seen)
            if "then" in schema:
                rule(holds & ~self.fits(schema["then"], v, seen), "must match then")
            if "else" in schema:
                rule(~holds & ~self.fits(schema["else"], v, seen), "must match else")
        return out, arrays


def compiled(schema: Mapping | bool | str, payload: Column) -> Column:
    """All violations of a JSON payload (text) as an array of structs (field, reason)."""
    schema = check_schema(json.loads(schema) if isinstance(schema, str) else schema)
    return let(F.try_parse_json(payload), lambda v: _Compiler(schema).found(schema, v, F.lit("")))


def _compiled_case(schema: Column, texts: list[tuple[str, str]], payload: Column) -> Column:
    found = F.when(schema.isNull(), F.array().cast(ISSUES))
    for key, text in texts:
        found = found.when(schema == key, compiled(text, payload))
    return found


def validated(events: DataFrame, schemas: DataFrame, plan_schemas: int = PLAN_SCHEMAS) -> DataFrame:
    """``events`` with ``registered`` and ``violations``, by the schema of their project and type.

    Schema texts come to the driver as plans need them, at most about ``plan_schemas`` at once. ``schemas`` has one row
    for each project and type, as ``register`` leaves it; Spark broadcasts it by its size.
    """
    keyed = schemas.select(F.col("project_id").alias("__project"), F.col("event_type").alias("__type"), "json_schema", F.md5("json_schema").alias("__schema"))
    joined = events.join(keyed.drop("json_schema"), (F.col("project_id") == F.col("__project")) & (F.col("type") == F.col("__type")), "left")
    different = keyed.select("__schema", "json_schema").distinct()
    out = lambda rows, texts: rows.withColumns({"registered": F.col("__schema").isNotNull(), "violations": _compiled_case(F.col("__schema"), texts, F.col("payload"))})
    some = different.limit(plan_schemas + 1).collect()
    if len(some) <= plan_schemas:
        return out(joined, sorted((r["__schema"], r["json_schema"]) for r in some)).drop("__project", "__type", "__schema")
    parts = -(-different.count() // plan_schemas)
    # more schemas than a plan should hold: events are written by parts of schemas, and each part has its own plan
    part = lambda key: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    path = shared.new_path(events.sparkSession, "by-schema")
    joined.withColumn("__part", F.coalesce(part("__schema"), F.lit(-1))).write.partitionBy("__part").parquet(path)
    stored = events.sparkSession.read.schema(StructType([*joined.schema.fields, StructField("__part", IntegerType())])).parquet(path)
    known = shared.written(different.withColumn("__part", part("__schema")).orderBy("__part"), "schemas")
    union = []
    for k in range(-1, parts):
        texts = [(r["__schema"], r["json_schema"]) for r in known.filter(F.col("__part") == k).orderBy("__schema").collect()]
        union.append(out(stored.filter(F.col("__part") == k), texts).drop("__project", "__type", "__schema", "__part"))
    return functools.reduce(DataFrame.unionByName, union)
