"""Compiled schemas: every keyword on documents that keep and break it, and a schema of records with conditions."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions.jsonschema import schema_errors

CASES = [
    ({"type": "string"}, '"a"', []), ({"type": "string"}, "1", ["$: type"]), ({"type": ["integer", "null"]}, "null", []), ({"type": "integer"}, "2.0", []), ({"type": "integer"}, "2.5", ["$: type"]),
    ({"type": "number"}, "true", ["$: type"]), ({"type": "object"}, "[]", ["$: type"]), ({"enum": ["a", 1, None]}, "1", []), ({"enum": ["a", 1]}, '"b"', ["$: enum"]), ({"const": {"x": [1]}}, '{"x":[1]}', []),
    ({"const": "failed"}, '"done"', ["$: const"]), ({"required": ["a", "b"]}, '{"a":1}', ["$: required b"]), ({"required": ["a"]}, "[]", []), ({"required": ["a"]}, '{"a":null}', []),
    ({"properties": {"a": {"type": "string"}}}, '{"a":1}', ["$.a: type"]), ({"properties": {"a": {"type": "string"}}}, "{}", []), ({"properties": {"a": {"type": "null"}}}, '{"a":null}', []),
    ({"properties": {"a": True}, "additionalProperties": False}, '{"a":1,"c":1,"b":2}', ["$.b: additionalProperties", "$.c: additionalProperties"]),
    ({"additionalProperties": {"type": "integer"}}, '{"a":1,"b":"x"}', ["$.b: type"]), ({"items": {"type": "integer", "minimum": 2}}, '[3,1,"x"]', ["$[1]: minimum", "$[2]: type"]), ({"items": False}, "[]", []),
    ({"minItems": 1}, "[]", ["$: minItems"]), ({"maxItems": 0}, "[1]", ["$: maxItems"]), ({"minItems": 1}, '"text"', []), ({"uniqueItems": True}, '[1,2,1]', ["$: uniqueItems"]), ({"minLength": 2}, '"é"', ["$: minLength"]),
    ({"maxLength": 2}, '"abc"', ["$: maxLength"]), ({"maxLength": 2}, "12345", []), ({"pattern": "^[a-z]+$"}, '"aB"', ["$: pattern"]), ({"maximum": 5}, "5", []), ({"exclusiveMaximum": 5}, "5", ["$: exclusiveMaximum"]),
    ({"exclusiveMinimum": 0}, "0", ["$: exclusiveMinimum"]), ({"allOf": [{"minimum": 1}, {"maximum": 0}]}, "0.5", ["$: maximum", "$: minimum"]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, "2", ["$: anyOf"]),
    ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "3", ["$: oneOf"]), ({"not": {"type": "null"}}, "null", ["$: not"]), ({"type": "string"}, "{", ["$: json"]), (False, "1", ["$: false"]), ({"title": "x"}, "1", []), ({"type": "string"}, None, None),
    ({"items": {"items": {"type": "integer"}}}, '[[1],["x",2,"y"]]', ["$[1][0]: type", "$[1][2]: type"]), ({"properties": {"a b'c": {"type": "null"}}}, '{"a b\'c": 1}', ["$.a b'c: type"]),
]


def test_keywords(spark):
    row = spark.range(1)
    for i in range(0, len(CASES), 8):
        part = CASES[i : i + 8]
        got = row.select(*[schema_errors(F.lit(doc).cast("string"), schema).alias(f"c{k}") for k, (schema, doc, _) in enumerate(part)]).first()
        for (schema, doc, want), found in zip(part, got, strict=True):
            assert found == want, (schema, doc)


RECORD = {
    "type": "object",
    "required": ["status", "pages", "blocks", "warnings"],
    "properties": {"status": {"enum": ["complete", "partial", "failed"]}, "pages": {"type": "array"}, "blocks": {"type": "array", "items": {"$ref": "#/$defs/Block"}}, "warnings": {"type": "array"}},
    "allOf": [
        {
            "if": {"properties": {"status": {"const": "failed"}}}, "then": {"properties": {"blocks": {"maxItems": 0}, "warnings": {"minItems": 1}}},
            "else": {"properties": {"pages": {"minItems": 1}, "blocks": {"minItems": 1}}},
        },
        {"if": {"properties": {"status": {"const": "partial"}}}, "then": {"properties": {"warnings": {"minItems": 1}}}},
    ],
    "$defs": {"Block": {"type": "object", "required": ["type"], "if": {"properties": {"type": {"const": "solution"}}}, "then": {"required": ["for_block_id"], "properties": {"visibility": {"const": "engine_only"}}}}},
}


def test_records_with_conditions(spark):
    good = {"status": "complete", "pages": [1], "blocks": [{"type": "text"}], "warnings": []}
    cases = [
        ({}, []), ({"status": "failed"}, ["$.blocks: maxItems", "$.warnings: minItems"]), ({"status": "failed", "blocks": [], "warnings": ["w"]}, []), ({"status": "partial"}, ["$.warnings: minItems"]), ({"pages": []}, ["$.pages: minItems"]),
        ({"status": "new"}, ["$.status: enum"]), ({"blocks": [{"type": "solution"}]}, ["$.blocks[0]: required for_block_id"]), ({"blocks": [{"type": "text"}, {"type": "solution", "for_block_id": "b", "visibility": "student"}]}, ["$.blocks[1].visibility: const"]),
        ({"blocks": [{}]}, ["$.blocks[0]: required for_block_id", "$.blocks[0]: required type"]),
    ]
    rows = spark.createDataFrame([(i, json.dumps({**good, **change})) for i, (change, _) in enumerate(cases)], "i int, doc string")
    got = {r.i: r.e for r in rows.select("i", schema_errors(F.col("doc"), RECORD).alias("e")).collect()}
    for i, (change, want) in enumerate(cases):
        assert got[i] == want, change


def test_recursive_references_are_refused(spark):
    with pytest.raises(ValueError):
        schema_errors(F.lit("1"), {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}})
