"""JSON Schema compiled to one column over VARIANT: what a document breaks, as a list of `path: keyword`.

Each keyword becomes an expression of the value at hand, lists become higher-order functions over their elements, `$ref` is followed when compiling. A document is
parsed once; a schema of any size is one projection, without Python on the rows. Known keywords: type, enum, const, required, properties, additionalProperties,
items, minItems, maxItems, uniqueItems, minLength, maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, allOf, anyOf, oneOf, not, if, then, else,
$ref to $defs. Other keywords say nothing about validity and are passed over; a recursive $ref is an error.

As the standard has it, a keyword says nothing about values of another type: `minLength` holds for a number. A null column is no document and gives a null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<string>"
#: Prefixes of what schema_of_variant says of a value, by JSON type.
_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}


class Compiler:
    def __init__(self, schema: dict | bool):
        self.root, self.open = schema, []

    def errors(self, value: Column) -> Column:
        """The broken keywords of a VARIANT."""
        return F.when(value.isNotNull(), self.of(self.root, value, F.lit("$")))

    def of(self, schema: dict | bool, v: Column, path: Column) -> Column:
        if isinstance(schema, bool):
            return self.list() if schema else self.broken(F.lit(True), path, "false")
        parts = [getattr(self, f"_{name.lstrip('$')}")(schema[name], v, path, schema) for name in schema if hasattr(self, f"_{name.lstrip('$')}")]
        return F.concat(*parts) if parts else self.list()

    def holds(self, schema: dict | bool, v: Column) -> Column:
        return F.size(self.of(schema, v, F.lit(""))) == 0

    @staticmethod
    def list(*items: Column) -> Column:
        return F.array(*items).cast(_NONE)

    def broken(self, test: Column, path: Column, keyword: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), self.list(F.concat(path, F.lit(f": {keyword}")))).otherwise(self.list())

    @staticmethod
    def kind(v: Column) -> Column:
        return F.schema_of_variant(v)

    def is_a(self, v: Column, name: str) -> Column:
        """Whether a value has a JSON type; whole decimals count as integers."""
        if name in _TYPES:
            return F.startswith(self.kind(v), F.lit(_TYPES[name]))
        number = self.kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return number if name == "number" else number & (self.number(v) == F.floor(self.number(v)))

    @staticmethod
    def number(v: Column) -> Column:
        return F.try_variant_get(v, "$", "double")

    @staticmethod
    def string(v: Column) -> Column:
        return F.try_variant_get(v, "$", "string")

    @staticmethod
    def member(v: Column, name: str) -> Column:
        if "'" in name:
            return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), name)
        return F.try_variant_get(v, f"$['{name}']", "variant")

    @staticmethod
    def elements(v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    def names(self, v: Column) -> Column:
        return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))

    @staticmethod
    def text(v: Column) -> Column:
        """Equal values have equal texts."""
        return F.to_json(v)

    def among(self, v: Column, values: list) -> Column:
        texts = [F.to_json(F.parse_json(F.lit(json.dumps(x)))) for x in values]
        return F.coalesce(F.array_contains(F.array(*texts), self.text(v)), F.lit(False))

    def _type(self, want, v, path, _):
        tests = [self.is_a(v, w) for w in ([want] if isinstance(want, str) else want)]
        any_ = tests[0]
        for t in tests[1:]:
            any_ = any_ | t
        return self.broken(~any_, path, "type")

    def _enum(self, values, v, path, _):
        return self.broken(~self.among(v, values), path, "enum")

    def _const(self, value, v, path, _):
        return self.broken(~self.among(v, [value]), path, "const")

    def _required(self, names, v, path, _):
        there = self.names(v)
        return F.when(self.is_a(v, "object"), F.concat(*[self.broken(~F.array_contains(there, n), path, f"required {n}") for n in names])).otherwise(self.list()) if names else self.list()

    def _properties(self, schemas, v, path, _):
        parts = []
        for name, schema in schemas.items():
            member = self.member(v, name)
            parts.append(F.when(self.is_a(v, "object") & F.array_contains(self.names(v), name), self.of(schema, member, F.concat(path, F.lit(f".{name}")))).otherwise(self.list()))
        return F.concat(*parts) if parts else self.list()

    def _additionalProperties(self, schema, v, path, whole):  # noqa: N802
        known = F.array(*[F.lit(n) for n in whole.get("properties", {})]).cast(_NONE)
        more = F.array_sort(F.array_except(self.names(v), known))
        if schema is False:
            found = F.transform(more, lambda n: F.concat(path, F.lit("."), n, F.lit(": additionalProperties")))
        else:
            entries = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~F.array_contains(known, e["key"]))
            found = F.flatten(F.transform(entries, lambda e: self.of(schema, e["value"], F.concat(path, F.lit("."), e["key"]))))
        return F.when(self.is_a(v, "object"), found).otherwise(self.list())

    def _items(self, schema, v, path, _):
        each = F.transform(self.elements(v), lambda x, i: self.of(schema, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(self.is_a(v, "array"), F.flatten(each)).otherwise(self.list())

    def _bound(self, kind: str, test: Column, v: Column, path: Column, keyword: str) -> Column:
        return self.broken(self.is_a(v, kind) & test, path, keyword)

    def _minItems(self, n, v, path, _):  # noqa: N802
        return self._bound("array", F.size(self.elements(v)) < n, v, path, "minItems")

    def _maxItems(self, n, v, path, _):  # noqa: N802
        return self._bound("array", F.size(self.elements(v)) > n, v, path, "maxItems")

    def _uniqueItems(self, on, v, path, _):  # noqa: N802
        texts = F.transform(self.elements(v), self.text)
        return self._bound("array", F.size(F.array_distinct(texts)) < F.size(texts), v, path, "uniqueItems") if on else self.list()

    def _minLength(self, n, v, path, _):  # noqa: N802
        return self._bound("string", F.char_length(self.string(v)) < n, v, path, "minLength")

    def _maxLength(self, n, v, path, _):  # noqa: N802
        return self._bound("string", F.char_length(self.string(v)) > n, v, path, "maxLength")

    def _pattern(self, pattern, v, path, _):
        return self._bound("string", ~self.string(v).rlike(pattern), v, path, "pattern")

    def _minimum(self, n, v, path, _):
        return self._bound("number", self.number(v) < n, v, path, "minimum")

    def _maximum(self, n, v, path, _):
        return self._bound("number", self.number(v) > n, v, path, "maximum")

    def _exclusiveMinimum(self, n, v, path, _):  # noqa: N802
        return self._bound("number", self.number(v) <= n, v, path, "exclusiveMinimum")

    def _exclusiveMaximum(self, n, v, path, _):  # noqa: N802
        return self._bound("number", self.number(v) >= n, v, path, "exclusiveMaximum")

    def _allOf(self, schemas, v, path, _):  # noqa: N802
        return F.concat(*[self.of(s, v, path) for s in schemas])

    def _count(self, schemas: list, v: Column) -> Column:
        return sum((self.holds(s, v).cast("int") for s in schemas[1:]), self.holds(schemas[0], v).cast("int"))

    def _anyOf(self, schemas, v, path, _):  # noqa: N802
        return self.broken(self._count(schemas, v) == 0, path, "anyOf")

    def _oneOf(self, schemas, v, path, _):  # noqa: N802
        return self.broken(self._count(schemas, v) != 1, path, "oneOf")

    def _not(self, schema, v, path, _):
        return self.broken(self.holds(schema, v), path, "not")

    def _if(self, schema, v, path, whole):
        return F.when(self.holds(schema, v), self.of(whole.get("then", True), v, path)).otherwise(self.of(whole.get("else", True), v, path))

    def _ref(self, ref, v, path, _):
        if ref in self.open:
            raise ValueError(f"{ref} refers to itself")
        schema = self.root
        for step in ref.removeprefix("#/").split("/"):
            schema = schema[step]
        self.open.append(ref)
        try:
            return self.of(schema, v, path)
        finally:
            self.open.pop()


def schema_errors(document: Column, schema: dict | bool) -> Column:
    """What a JSON text breaks of a schema, sorted; a text that is no JSON breaks `$: json`, a null gives a null."""
    parsed = F.try_parse_json(document)
    found = F.array_sort(Compiler(schema).errors(parsed))
    return F.when(document.isNotNull(), F.coalesce(found, F.array(F.lit("$: json"))))
