"""Keywords that lead from one schema to others, in every mode, against brute force."""

import json
import random

import pytest

from brute import primary, violations
from test_validate import MODES, calls_of, verdicts_of
from callsieve.operators.nodes import shred_calls
from callsieve.operators.schemas import compile_schemas, schema_catalog
from callsieve.operators.validate import violation_table

JOINED = {"broadcast": MODES["broadcast"], "salted": MODES["salted"]}
TREE = {
    "$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"items": {"$ref": "#/$defs/node"}}}, "required": ["v"]}},
    "$ref": "#/$defs/node",
}
LIST = {"properties": {"v": {"type": "string"}, "next": {"anyOf": [{"type": "null"}, {"$ref": "#"}]}}, "additionalProperties": False}
LINKS = {
    "$defs": {"a/b~c": {"type": "integer", "$anchor": "whole"}, "k %": {"minimum": 5}},
    "properties": {
        "a": {"items": {"type": "string"}},
        "b": {"$ref": "#/properties/a/items"},
        "c": {"$ref": "#/$defs/a~1b~0c"},
        "d": {"$ref": "#whole"},
        "e": {"$ref": "#/$defs/k%20%25"},
        "f": {"$ref": "#/components/text"},
        "g": {"$ref": "#/properties/f"},
        "h": {"$ref": "http://x.org/own#/properties/q"},
        "i": {"$id": "http://x.org/own", "properties": {"q": {"type": "boolean"}}},
    },
    "components": {"text": {"type": "string", "maxLength": 2}},
}
PATTERNS = {
    "properties": {"ab": {"type": "integer"}},
    "patternProperties": {"^a": {"type": ["integer", "string"]}, "b$": {"type": ["integer", "null"]}},
    "additionalProperties": {"type": "boolean"},
    "propertyNames": {"maxLength": 3, "pattern": "^[a-z]+$"},
}
CLOSED = {"properties": {"x": {}}, "patternProperties": {"^p": {"minimum": 1}}, "additionalProperties": False}
GUARDED = {
    "if": {"properties": {"kind": {"const": "card"}}, "required": ["kind"]},
    "then": {"required": ["number"], "properties": {"number": {"type": "string"}}},
    "else": {"properties": {"number": False}},
    "dependentRequired": {"number": ["expiry", "name"]},
    "dependentSchemas": {"expiry": {"properties": {"expiry": {"pattern": "^\\d\\d$"}}, "maxProperties": 4}},
}
LOOSE = {
    "allOf": [{"properties": {"a": {"type": "integer"}}}],
    "anyOf": [{"properties": {"b": {"type": "integer"}}, "required": ["b"]}, {"properties": {"c": {}}, "required": ["c"]}],
    "properties": {"z": {}},
    "unevaluatedProperties": False,
}
LOOSE_SCHEMA = {**LOOSE, "unevaluatedProperties": {"type": "string"}}
ELEMENTS = {
    "prefixItems": [{"type": "string"}, {"type": "integer"}],
    "items": {"type": "boolean"},
    "uniqueItems": True,
}
COUNTED = {"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}
LEFT = {"prefixItems": [{}], "contains": {"type": "string"}, "unevaluatedItems": {"type": "null"}}
NUMBERS = {"multipleOf": 0.1, "not": {"multipleOf": 7}}
CASES = [
    ('{"v":1,"kids":[{"v":2,"kids":[{"v":3}]},{"v":4}]}', TREE, None),
    ('{"v":1,"kids":[{"v":2,"kids":[{"v":"3"}]},{"v":4}]}', TREE, "type"),
    ('{"v":1,"kids":[{"v":2,"kids":[{}]}]}', TREE, "required"),
    ('{"v":"a","next":{"v":"b","next":{"v":"c","next":null}}}', LIST, None),
    ('{"v":"a","next":{"v":"b","next":{"v":3}}}', LIST, "anyOf"),
    ('{"a":["x"],"b":"x","c":1,"d":2,"e":5,"f":"ab","g":"ab","h":true}', LINKS, None),
    ('{"b":1}', LINKS, "type"),
    ('{"c":"1"}', LINKS, "type"),
    ('{"d":"1"}', LINKS, "type"),
    ('{"e":4}', LINKS, "minimum"),
    ('{"g":"abc"}', LINKS, "maxLength"),
    ('{"h":1}', LINKS, "type"),
    ('{"ab":1,"ax":"s","cb":null,"o":true}', PATTERNS, None),
    ('{"ab":"s"}', PATTERNS, "type"),
    ('{"axb":"s"}', PATTERNS, "type"),
    ('{"o":1}', PATTERNS, "type"),
    ('{"long":true}', PATTERNS, "maxLength"),
    ('{"p1":1,"x":0}', CLOSED, None),
    ('{"p1":0}', CLOSED, "minimum"),
    ('{"q":1}', CLOSED, "additionalProperties"),
    ('{"kind":"card","number":"1","expiry":"12","name":"n"}', GUARDED, None),
    ('{"kind":"card"}', GUARDED, "required"),
    ('{"kind":"cash","number":1,"expiry":"12","name":"n"}', GUARDED, "false"),
    ('{"kind":"card","number":"1","expiry":"12"}', GUARDED, "dependentRequired"),
    ('{"expiry":"1x"}', GUARDED, "pattern"),
    ('{"a":1,"b":2,"z":0}', LOOSE, None),
    ('{"a":1,"b":2,"c":0}', LOOSE, None),
    ('{"b":2,"q":0}', LOOSE, "unevaluatedProperties"),
    ('{"b":"x","c":0}', LOOSE, "unevaluatedProperties"),
    ('{"b":2,"q":"text"}', LOOSE_SCHEMA, None),
    ('{"b":2,"q":1}', LOOSE_SCHEMA, "type"),
    ('["a",1,true,false]', ELEMENTS, None),
    ('[1]', ELEMENTS, "type"),
    ('["a",1,2]', ELEMENTS, "type"),
    ('[{"a":1,"b":[2]},{"b":[2.0],"a":1}]', {"uniqueItems": True}, "uniqueItems"),
    ('[1,true,"1",[1],{"a":1}]', {"uniqueItems": True}, None),
    ('[1,"a",2]', COUNTED, None),
    ('["a"]', COUNTED, "contains"),
    ('["a",1]', COUNTED, "minContains"),
    ('[1,2,3,4]', COUNTED, "maxContains"),
    ('[5,"x",null]', LEFT, None),
    ('[5,"x",6]', LEFT, "type"),
    ("0.3", NUMBERS, None),
    ("0.35", NUMBERS, "multipleOf"),
    ("1e2", NUMBERS, None),
    ("70", NUMBERS, "not"),
    ("123456789012345678901234567890", {"multipleOf": 4}, "multipleOf"),
    ("123456789012345678901234567890", {"multipleOf": 10}, None),
]


@pytest.mark.parametrize("mode", MODES)
def test_labelled_cases(spark, mode):
    for row, (text, schema, keyword) in zip(verdicts_of(spark, CASES, **MODES[mode]), CASES):
        assert (row["keyword"], row["is_valid"]) == (keyword, keyword is None), (text, schema, row)
        found = primary(violations(json.loads(text), schema))
        assert found == ((row["path"], row["keyword"]) if keyword else None), text


def test_what_stays_undecided(spark):
    odd = {"$dynamicRef": "#x"}
    loop = {"$defs": {"a": {"allOf": [{"$ref": "#/$defs/b"}]}, "b": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}
    cases = [
        ("1", loop, ("unsupported_schema", None)),
        ("1", {**loop, "type": "string"}, ("invalid", False)),
        ("1", {"if": odd, "then": {"type": "string"}}, ("unsupported_schema", None)),
        ("1", {"if": odd, "then": {"type": "integer"}}, ("valid", True)),
        ("[1]", {"contains": odd}, ("unsupported_schema", None)),
        ("[1,2]", {"contains": odd, "minContains": 3}, ("invalid", False)),
        ("[]", {"contains": odd}, ("invalid", False)),
        ('{"a":1}', {"allOf": [{**odd, "properties": {"a": {}}}], "unevaluatedProperties": False}, ("unsupported_schema", None)),
        ('{"a":1}', {"anyOf": [{**odd, "properties": {"a": {}}}, {}], "unevaluatedProperties": False}, ("unsupported_schema", None)),
        ("1e30", {"multipleOf": 0.1}, ("unsupported_number", None)),
        ("[[1e2],[1e2]]", {"uniqueItems": True}, ("invalid", False)),
        ("[[1e2],[100]]", {"uniqueItems": True}, ("unsupported_number", None)),
        ("1", {"multipleOf": 0}, ("bad_schema", False)),
        ("1", {"if": 1}, ("bad_schema", False)),
        ("1", {"$defs": {"x": {"type": "nothing"}}}, ("bad_schema", False)),
        ("1", {"dependentRequired": {"a": "b"}}, ("bad_schema", False)),
        ("1", {"prefixItems": []}, ("bad_schema", False)),
        ('["a",1]', {"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "string"}], "additionalItems": False}, ("invalid", False)),
        ('["a"]', {"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "string"}], "additionalItems": False}, ("valid", True)),
        ("1", {"$schema": "http://json-schema.org/draft-07/schema#", "$defs": {"x": {}}, "$ref": "#/$defs/x", "type": "null"}, ("valid", True)),
        ('{"a":1}', {"$schema": "http://json-schema.org/draft-07/schema#", "dependencies": {"a": ["b"]}}, ("invalid", False)),
        ('{"a":1}', {"$schema": "http://json-schema.org/draft-07/schema#", "dependencies": {"a": {"maxProperties": 1}}}, ("valid", True)),
        ("[1]", {"items": [{}]}, ("unsupported_schema", None)),
    ]
    for mode in MODES.values():
        for row, (text, schema, expected) in zip(verdicts_of(spark, cases, **mode), cases):
            assert (row["status"], row["is_valid"]) == expected, (text, schema, row)


def _value(rng, depth=0):
    pick = rng.randrange(8 if depth < 3 else 5)
    if pick < 5:
        return rng.choice([0, 1, 2, 6, -3, 0.5, 1.0, "a", "ab", "", "b1", None, True, False])
    if pick == 5:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: _value(rng, depth + 1) for k in rng.sample(["a", "b", "ab", "b1", "c"], rng.randrange(5))}


KEYS = ["a", "b", "ab", "b1", "c"]


def _schema(rng, depth=0):
    out = {}

    def some(chance):
        return rng.random() < chance * (1 if depth < 2 else 0.3)

    def below():
        return rng.choice([True, False]) if rng.random() < 0.1 else _schema(rng, depth + 1)

    if rng.random() < 0.4:
        out["type"] = rng.sample(["string", "integer", "number", "boolean", "null", "array", "object"], rng.randrange(1, 5))
    if rng.random() < 0.15:
        out["multipleOf"] = rng.choice([0.5, 2, 3])
    if rng.random() < 0.15:
        out["minimum"] = rng.choice([0, 1, 2.5])
    if rng.random() < 0.15:
        out["maxLength"] = 1
    if depth > 3:
        return out
    for keyword, chance in (("allOf", 0.15), ("anyOf", 0.2), ("oneOf", 0.15), ("prefixItems", 0.2)):
        if some(chance):
            out[keyword] = [below() for _ in range(rng.randrange(1, 3))]
    for keyword, chance in (("not", 0.12), ("items", 0.25), ("contains", 0.2), ("propertyNames", 0.08), ("additionalProperties", 0.25)):
        if some(chance):
            out[keyword] = below()
    if some(0.25):
        out |= {"if": below(), "then": below(), "else": below()}
    if "contains" in out and rng.random() < 0.5:
        out |= {"minContains": rng.randrange(3), "maxContains": rng.randrange(1, 4)}
    if some(0.4):
        out["properties"] = {k: below() for k in rng.sample(KEYS, 2)}
    if some(0.2):
        out["patternProperties"] = {p: below() for p in rng.sample(["^a", "b", "1$"], 2)}
    if some(0.15):
        out["dependentSchemas"] = {rng.choice(KEYS): below()}
    if some(0.15):
        out["dependentRequired"] = {rng.choice(KEYS): rng.sample(KEYS, 2)}
    if some(0.2):
        out["unevaluatedProperties"] = below()
    if some(0.2):
        out["unevaluatedItems"] = below()
    if some(0.15):
        out["uniqueItems"] = True
    if some(0.2):
        out["$ref"] = rng.choice(["#/$defs/tree", "#leaf", "#/$defs/tree/properties/a"])
    if depth == 0:
        out["$defs"] = {
            "tree": {"properties": {"a": {"anyOf": [{"type": "integer"}, {"$ref": "#/$defs/tree"}]}, "b": {"items": {"$ref": "#"}}}},
            "leaf": {"$anchor": "leaf", "type": ["integer", "string", "array", "object", "null"]},
        }
    return out


def _without_loops(rng):
    """A schema in which no reference leads back to the same value."""
    while True:
        schema = _schema(rng)
        try:
            for value in (0, "a", [], [0], {}, {"a": 0, "b": [], "ab": {}, "b1": 0, "c": [0]}):
                violations(value, schema)
            return schema
        except RecursionError:
            continue


@pytest.mark.parametrize("mode", JOINED)
def test_random_schemas_against_brute_force(spark, mode):
    rng = random.Random(11)
    schemas = [_without_loops(rng) for _ in range(150)]
    cases = [(json.dumps(_value(rng)), rng.choice(schemas)) for _ in range(3000)]
    for row, (text, schema) in zip(verdicts_of(spark, cases, **JOINED[mode]), cases):
        expected = primary(violations(json.loads(text), schema))
        assert ((row["path"], row["keyword"]) if row["keyword"] else None) == expected, (text, schema, row)
        assert row["is_valid"] is (expected is None), (text, schema, row)
    calls = calls_of(spark, cases)
    found = violation_table(calls, schema_catalog(calls), **JOINED[mode])
    assert found.count() == sum(len(violations(json.loads(t), s)) for t, s in cases)


def test_one_definition_is_compiled_once(spark):
    one = {"type": "object", "properties": {"x": {"items": {"type": "integer"}}}}
    schema = {"$defs": {"d": one}, "properties": {f"p{i}": {"$ref": "#/$defs/d"} for i in range(100)}}
    catalog = schema_catalog(calls_of(spark, [("{}", schema)]))
    assert len(compile_schemas(catalog).first()["rules"]) == 1 + 100 + 3
    cases = [('{"p99":{"x":["1"]}}', schema), ('{"p0":{"x":[1]}}', schema)]
    assert [r["is_valid"] for r in verdicts_of(spark, cases)] == [False, True]


def test_chains_of_references(spark):
    defs = {f"d{i}": {"properties": {"n": {"$ref": f"#/$defs/d{i + 1}"}}} for i in range(20)} | {"d20": {"type": "integer"}}
    schema = {"$defs": defs, "$ref": "#/$defs/d0"}
    texts = ['{"n":' * 20 + leaf + "}" * 20 for leaf in ("1", '"x"')]
    for mode in MODES.values():
        rows = verdicts_of(spark, [(t, schema) for t in texts], **mode)
        assert [(r["is_valid"], r["path"]) for r in rows] == [(True, None), (False, ["n"] * 20)]


def test_deep_calls_of_a_recursive_schema(spark):
    depth = 400
    texts = ['{"v":"x","next":' * depth + end + "}" * depth for end in ("null", '{"v":1}')]
    rows = verdicts_of(spark, [(t, LIST) for t in texts])
    assert [(r["is_valid"], r["keyword"]) for r in rows] == [(True, None), (False, "anyOf")]
    nodes = shred_calls(calls_of(spark, [(texts[1], LIST)] + [("{}", LIST)] * 50)).selectExpr("size(path) AS n").collect()
    assert len(nodes) == 2 + 2 * depth + 50 and max(r["n"] for r in nodes) == depth + 1


def test_wide_calls(spark):
    schema = {"items": {"oneOf": [{"type": "integer"}, {"type": "string"}, {"minimum": 90_000}]}}
    texts = [json.dumps(list(range(n))) for n in (90_000, 90_001)]
    rows = verdicts_of(spark, [(t, schema) for t in texts], **MODES["broadcast"])
    assert [(r["is_valid"], r["path"]) for r in rows] == [(True, None), (False, ["90000"])]
