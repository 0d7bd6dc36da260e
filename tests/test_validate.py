import json
import random
import re

import pytest

from brute import CATEGORY, primary, strict_json, violations
from callsieve.operators.nodes import shred_calls
from callsieve.operators.salting import join_unique
from callsieve.operators.schemas import compile_schemas, constraint_table, schema_catalog, with_schema_id
from callsieve.operators.validate import validate_calls, violation_table

MODES = {
    "inline": {},
    "broadcast": {"inline_schemas": 0},
    "salted": {"inline_schemas": 0, "broadcast_bytes": 0},
}


def wrap(parameters, tool="create_task"):
    return json.dumps({"tool": tool, "parameters": parameters})


TASK = {
    "type": "object",
    "properties": {
        "tool": {"type": "string", "const": "create_task"},
        "parameters": {
            "type": "object",
            "properties": {
                "title": {"type": "string"},
                "priority": {"type": "string", "enum": ["low", "medium", "high"]},
                "limit": {"type": "integer"},
            },
            "required": ["title", "priority"],
            "additionalProperties": False,
        },
    },
    "required": ["tool", "parameters"],
    "additionalProperties": False,
}
NESTED = {
    "properties": {
        "parameters": {
            "properties": {
                "tags": {"type": "array", "items": {"type": "string"}},
                "grid": {"items": {"items": {"type": "integer", "maximum": 9}, "maxItems": 2}},
                "people": {"items": {"type": "object", "properties": {"age": {"minimum": 0}}, "required": ["age"]}},
                "geo": {
                    "type": "object",
                    "properties": {"lat": {"type": "number"}},
                    "required": ["lat"],
                    "additionalProperties": False,
                },
                "a.b": {"type": "integer"},
                "it's": {"type": "null"},
                "slash/*~": {"enum": ["x", 1, None]},
                "either": {"type": ["integer", "null"]},
                "fixed": {"const": None},
                "box": {"const": {"n": 1}},
                "code": {"type": "string", "pattern": "^[A-Z]{2}\\d+$", "maxLength": 5},
                "banned": False,
            },
            "maxProperties": 3,
        }
    }
}
BRANCHED = {
    "$defs": {"size": {"type": "integer", "minimum": 1}, "box": {"type": "object", "properties": {"w": {"$ref": "#/$defs/size"}}}},
    "properties": {
        "maybe": {"anyOf": [{"type": "string"}, {"type": "null"}]},
        "one": {"oneOf": [{"type": "integer"}, {"minimum": 5}]},
        "no": {"not": {"enum": ["x", 1]}},
        "both": {"allOf": [{"type": "integer"}, {"maximum": 9}]},
        "size": {"$ref": "#/$defs/size"},
        "box": {"$ref": "#/$defs/box", "required": ["w"]},
        "list": {"items": {"anyOf": [{"$ref": "#/$defs/box"}, {"type": "array", "items": {"not": {"type": "null"}}}]}},
        "map": {"properties": {"k": {}}, "additionalProperties": {"anyOf": [{"type": "integer"}, {"const": "all"}]}},
    },
    "additionalProperties": {"type": "boolean"},
}
TITLE = {"title": "t", "priority": "low"}
CASES = [
    (wrap(TITLE), TASK, None),
    (wrap({**TITLE, "priority": "urgent"}), TASK, "enum"),
    (wrap({**TITLE, "limit": "10"}), TASK, "type"),
    (wrap({**TITLE, "limit": True}), TASK, "type"),
    (wrap({**TITLE, "limit": 10.0}), TASK, None),
    ('{"tool":"create_task","parameters":{"title":"t","priority":"low","limit":1e2}}', TASK, None),
    (f'{{"tool":"create_task","parameters":{{"title":"t","priority":"low","limit":{"9" * 50}}}}}', TASK, None),
    (wrap({**TITLE, "zz": 1}), TASK, "additionalProperties"),
    (wrap({"title": "t"}), TASK, "required"),
    (wrap({**TITLE, "title": None}), TASK, "type"),
    (wrap(TITLE, "x"), TASK, "const"),
    (json.dumps(TITLE), TASK, "required"),
    ("[1]", TASK, "type"),
    ("null", TASK, "type"),
    (wrap({"tags": ["x", 5]}), NESTED, "type"),
    (wrap({"tags": "x"}), NESTED, "type"),
    (wrap({"tags": []}), NESTED, None),
    (wrap({"grid": [[1, 2], [3, 10]]}), NESTED, "maximum"),
    (wrap({"grid": [[1, 2, 3]]}), NESTED, "maxItems"),
    (wrap({"people": [{"age": 1}, {}]}), NESTED, "required"),
    (wrap({"people": [{"age": -1}]}), NESTED, "minimum"),
    (wrap({"geo": {"lat": "1"}}), NESTED, "type"),
    (wrap({"geo": {}}), NESTED, "required"),
    (wrap({"geo": {"lat": 1, "z": 1}}), NESTED, "additionalProperties"),
    (wrap({"a.b": "q"}), NESTED, "type"),
    (wrap({"it's": 1}), NESTED, "type"),
    (wrap({"slash/*~": 1.0}), NESTED, None),
    (wrap({"slash/*~": True}), NESTED, "enum"),
    (wrap({"slash/*~": "1"}), NESTED, "enum"),
    (wrap({"slash/*~": None}), NESTED, None),
    (wrap({"either": None}), NESTED, None),
    (wrap({"either": "1"}), NESTED, "type"),
    (wrap({"fixed": 0}), NESTED, "const"),
    (wrap({"fixed": None}), NESTED, None),
    (wrap({"box": {"n": 1.0}}), NESTED, None),
    (wrap({"box": {"n": "1"}}), NESTED, "const"),
    (wrap({"code": "AB12"}), NESTED, None),
    (wrap({"code": "ab12"}), NESTED, "pattern"),
    (wrap({"code": "AB1234"}), NESTED, "maxLength"),
    (wrap({"banned": 1}), NESTED, "false"),
    (wrap({"p": 1, "q": 1, "r": 1, "s": 1}), NESTED, "maxProperties"),
    ('{"maybe":null,"one":1,"no":2,"both":9,"size":1,"box":{"w":3},"list":[{"w":1},[1]],"map":{"k":"x","z":"all"}}',
     BRANCHED, None),
    ('{"maybe":1}', BRANCHED, "anyOf"),
    ('{"one":7}', BRANCHED, "oneOf"),
    ('{"one":0.5}', BRANCHED, "oneOf"),
    ('{"one":"x"}', BRANCHED, None),
    ('{"no":"x"}', BRANCHED, "not"),
    ('{"both":10}', BRANCHED, "maximum"),
    ('{"both":"10"}', BRANCHED, "type"),
    ('{"size":0}', BRANCHED, "minimum"),
    ('{"box":{"w":0}}', BRANCHED, "minimum"),
    ('{"box":{}}', BRANCHED, "required"),
    ('{"list":[{"w":0}]}', BRANCHED, "anyOf"),
    ('{"list":[[null]]}', BRANCHED, "anyOf"),
    ('{"map":{"k":1,"z":"some"}}', BRANCHED, "anyOf"),
    ('{"other":1}', BRANCHED, "type"),
    ('{"other":true}', BRANCHED, None),
]


def calls_of(spark, cases):
    rows = [(i, c[0], json.dumps(c[1]) if c[1] is not None else None) for i, c in enumerate(cases)]
    return with_schema_id(spark.createDataFrame(rows, "i int, call string, schema string"))


def verdicts_of(spark, cases, **limits):
    calls = calls_of(spark, cases)
    out = validate_calls(calls, schema_catalog(calls), **limits)
    return sorted(out.collect(), key=lambda r: r["i"])


@pytest.mark.parametrize("mode", MODES)
def test_labelled_cases(spark, mode):
    for row, (text, schema, keyword) in zip(verdicts_of(spark, CASES, **MODES[mode]), CASES):
        assert row["keyword"] == keyword, (text, row)
        assert row["is_valid"] is (keyword is None), (text, row)
        expected = primary(violations(json.loads(text), schema))
        assert expected == ((row["path"], row["keyword"]) if keyword else None), text


@pytest.mark.parametrize("mode", MODES)
def test_status_is_decided_first(spark, mode):
    cases = [
        (wrap({}), {"$ref": "#/x"}, ("unsupported_schema", None)),
        (wrap({}), {"properties": {"tool": {"anyOf": []}}}, ("bad_schema", False)),
        (wrap({}), {"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}, ("unsupported_schema", None)),
        (wrap({}), {"properties": {"tool": {"$dynamicRef": "#x"}}}, ("unsupported_schema", None)),
        (wrap({}), {"properties": {"other": {"$dynamicRef": "#x"}}}, ("valid", True)),
        (wrap({}), {"properties": {"tool": {"$dynamicRef": "#x"}}, "maxProperties": 0}, ("invalid", False)),
        (wrap({}), {"properties": {"tool": {"anyOf": [{"$dynamicRef": "#x"}, {"type": "string"}]}}}, ("valid", True)),
        (wrap({}), {"properties": {"tool": {"anyOf": [{"$dynamicRef": "#x"}, {"type": "null"}]}}}, ("unsupported_schema", None)),
        (wrap({}), {"properties": {"tool": {"not": {"$dynamicRef": "#x", "type": "null"}}}}, ("valid", True)),
        (wrap({}), {"patternProperties": {"(?P<x>t)": {}}, "additionalProperties": False}, ("unsupported_schema", None)),
        (wrap({}), {"definitions": {"a": {}}, "$ref": "#/definitions/a"}, ("valid", True)),
        (wrap({}), {"properties": {"tool": {"pattern": "(?P<x>a)"}}}, ("unsupported_schema", None)),
        (wrap({}), {"properties": {"tool": {"pattern": "a{3,1}"}}}, ("unsupported_schema", None)),
        (wrap({}), {"$schema": "http://json-schema.org/draft-04/schema#"}, ("unsupported_schema", None)),
        ("[" * 8 + "1" + "]" * 8, json.loads('{"items":' * 8 + "{}" + "}" * 8), ("valid", True)),
        ("[" * 8 + "1" + "]" * 8, json.loads('{"items":' * 8 + '{"type":"null"}' + "}" * 8), ("invalid", False)),
        ("[" * 1100 + "]" * 1100, {"type": "array"}, ("unsupported_text", None)),
        ("1" * 1200, {"type": "integer"}, ("unsupported_text", None)),
        (wrap({}), None, ("bad_schema", False)),
        (wrap({}), [1], ("bad_schema", False)),
        (wrap({}), {"type": "str"}, ("bad_schema", False)),
        (wrap({}), {"required": "title"}, ("bad_schema", False)),
        (wrap({}), {"properties": {"x": {"minLength": -1}}}, ("bad_schema", False)),
        (wrap({}) + " x", {"$ref": "#/x"}, ("json_error", False)),
        (wrap({}) + " x", None, ("json_error", False)),
        (wrap({}), True, ("valid", True)),
        (wrap({}), False, ("invalid", False)),
        ('{"n":1e400}', {"properties": {"n": {"type": "number"}}}, ("unsupported_number", None)),
        ('{"n":1e400}', {"properties": {"n": {"maximum": 5}}}, ("invalid", False)),
    ]
    for row, (text, schema, (status, is_valid)) in zip(verdicts_of(spark, cases, **MODES[mode]), cases):
        assert (row["status"], row["is_valid"]) == (status, is_valid), (text, schema, row)
        if row["keyword"]:
            assert row["category"] == CATEGORY.get(row["keyword"], "other_schema_error")
        else:
            assert row["category"] == (
                "json_error" if status == "json_error" else "other_schema_error" if is_valid is False else None
            )


def test_null_text_and_unknown_schema(spark):
    calls = calls_of(spark, [(None, TASK), (wrap(TITLE), TASK)])
    assert [r["status"] for r in validate_calls(calls, schema_catalog(calls)).orderBy("i").collect()] == [
        "json_error",
        "valid",
    ]
    other = schema_catalog(calls_of(spark, [("{}", NESTED)]))
    for limits in MODES.values():
        rows = validate_calls(calls, other, **limits).orderBy("i").collect()
        assert [(r["status"], r["is_valid"]) for r in rows] == [("json_error", False), ("unknown_schema", None)]


DIALECT = (
    "^(?=.*[A-F])[0-9a-fA-F]+$",
    "^(?!a)(b|(c|(d|e)f)+?)*$",
    r"^(?:(?:a{1,2}?b)+|x$)|^\u00e9[\u4e00-]",
    r"^a$|^b$|\t",
    r"([x-z]|[^a-f\]])(?=[!-])",
)
TEXTS = ("", "aF", "09af", "bcdfef", "ab", "aab", "xz!", "é漢", "é-", "b", "a", "a\tb", "b-", "aaab", "]!", "e-", "cc", "A0")


def test_patterns_are_read_as_by_python(spark):
    cases = [(json.dumps(t), {"pattern": p}) for p in DIALECT for t in TEXTS]
    for row, (text, schema) in zip(verdicts_of(spark, cases), cases):
        assert row["is_valid"] is bool(re.search(schema["pattern"], json.loads(text))), (text, schema, row)


def test_patterns_that_dialects_read_differently_give_no_verdict(spark):
    odd = ["[z-a]", "(?=a)*", "^*a", "a{3,1}", r"(a)\1", "(?<=a)b", "a++", r"\bx", "[a&&b]", "[[a]]", "(?i)a", r"\ud83d", "(a", "a)", "*a", "[a-z-b-a]", r"\p{L}"]
    for row, pattern in zip(verdicts_of(spark, [('"a"', {"pattern": p}) for p in odd]), odd):
        assert row["status"] == "unsupported_schema", (pattern, row)


def test_messages(spark):
    rows = verdicts_of(spark, [CASES[1], CASES[8], CASES[7], (wrap(TITLE) + " sure" * 40, TASK, None)])
    assert rows[0]["message"] == 'Schema Violation: "urgent" is not one of ["low", "medium", "high"]'
    assert rows[1]["message"] == "Schema Violation: 'priority' is a required property"
    assert rows[2]["message"] == (
        "Schema Violation: Additional properties are not allowed ('zz' was unexpected)"
    )
    raw = wrap(TITLE) + " sure" * 40
    assert rows[3]["message"] == f"Invalid JSON Syntax (raw: {raw[:100]}...)"


def test_quoted_phrase_does_not_change_the_category(spark):
    row = verdicts_of(spark, [(wrap({**TITLE, "priority": "Additional properties"}), TASK, None)])[0]
    assert row["category"] == "enum_violation"


def _random_value(rng, depth=0):
    pick = rng.randrange(9 if depth < 2 else 6)
    if pick == 0:
        return rng.choice([0, 1, 2, -1, 10])
    if pick == 1:
        return rng.choice([1.0, 0.5, -2.5, 100.0])
    if pick == 2:
        return rng.choice(["", "a", "1", "low", "x y"])
    if pick == 3:
        return rng.choice([True, False])
    if pick == 4:
        return None
    if pick in (5, 6):
        return [_random_value(rng, depth + 1) for _ in range(rng.randrange(3))] if depth < 2 else 3
    return {k: _random_value(rng, depth + 1) for k in rng.sample(["a", "b", "c.d", "e"], rng.randrange(4))}


def _random_schema(rng, depth=0):
    schema = {}
    if rng.random() < 0.5:
        names = ["string", "integer", "number", "boolean", "null", "array", "object"]
        schema["type"] = rng.choice(names) if rng.random() < 0.7 else rng.sample(names, 3)
    if rng.random() < 0.2:
        schema["enum"] = [_random_value(rng, 2) for _ in range(3)]
    if rng.random() < 0.1:
        schema["const"] = _random_value(rng, 2)
    for keyword in ("minimum", "exclusiveMaximum"):
        if rng.random() < 0.15:
            schema[keyword] = rng.choice([0, 1, 0.5, 50])
    for keyword in ("minLength", "maxItems", "maxProperties", "minProperties"):
        if rng.random() < 0.1:
            schema[keyword] = rng.randrange(3)
    if depth < 2 and rng.random() < 0.7:
        schema["properties"] = {
            k: _random_schema(rng, depth + 1) for k in rng.sample(["a", "b", "c.d"], rng.randrange(1, 4))
        }
        if rng.random() < 0.5:
            schema["required"] = rng.sample(["a", "b", "e"], rng.randrange(1, 3))
        if rng.random() < 0.4:
            schema["additionalProperties"] = False if rng.random() < 0.6 else _random_schema(rng, depth + 1)
    if depth < 2:
        for keyword in ("allOf", "anyOf", "oneOf"):
            if rng.random() < 0.12:
                schema[keyword] = [_random_schema(rng, depth + 1) for _ in range(rng.randrange(1, 3))]
        if rng.random() < 0.1:
            schema["not"] = _random_schema(rng, depth + 1)
        if rng.random() < 0.15:
            schema["$ref"] = rng.choice(["#/$defs/one", "#/definitions/two"])
    if depth == 0:
        schema["$defs"] = {"one": {"type": ["integer", "object"], "properties": {"a": {"$ref": "#/definitions/two"}}}}
        schema["definitions"] = {"two": {"anyOf": [{"type": "null"}, {"minimum": 1}]}}
    if depth < 2 and rng.random() < 0.4:
        schema["items"] = _random_schema(rng, depth + 1)
    return schema


@pytest.mark.parametrize("mode, n_schemas", [("inline", 12), ("broadcast", 60), ("salted", 60)])
def test_random_schemas_against_brute_force(spark, mode, n_schemas):
    rng = random.Random(7)
    schemas = [_random_schema(rng) for _ in range(n_schemas)]
    cases = [(json.dumps(_random_value(rng)), rng.choice(schemas)) for _ in range(1500)]
    rows = verdicts_of(spark, cases, **MODES[mode])
    for row, (text, schema) in zip(rows, cases):
        expected = primary(violations(json.loads(text), schema))
        got = (row["path"], row["keyword"]) if row["keyword"] else None
        assert got == expected, (text, schema, row)
        assert row["is_valid"] is (expected is None)
        if expected:
            assert row["category"] == CATEGORY.get(expected[1], "other_schema_error")
    calls = calls_of(spark, cases)
    found = violation_table(calls, schema_catalog(calls), **MODES[mode])
    assert found.count() == sum(len(violations(json.loads(t), s)) for t, s in cases)


def test_shredded_nodes(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"c.d":"x"}'), (2, "{} x")], "i int, call string")
    got = {(tuple(r["path"]), r["json_type"], r["json"]) for r in shred_calls(df).collect()}
    assert got == {
        ((), "object", '{"a":[1,{"b":null}],"c.d":"x"}'),
        (("a",), "array", '[1,{"b":null}]'),
        (("a", "0"), "integer", "1"),
        (("a", "1"), "object", '{"b":null}'),
        (("a", "1", "b"), "null", "null"),
        (("c.d",), "string", '"x"'),
    }


def test_constraint_table(spark):
    calls = calls_of(spark, [("{}", TASK), ("{}", TASK), ("{}", NESTED)])
    catalog = schema_catalog(calls)
    assert catalog.count() == 2
    rules = constraint_table(compile_schemas(catalog)).collect()
    by_path = {tuple(r["path"]): r for r in rules}
    assert by_path[("parameters", "priority")]["enum"] == ['"low"', '"medium"', '"high"']
    assert by_path[("parameters", "tags", "[]")]["type"] == ["string"]
    assert by_path[("parameters", "slash/*~")]["at"] == "/parameters/slash~1~2~0"


def test_partitioning_changes_nothing(spark):
    calls = calls_of(spark, [c[:2] for c in CASES])
    catalog = schema_catalog(calls)
    one = validate_calls(calls.coalesce(1), catalog).orderBy("i").collect()
    many = validate_calls(calls.repartition(13), catalog).orderBy("i").collect()
    assert one == many


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k")
    right = spark.range(40).selectExpr("concat('k', id) AS k", "id AS w").union(
        spark.createDataFrame([("hot", 99)], "k string, w bigint")
    )
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("id", "k", "w").orderBy("id").collect()
        salted = join_unique(left, right, "k", how, hot_rows=100)
        assert salted.select("id", "k", "w").orderBy("id").collect() == plain


HOSTILE = ["{it}", "' OR 1=1 --", '" , raise_error("x") , "{it}', "a\\'b", 'x\ny "q"', "$1 {0} %s `c`", "\\", "{{it}}"]


def test_texts_of_a_schema_are_never_read_as_expressions(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(8):
        keys = rng.sample(HOSTILE, 3)
        schema = {
            "properties": {
                keys[0]: {"enum": rng.sample(HOSTILE, 3) + [1]},
                keys[1]: {"const": rng.choice(HOSTILE)},
                keys[2]: {"anyOf": [{"const": rng.choice(HOSTILE)}, {"enum": [rng.choice(HOSTILE)]}]},
            },
            "required": [rng.choice(HOSTILE)],
            "additionalProperties": rng.random() < 0.5,
        }
        cases += [({k: rng.choice(HOSTILE) for k in rng.sample(HOSTILE, 3)}, schema) for _ in range(40)]
        cases += [({k: rng.choice(HOSTILE) for k in keys}, schema) for _ in range(40)]
    cases = [(json.dumps(x), s) for x, s in cases]
    expected = [primary(violations(json.loads(t), s)) for t, s in cases]
    assert any(expected) and not all(expected)
    for limits in MODES.values():
        rows = verdicts_of(spark, cases, **limits)
        assert [(r["path"], r["keyword"]) if r["keyword"] else None for r in rows] == expected


def test_deep_calls_keep_all_nodes(spark):
    df = spark.createDataFrame([(1, '{"a":' * 12 + '["]}",[]]' + "}" * 12), (2, '"\\"{[["')], "i int, call string")
    rows = shred_calls(df).collect()
    assert sum(r["i"] == 1 for r in rows) == 15 and max(len(r["path"]) for r in rows) == 13


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_narrow(spark):
    calls = calls_of(spark, [c[:2] for c in CASES])
    stored = calls.select("i", "call", "schema_id")
    inline = _plan(validate_calls(stored, schema_catalog(calls)).filter("NOT is_valid"))
    assert "Exchange" not in inline and "Join" not in inline and "Python" not in inline
    joined = _plan(validate_calls(stored, schema_catalog(calls), inline_schemas=0).filter("NOT is_valid"))
    assert "BroadcastHashJoin" in joined and "Python" not in joined
    assert "hashpartitioning" not in joined and "CartesianProduct" not in joined
    assert len(inline) < 200_000 and len(joined) < 200_000


def test_json_reference_agrees_on_cases():
    assert all(strict_json(text)[0] for text, _, _ in CASES)
