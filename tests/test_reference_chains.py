"""References that stand alone are passed over when rules come by a join, with the same verdicts."""

import pytest

from test_validate import MODES, verdicts_of
from callsieve.operators.validate import Checker
from callsieve.plans import derive

CHAIN = {"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/c"}, "c": {"type": "integer"}}, "$ref": "#/$defs/a"}
ROUND = {"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}, "properties": {"x": {"$ref": "#/$defs/a"}, "y": {"type": "null"}}}
RING = {"$defs": {**{f"r{i}": {"$ref": f"#/$defs/r{(i + 1) % 3}"} for i in range(3)}, "in": {"$ref": "#/$defs/r0"}}, "items": {"$ref": "#/$defs/in"}}
SELF = {"$defs": {"a": {"$ref": "#/$defs/a"}, "b": {"$ref": "#/$defs/a"}}, "items": {"$ref": "#/$defs/b"}}
BACK = {"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"allOf": [{"$ref": "#/$defs/a"}], "type": "object"}}, "$ref": "#/$defs/a"}
BESIDE = {"$defs": {"a": {"$ref": "#/$defs/b", "maximum": 3}, "b": {"type": "integer"}}, "items": {"anyOf": [{"$ref": "#/$defs/a"}, {"type": "null"}]}}
KEYS = {"properties": {"a/b": {"properties": {"~1": {"properties": {"": {"$ref": "#/$defs/n"}}}}}}, "$defs": {"n": {"type": "integer"}}}
CASES = [
    ("1", CHAIN, "valid", None, None),
    ('"x"', CHAIN, "invalid", "type", []),
    ('{"x":1}', ROUND, "unsupported_schema", None, None),
    ('{"x":1,"y":1}', ROUND, "invalid", "type", ["y"]),
    ("{}", ROUND, "valid", None, None),
    ("[]", RING, "valid", None, None),
    ("[1]", RING, "unsupported_schema", None, None),
    ("[1]", SELF, "unsupported_schema", None, None),
    ("{}", BACK, "unsupported_schema", None, None),
    ("1", BACK, "invalid", "type", []),
    ("[1,null]", BESIDE, "valid", None, None),
    ("[1,4]", BESIDE, "invalid", "anyOf", ["1"]),
    ('{"a/b":{"~1":{"":"x"}}}', KEYS, "invalid", "type", ["a/b", "~1", ""]),
    ('{"a/b":{"~1":{"":1}}}', KEYS, "valid", None, None),
]


@pytest.mark.parametrize("mode", ["broadcast", "salted"])
def test_verdicts_behind_references(spark, mode):
    found = verdicts_of(spark, [(call, schema) for call, schema, *_ in CASES], **MODES[mode])
    assert [(v["status"], v["keyword"], v["path"]) for v in found] == [tuple(case[2:]) for case in CASES]


def test_a_chain_of_references_is_one_step(spark):
    checker = Checker(derive.schemas_of(spark, derive.LINKED_SCHEMA), **MODES["broadcast"])
    compiled = checker.rules.compiled.first()
    # Each of the twenty references would be a pair of its own, and a round of the loop.
    assert compiled["chain"] == 1
    assert all(not rule["beside"] for rule in compiled["rules"] if rule)
