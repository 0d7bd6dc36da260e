import json
import random

import pytest

from brute import strict_json
from callsieve.functions import jsontext

CASES = {
    '{"a":1}': True,
    ' {"a":1} ': True,
    '\t{"a":1}\n': True,
    '{"a":1} x': False,
    '{"a":1}{"b":2}': False,
    '{"a":1}] x': False,
    '1} x': False,
    "1,2": False,
    '1,"a":2': False,
    "{'a':1}": False,
    '{"a":1,}': False,
    '{"a":01}': False,
    "{a:1}": False,
    '{"a":"\\q"}': False,
    '{"a":"x\ny"}': False,
    "": False,
    "   ": False,
    '{"a":1,"a":2}': True,
    '{"a":NaN}': False,
    '{"a":Infinity}': False,
    "[1]": True,
    "3": True,
    '"s"': True,
    "null": True,
    "9" * 900: True,
    "9" * 1200: False,
}


def _check(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column).collect())]


def test_strict_json_cases(spark):
    assert _check(spark, [*CASES, None], jsontext.is_strict_json("t")) == [*CASES.values(), False]


def test_strict_json_against_parser(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(3000):
        seed = json.dumps({"a": [1, True, None, "x{}"], "b": {"c": 1.5}})
        cut, extra = rng.randrange(len(seed)), rng.choice(['"', "}", "]", ",", " ", "1", ":", "{", "\\", ""])
        texts.append(seed[:cut] + extra + seed[cut + rng.randrange(2) :])
        texts.append("".join(rng.choice('{}[]",:1a \\') for _ in range(rng.randrange(8))))
    assert _check(spark, texts, jsontext.is_strict_json("t")) == [strict_json(t)[0] for t in texts]


def test_duplicate_keys_last_wins(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',)], "t string")
    df = df.select(jsontext.parse_strict("t").alias("v")).selectExpr("variant_get(v, '$.a', 'int') AS a")
    assert df.first()["a"] == 2


@pytest.mark.parametrize(
    "text, expected",
    [
        ('  {"a":1}\n', '{"a":1}'),
        (" {x} ", "{x}"),
        ('Sure: ```json\n{"a":1}\n``` done', '{"a":1}'),
        ('Sure: ```{"a":{"b":2}}``` done', '{"a":{"b":2}}'),
        ("```json {} ``` x", "{}"),
        ("call {a{b}c} and {d}", "{a{b}c}"),
        ('say {"x":"}"} end', '{"x":"}'),
        ("{ never closed", None),
        ("closed } only", None),
        ("no braces", None),
        ("", None),
        ("😀 {😀{}😀} z", "{😀{}😀}"),
        ("{}{", "{}"),
    ],
)
def test_extract_object(spark, text, expected):
    assert _check(spark, [text], jsontext.extract_object("t")) == [expected]
    assert _check(spark, [text], jsontext.lenient_text("t")) == [text if expected is None else expected]
