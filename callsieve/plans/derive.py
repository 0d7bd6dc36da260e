"""Tool calls, schemas, triplets, batches and responses derived from the given tables.

Every row of a table gives one row here; the mutation of a call follows from its key.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.operators.schemas import with_schema_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits in which it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Below so many rows for each task, more tasks are not worth a shuffle.
TASK_ROWS = 10_000
#: Tasks for each core, so that a slow one does not hold up the rest.
TASKS_PER_CORE = 8


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table whose rows are checked one by one: dealt evenly over the cores, as a file may be
    stored in one piece. Small tables stay in their splits.

    Only the columns that are asked for are dealt, before any text is made of them.
    """
    return dealt(table(spark, sf_dir, name))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in as many tasks as their number asks for, those with equal ``keys`` in one task."""
    tasks = min(rows.count() // TASK_ROWS, TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def tool_schema(tool: str, parameters: dict, required: list[str]) -> str:
    """Schema text of a tool whose parameters are closed."""
    return json.dumps(
        {
            "type": "object",
            "properties": {
                "tool": {"type": "string", "const": tool},
                "parameters": {
                    "type": "object",
                    "properties": parameters,
                    "required": required,
                    "additionalProperties": False,
                },
            },
            "required": ["tool", "parameters"],
            "additionalProperties": False,
        }
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORDER_SCHEMA = tool_schema(
    "create_order",
    {
        "customer": {"type": "integer"},
        "priority": {"type": "string", "enum": PRIORITIES},
        "date": {"type": "string"},
        "total": {"type": "number"},
    },
    ["customer", "priority", "date", "total"],
)
LINE_SCHEMA = tool_schema(
    "record_line",
    {
        "order": {"type": "integer", "minimum": 0},
        "line": {"type": "integer", "exclusiveMaximum": 7},
        "amounts": {"type": "array", "items": {"type": "number", "maximum": 40}, "minItems": 2, "maxItems": 3},
        "flag": {"type": "string", "enum": ["A", "N"]},
        "ship": {"type": "string", "pattern": r"^(199[0-9]|2000)-\d{2}-\d{2}$", "maxLength": 10},
    },
    ["order", "line", "amounts", "flag"],
)
CUSTOMER_SCHEMA = tool_schema(
    "open_account",
    {
        "customer": {"type": "integer"},
        "name": {"type": "string", "minLength": 1},
        "segment": {"type": "string", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
    },
    ["customer", "name", "segment"],
)
PART_SCHEMA = tool_schema(
    "list_part",
    {
        "brand": {"type": "string"},
        "part": {"type": "integer"},
        "size": {"type": "integer", "minimum": 1},
        "type": {"type": "string", "enum": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]},
    },
    ["part", "size", "type"],
)
EVENT_SCHEMA = json.dumps(
    {
        "type": "object",
        "properties": {"k": {"type": "integer", "maximum": 49}},
        "required": ["k"],
        "additionalProperties": False,
    }
)
# Ten levels of objects around one number.
DEEP_LEVELS = 10
DEEP_SCHEMA = '{"properties":{"n":' * DEEP_LEVELS + '{"type":"integer"}' + "}}" * DEEP_LEVELS
# Keys and values that would break an expression if they were ever read as one.
HOSTILE = ["{it}", "' OR 1=1 --", '" , raise_error("x") , "{it}', "a\\'b", 'line\nbreak "q"', "$1 {0} %s `c`"]
HOSTILE_SCHEMA = json.dumps(
    {
        "type": "object",
        "properties": {"{it}": {"enum": [*HOSTILE, 1]}, "it's \"k\"": {"const": HOSTILE[2]}, "p": {"pattern": r"^\{it\}$"}},
        "required": ["{it}"],
        "additionalProperties": False,
    }
)
# The order's priority and total in other words: an optional text of a list, a definition that
# is referred to, something excluded, and members that are not declared.
COMPOSED_SCHEMA = json.dumps(
    {
        "$defs": {"count": {"type": "integer", "minimum": 0}},
        "type": "object",
        "properties": {
            "tool": {"not": {"const": "drop_order"}},
            "parameters": {
                "properties": {
                    "customer": {"$ref": "#/$defs/count"},
                    "priority": {"anyOf": [{"enum": PRIORITIES}, {"type": "null"}]},
                    "total": {"allOf": [{"type": "number"}, {"minimum": 0}]},
                    "date": {"oneOf": [{"type": "string"}, {"type": "integer"}]},
                },
                "required": ["customer", "priority"],
                "additionalProperties": {"type": "boolean"},
            },
        },
    }
)
REFERENCE_SCHEMA = json.dumps({"$ref": "#/definitions/order"})


def call_text(tool: str, *parameters: str) -> str:
    """SQL text of a call; parameters alternate name literals and expressions."""
    return f"to_json(named_struct('tool', '{tool}', 'parameters', named_struct({', '.join(parameters)})))"


_CUSTOMER = ("'customer'", "o_custkey")
_PRIORITY = ("'priority'", "o_orderpriority")
_REST = ("'date'", "date_format(o_orderdate, 'yyyy-MM-dd')", "'total'", "o_totalprice")
ORDER_CALL = call_text("create_order", *_CUSTOMER, *_PRIORITY, *_REST)
BROKEN = {
    "type_mismatch": call_text("create_order", "'customer'", "string(o_custkey)", *_PRIORITY, *_REST),
    "enum_violation": call_text("create_order", *_CUSTOMER, "'priority'", "'urgent'", *_REST),
    "hallucinated_param": call_text("create_order", *_CUSTOMER, *_PRIORITY, *_REST, "'zz'", "1"),
    "missing_required": call_text("create_order", *_CUSTOMER, *_REST),
    "json_error": f"concat({ORDER_CALL}, ' sure!')",
}
SIX_WAYS = (
    f"CASE o_orderkey % 6 WHEN 0 THEN {BROKEN['type_mismatch']} WHEN 1 THEN {BROKEN['enum_violation']}"
    f" WHEN 2 THEN {BROKEN['hallucinated_param']} WHEN 3 THEN {BROKEN['missing_required']}"
    f" WHEN 4 THEN {BROKEN['json_error']} ELSE {ORDER_CALL} END"
)
FOUR_WAYS = (
    f"CASE o_orderkey % 4 WHEN 0 THEN {BROKEN['enum_violation']} WHEN 1 THEN {BROKEN['missing_required']}"
    f" WHEN 2 THEN {BROKEN['json_error']} ELSE {ORDER_CALL} END"
)
PROMPT = (
    "concat('Order for customer ', o_custkey, ' with priority ', o_orderpriority,"
    " '.\\nTool: create_order(customer: int, priority: enum, date: str, total: float)')"
)


def schemas_of(spark: SparkSession, *schemas: str | None) -> DataFrame:
    """Catalog of schema texts known by name."""
    rows = spark.createDataFrame([(s,) for s in schemas], "schema string")
    return with_schema_id(rows).select("schema_id", "schema")


def order_calls(spark: SparkSession, sf_dir: str, mutated: bool = True) -> DataFrame:
    """``example_id, call, schema_id``: calls in six ways by key, or all of them good."""
    calls = spread(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS example_id", f"{SIX_WAYS if mutated else ORDER_CALL} AS call"
    )
    return with_schema_id(calls.withColumn("schema", F.lit(ORDER_SCHEMA))).drop("schema")


def line_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = call_text(
        "record_line",
        *("'order'", "l_orderkey", "'line'", "l_linenumber"),
        *("'amounts'", "array(l_quantity, l_discount, l_tax)", "'flag'", "l_returnflag"),
        *("'ship'", "date_format(l_shipdate, 'yyyy-MM-dd')"),
    )
    lines = spread(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS call_id", f"{call} AS call"
    )
    return with_schema_id(lines.withColumn("schema", F.lit(LINE_SCHEMA))).drop("schema")


def customer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = call_text("open_account", "'customer'", "c_custkey", "'name'", "c_name", "'segment'", "c_mktsegment")
    calls = spread(spark, sf_dir, "customer").selectExpr("c_custkey AS example_id", f"{call} AS call")
    return with_schema_id(calls.withColumn("schema", F.lit(CUSTOMER_SCHEMA))).drop("schema")


def many_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer calls that break several demands at once."""
    key, label, segment = ("'customer'", "c_custkey"), ("'name'", "c_name"), ("'segment'", "c_mktsegment")
    call = (
        "CASE c_custkey % 5"
        " WHEN 0 THEN to_json(named_struct('customer', c_custkey))"
        f" WHEN 1 THEN {call_text('open_account', "'customer'", 'c_name', *label, "'segment'", "'NONE'")}"
        " WHEN 2 THEN to_json(named_struct('tool', 'open_account', 'parameters', named_struct("
        "'customer', c_custkey, 'name', c_name, 'segment', 'NONE'), 'note', 'x'))"
        f" WHEN 3 THEN {call_text('open_account', *key)}"
        f" ELSE {call_text('open_account', *key, *label, *segment)} END"
    )
    calls = spread(spark, sf_dir, "customer").selectExpr("c_custkey AS example_id", f"{call} AS call")
    return with_schema_id(calls.withColumn("schema", F.lit(CUSTOMER_SCHEMA))).drop("schema")


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = call_text("list_part", "'brand'", "p_brand", "'part'", "p_partkey", "'size'", "p_size", "'type'", "p_type")
    calls = spread(spark, sf_dir, "part").selectExpr("p_partkey AS example_id", f"{call} AS call")
    return with_schema_id(calls.withColumn("schema", F.lit(PART_SCHEMA))).drop("schema")


def part_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that each bring a schema of their own, made from the part."""
    schema = (
        "to_json(named_struct('type', 'object', 'properties', named_struct("
        "'tool', named_struct('const', 'quote'), 'parameters', named_struct('type', 'object', 'properties',"
        " named_struct('size', named_struct('type', 'integer', 'maximum', p_size),"
        " 'brand', named_struct('enum', array(p_brand, 'any')),"
        " 'name', named_struct('type', array('string', 'null'), 'minLength', length(p_name))),"
        " 'required', array('size'), 'additionalProperties', false))))"
    )
    call = (
        "to_json(named_struct('tool', 'quote', 'parameters', named_struct("
        "'size', p_size + if(p_partkey % 3 = 0, 1, 0), 'brand', if(p_partkey % 5 = 0, 'other', p_brand),"
        " 'name', p_name)))"
    )
    parts = spread(spark, sf_dir, "part").selectExpr(
        "p_partkey AS example_id", f"{call} AS call", f"{schema} AS schema"
    )
    return with_schema_id(parts)


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_id, prompt, chosen, rejected, schema``; some chosen calls are broken, too."""
    rows = spread(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS example_id",
        f"{PROMPT} AS prompt",
        f"if(o_orderstatus = 'P', {BROKEN['missing_required']}, {ORDER_CALL}) AS chosen",
        f"{SIX_WAYS} AS rejected",
    )
    return rows.withColumn("schema", F.lit(ORDER_SCHEMA))


#: What the call for an order is made of.
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_id, doc``: generator documents.

    Urgent orders come as bare triplets; the others by five keys under ``examples`` or
    ``triplets``. Items of in-process orders lack ``chosen``; even keys carry it as an object.
    """
    item = (
        "concat('{\"example_id\":', o_orderkey, ',\"prompt\":', to_json(named_struct('p', o_orderpriority)),"
        f" if(o_orderstatus = 'P', '', concat(',\"chosen\":', if(o_orderkey % 2 = 0, {ORDER_CALL},"
        f" concat('\"', replace({ORDER_CALL}, '\"', '\\\\\"'), '\"')))),"
        f" ',\"rejected\":\"', replace({SIX_WAYS}, '\"', '\\\\\"'), '\",\"schema\":', order_schema, '}}')"
    )
    urgent = "o_orderpriority = '1-URGENT'"
    keyed = table(spark, sf_dir, "orders").selectExpr(
        *ORDER_COLUMNS, f"if({urgent}, 10000000000 + o_orderkey, o_orderkey div 5) AS batch_id", f"{urgent} AS bare"
    )
    # At most five items share a batch, as the order keys are unique. The orders are brought together by themselves:
    # their items, with a schema in each, are many times as large and are made in the task that needs them.
    orders = dealt(keyed, "batch_id", "bare").groupBy("batch_id", "bare").agg(
        F.collect_list(F.struct(*ORDER_COLUMNS)).alias("orders")
    )
    one = re.sub(rf"\b({'|'.join(ORDER_COLUMNS)})\b", r"o.\1", item)
    grouped = orders.withColumn("order_schema", F.lit(ORDER_SCHEMA)).selectExpr(
        "batch_id",
        "bare",
        f"array_sort(transform(orders, o -> named_struct('o_orderkey', o.o_orderkey, 'item', {one}))) AS items",
    )
    listed = "concat('[', array_join(items.item, ','), ']')"
    wrapper = "if(batch_id % 2 = 0, 'examples', 'triplets')"
    return grouped.selectExpr(
        "batch_id", f"if(bare, items[0].item, concat('{{\"', {wrapper}, '\":', {listed}, '}}')) AS doc"
    )


def itemless_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as generator output without a list of items; every fourth has a malformed one."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN to_json(array(text))"
        " WHEN 2 THEN to_json(named_struct('examples', text)) ELSE to_json(named_struct('triplets', array(text))) END"
        " AS doc",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' answers to every order; model B has none for in-process orders."""
    orders = spread(spark, sf_dir, "orders")
    a = orders.selectExpr("o_orderkey AS example_id", "'A' AS model", f"{SIX_WAYS} AS response")
    b = orders.filter("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS example_id", "'B' AS model", f"{FOUR_WAYS} AS response"
    )
    return a.unionByName(b)


def deep_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls nested as deep as ``DEEP_SCHEMA``, with a text for the number in every third."""
    inner = "if(o_orderkey % 3 = 0, concat('\"', o_orderkey, '\"'), string(o_orderkey))"
    call = f"concat(repeat('{{\"n\":', {DEEP_LEVELS}), {inner}, repeat('}}', {DEEP_LEVELS}))"
    calls = spread(spark, sf_dir, "orders").selectExpr("o_orderkey AS example_id", f"{call} AS call")
    return with_schema_id(calls.withColumn("schema", F.lit(DEEP_SCHEMA))).drop("schema")


def hostile_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose members are taken in turn from the hostile texts, some of them not allowed."""
    texts = F.array(*map(F.lit, [*HOSTILE, "other"]))
    n = F.col("o_orderkey")

    def text(divisor: int) -> F.Column:
        return F.get(texts, F.pmod(F.floor(n / divisor), F.lit(len(HOSTILE) + 1)).cast("int"))

    members = F.map_from_arrays(
        F.array(F.lit("{it}"), F.lit("it's \"k\""), F.lit("p")),
        F.array(text(1), F.when(n % 2 == 0, F.lit(HOSTILE[2])).otherwise(text(3)), F.when(n % 5 > 0, F.lit("{it}")).otherwise("x")),
    )
    calls = spread(spark, sf_dir, "orders").select(n.alias("example_id"), F.to_json(members).alias("call"))
    return with_schema_id(calls.withColumn("schema", F.lit(HOSTILE_SCHEMA))).drop("schema")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples that the models answer, with prompt, expected call and schema id."""
    rows = spread(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS example_id", f"{PROMPT} AS prompt", f"{ORDER_CALL} AS chosen"
    )
    return with_schema_id(rows.withColumn("schema", F.lit(ORDER_SCHEMA))).drop("schema")


def wrapped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls inside the prose of whole documents: bare, embedded, fenced, or never closed."""
    call = "to_json(named_struct('tool', 'cite', 'parameters', named_struct('doc', doc_id, 'lang', lang)))"
    fence = "```"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        f"""CASE doc_id % 5
        WHEN 0 THEN concat('\\n ', {call}, ' \\n')
        WHEN 1 THEN concat(text, ' ', {call}, ' ', text)
        WHEN 2 THEN concat(text, '\\n{fence}json\\n', {call}, '\\n{fence}\\n', text)
        WHEN 3 THEN concat('{fence}\\n', {call}, '{fence} ', text)
        ELSE concat(text, ' {{"tool": ', text) END AS response""",
    )


# -- calls for keywords that lead from one schema to others ----------------------------------

RECURSIVE_SCHEMA = json.dumps(
    {
        "$defs": {
            "cell": {
                "type": ["object", "null"],
                "properties": {"v": {"type": "integer"}, "next": {"$ref": "#/$defs/cell"}},
                "required": ["v"],
                "additionalProperties": False,
            }
        },
        "$ref": "#/$defs/cell",
    }
)
LINK_LEVELS = 20
LINKED_SCHEMA = json.dumps(
    {
        "$defs": {
            "a/b~c": {"type": "integer", "$anchor": "whole"},
            "own": {"$id": "http://example.org/own", "properties": {"q": {"type": "boolean"}}},
            **{f"level{i}": {"properties": {"n": {"$ref": f"#/$defs/level{i + 1}"}}} for i in range(LINK_LEVELS)},
            f"level{LINK_LEVELS}": {"type": "integer"},
        },
        "properties": {
            "a": {"items": {"type": "string"}},
            "b": {"$ref": "#/properties/a/items"},
            "c": {"$ref": "#/$defs/a~1b~0c"},
            "d": {"$ref": "#whole"},
            "e": {"$ref": "http://example.org/own#/properties/q"},
            "n": {"$ref": "#/$defs/level0"},
        },
    }
)
PATTERN_SCHEMA = json.dumps(
    {
        "properties": {"ab": {"type": "integer"}},
        "patternProperties": {"^a": {"type": ["integer", "string"]}, "b$": {"type": ["integer", "null"]}},
        "additionalProperties": {"type": "boolean"},
        "propertyNames": {"maxLength": 3},
    }
)
CONDITIONAL_SCHEMA = json.dumps(
    {
        "if": {"properties": {"kind": {"const": "card"}}, "required": ["kind"]},
        "then": {"required": ["number"]},
        "else": {"properties": {"number": False}},
        "dependentRequired": {"number": ["expiry"]},
        "dependentSchemas": {"expiry": {"properties": {"expiry": {"pattern": "^[0-9]{2}$"}}}},
    }
)
# The condition uses a keyword that is not judged: only what both branches agree on is decided.
OPEN_CONDITION_SCHEMA = json.dumps({"if": {"$dynamicRef": "#x"}, "then": {"maxProperties": 3}, "else": {"maxProperties": 2}})
UNEVALUATED_SCHEMA = json.dumps(
    {
        "allOf": [{"properties": {"a": {"type": "integer"}}}],
        "anyOf": [
            {"properties": {"b": {"type": "integer"}}, "required": ["b"]},
            {"properties": {"c": {"type": "integer"}}, "required": ["c"]},
        ],
        "unevaluatedProperties": False,
    }
)
ARRAY_SCHEMA = json.dumps(
    {
        "properties": {
            "set": {"uniqueItems": True},
            "row": {"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False},
            "some": {"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3},
            "rest": {"prefixItems": [{}], "contains": {"type": "string"}, "unevaluatedItems": {"type": "null"}},
        }
    }
)
MULTIPLE_SCHEMA = json.dumps({"properties": {"total": {"multipleOf": 0.05}, "key": {"multipleOf": 3}, "long": {"multipleOf": 11}}})

#: Look-ahead, groups in groups, lazy quantifiers, ranges, code units.
DIALECT_SCHEMA = json.dumps(
    {
        "properties": {
            "total": {"pattern": r"^(?!.*7$)(?=[0-9]+?\.)(?:(?:[0-9a-fA-F]{1,3}?)+\.(\d|[x-z])*)$"},
            "day": {"pattern": r"^((19(9[0-4])|20\d\d)\u002d(0[1-9]|1[0-2]))-"},
            "key": {"pattern": r"^[^\u0030-]+$|[02468]$|^(?:1|(?:3|5)+)"},
        }
    }
)

CONDITIONAL_CALLS = (
    '{"kind":"card","number":1,"expiry":"12"}',
    '{"kind":"card"}',
    '{"kind":"cash","number":1,"expiry":"12"}',
    '{"kind":"card","number":1}',
    '{"kind":"cash","expiry":"1x"}',
    '{"kind":"cash"}',
)
UNEVALUATED_CALLS = ('{"a":1,"b":2}', '{"a":1,"b":2,"c":3}', '{"b":2,"q":0}', '{"b":"x","c":0}', '{"a":"1","c":0}')
ARRAY_CALLS = (
    '{"set":[{"a":1,"b":[2]},{"b":[2.0],"a":1}]}',
    '{"set":[1,true,"1",[1]]}',
    '{"row":["x",1]}',
    '{"row":["x",1,2]}',
    '{"row":[1]}',
    '{"some":["x"]}',
    '{"some":["x",1]}',
    '{"some":[1,2,3,4]}',
    '{"some":[1,"x",2]}',
    '{"rest":[5,"x",null]}',
    '{"rest":[5,"x",6]}',
)


def calls_of(spark: SparkSession, sf_dir: str, call: str, schema: str) -> DataFrame:
    """A call for each order, as the SQL expression ``call`` gives it, to be checked against ``schema``."""
    calls = spread(spark, sf_dir, "orders").selectExpr("o_orderkey AS example_id", f"{call} AS call")
    return with_schema_id(calls.withColumn("schema", F.lit(schema))).drop("schema")


def in_turn(calls: tuple[str, ...]) -> str:
    """SQL text: the calls taken in turn by order."""
    cases = " ".join(f"WHEN {n} THEN '{call}'" for n, call in enumerate(calls))
    return f"CASE o_orderkey % {len(calls)} {cases} END"


def _nested(levels: str, key: str, leaf: str, more: str = "") -> str:
    return f"concat(repeat('{{{more}\"{key}\":', int({levels})), {leaf}, repeat('}}', int({levels})))"


RECURSIVE_CALL = _nested(
    "o_orderkey % 9 + 1",
    "next",
    """CASE o_orderkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{"v":"x"}' WHEN 2 THEN '{"v":1,"more":2}' ELSE '{"v":1}' END""",
    '"v":1,',
)
LINKED_CALL = (
    "concat('{\"a\":[\"x\"],\"b\":', if(o_orderkey % 6 = 1, '1', '\"x\"'), ',\"c\":', if(o_orderkey % 6 = 2, '\"x\"', '1'),"
    " ',\"d\":', if(o_orderkey % 6 = 3, '\"x\"', '1'), ',\"e\":', if(o_orderkey % 6 = 4, '1', 'true'), ',\"n\":', "
    + _nested(str(LINK_LEVELS), "n", "if(o_orderkey % 6 = 5, '\"x\"', '1')")
    + ", '}')"
)
PATTERN_CALL = (
    "concat('{\"', element_at(array('ab', 'ax', 'cb', 'o', 'long'), int(o_orderkey % 5) + 1), '\":',"
    " element_at(array('1', '\"s\"', 'null', 'true'), int(o_orderkey % 4) + 1), '}')"
)
MULTIPLE_CALL = (
    "concat('{\"total\":', cast(o_totalprice AS decimal(15,2)), ',\"key\":', o_orderkey, ',\"long\":', o_orderkey + 1,"
    " repeat('0', 25), '}')"
)
DIALECT_CALL = (
    "concat('{\"total\":\"', cast(o_totalprice AS decimal(15,2)), '\",\"day\":\"', date_format(o_orderdate, 'yyyy-MM-dd'),"
    " '\",\"key\":\"', o_orderkey, '\"}')"
)
#: Every so many orders have a call that is nested this deep.
DEEP_EVERY, DEEP_CALL_LEVELS = 4999, 500
UNEVEN_CALL = f"if(o_orderkey % {DEEP_EVERY} = 1, {_nested(str(DEEP_CALL_LEVELS), 'n', 'o_orderkey')}, {ORDER_CALL})"
