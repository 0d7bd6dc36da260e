"""Batches are made and opened without carrying or writing a schema for each item more than once."""

import datetime
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from callsieve.operators import schemas
from callsieve.plans import derive
from callsieve.sources import batches


def _orders(path, keys):
    n, day = len(keys), datetime.datetime(1995, 3, 4)
    columns = {
        "o_orderkey": pa.array(keys, pa.int64()),
        "o_custkey": [None if i % 7 == 0 else i % 5 for i in range(n)],
        "o_orderstatus": ["POF"[i % 3] for i in range(n)],
        "o_totalprice": [i + 0.5 for i in range(n)],
        "o_orderdate": [day] * n,
        "o_orderpriority": [["1-URGENT", "2-HIGH", None][i % 3 if i % 2 else 1] for i in range(n)],
    }
    pq.write_table(pa.table(columns), f"{path}/orders.parquet")


def test_orders_meet_by_batch_in_as_many_tasks_as_they_ask_for(spark, tmp_path):
    n = 3 * derive.TASK_ROWS
    _orders(tmp_path, list(range(n)))
    docs = derive.batches(spark, str(tmp_path))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(batch_id" in plan
    # The schema is added after the shuffle.
    assert "additionalProperties" not in plan[plan.index("Exchange") :]
    items = batches.explode_batches(docs).selectExpr("try_variant_get(item, '$.example_id', 'bigint') AS k")
    assert items.distinct().count() == n


def test_items_of_a_batch_are_in_order_also_where_keys_repeat_or_are_null(spark, tmp_path):
    _orders(tmp_path, [4, 2, 2, 0, None, 9, 9, 3, 3, None])
    docs = [r["doc"] for r in derive.batches(spark, str(tmp_path)).collect()]
    lists = [d.get("examples") or d.get("triplets") for d in (json.loads(d) for d in docs if d) if "example_id" not in d]
    assert lists
    for found in lists:
        places = [(i["example_id"], json.dumps(i)) for i in found]
        assert [k for k, _ in places] == sorted(k for k, _ in places)


def test_schema_texts_are_equal_as_json_to_those_of_the_items(spark):
    good = {"chosen": "{}", "rejected": "x"}
    each = [
        '{"b": {"z": 1, "a": [1, null]}, "a": "é\\n\\u0041"}',
        '"{}"',
        "null",
        "5",
        "[1]",
        '{"minimum": 0.12345678901234567891}',
        '{"minimum": 1e400}',
        f'{{"minimum": {"9" * 320}}}',
        '{"type": "string", "type": "object"}',
        "{}",
    ]
    items = [json.dumps(good)[:-1] + f', "schema": {s}}}' for s in each] + [json.dumps(good), "7", "null"]
    twice = json.dumps(good)[:-1] + ', "schema": {"a": 1}, "schema": "s"}'
    docs = [
        '{"examples": [' + ", ".join(items[:-2]) + "]}",
        '{"examples": [' + ", ".join(items) + "]}",
        '{"triplets": [' + ", ".join([twice, *items[::-1]]) + "]}",
        '{"examples": 1, "triplets": [' + items[0] + "]}",
        '{"examples": [1], "examples": [' + items[0] + ", " + items[1] + "]}",
        *items,
        '{"examples": []}',
        "no json",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "batch_id int, doc string")

    def rows(**how):
        triplets = batches.items_to_triplets(batches.explode_batches(df, **how)).drop("item")
        assert triplets.columns == ["batch_id", "pos", "malformed", "prompt", "chosen", "rejected", "schema"]
        return sorted(triplets.collect(), key=lambda r: (r["batch_id"], r["pos"]))

    plain, read = rows(), rows(schema_texts=True)
    assert [r[:-1] for r in plain] == [r[:-1] for r in read] and len(plain) > 2 * len(items)

    def value(text):
        return text if text is None else json.loads(text)

    assert [value(r["schema"]) for r in plain] == [value(r["schema"]) for r in read]
    # Taken from the document, not written out of the parsed item, which sorts members.
    assert read[0]["schema"].startswith('{"b"')


def test_as_many_tasks_compile_as_there_are_schemas(spark):
    catalog = schemas.with_schema_id(spark.createDataFrame([("{}",), ('{"type":"object"}',)], "schema string"))
    few = schemas.compile_schemas(catalog, 2)
    assert few.select(F.spark_partition_id()).count() == 2
    assert "hashpartitioning(schema_id" in (plan := few._jdf.queryExecution().executedPlan().toString())
    assert ", 2), REPARTITION_BY_NUM" in plan
