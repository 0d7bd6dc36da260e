"""Checks of a few schemas are compiled with the row, not interpreted."""

from callsieve.operators.schemas import with_schema_id
from callsieve.operators.validate import violation_table
from callsieve.plans import derive
from pyspark.sql import functions as F


def test_checks_of_few_schemas_are_not_interpreted(spark):
    calls = spark.createDataFrame([("a", '{"tool":"x"}'), ("b", "{")], "call_id string, call string")
    calls = with_schema_id(calls.withColumn("schema", F.lit(derive.ORDER_SCHEMA))).drop("schema")
    catalog = derive.schemas_of(spark, derive.ORDER_SCHEMA)
    found = violation_table(calls, catalog, labels_only=True)
    # Spark interprets all that a filter of an array holds; only elements of a call need one.
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.call_id, r.keyword) for r in found.collect()} == {("a", "const"), ("a", "required")}
