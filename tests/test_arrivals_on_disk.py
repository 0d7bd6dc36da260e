"""What a stream of batches takes on disk: packed arrivals, and no shuffle files of jobs that are over."""

import os
import time

from pyspark.sql import functions as F

from callsieve import session
from callsieve.operators.validate import Checker, validate_calls
from callsieve.plans import derive, registry
from callsieve.streaming import gate


def test_arrivals_are_packed_and_whole(spark, sf_dir):
    path = registry._batch_files(spark, sf_dir)
    found = spark.read.schema(gate.BATCH_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    batches = derive.batches(spark, sf_dir).select("batch_id", "doc")
    others = derive.itemless_documents(spark, sf_dir).selectExpr("-1 - doc_id AS batch_id", "doc")
    records = found.filter("_corrupt_record IS NULL").select("batch_id", "doc").collect()
    assert sorted(records) == sorted(batches.unionByName(others).collect())
    kept = sum(os.path.getsize(f"{path}/{name}") for name in os.listdir(path))
    assert kept < found.agg(F.sum(F.length("doc"))).first()[0] / 4


def test_shuffle_files_of_jobs_that_are_over_go(spark, monkeypatch):
    monkeypatch.setattr(session, "COLLECT_EVERY", 0)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.range(1000).repartition(16).groupBy(F.col("id") % 7).count().collect()
    held, until = manager.getAllFiles().size(), time.monotonic() + 30
    while manager.getAllFiles().size() >= held and time.monotonic() < until:
        session.free_shuffles(spark)
        time.sleep(0.5)
    assert manager.getAllFiles().size() < held


def test_an_epoch_of_known_batches_brings_no_rules(spark):
    catalog = derive.schemas_of(spark, "{}").limit(0)
    # Rules for a join would be planned and compiled in each epoch to judge nothing.
    assert not hasattr(Checker(catalog).rules, "compiled")
    calls = spark.createDataFrame([(1, "{}", "x"), (2, "{", None)], "i int, call string, schema_id string")
    assert {(r.i, r.status) for r in validate_calls(calls, catalog).collect()} == {(1, "unknown_schema"), (2, "json_error")}
