"""Rows that are checked one by one are dealt over the cores, however a file is stored."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from callsieve.operators.nodes import shred_calls
from callsieve.plans import derive


def test_a_table_stored_in_one_piece_is_dealt_over_the_cores(spark, tmp_path):
    n = 3 * derive.TASK_ROWS
    pq.write_table(pa.table({"k": list(range(n))}), f"{tmp_path}/orders.parquet")
    rows = derive.spread(spark, str(tmp_path), "orders")
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and rows.distinct().count() == n


def test_a_small_table_stays_in_its_splits(spark, sf_dir):
    plan = derive.spread(spark, sf_dir, "orders")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nodes_of_calls_that_take_several_blocks_of_rounds(spark):
    depths = [1, 15, 16, 17, 40, 300]
    calls = spark.createDataFrame([(d, '{"n":' * d + f"[{d}]" + "}" * d) for d in depths], "depth int, call string")
    found = shred_calls(calls).groupBy("depth").agg(F.count("*").alias("n"), F.max(F.size("path")).alias("most"))
    assert {(r.depth, r.n, r.most) for r in found.collect()} == {(d, d + 2, d + 1) for d in depths}
