"""Session settings and shared scratch space.

The caller owns the SparkSession; nothing here creates one.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options the JSON expressions rely on.

    Duplicate object keys resolve to the last one, and timestamps are rendered in UTC. They stay
    set for all later queries of the session.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The JVM never compiles methods above 8000 bytes; fall back to smaller generated ones.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Every level of a nested schema takes some rounds of the analyzer.
    spark.conf.set("spark.sql.analyzer.maxIterations", "2000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    path = tempfile.mkdtemp(prefix="callsieve-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    Cuts the lineage in a way that outlives executors, and keeps file statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between two collections that ``free_shuffles`` asks for.
COLLECT_EVERY = 60
_collected: dict[str, float] = {}


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over.

    It does so when the driver's garbage collector finds that nothing refers to them, and a large heap
    can put that off until the disks are full. Where the last time is not long past nothing is done.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _collected.get(app, -COLLECT_EVERY) >= COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[app] = time.monotonic()
