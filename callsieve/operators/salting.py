"""Equi joins to a side with unique keys, safe when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsieve.functions.sqltext import name

#: A key with more rows than this is spread, so that each part has about as many.
HOT_ROWS = 2_000_000


def _frequent(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    return counts.filter(F.col("count") > hot_rows).select(
        F.col(key), F.ceil(F.col("count") / hot_rows).cast("int").alias("__parts")
    )


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def join_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to ``right`` on ``key``, where ``right`` has one row per key.

    Keys frequent on the left are found by a count that reduces before its shuffle. Their
    left rows are spread over as many salts as keep each below ``hot_rows``, and only their
    right rows are repeated; all other rows keep salt 0. The salt is a hash of the row and of
    its partition's number: a recomputed task repeats it, and equal rows are spread, too. At most (left rows / ``hot_rows``) keys can be frequent, which bounds the broadcast.
    """
    hot = F.broadcast(_frequent(left, key, hot_rows))
    plain = [F.col(name(f.name)) for f in left.schema.fields if _hashable(f.dataType)]
    hashed = left.withColumn("__hash", F.xxhash64(*plain, F.spark_partition_id()))
    parts = F.coalesce("__parts", F.lit(1))
    salted_left = hashed.join(hot, key, "left").withColumn("__salt", F.pmod("__hash", parts).cast("int"))
    salted_right = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    joined = salted_left.drop("__hash", "__parts").join(salted_right.drop("__parts"), [key, "__salt"], how)
    return joined.drop("__salt")
