"""Scores: pass rate, failure breakdown, and comparison of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.functions.labels import CATEGORIES


def pass_rate(verdicts: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """``total``, ``passed``, ``no_verdict`` and ``pass_rate`` (0.0 for no rows).

    Calls without a verdict stay in the total, so they can only lower the rate. Without
    grouping columns an empty table still gives one row.
    """
    totals = verdicts.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("passed"),
        F.count_if(F.col("is_valid").isNull()).alias("no_verdict"),
    )
    rate = F.coalesce(F.try_divide(F.col("passed"), F.col("total")), F.lit(0.0))
    return totals.withColumn("pass_rate", rate)


def failure_breakdown(verdicts: DataFrame, by: str = "model") -> DataFrame:
    """One row per model and category, zeros included, with the share of all samples.

    One aggregate with a column per category, then a narrow unpivot: no second shuffle and
    no join to fill the zeros.
    """
    counts = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    wide = verdicts.groupBy(by).agg(F.count("*").alias("total"), *counts)
    return with_percent(wide.unpivot([by, "total"], list(CATEGORIES), "category", "n"))


def with_percent(breakdown: DataFrame) -> DataFrame:
    """Add ``percent`` of all samples, one decimal. ``total`` is an input, not the sum."""
    share = F.coalesce(F.try_divide(100 * F.col("n"), F.col("total")), F.lit(0.0))
    return breakdown.withColumn("percent", F.round(share, 1))


def shown(breakdown: DataFrame) -> DataFrame:
    """Rows a report prints: zero counts are left out."""
    return breakdown.filter("n > 0")


def breakdown_rollup(verdicts: DataFrame, by: tuple[str, ...] = ("model", "tool", "outcome")) -> DataFrame:
    """Counts for every prefix of the grouping columns.

    Rows are counted on the full key first, so only the small result is expanded.
    """
    base = verdicts.groupBy(*by).agg(F.count("*").alias("n"))
    levels = F.grouping_id().cast("int").alias("level")
    return base.rollup(*by).agg(levels, F.sum("n").alias("n"))


def compare_rates(rates: DataFrame, base: str, new: str) -> DataFrame:
    """Gain in points and ratio of two models' pass rates; ratio is NULL for a base of 0."""
    wide = rates.agg(
        F.max(F.when(F.col("model") == base, F.col("pass_rate"))).alias("base_rate"),
        F.max(F.when(F.col("model") == new, F.col("pass_rate"))).alias("new_rate"),
    )
    return wide.select(
        "base_rate",
        "new_rate",
        F.round(100 * (F.col("new_rate") - F.col("base_rate")), 2).alias("delta_pp"),
        F.round(F.try_divide("new_rate", "base_rate"), 1).alias("ratio"),
    )


def compare_breakdowns(breakdown: DataFrame, base: str, new: str) -> DataFrame:
    """Per category: both counts, the change in percent of the base count, the change of the
    share of all samples in points, and the ratio of both shares (NULL for a base of 0)."""

    def of(model: str, column: str):
        return F.coalesce(F.sum(F.when(F.col("model") == model, F.col(column))), F.lit(0))

    wide = breakdown.groupBy("category").agg(
        *(of(m, c).alias(f"{side}_{c}") for side, m in (("base", base), ("new", new)) for c in ("n", "total"))
    )
    change = F.try_divide(100 * (F.col("new_n") - F.col("base_n")), F.col("base_n"))
    base_share, new_share = (F.try_divide(F.col(f"{s}_n"), F.col(f"{s}_total")) for s in ("base", "new"))
    return wide.select(
        "category",
        "base_n",
        "new_n",
        F.round(change, 0).alias("pct_change"),
        F.round(100 * (F.coalesce(new_share, F.lit(0.0)) - F.coalesce(base_share, F.lit(0.0))), 2).alias("delta_pp"),
        F.round(F.try_divide(new_share, base_share), 2).alias("ratio"),
    )


def paired_outcomes(verdicts: DataFrame, base: str, new: str, key: str = "example_id") -> DataFrame:
    """How often both models pass an example, only one, or neither.

    A grouped aggregate instead of a self-join: rows of one example are reduced before the
    shuffle. A model passes an example if all its responses to it do.
    """

    def passed(model: str):
        return F.bool_and(F.when(F.col("model") == model, F.coalesce("is_valid", F.lit(False))))

    pairs = verdicts.groupBy(key).agg(passed(base).alias("pass_a"), passed(new).alias("pass_b"))
    both = pairs.filter("pass_a IS NOT NULL AND pass_b IS NOT NULL")
    return both.groupBy("pass_a", "pass_b").agg(F.count("*").alias("n"))
