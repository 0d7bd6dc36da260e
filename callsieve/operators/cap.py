"""Stop after N accepted rows in a stated order, without sorting the table.

The cut is found by narrowing: count rows in equal slices of the order column, keep the
slice in which the running count reaches N, and repeat inside it. Each pass collects at most
``SLICES`` counts. What remains is a plain filter on the order columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.session import materialise

SLICES = 1024


def _cut(counts: DataFrame, key: str, weight: str, n: int) -> tuple[int, int] | None:
    """Smallest key at which the running sum reaches ``n``, and the sum before that key."""
    low, high = counts.agg(F.min(key), F.max(key)).first()
    before = 0
    if low is None:
        return None
    while True:
        width = (high - low) // SLICES + 1
        slice_of = F.floor((F.col(key) - F.lit(low)) / F.lit(width)) if width > 1 else F.col(key) - F.lit(low)
        sums = (
            counts.filter(F.col(key).between(low, high))
            .groupBy(slice_of.cast("long").alias("slice"))
            .agg(F.sum(weight).alias("rows"))
            .collect()
        )
        for row in sorted(sums, key=lambda r: r["slice"]):
            if before + row["rows"] >= n:
                low, high = low + row["slice"] * width, min(high, low + (row["slice"] + 1) * width - 1)
                break
            before += row["rows"]
        else:
            return None
        if low == high:
            return low, before


def first_n(
    accepted: DataFrame, n: int, batch: str = "batch_id", pos: str = "pos", whole_batch: bool = False
) -> DataFrame:
    """The first ``n`` rows by ``(batch, pos)``; both whole numbers, the pair unique.

    Rows without a batch have no place in the order and come after all others, so they are only
    kept if all rows are. With ``whole_batch`` the batch that reaches ``n`` is kept to its end, so there may be more.
    The table is read several times, so it should be a stored one.
    """
    if n <= 0:
        return accepted.limit(0)
    placed = accepted.filter(F.col(batch).isNotNull())
    per_batch = materialise(placed.groupBy(batch).agg(F.count("*").alias("rows")), "batch-counts")
    found = _cut(per_batch, batch, "rows", n)
    if found is None:
        missing = n - (per_batch.agg(F.sum("rows")).first()[0] or 0)
        unplaced = accepted.filter(F.col(batch).isNull())
        return accepted if unplaced.limit(missing + 1).count() <= missing else placed
    last, before = found
    if whole_batch:
        return accepted.filter(F.col(batch) <= last)
    inside = accepted.filter(F.col(batch) == last).select(F.col(pos).cast("long").alias(pos), F.lit(1).alias("rows"))
    place, _ = _cut(inside, pos, "rows", n - before)
    return accepted.filter((F.col(batch) < last) | ((F.col(batch) == last) & (F.col(pos) <= place)))
