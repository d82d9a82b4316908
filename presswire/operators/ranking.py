"""Positions over a whole DataFrame without collecting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswire.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row under a total order.

    A distributed sort gives each partition a consecutive range; rows carry their
    partition and position, and per-partition offsets (one row per partition) are joined
    back. The sorted rows are written to reliable storage first: offsets and rows must come
    from the same partitioning, also when an executor is lost in between.
    """
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .drop("_part", "_at", "_before")
    )
