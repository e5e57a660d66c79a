"""Dense 64-bit stand-ins for string keys, and bounded heavy-key tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelattice.plans.materialize import Workspace


def number_ids(ids: DataFrame, column: str, work: Workspace, name: str) -> DataFrame:
    """Give each distinct non-null value of ``column`` a unique long ``nr``.

    The numbers are fixed by writing the table once; they carry no order.
    """
    distinct = ids.where(F.col(column).isNotNull()).select(column).distinct()
    return work.write(distinct.withColumn("nr", F.monotonically_increasing_id()), name)


def heavy_keys(df: DataFrame, keys: list[str], total: int, share: int = 2000, floor: int = 100_000) -> DataFrame:
    """Keys with more than ``max(floor, total / share)`` rows, with their ``heavy_n``.

    At most ``share`` keys can exceed that, whatever the input, so the table may be
    broadcast.  The count is pre-aggregated before the shuffle.
    """
    limit = max(floor, total // share)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("heavy_n")).where(F.col("heavy_n") > limit)


def nonempty(column: Column) -> Column:
    return column.isNotNull() & (F.length(column) > 0)
