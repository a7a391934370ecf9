"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_buckets(rows: DataFrame, group: list[str], buckets: dict[str, tuple[Column, Column]], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 by (buckets, order).

    ``buckets`` names columns with their value and their place in the order; together with
    the group they must cut the rows into pieces that a task can sort.  A piece starts where
    the counts of those before it end, so no task sorts a whole group.
    """
    rows = rows.withColumns({k: v for k, (v, _) in buckets.items()})
    keys = [*group, *buckets]
    before = Window.partitionBy(*group).orderBy(*[o for _, o in buckets.values()]).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_local", local).join(starts, keys).withColumn(name, F.col("_start") + F.col("_local")).drop("_start", "_local", *buckets)


def by_prefix(digest: str, digits: int = 3) -> dict[str, tuple[Column, Column]]:
    """Buckets of hex digests by their first digits."""
    return {"_prefix": (F.substring(digest, 1, digits), F.col("_prefix"))}
