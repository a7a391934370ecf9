"""The place of a row among the rows of its files, and what the first or last row of a key says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordinal(files: Sequence[str] | None = None) -> Column:
    """The place of a row that has just been read: its file, where its block starts in it, and its place in the block.

    A block is read by one task from start to end, so the number that a task gives its
    rows orders them within the block, and a task that is run again gives the same.
    Files come in the order of ``files``, names or ends of paths, others after them by path.  The
    column must be added to a frame as the reader returns it.
    """
    path = F.col("_metadata.file_path")
    turn = F.lit(len(files or ()))
    for k, name in reversed(list(enumerate(files or ()))):
        turn = F.when(path.endswith(name), k).otherwise(turn)
    return F.struct(turn.alias("turn"), path.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))


def _one(rows: DataFrame, keys: Sequence[str], place: str, pick) -> DataFrame:
    others = [c for c in rows.columns if c not in keys and c != place]
    found = rows.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in others]), place).alias("_row") if others else F.count("*").alias("_n"))
    return found.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others])


def first_rows(rows: DataFrame, keys: Sequence[str], place: str = "_ordinal") -> DataFrame:
    """The first row of each key in the order of ``place``, without it; rows are reduced before they are shuffled."""
    return _one(rows, keys, place, F.min_by)


def last_rows(rows: DataFrame, keys: Sequence[str], place: str = "_ordinal") -> DataFrame:
    """The last row of each key."""
    return _one(rows, keys, place, F.max_by)


def crosswalk(tables: Sequence[DataFrame], keys: Sequence[str], place: str = "_ordinal") -> DataFrame:
    """The rows of all tables together; of a key's rows the last one of the last table that has it."""
    marked = [t.withColumn(place, F.struct(F.lit(k).alias("table"), F.col(place).alias("row"))) for k, t in enumerate(tables)]
    out = marked[0]
    for t in marked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return last_rows(out, keys, place)
