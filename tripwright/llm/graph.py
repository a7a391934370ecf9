"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import bucketed, forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``: the smallest node that each node reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every
    step hangs a node's neighbours on the smallest of them, until only stars are
    left.  Neighbours meet in aggregates and joins, never in a list, so a centre
    with a third of all nodes is an ordinary, splittable join.  Each round is
    written to the shared folder.  Nulls and loops are left out; a node without
    edges is not returned.
    """
    now = materialize(_tidy(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    state = _state(now)
    while True:
        last, now = now, materialize(_small_star(_large_star(now)))
        after = _state(now)
        forget(last)
        if after == state:
            break
        state = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())


def _tidy(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs.where(a != b).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(pairs.select("hi", "lo"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    return _tidy(pairs.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b")).union(least.select("hi", "m")))


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def keep_leaders(marked: DataFrame, mark: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of the rows of ``marked`` whose ``mark`` (a long) is equal or linked, one each, without ``mark`` and other ``__tw_`` columns.

    It is the row of the smallest (doc_id, mark, text hash), rows without a doc_id after all
    others; a hash of the whole row decides between rows that agree in these.
    ``find`` gives the links ``(a, b)`` of a table with one row for each mark.  Whole
    rows are shuffled once, to the buckets of their marks, where they stay.
    """
    columns = [f"`{c}`" for c in marked.columns]
    order = F.struct(F.isnull("doc_id"), "doc_id", F.xxhash64("text"), F.xxhash64(*columns))
    one = marked.groupBy(mark).agg(F.min_by(F.struct(*[c for c in columns if c != f"`{mark}`"]), order).alias("row")).select(mark, "row.*")
    one = bucketed(one, mark)
    links = materialize(find(one))
    found = components(links).select(F.col("node").alias(mark), "root")
    firsts = found.join(one.select(mark, "doc_id"), mark)
    firsts = materialize(firsts.select("root", F.struct(F.isnull("doc_id"), "doc_id", F.col(mark).alias("mark")).alias("one")))
    leaders = firsts.groupBy("root").agg(F.min("one").alias("leader"))
    gone = materialize(firsts.join(leaders, "root").where("one.mark <> leader.mark").select(F.col("one.mark").alias(mark)))
    forget(links, firsts)
    return one.join(gone, mark, "left_anti").select(*[c for c in columns if not c.startswith("`__tw_")])
