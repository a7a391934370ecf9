"""Exact top-k search by distributed histogram selection.

Queries and candidates meet in square blocks.  In each round every block scores all its
pairs and counts them by bin within the query's range; the blocks' histograms are
added up, and the bin in which the kth score falls is the next, narrower range.  At
the end each query's kth value is known; the blocks hand on the scores above it, and
of those at it the smallest ids.  Blocks are scored again in each round, so that no
score is ever stored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwright.llm.common import materialize

BLOCK_QUERIES, BLOCK_ROWS, BINS = 1024, 8192, 1024
#: Stands for the score of a query with itself.
LEAST = np.iinfo(np.int64).min


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``q`` = floor(scale * x) of the usable vectors, one for each vec_id.

    Left out: null ids, null or empty vectors, and those with null or non-finite
    components.  Of several vectors of one vec_id the smallest in Spark's order of
    arrays stands for it.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & ~bad)
    one = ok.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by floating point where that is exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    kind = "f4" if bound < 2**24 else "f8" if bound < 2**53 else "i8"
    return (queries.astype(kind) @ rows.astype(kind).T).astype("i8")


def _across(vectors: DataFrame, queries: DataFrame, run: Callable[[pd.DataFrame, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``run(queries, ids, scores)`` over every block, for 128 queries at a time: a candidate's score, or LEAST for the query itself.

    ``queries`` are rows (vec_id, q, dim and the state of the query).  Only vectors of
    a query's own dimension are its candidates; ``ids`` ascend.
    """
    across, down = max(1, -(-vectors.count() // BLOCK_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("vec_id", "q", "dim", place(across).alias("c"), every(down).alias("r"))
    asked = queries.withColumn("r", place(down)).withColumn("c", every(across))
    names = [x.split()[0] for x in schema.split(",")]

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids, table = right["vec_id"].to_numpy(), np.stack(right["q"].to_numpy())
            for at in range(0, len(left), 128):
                part = left.iloc[at : at + 128]
                scores = _products(np.stack(part["q"].to_numpy()), table)
                scores[part["vec_id"].to_numpy()[:, None] == ids[None, :]] = LEAST
                out.append(run(part, ids, scores))
        return pd.DataFrame({n: np.concatenate([x[n] for x in out]) if out else np.zeros(0, "i8") for n in names})

    keys = ["c", "r", "dim"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(block, schema)


def histograms(vectors: DataFrame, queries: DataFrame, width: int, span: int) -> DataFrame:
    """query_id, bin, n: how many scores of all candidates lie in each ``width`` of the query's [low, low + span)."""

    def run(part: pd.DataFrame, ids: np.ndarray, scores: np.ndarray) -> dict[str, np.ndarray]:
        bins = (scores - part["low"].to_numpy()[:, None]) // width
        row, at = np.nonzero((scores != LEAST) & (bins >= 0) & (bins < -(-span // width)))
        kinds = -(-span // width)
        found, n = np.unique(row * kinds + bins[row, at], return_counts=True)
        return {"query_id": part["vec_id"].to_numpy()[found // kinds], "bin": found % kinds, "n": n}

    return _across(vectors, queries, run, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def narrowed(bins: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """``queries`` with ``low`` and ``need`` of the bin in which the need-th score from above falls; the lowest bin where there are fewer."""
    down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    known = bins.join(queries.select(F.col("vec_id").alias("query_id"), "need"), "query_id").withColumn("upto", F.sum("n").over(down))
    every = F.sum("n").over(Window.partitionBy("query_id"))
    known = known.withColumn("need", F.least("need", every)).where("upto >= need AND upto - n < need")
    state = known.select(F.col("query_id").alias("vec_id"), "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
    return queries.drop("need").join(state, "vec_id").withColumn("low", F.col("low") + F.col("bin") * width).drop("bin")


def above(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, score: the scores over each query's ``low``, and of each block the ``need`` smallest ids of those at it."""

    def run(part: pd.DataFrame, ids: np.ndarray, scores: np.ndarray) -> dict[str, np.ndarray]:
        low, need = part["low"].to_numpy()[:, None], part["need"].to_numpy()[:, None]
        tie = (scores == low) & (scores != LEAST)
        row, at = np.nonzero((scores > low) | (tie & (np.cumsum(tie, axis=1) <= need)))
        return {"query_id": part["vec_id"].to_numpy()[row], "vec_id": ids[at], "score": scores[row, at]}

    return _across(vectors, queries, run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's k best of all other vectors: query_id, rank, vec_id, score.

    ``is_query`` is a condition on vec_id.  A query with fewer candidates returns all;
    without queries or usable vectors the result is empty.  The first range is that of
    Cauchy and Schwarz; every round divides it by BINS, and after the last one bins are one score wide.
    """
    usable = materialize(integers(vectors, scale).withColumn("dim", F.size("q")))
    longest = usable.agg(F.max(F.expr("aggregate(q, 0D, (a, x) -> a + x * x)"))).first()[0]
    bound = int(longest or 0) + 1
    queries = materialize(usable.where(is_query).withColumn("low", F.lit(-bound).cast("long")).withColumn("need", F.lit(k).cast("long")))
    span = 2 * bound + 1
    while span > 1:
        width = -(-span // BINS)
        queries, span = materialize(narrowed(histograms(usable, queries, width, span), queries, width)), width
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = above(usable, queries).withColumn("rank", F.row_number().over(order))
    return kept.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
