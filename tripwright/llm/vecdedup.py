"""Embedding near-duplicates by sorted projection passes.

A pass sorts the vectors of each label by the concatenated bits of random
projections and compares each with the next few; verified pairs are united across
passes.  Within the groups so found, all links are then counted exactly, by blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import gapless_index, group_batches, join_by_key, materialize
from tripwright.llm.graph import components

PASSES, WINDOW = 12, 24
#: Rows of a block of a pass; members of a part of a group, at least and at most.
BLOCK, SMALL, PART = 4096, 64, 2048


def _signatures(vectors: np.ndarray, passes: int) -> np.ndarray:
    """``[vector, pass]``: 62 signs of random projections each, as a number that sorts like the bits."""
    out = np.zeros((len(vectors), passes), np.int64)
    weights = 1 << np.arange(61, -1, -1, dtype=np.int64)
    for p in range(passes):
        planes = np.random.default_rng(1000 + p).standard_normal((vectors.shape[1], 62))
        out[:, p] = (vectors @ planes > 0) @ weights
    return out


def _prepared(passes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            rows = []
            by_size: dict[int, list[int]] = {}
            vectors = [np.asarray(x, np.float64) for x in frame["embedding"]]
            for i, x in enumerate(vectors):
                by_size.setdefault(len(x), []).append(i)
            for places in by_size.values():
                table = np.stack([vectors[i] for i in places])
                for i, signs in zip(places, _signatures(table, passes)):
                    data = vectors[i].tobytes()
                    label = frame["label"].iloc[i]
                    rows.append((frame["vec_id"].iloc[i], label, hashlib.sha256(f"{label}\0".encode() + data).digest(), data, signs))
            yield pd.DataFrame(rows, columns=["vec_id", "label", "digest", "v", "signs"])

    return run


def _unit(blobs: pd.Series) -> np.ndarray:
    table = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def _windows(least: float, window: int):
    """Compare each row of a sorted block with the next ones of its pass, label and dimension; rows of one block have ``block`` equal."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, groups in group_batches(frames, ["block", "dim"]):
            a, b = [], []
            for _, frame in groups:
                keys = frame["run"].to_numpy()
                own, ids, mine = _unit(frame["v"]), frame["rep"].to_numpy(), frame["own"].to_numpy()
                for step in range(1, min(window, len(own) - 1) + 1):
                    hit = np.flatnonzero(mine[:-step] & (keys[:-step] == keys[step:]) & ((own[:-step] * own[step:]).sum(axis=1) >= least))
                    a.append(ids[hit])
                    b.append(ids[hit + step])
            if a:
                pairs = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                if len(pairs):
                    yield _forest(pairs)

    return run


def _passes(reps: DataFrame, window: int) -> DataFrame:
    """rep, dim, v, run, rank, block, own: every vector in each pass's order, cut into blocks of BLOCK rows.

    Vectors are ranked over all passes at once, on narrow rows, so that where a
    block ends depends on the order alone and not on partitions.  A block also holds
    the ``window`` rows after it, which are its neighbours but not its own.
    """
    order = ["turn", "label", "dim", "sign", "rep"]
    turns = reps.select("rep", "label", "dim", F.posexplode("signs").alias("turn", "sign"))
    placed = materialize(turns.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    ranked = gapless_index(placed, [], [F.col(c) for c in order], F.col("pid"), "rank")
    ranked = ranked.select("rep", F.xxhash64("turn", "label", "dim").alias("run"), "rank")
    block, rest = F.floor(F.col("rank") / BLOCK), F.pmod("rank", F.lit(BLOCK))
    where = F.when((rest < window) & (block > 0), F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))
    return ranked.select("rep", "run", "rank", F.inline(where)).join(reps.select("rep", "dim", "v"), "rep")


def _forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the pairs: at most one a vector leaves the task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
        if (x := root(a)) != (y := root(b)):
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")


def _count(least: float):
    """Links of each vector to those of its group: rows of sorted (root, i, j) groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, groups in group_batches(frames, ["root", "i", "j"]):
            out = []
            for (_, i, j), group in groups:
                side = group["part"].to_numpy()
                left = group[side == i]
                right = left if i == j else group[side == j]
                if not len(left) or not len(right):
                    continue
                a, b = _unit(left["v"]), _unit(right["v"])
                hits = a @ b.T >= least
                if i == j:
                    np.fill_diagonal(hits, False)
                out.append(pd.DataFrame({"rep": left["rep"], "n": hits @ right["copies"].to_numpy()}))
                if i != j:
                    out.append(pd.DataFrame({"rep": right["rep"], "n": hits.T @ left["copies"].to_numpy()}))
            if out:
                yield pd.concat(out)

    return run


def links(vectors: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector.

    Vectors link at equal, non-null labels and a cosine of ``least`` or more.  Null,
    empty and zero vectors and those with null or non-finite components link with
    nothing.  Several rows of one vec_id count as one, the smallest usable (label, vector);
    a null vec_id has no row.  Equal vectors of a label are one class and compared
    once.  A group's links are counted exactly; two groups stay apart only where the bits
    of all passes keep all their links apart, which is how recall can fall short of 1.
    The result does not depend on how ``vectors`` is partitioned.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    one = vectors.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.when(usable, F.struct("label", "embedding"))).alias("s")).select("vec_id", "s.label", "s.embedding")
    ready = one.where("embedding IS NOT NULL").withColumn("label", F.col("label").cast("string")).mapInPandas(_prepared(passes), "vec_id long, label string, digest binary, v binary, signs array<long>")
    ready = materialize(ready)
    classes = materialize(ready.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reps = ready.join(classes.select(F.col("rep").alias("vec_id"), "rep", "copies"), "vec_id").select("rep", "copies", "label", "v", F.octet_length("v").alias("dim"), "signs")
    reps = materialize(reps)
    blocks = _passes(reps, window).repartition("block").sortWithinPartitions("block", "dim", "rank")
    found = components(blocks.mapInPandas(_windows(least, window), "a long, b long"))
    grouped = materialize(found.select(F.col("node").alias("rep"), "root").join(reps.select("rep", "copies", "v"), "rep"))
    # Eight parts or more above SMALL members, and larger ones for larger groups, so that a vector is copied seldom.
    sizes = grouped.groupBy("root").agg(F.expr(f"CAST(ceil(count(*) / greatest({SMALL}, least({PART}, ceil(count(*) / 8)))) AS INT)").alias("parts"))
    cells = grouped.join(sizes, "root").withColumn("part", F.expr("CAST(pmod(xxhash64(rep), parts) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cells = cells.select("rep", "copies", "v", "part", "root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    counted = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(_count(least), "rep long, n long")
    counted = counted.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.join(grouped.select("rep", "root"), "rep", "left").join(counted, "rep", "left")
    known = known.select("digest", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    named = join_by_key(ready.select("vec_id", "digest"), materialize(known), "digest", "copies").select("vec_id", "n_links", "component_id")
    alone = one.where("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
