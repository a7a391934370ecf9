"""Sharding by Karmarkar-Karp differencing, in levels.

A partial partition is a vector of subset sizes.  The two with the largest spread
are combined in opposite order, again and again, until one is left.  Groups are
differenced in chunks, by Spark tasks.  Half of a chunk makes a few subsets, half of the rest as many
smaller ones, and so on; the subsets and some single groups, of many sizes so that the
last step can even out, are the items of the next level.  There is at least one level,
and more until LAST items or fewer are left for one last differencing into the shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import forget, gapless_index, group_batches, hash_buckets, join_by_key, materialize

CHUNK, BANDS, SUBSETS, SINGLES, LAST = 4096, 6, 12, 48, 4096


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The subset, 0 to parts - 1, of each size."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    state: list[np.ndarray | None] = [None] * n
    heap = []
    for k, size in enumerate(sizes.tolist()):
        state[k] = np.zeros(parts, np.int64)
        state[k][0] = size
        heap.append((-size, k))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = state[a] + state[b][::-1]
        state[a] = state[b] = None
        order = np.argsort(-both, kind="stable")
        both = both[order] - both.min()
        state.append(both)
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), n + len(merges) - 1))
    labels: dict[int, np.ndarray] = {heap[0][1]: np.arange(parts)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        own = np.empty(parts, np.int64)
        own[order] = labels.pop(n + k)
        labels[a], labels[b] = own, own[::-1]
    return np.array([labels[k][0] for k in range(n)])


def even_out(sizes: np.ndarray, labels: np.ndarray, parts: int, turns: int = 64) -> np.ndarray:
    """``labels`` after exchanges of one item for another between the largest and the smallest subset, while one narrows their gap."""
    labels = labels.copy()
    for _ in range(turns if len(sizes) else 0):
        totals = np.bincount(labels, weights=sizes, minlength=parts)
        high, low = int(totals.argmax()), int(totals.argmin())
        gap = totals[high] - totals[low]
        ours, theirs = np.flatnonzero(labels == high), np.flatnonzero(labels == low)
        if gap < 2 or not len(theirs):
            break
        theirs = theirs[np.argsort(sizes[theirs], kind="stable")]
        above = np.searchsorted(sizes[theirs], sizes[ours] - gap / 2)
        ours, at = np.tile(ours, 2), np.clip(np.concatenate([above, above - 1]), 0, len(theirs) - 1)  # the nearest on both sides
        moved = sizes[ours] - sizes[theirs[at]]
        best = int(np.abs(moved - gap / 2).argmin())
        if not 0 < moved[best] < gap:
            break
        labels[ours[best]], labels[theirs[at[best]]] = low, high
    return labels


def _chunk(singles: int):
    """Whole chunks of items to the items of the next level, about ``singles`` of which stay single."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, groups in group_batches(frames, ["chunk"]):
            for _, group in groups:
                yield _merged(group, singles)

    return run


def _merged(frame: pd.DataFrame, singles: int) -> pd.DataFrame:
    frame = frame.sort_values(["size", "item"], ignore_index=True)
    single = np.arange(len(frame)) % max(2, len(frame) // singles) == 0
    first = frame["item"].iloc[0].hex()
    names = np.empty(len(frame), object)
    names[single] = [f"{x.hex()}.s" for x in frame["item"][single]]
    rest = np.flatnonzero(~single)
    turn = np.arange(1, len(rest) + 1)
    band = np.minimum(np.bitwise_count((turn & -turn) - 1), BANDS - 1)  # how often 2 divides the turn: half of them never
    for b in range(BANDS):
        own = rest[band == b]
        names[own] = [f"{first}.{b}.{k}" for k in difference(frame["size"].to_numpy(np.int64)[own], SUBSETS)]
    return pd.DataFrame({"item": frame["item"], "parent": [x.encode() for x in names], "size": frame["size"]})


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """``groups(item binary, size long)``, distinct items, to ``(item, shard)``.

    What comes to the driver is bounded by LAST.  A level leaves about one item in 34,
    or, of the few items of a small table, up to one in two.
    """
    levels, now = [], groups
    while (n := now.count()) > LAST or not levels:
        # Chunks are as many as the items ask for, on however many partitions they lie, so that every level is smaller than the one before.
        chunks, parts = max(1, -(-n // CHUNK)), max(1, -(-n // (4 * CHUNK)))
        # The singles of all chunks are about LAST / 2 at least, however few chunks there are.
        singles = max(SINGLES, LAST // 2 // chunks)
        chunked = now.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks))).repartition(parts, "chunk").sortWithinPartitions("chunk", "item")
        level = materialize(chunked.mapInPandas(_chunk(singles), "item binary, parent binary, size long"))
        levels.append(level)
        now = level.groupBy(F.col("parent").alias("item")).agg(F.sum("size").alias("size"))
    last = now.orderBy("item").toPandas()
    sizes = last["size"].to_numpy(np.int64)
    last["shard"] = even_out(sizes, difference(sizes, shards), shards)
    out = groups.sparkSession.createDataFrame([(bytes(a), int(b)) for a, b in zip(last["item"], last["shard"])], "item binary, shard int")
    for level in reversed(levels):
        out = level.select("item", "parent").join(out.withColumnRenamed("item", "parent"), "parent").select("item", "shard")
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Even bytes for each shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows of equal texts, null ones among themselves, are one group and go to one
    shard.  ``slot`` numbers a shard's rows from 0.  Every row of ``docs`` has a place.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.when(F.col("text").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(body, 256))).alias("item"))
    rows = materialize(rows)
    groups = materialize(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    found = materialize(assign(groups.select("item", "size"), shards).join(groups.select("item", "n"), "item"))
    placed = materialize(join_by_key(rows, found, "item", "n").drop("item"))
    forget(rows, groups, found)  # nothing reads them any more
    out = gapless_index(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], hash_buckets(placed, "doc_id", "text_crc32"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
