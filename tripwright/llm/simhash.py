"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints at 3 or fewer differing bits agree on two of five blocks of bits, so
they meet under one of ten keys.  Under a key they are compared 64 at a time: bit
planes hold one bit of 64 fingerprints in each word, carry-save counters add the
differing planes, and a block of 64 is abandoned once all its counters are past the
radius.  The bits of the key are equal and not compared.  ``nearcopies`` compares with
a wider radius what its bands bring together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tripwright.llm.common import group_batches, join_by_key, materialize, small_batches
from tripwright.llm.graph import components, keep_leaders

RADIUS = 3
#: Five blocks of bits, as (lowest bit, width); any two make a key.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that one task compares with each other at most; larger buckets are cut into pairs of parts.
PART = 2048
#: Buckets of at most SMALL members share blocks; dead blocks are dropped every STEP bits.
SMALL, STEP = 8, 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(total: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of hashes: the bits that over half of them have; zero for none."""
    return _over_half(sum((_ones(hashes[at : at + (1 << 15)]) for at in range(0, len(hashes), 1 << 15)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's word shingles, by majority of their XXH64."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(parts) - words + 1
    stops = (ends[words - 1 :] - 1).tolist()
    for at in range(0, n, 1 << 15):
        total += _ones(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])), "<u8"))
    return _over_half(total, n)


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(np.array([fingerprint(x or "") for x in batch], "u8").view("i8"))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: ``[bit, word]`` with fingerprint ``64 * word + lane`` in bit ``lane``."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class Counters:
    """Carry-save counters of differing bits for blocks of 64 lanes, and ``over``: the lanes past the radius.

    They start at what makes the first bit past the radius overflow the highest
    counter.  Dead blocks leave the working set.
    """

    def __init__(self, over: np.ndarray, radius: int):
        width = radius.bit_length()
        start = (1 << width) - 1 - radius
        self.over = over
        self.counts = [np.full_like(over, _ALL if start >> k & 1 else 0) for k in range(width)]

    def add(self, carry: np.ndarray) -> None:
        for k, count in enumerate(self.counts):
            self.counts[k], carry = count ^ carry, count & carry
        self.over = self.over | carry

    def within(self) -> np.ndarray:
        return ~self.over

    def keep(self, live: np.ndarray) -> None:
        self.over, self.counts = self.over[live], [c[live] for c in self.counts]


def _lanes(blocks: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, 64 * word + lane) of the set lanes."""
    at, lane = np.nonzero(np.unpackbits(words.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little"))
    return blocks[at], lane


def _compared(left: np.ndarray, right: np.ndarray, radius: int, skip: int, same: bool, work: Counter | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks left at the last bit: place in ``left``, word of ``right``, lanes within the radius."""
    table = planes(right)
    width, order = table.shape[1], [b for b in range(64) if not skip >> b & 1]
    empty = np.zeros(width, np.uint64)
    if len(right) % 64:
        empty[-1] = _ALL << np.uint64(len(right) % 64)
    step = max(1, (1 << 15) // max(width, 1))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        row, word = (x.ravel() for x in np.mgrid[: len(some), :width])
        over = np.tile(empty, len(some))
        if same:  # lanes at or before the row's own place
            own = at + row - 64 * word
            over |= np.where(own >= 63, _ALL, np.where(own < 0, np.uint64(0), (np.uint64(2) << np.clip(own, 0, 62).astype(np.uint64)) - np.uint64(1)))
        counters = Counters(over, radius)
        counted = len(over)
        for done, bit in enumerate(order):
            if done % STEP == 0:
                live = np.flatnonzero(counters.over != _ALL)
                if len(live) < len(row):
                    counters.keep(live)
                    row, word = row[live], word[live]
                if not len(row):
                    break
            flip = np.where(some >> np.uint64(bit) & np.uint64(1), _ALL, np.uint64(0))
            counters.add(table[bit][word] ^ flip[row])
        if work is not None:
            work.update(blocks=counted, abandoned=counted - len(row))
        if len(row):
            yield at + row, word, counters.within()


def near(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, skip: int = 0, same: bool = False, work: Counter | None = None) -> np.ndarray:
    """``[n, 2]`` places of the pairs of ``left`` and ``right`` that differ in at most ``radius`` bits.

    A block is one fingerprint of ``left`` against 64 of ``right``.  Every STEP bits
    the blocks in which all lanes are past the radius are abandoned.  Bits set in ``skip`` are
    known to be equal and passed over.  With ``same``, ``right`` is ``left``: a pair is
    found once, smaller place first, and itself not at all.  ``work`` counts the
    blocks, and those abandoned before their last bit.
    """
    out = []
    for row, word, lanes in _compared(left, right, radius, skip, same, work):
        block, lane = _lanes(np.arange(len(row)), lanes)
        out.append(np.stack([row[block], 64 * word[block] + lane], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def reach(values: np.ndarray, radius: int) -> np.ndarray:
    """``[i, word]``: in bit ``lane`` whether ``values[i]`` and ``values[64 * word + lane]`` differ in at most ``radius`` bits; 64 pairs take 8 bytes."""
    out = np.zeros((len(values), -(-len(values) // 64)), np.uint64)
    for row, word, lanes in _compared(values, values, radius, 0, False, None):
        out[row, word] = lanes
    return out


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, work: Counter | None = None) -> np.ndarray:
    """The places at which the two arrays, as long as each other, differ in at most ``radius`` bits: 64 pairs a block."""
    table = planes(left ^ right)
    over = np.zeros(table.shape[1], np.uint64)
    if len(left) % 64:
        over[-1] = _ALL << np.uint64(len(left) % 64)
    counters, word = Counters(over, radius), np.arange(table.shape[1])
    for bit in range(64):
        if bit % STEP == 0:
            live = np.flatnonzero(counters.over != _ALL)
            counters.keep(live)
            word = word[live]
        counters.add(table[bit][word])
    if work is not None:
        work.update(blocks=table.shape[1], abandoned=table.shape[1] - len(word))
    block, lane = _lanes(np.arange(len(word)), counters.within())
    return 64 * word[block] + lane


def _spanning(size: int, pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs that make a spanning forest of what the pairs connect."""
    root, kept = np.arange(size), []
    while len(pairs := pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]):
        ends = np.sort(root[pairs], axis=1)
        high, first = np.unique(ends[:, 1], return_index=True)  # each root hangs on one smaller root
        kept.append(pairs[first])
        up = np.arange(size)
        up[high] = ends[first, 0]
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    return np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)


def _key_mask(tab: int) -> int:
    """The bits on which all fingerprints of a bucket of the table agree."""
    return sum(((1 << width) - 1) << low for low, width in (BLOCKS[b] for b in list(combinations(range(5), 2))[tab]))


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within sorted (table, key, i, j) groups: a spanning forest for each group.

    A large group is compared block by block; the pairs of many small ones, up to
    SMALL members each, are put together into blocks.
    """
    for _, groups in group_batches(frames, ["tab", "key", "i", "j"]):
        out, few = [], []
        for (tab, _, _, _), group in groups:
            values = group["fp"].to_numpy()
            if len(values) <= SMALL:
                few += [(values[x], values[y]) for x, y in combinations(range(len(values)), 2)]
            else:
                prints = values.view("u8")
                out.append(values[_spanning(len(values), near(prints, prints, skip=_key_mask(int(tab)), same=True))])
        if few:
            ends = np.array(few, np.int64)
            out.append(ends[near_pairs(*np.ascontiguousarray(ends.T).view("u8"))])
        if out:
            yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])


def _bits(fp: str, block: int) -> str:
    low, width = BLOCKS[block]
    return f"(shiftrightunsigned({fp}, {low}) & {(1 << width) - 1})"


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` to links ``(a, b)`` that connect all at 3 or fewer differing bits.

    A bucket gives a spanning forest of its links, at most one row a member, not all
    pairs.  A bucket beyond PART members is cut: each member goes to every pair of
    parts that its own part is in, and the pairs are compared in separate tasks.
    """
    keys = ", ".join(f"struct({t} AS tab, {_bits('fp', a)} * {1 << BLOCKS[b][1]} + {_bits('fp', b)} AS key)" for t, (a, b) in enumerate(combinations(range(5), 2)))
    rows = prints.select("fp", F.inline(F.expr(f"array({keys})")))
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["tab", "key"]).withColumn("parts", F.expr(f"CAST(ceil(n / {PART}) AS INT)"))
    rows = rows.withColumn("part", F.expr("CAST(pmod(xxhash64(fp), parts) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("fp", "tab", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return rows.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j").mapInPandas(_links, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row: the smallest doc_id that links reach.

    One row for each row of ``docs``.  A null or empty text has fingerprint zero and
    links like any other.  A row without a doc_id has its group's smallest doc_id as
    component_id, or null if the group has none.  Equal fingerprints meet in one
    aggregate; only distinct ones are compared.
    """
    printed = materialize(small_batches(docs).select("doc_id", _fingerprints("text").alias("fp")))
    prints = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(prints.select("fp"))).select(F.col("node").alias("fp"), "root")
    found = materialize(found.join(prints, "fp"))
    roots = found.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = found.select("fp", "root").join(roots, "root").select("fp", "component_id")
    classes = materialize(prints.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    return join_by_key(printed, classes, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each group of linked rows one stays, as in ``keep_leaders``.

    A doc_id may stand on several rows; each row counts with its own text.
    """
    marked = small_batches(docs).withColumn("__tw_fp", _fingerprints("text"))
    return keep_leaders(marked, "__tw_fp", lambda one: links(one.select(F.col("__tw_fp").alias("fp"))))
