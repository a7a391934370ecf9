"""Near copies by SimHash fingerprints, held to the Jaccard similarity of word shingles.

Fingerprints of the distinct shingles meet under the keys of ``simhash``, where those
at 3 or fewer differing bits link.  Near copies differ in more: at a similarity of
0.8 in 10 bits on average, for which no key of fingerprints is selective.  So texts
meet under MinHash bands too; the smallest of each bucket links the others.  What all
these links connect is a candidate group.  Within it fingerprints are compared bit by
bit, 64 at a time, and of those within RADIUS the shingles themselves: only pairs at
the similarity or above count.  At a similarity of 0.8 the bands miss a pair once in
150,000, and the radius one in 20 million (of 4 and 5 shingles, one in 900,000).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm import simhash
from tripwright.llm.common import forget, group_batches, materialize, released, small_batches
from tripwright.llm.graph import components, keep_leaders

BANDS, ROWS = 30, 5
#: Differing bits of 64 up to which the shingles are compared: 4 of 5 unlike pairs are past it.
RADIUS = 28
#: Candidate groups are cut into pairs of parts: of an eighth of the group, but no fewer than SMALL and no more than PART texts.
SMALL, PART = 256, 2048
_SALTS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_SALTS[1] |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Distinct XXH64 of the text's runs of ``words`` words, ascending; a shorter text is one run."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, 42)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)).tolist()
    starts = [0, *ends[:-words]]
    return np.unique(np.fromiter((digest(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the least of each of its rows' orders; no keys for no shingles."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1 << 13):
        some = hashes[None, at : at + (1 << 13)] ^ _SALTS[0][:, None]
        some *= _SALTS[1][:, None]
        np.minimum(least, some.min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _printer(words: int):
    @F.pandas_udf("digest long, fp long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            sets = [shingles(x or "", words) for x in batch]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64)
            prints = np.array([simhash.majority(s) for s in sets], np.uint64)
            yield pd.DataFrame({"digest": digests.view(np.int64), "fp": prints.view(np.int64), "bands": [bands(s).view(np.int64) for s in sets]})

    return run


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where the owners of each start, and the owners."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    values, starts = np.unique(flat[order], return_index=True)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    return values, np.append(starts, len(flat)), owners


def forest(sets: list[np.ndarray], prints: np.ndarray, similarity: float, work: Counter | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all pairs of non-empty sets at ``similarity`` or more whose fingerprints lie within RADIUS.

    Each set is opened once at most, and only if the fingerprint of one not reached yet
    is near.  ``work`` counts the opened sets.
    """
    sizes, fresh, edges = np.array([len(s) for s in sets]), np.ones(len(sets), bool), []
    near, live = simhash.reach(prints, RADIUS), None
    for root in range(len(sets)):
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo and (left := int(fresh.sum())):
            at = todo.pop()
            close = np.unpackbits(near[at].view(np.uint8), count=len(sets), bitorder="little").view(bool) & fresh
            if not close.any():
                continue
            if live is None or 2 * left < len(live):  # what has been reached needs no further comparison
                live = np.flatnonzero(fresh)
                values, starts, owners = _postings([sets[i] for i in live])
            if work is not None:
                work["opened"] += 1
            place = np.searchsorted(values, sets[at])
            hit = place < len(values)
            hit[hit] = values[place[hit]] == sets[at][hit]
            place = place[hit]
            length = starts[place + 1] - starts[place]
            index = np.repeat(starts[place] - np.cumsum(length) + length, length) + np.arange(length.sum())
            both = np.bincount(owners[index], minlength=len(live))
            new = live[(both >= similarity * (sizes[live] + sizes[at] - both) - 1e-9) & close[live]]
            fresh[new] = False
            edges += [(at, x) for x in new.tolist()]
            todo += new.tolist()
    return edges


def _verifier(words: int, similarity: float):
    """Edges of each sorted (root, i, j) group of texts; their shingles exist only here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, groups in group_batches(released(frames), ["root", "i", "j"]):
            rows: list[tuple[int, int]] = []
            for _, group in groups:
                ids, prints = group["digest"].to_numpy(), group["fp"].to_numpy().view("u8")
                rows += [(int(ids[a]), int(ids[b])) for a, b in forest([shingles(x or "", words) for x in group["text"]], prints, similarity)]
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b"])

    return run


def _fingerprint_links(prints: DataFrame, least: DataFrame) -> DataFrame:
    """Links ``(hub, digest)`` that connect the digests of ``prints`` (digest, fp) with equal fingerprints or linked ones; ``least`` (fp, hub) holds each one's smallest digest."""
    near = simhash.links(least.select("fp")).join(least.select(F.col("fp").alias("a"), "hub"), "a")
    near = near.join(least.select(F.col("fp").alias("b"), F.col("hub").alias("digest")), "b").select("hub", "digest")
    return near.union(prints.join(least, "fp").where("digest <> hub").select("hub", "digest"))


def links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between the digests of ``texts`` (digest, text, fp, bands; one row a digest) that connect all pairs at ``similarity`` or more."""
    keyed = materialize(texts.select("digest", F.explode("bands").alias("key")))
    hubs = keyed.groupBy("key").agg(F.min("digest").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    met = keyed.join(hubs, "key").where("digest <> hub").select("hub", "digest")
    prints = materialize(texts.where("size(bands) > 0").select("digest", "fp"))
    least = materialize(prints.groupBy("fp").agg(F.min("digest").alias("hub")))
    met = met.union(_fingerprint_links(prints, least))
    candidates = components(met.select(F.col("hub").alias("a"), F.col("digest").alias("b")))
    candidates = materialize(candidates.select(F.col("node").alias("digest"), "root"))
    forget(keyed, prints, least)
    parts = candidates.groupBy("root").agg(F.expr(f"CAST(ceil(count(*) / greatest({min(SMALL, PART)}, least({PART}, ceil(count(*) / 8)))) AS INT)").alias("parts"))
    rows = candidates.join(parts, "root").withColumn("part", F.expr("CAST(pmod(xxhash64(digest), parts) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("digest", "root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows = texts.select("digest", "text", "fp").join(rows, "digest")
    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(_verifier(words, similarity), "a long, b long").distinct()


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of the rows that links at ``similarity`` connect, one stays, as in ``keep_leaders``.

    Texts without a word are copies of each other.
    """
    columns = [f"`{c}`" for c in docs.columns]
    marked = small_batches(docs).withColumn("__tw_print", _printer(words)(F.col("text")))
    marked = marked.select(*columns, F.col("__tw_print.digest").alias("__tw_digest"), F.col("__tw_print.fp").alias("__tw_fp"), F.col("__tw_print.bands").alias("__tw_bands"))
    return keep_leaders(marked, "__tw_digest", lambda one: links(one.select("text", *[F.col(f"__tw_{c}").alias(c) for c in ("digest", "fp", "bands")]), words, similarity))
