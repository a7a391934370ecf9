"""Repeated passages by Rabin-Karp hashes of every window of words.

A window's hash is a polynomial in the hashes of its words, so that the hashes of all
windows of a text come from one running sum.  Tasks hand each distinct window of the
texts at hand on once, with the smallest document that holds it, to the bucket of
its hash; there the windows are counted, and every holder but the smallest document is
told.  A window that a smaller document of the same task holds needs no message.
Back at the text, repeated windows merge into maximal intervals, which are removed.

Two windows are taken as equal if 64 bits of one polynomial and the bucket's bits of
another are.  Buckets grow with the input, so what is compared grows from some 70
bits over a few GB to 87 over 100 TB, where about one pair of unlike windows in all
is expected to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import group_batches, small_batches

#: Windows that a task gathers before it hands them on, and that one bucket has on average.
#: A message holds FLUSH * BUCKET / windows of them: thousands at 30 GB, and 25 at 4 TB; beyond, raise both.
FLUSH = BUCKET = 1 << 21
#: Bytes of text a word, about; only the number of buckets depends on it.
WORD_BYTES = 6
#: Odd and 3 modulo 8, so that the differences of their powers have few factors of two.
_BASES = (0x9E3779B97F4A7C13, 0xD1B54A32D192ED03)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Rows without a doc_id come after all others.
LAST_DOC = np.iinfo(np.int64).max


def split(text: str | None) -> list[bytes]:
    """The words of a text: runs of anything but the six ASCII white spaces."""
    return text.encode().split() if text else []


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _rolled(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial hash of every ``window`` consecutive values, mixed."""
    n = len(values)
    if n < window:
        return np.zeros(0, np.uint64)
    bits = max(12, n.bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, bits)[:n], out=sums[1:])
    out = (sums[window:] - sums[:-window]) * _powers(pow(base, -1, 1 << 64), bits)[: n - window + 1]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    return _rolled(words, window, _BASES[0])


def _buckets(words: np.ndarray, window: int, buckets: int) -> np.ndarray:
    other = (words ^ (words >> np.uint64(31))) * _MIX
    return (((_rolled(other, window, _BASES[1]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)


def _blobs(bucket: np.ndarray, doc: np.ndarray, hashes: np.ndarray, ids: np.ndarray, salts: np.ndarray, repeated: bool) -> pd.DataFrame:
    """A row for each bucket: its documents, their salts, how many windows each has, and these."""
    order = np.lexsort((doc, bucket))
    bucket, doc, hashes = bucket[order], doc[order], hashes[order]
    new_bucket = np.append(True, bucket[1:] != bucket[:-1])
    starts = np.flatnonzero(new_bucket | np.append(True, doc[1:] != doc[:-1]))
    counts, owner = np.diff(np.append(starts, len(doc))).astype("<u4"), doc[starts]
    cuts = np.flatnonzero(new_bucket)
    first = np.searchsorted(starts, cuts)
    ends, lasts = np.append(cuts[1:], len(doc)), np.append(first[1:], len(starts))
    owner_ids, owner_salts = ids[owner], salts[owner]
    return pd.DataFrame({
        "bucket": bucket[cuts].astype("i4"), "repeated": repeated, "docs": [owner_ids[a:b].tobytes() for a, b in zip(first, lasts)], "salts": [owner_salts[a:b].tobytes() for a, b in zip(first, lasts)],
        "counts": [counts[a:b].tobytes() for a, b in zip(first, lasts)], "hashes": [hashes[a:b].tobytes() for a, b in zip(cuts, ends)],
    })


def _sender(window: int, buckets: int, flush: int):
    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        ids = np.concatenate([x[0] for x in held])
        salts = np.concatenate([x[1] for x in held])
        before = np.cumsum([0] + [len(x[0]) for x in held])
        doc = np.concatenate([x[2] + b for x, b in zip(held, before)])
        hashes, bucket = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
        # Documents by place in the order of (doc_id, salt): a smaller place is a smaller or an equal doc_id.
        order = np.lexsort((salts, ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, salts, doc = ids[order], salts[order], place[doc]
        order = np.lexsort((doc, hashes, bucket))
        doc, hashes, bucket = doc[order], hashes[order], bucket[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1]))
        once = new | np.append(True, doc[1:] != doc[:-1])  # a document's own repeats are one
        first_id = ids[doc[new]][np.cumsum(new) - 1]
        later = once & (ids[doc] > first_id)
        first = once & ~later  # of one doc_id, however many rows it has
        yield _blobs(bucket[first], doc[first], hashes[first], ids, salts, False)
        if later.any():
            yield _blobs(bucket[later], doc[later], hashes[later], ids, salts, True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for frame in frames:
            words = [split(x) for x in frame["text"]]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            values = word_hashes(list(chain.from_iterable(words)))
            if len(values) < window:
                continue
            del words
            doc = np.repeat(np.arange(len(sizes)), sizes)
            inside = doc[: len(doc) - window + 1] == doc[window - 1 :]
            own = doc[: len(inside)][inside]
            if len(own):
                held.append((frame["doc"].to_numpy(np.int64), frame["salt"].to_numpy().astype("<u2"), own, window_hashes(values, window)[inside], _buckets(values, window, buckets)[inside]))
                count += len(own)
            if count >= flush:
                yield from sent(held)
                held, count = [], 0
        if held:
            yield from sent(held)

    return run


def _joined(blobs: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Document, salt and hash of each window of the rows."""
    counts = np.frombuffer(b"".join(blobs["counts"]), "<u4")
    docs, salts = np.frombuffer(b"".join(blobs["docs"]), np.int64), np.frombuffer(b"".join(blobs["salts"]), "<u2")
    return np.repeat(docs, counts), np.repeat(salts, counts), np.frombuffer(b"".join(blobs["hashes"]), np.uint64)


def _cell(doc, salt, cells: int, mod):
    """Where a document's rows and what is told of it meet, of numpy's numbers or of columns."""
    return mod(mod(doc, 1_000_003) * 7_919 + salt, cells)


def _counter(cells: int):
    """Sorted buckets to the windows that a smaller document holds, by cells of the documents to tell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, groups in group_batches(frames, ["bucket"]):
            for _, group in groups:
                known = group["repeated"].to_numpy(bool)
                docs, salts, hashes = _joined(group[~known])
                found = [_joined(group[known])]
                if len(hashes):
                    order = np.argsort(hashes)
                    docs, salts, hashes = docs[order], salts[order], hashes[order]
                    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                    later = docs > np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(hashes))))
                    found.append((docs[later], salts[later], hashes[later]))
                docs, salts, hashes = (np.concatenate(x) for x in zip(*found))
                if len(docs):
                    order = np.lexsort((hashes, salts, docs))
                    docs, salts, hashes = docs[order], salts[order], hashes[order]
                    place = np.cumsum(np.append(False, (docs[1:] != docs[:-1]) | (salts[1:] != salts[:-1])))
                    first = np.append(True, place[1:] != place[:-1])
                    yield _blobs(_cell(docs, salts.astype(np.int64), cells, np.mod), place, hashes, docs[first], salts[first], True).rename(columns={"bucket": "__tw_cell"}).drop(columns="repeated")

    return run


def covered(words: list[bytes], repeated: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a window whose hash is among ``repeated``."""
    hits = np.flatnonzero(np.isin(window_hashes(word_hashes(words), window), repeated))
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, hits, 1)
    np.add.at(turns, hits + window, -1)
    return np.cumsum(turns[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true values as (start, stop)."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype("i1"), [0]])))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


BLOB = "docs binary, salts binary, counts binary, hashes binary"


def _finisher(columns: list[str], window: int, outcome: Callable[[list[bytes], np.ndarray], tuple], kinds: dict[str, pa.DataType]):
    """Rows sorted by cell, what is told before the documents, to documents with what ``outcome`` makes of their words and of which are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, told = None, []
        known: dict[tuple[int, int], np.ndarray] | None = None
        for batch in batches:
            rows = []
            names = ["__tw_cell", "__tw_doc", "__tw_salt", "text", *(f"__tw_{x.split()[0]}" for x in BLOB.split(", "))]
            for own, doc, salt, text, docs, *blob in zip(*[batch.column(n).to_pylist() for n in names]):
                if own != cell:
                    cell, told, known = own, [], None
                if docs is not None:
                    told.append((docs, *blob))
                    continue
                if known is None:
                    known = _by_document(told)
                words, found = split(text), known.get((doc, salt))
                rows.append(outcome(words, np.zeros(len(words), bool) if found is None else covered(words, found, window)))
            mine = batch.filter(pc.is_null(batch.column("__tw_docs")))
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in columns), *added], names=[*columns, *kinds])

    return run


def _by_document(told: list[tuple[bytes, ...]]) -> dict[tuple[int, int], np.ndarray]:
    """The repeated windows of each (document, salt)."""
    if not told:
        return {}
    docs, salts, hashes = _joined(pd.DataFrame(told, columns=[x.split()[0] for x in BLOB.split(", ")]))
    order = np.lexsort((salts, docs))
    docs, salts, hashes = docs[order], salts[order], hashes[order]
    cuts = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (salts[1:] != salts[:-1])))
    return {(d, s): h for d, s, h in zip(docs[cuts].tolist(), salts[cuts].tolist(), np.split(hashes, cuts[1:]))}


def _apply(docs: DataFrame, window: int, outcome: Callable[[list[bytes], np.ndarray], tuple], kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``docs`` and the columns ``kinds``, which ``outcome`` makes of a text's words and of which of them are repeated.

    What is told of documents and the documents meet in cells, whose number grows with
    the input; a cell's messages come first, and its documents stream past them.
    """
    salt = F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("int")
    keyed = small_batches(docs).withColumns({"__tw_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_DOC))), "__tw_salt": salt})
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (WORD_BYTES * BUCKET)))
    blobs = keyed.select(F.col("__tw_doc").alias("doc"), F.col("__tw_salt").alias("salt"), "text").mapInPandas(_sender(window, buckets, FLUSH), f"bucket int, repeated boolean, {BLOB}")
    told = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(_counter(buckets), f"__tw_cell int, {BLOB}")
    told = told.withColumnsRenamed({x.split()[0]: f"__tw_{x.split()[0]}" for x in BLOB.split(", ")})

    cell = _cell(F.col("__tw_doc"), F.col("__tw_salt"), buckets, lambda x, n: F.pmod(x, F.lit(n))).cast("int")
    both = keyed.withColumn("__tw_cell", cell).unionByName(told, allowMissingColumns=True)
    both = both.repartition(buckets, "__tw_cell").sortWithinPartitions("__tw_cell", F.isnull("__tw_docs"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{name} {kind}" for name, (kind, _) in kinds.items())])
    return both.mapInArrow(_finisher(docs.columns, window, outcome, {name: kind for name, (_, kind) in kinds.items()}), schema)


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without the words of windows that also start in a document of a smaller doc_id.

    ``text`` becomes the words kept, joined by single spaces (a null text stays null);
    ``__tw_removed`` has the maximal intervals of words removed, as (start, stop).  All
    windows are judged on the input.  Rows of one doc_id do not repeat each other, and a
    row without a doc_id comes after all rows that have one.  A text of fewer words
    than ``window`` keeps all.
    """

    def outcome(words: list[bytes], mask: np.ndarray) -> tuple[str, list[dict]]:
        return b" ".join(w for w, gone in zip(words, mask) if not gone).decode(), [{"start": a, "stop": b} for a, b in intervals(mask)]

    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    found = _apply(docs, window, outcome, {"__tw_kept": ("string", pa.string()), "__tw_removed": ("array<struct<start:int,stop:int>>", spans)})
    return found.withColumn("text", F.when(F.col("text").isNotNull(), F.col("__tw_kept"))).drop("__tw_kept")


def digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the digest of the words kept, of each row as in ``remove_repeats``."""

    def outcome(words: list[bytes], mask: np.ndarray) -> tuple[int, int, str]:
        kept = [w for w, gone in zip(words, mask.tolist()) if not gone] if mask.any() else words
        return len(words), int(mask.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    long = ("long", pa.int64())
    return _apply(docs.select("doc_id", "text"), window, outcome, {"n_words": long, "n_removed": long, "kept_sha256": ("string", pa.string())}).drop("text")
