"""Best-two-fit packing of token pieces into sequences of bounded length.

A piece's length is all that packing depends on, and lengths are bounded by the
sequence, so the packing is planned on the table of (length, count): fill a bin
greedily, longest piece first; then replace its smallest piece with the two unpacked
pieces that fill the gap, so widened, more tightly.  Equal bins are planned together.
Pieces then take the planned places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import gapless_index, hash_buckets, materialize, released, small_batches


@lru_cache(maxsize=2)
def _encoding(vocabulary_path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file: its vocabulary as ranks and its added tokens, encoded by tiktoken.

    Ids of a vocabulary that was trained by merges ascend in the order of the merges,
    so they are the ranks.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        found = json.load(file)
    added = {x["content"]: x["id"] for x in found["added_tokens"]}
    byte_of = {c: b for b, c in bytes_to_characters().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def bytes_to_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the limit."""
    first = total % limit or min(total, limit)
    return [(0, first)] + [(at, limit) for at in range(first, total, limit)]


def tokenized(docs: DataFrame, vocabulary_path: str, limit: int, end: int, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, if asked for) of each document's pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary_path)
        for frame in released(frames):
            rows = []
            for doc, text in zip(frame["doc_id"].array, frame["text"].array):
                tokens = np.append(encoding.encode_to_numpy(text, allowed_special="all").astype("<u4") if text else np.zeros(0, "<u4"), np.array([end], "<u4"))
                for k, (start, length) in enumerate(cut(len(tokens), limit)):
                    part = tokens[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(part.tobytes())) + ((part.astype("i4"),) if ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    # As text, so that pandas does not turn ids beside a null into floats.
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return small_batches(docs).select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one bin, number of such bins), covering each length as often as counted.

    ``counts`` has at most ``limit`` keys, whatever the number of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    bins: list[tuple[tuple[int, ...], int]] = []
    while left:
        sizes = sorted(left, reverse=True)
        used: Counter[int] = Counter()
        room = limit
        for size in sizes:
            take = min(left[size], room // size)
            if take:
                used[size] += take
                room -= take * size
        if room:
            least = min(used)
            best, pair = room, None
            wide = room + least
            free = {s: left[s] - used[s] for s in sizes if left[s] > used[s]}
            # The freed piece itself stays out: a pair that took it back would be the old bin with one more.
            for a in free:
                b = min(wide - a, a)
                while b > 0 and wide - a - b < best:
                    if free.get(b, 0) >= (2 if a == b else 1):
                        best, pair = wide - a - b, (a, b)
                        break
                    b -= 1
                if not best:
                    break
            if pair:
                used[least] -= 1
                used += Counter(pair)
        used = +used
        times = min(left[s] // n for s, n in used.items())
        bins.append((tuple(sorted(used.elements(), reverse=True)), times))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return bins


def places(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, number in a bin, first sequence, first offset): where each rank of a length goes."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, times in bins:
        offset = 0
        for size, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((size, taken[size], taken[size] + n * times, n, sequence, offset))
            taken[size] += n * times
            offset += size * n
        sequence += times
    return rows


def pack(pieces: DataFrame, limit: int, bucket: Column, order: list[Column]) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, which has a ``length`` of 1 to ``limit`` on each row.

    ``pieces`` is read more than once and must be materialized.  The planned places
    are at most a few for each length and bin shape; Spark chooses how to join them.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = pieces.sparkSession
    where = spark.createDataFrame(places(plan(counts, limit)), "length long, low long, high long, per long, first long, base long")
    # A place's ranks are cut at even strides, so that the join is by equality and a hot length is spread.
    stride = 1 << 16
    where = where.withColumn("step", F.explode(F.sequence(F.floor(F.col("low") / stride), F.floor((F.col("high") - 1) / stride))))
    ranked = gapless_index(pieces, ["length"], order, hash_buckets(pieces, bucket), "_rank")
    ranked = ranked.withColumn("step", F.floor(F.col("_rank") / stride))
    out = ranked.join(where, ["length", "step"]).where("_rank >= low AND _rank < high")
    nth = F.col("_rank") - F.col("low")
    return out.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("per"))).withColumn("offset", F.col("base") + F.pmod(nth, F.col("per")) * F.col("length")).drop("_rank", "step", "low", "high", "per", "first", "base")


def pack_documents(docs: DataFrame, vocabulary_path: str, limit: int = 1024, end: int = 2, ids: bool = False) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    ``vocabulary_path`` is a byte-level BPE in the ``tokenizers`` format.  A document is its tokens and the ``end`` id; a null or empty text is that id
    alone.  Only documents beyond ``limit`` are cut.  Every row of ``docs`` is packed,
    repeated rows and rows without a doc_id too.
    """
    pieces = tokenized(docs, vocabulary_path, limit, end, ids)
    if not ids:
        packed = pack(materialize(pieces), limit, F.struct("doc_id", "piece"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
        return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    # Ids are many times wider than the rest; they stay out of the ranking and meet the places once,
    # as 16-bit numbers where the vocabulary allows it.
    half = 1 << 15
    short = _encoding(vocabulary_path).max_token_value < 2 * half and end < 2 * half
    if short:
        pieces = pieces.withColumn("ids", F.transform("ids", lambda x: (x - half).cast("short")))
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    narrow = pieces.select("_row", "doc_id", "piece", "length", "ids_crc32")
    placed = pack(narrow, limit, F.struct("doc_id", "piece"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("_row")]).select("_row", "sequence_id", "offset")
    out = pieces.join(placed, "_row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    return out.withColumn("ids", F.transform("ids", lambda x: x.cast("int") + half)) if short else out
