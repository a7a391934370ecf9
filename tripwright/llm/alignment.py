"""Alignment of two tokenizers' tokens over the same bytes.

The ends of each side's tokens are set bits over the bytes.  The bits that both have
are the shared cuts, at which the tokens fall into groups; the number of bits before a
cut (its rank, by population counts) is the token there, so a cut maps to a range of
tokens of either side.  Each stretch between two ends of either side lies in one
token of both, and these pairs are the links.  A batch of texts is one row of bits, since
texts end in shared cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwright.llm.common import materialize, small_batches
from tripwright.llm.packing import _encoding

#: The table of pair counts is broadcast up to so many rows of 13 bytes, and joined by a shuffle beyond.
BROADCAST_PAIRS = 1 << 20


class Bits:
    """Places below ``size`` as packed words, with the number of those set before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view("u1"), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many are set below each place."""
        at, rest = places >> 6, (places & 63).astype(np.uint64)
        words = np.append(self.words, np.uint64(0))[at]
        return self._before[at] + np.bitwise_count(words & ((np.uint64(1) << rest) - np.uint64(1)))


class Aligned:
    """Two segmentations of the same bytes: ``cuts`` are the shared ends, and ``a_stops`` and ``b_stops`` how many tokens end up to each."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        size = int(a_ends[-1]) if len(a_ends) else 0
        if size != (int(b_ends[-1]) if len(b_ends) else 0):
            raise ValueError("the two sides differ in bytes")
        # A token that ends before byte e sets bit e - 1.
        self.a, self.b = Bits.of(a_ends - 1, size), Bits.of(b_ends - 1, size)
        self.shared, self.either = self.a & self.b, self.a | self.b
        self.cuts = self.shared.places() + 1
        self.a_stops, self.b_stops = self.a.rank(self.cuts), self.b.rank(self.cuts)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of both sides whose bytes overlap, as places among the tokens of each."""
        ends = self.either.places()
        return self.a.rank(ends), self.b.rank(ends)


@lru_cache(maxsize=2)
def _byte_level(path: str) -> tuple[tiktoken.Encoding, list[bytes], np.ndarray]:
    encoding = _encoding(path)
    table = [b""] * (encoding.max_token_value + 1)
    for data, token in encoding._mergeable_ranks.items():
        table[token] = data
    return encoding, table, np.fromiter(map(len, table), np.int64, len(table))


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes], np.ndarray]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(len(model))]
    return model, table, np.fromiter(map(len, table), np.int64, len(table))


def sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """The number of ids of each side."""
    return len(_byte_level(a_path)[1]), len(_pieces(b_path)[1])


def _encoded(texts: pd.Series, a_path: str, b_path: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of both sides, none where a side's tokens do not spell a space and the text."""
    first, a_table, _ = _byte_level(a_path)
    second, b_table, _ = _pieces(b_path)
    none = np.zeros(0, np.int64)
    left, right = [], []
    for text, b in zip(texts, second.encode([x or "" for x in texts], num_threads=1)):
        a = first.encode_ordinary(f" {text}") if text else []
        data = f" {text}".encode() if text else None
        same = data is not None and b"".join(map(a_table.__getitem__, a)) == data and b"".join(map(b_table.__getitem__, b)) == data
        left.append(np.array(a, np.int64) if same else none)
        right.append(np.array(b, np.int64) if same else none)
    return left, right


@lru_cache(maxsize=2)
def _names(a_size: int, b_size: int) -> list[str]:
    """Each id with what may follow it: of the first side `,` or `|`; of the second `,`, `;` or nothing."""
    return [f"{i}{mark}" for mark in (",", "|") for i in range(a_size)] + [f"{i}{mark}" for mark in (",", ";", "") for i in range(b_size)]


def _lines(aligned: Aligned, a: np.ndarray, b: np.ndarray, a_size: int, b_size: int, last: np.ndarray) -> np.ndarray:
    """Places in ``_names`` of all tokens, group by group, the first side's before the second's.  ``last`` are the groups that end a text."""
    a_group = np.repeat(np.arange(len(aligned.cuts)), np.diff(aligned.a_stops, prepend=0))
    b_group = np.repeat(np.arange(len(aligned.cuts)), np.diff(aligned.b_stops, prepend=0))
    a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_mark[aligned.a_stops - 1] = b_mark[aligned.b_stops - 1] = 1
    b_mark[aligned.b_stops[last] - 1] = 2
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.concatenate([[0], aligned.b_stops])[a_group]] = a + a_mark * a_size
    out[np.arange(len(b)) + aligned.a_stops[b_group]] = 2 * a_size + b + b_mark * b_size
    return out


def _aligner(a_path: str, b_path: str):
    a_size, b_size = sizes(a_path, b_path)
    kind = "<i4" if a_size * b_size < 1 << 31 else "<i8"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_bytes, b_bytes = _byte_level(a_path)[2], _pieces(b_path)[2]
        names = _names(a_size, b_size)
        for frame in frames:
            left, right = _encoded(frame["text"], a_path, b_path)
            n_a, n_b = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
            a, b = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
            aligned = Aligned(a_bytes[a], b_bytes[b])
            ends = np.concatenate([[0], np.cumsum(a_bytes[a])])[np.cumsum(n_a)]  # of each text's bytes
            n_groups, n_links = (np.diff(x.rank(ends), prepend=0) for x in (aligned.shared, aligned.either))
            filled = n_a > 0
            lines = _lines(aligned, a, b, a_size, b_size, np.cumsum(n_groups)[filled] - 1)
            stops = np.cumsum(n_a + n_b)
            hashes = [hashlib.sha256("".join(map(names.__getitem__, lines[stop - n : stop].tolist())).encode()).hexdigest() if n else "" for stop, n in zip(stops.tolist(), (n_a + n_b).tolist())]
            x, y = aligned.links()
            keys = np.repeat(np.arange(len(frame)), n_links) * (a_size * b_size) + a[x] * b_size + b[y]
            keys, times = np.unique(keys, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(1, len(frame)) * (a_size * b_size))
            pairs = (keys % (a_size * b_size)).astype(kind)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy(), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes,
                "pairs": np.split(pairs, cuts) if len(frame) > 1 else [pairs], "times": np.split(times.astype("<i4"), cuts) if len(frame) > 1 else [times.astype("<i4")],
            })

    # As text, so that pandas does not turn ids beside a null into floats.
    return run, f"doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{'int' if kind == '<i4' else 'long'}>, times array<int>"


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs`` with ``__tw_aligned``: the ids of both sides, the byte of each shared cut, and how many tokens of each side end up to it.

    ``a_path`` is a byte-level BPE in the ``tokenizers`` format, which encodes a space and
    the text; ``b_path`` a ``sentencepiece`` model, which adds that space itself.  Special
    tokens in a text are plain text.  A null or empty text, or one that a side's tokens do not spell, has none.
    """
    schema = "a array<int>, b array<int>, cuts array<int>, a_stops array<int>, b_stops array<int>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a_bytes, b_bytes = _byte_level(a_path)[2], _pieces(b_path)[2]
        for texts in batches:
            rows = []
            for a, b in zip(*_encoded(texts, a_path, b_path)):
                found = Aligned(a_bytes[a], b_bytes[b])
                rows.append([x.astype("i4") for x in (a, b, found.cuts, found.a_stops, found.b_stops)])
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return small_batches(docs).withColumn("__tw_aligned", run(F.col("text")))


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, n (how many rows of ``rows`` have it in ``pairs``) and best: whether no pair of the same first id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # A first id meets the ids of the other side at most, so its pairs are bounded by a vocabulary.
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / b_size)))
    return counts.withColumn("best", F.col("n") == most)


def digests(docs: DataFrame, a_path: str, b_path: str, broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``.

    ``groups_sha256`` is the digest of the groups as ``a1,a2|b1;a3|b2,b3``.  A pair of
    ids counts once for each row that has it linked; ``n_best`` is the number of a row's
    links whose pair counts the most of its first id, and ``count_sum`` the sum of the counts
    over its links.  Texts without tokens, see ``groups``, have zeros and an empty digest.
    Each row counts by itself, also if its doc_id repeats or is missing.

    Texts are encoded once, and what a row needs afterwards is written to the shared
    folder: its pairs and how often each occurs.  Rows stay where they are when they look
    their pairs' counts up, and only their sums are shuffled, unless there are more than
    ``broadcast`` pairs.
    """
    run, schema = _aligner(a_path, b_path)
    found = small_batches(docs).select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    found = materialize(found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_row", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(found, sizes(a_path, b_path)[1]))
    if counts.count() <= broadcast:
        counts = F.broadcast(counts)
    linked = found.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair").join(counts, "pair")
    sums = linked.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
