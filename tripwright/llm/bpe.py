"""Byte-level BPE by prefix dynamic programming.

A token sequence is the BPE encoding of its bytes exactly if every two adjacent
tokens, merged from their own bytes alone, come out as those two tokens.  So each
prefix of a piece has one valid last token, and the table of last tokens holds the
encodings of all prefixes: appending reads on from the end, and an edit reads on
from its place until the table repeats.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space of the tokenizer's own regex engine, fixed by Unicode's White_Space property.
WHITE = "\t-\r\x20\x85\xa0  -     　"
#: Characters on which the fast engine's classes and the tokenizer's agree, besides those that it treats as others.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ʯΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁔₠-₿一-龥가-힣]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_FULL = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"[{WHITE}]+(?![^{WHITE}])").replace(r"\s+", rf"[{WHITE}]+"))
_BREAK = re.compile(r"(?<=\S)(?= )")
#: A space of which the character before it, or the text's start or end, may make more than a word's first character.
_ODD_SPACE = re.compile(r"\s |^ | $")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pieces(text: str) -> list[str]:
    """The matches of the tokenizer's pattern; the fast engine reads what both engines read alike."""
    return (_FAST if _PLAIN.fullmatch(text) else _FULL).findall(text)


class Vocabulary:
    """Ranks with what the dynamic program needs: the tokens that end at a place, and which pairs stay apart."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 500_000):
        self.ranks, self.bytes_of, self.memo = ranks, {i: b for b, i in ranks.items()}, memo
        self.reach = max(map(len, ranks))
        self._ending = ahocorasick.Automaton()
        for data, token in ranks.items():
            self._ending.add_word(data.decode("latin-1"), (token, len(data)))
        self._ending.make_automaton()
        self._apart: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: merge the lowest rank first, the leftmost of equals."""
        never, rank = 1 << 60, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < never:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives them again, one after the other.

        With -1 for left, a start of the piece: whether the right token's own bytes give it.
        """
        if len(self._apart) >= self.memo:
            self._apart.clear()
        tokens = [right] if left < 0 else [left, right]
        known = self._apart[left << 20 | right] = self.merge(b"".join(map(self.bytes_of.__getitem__, tokens))) == tokens
        return known

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Append to ``last`` the valid last tokens of the prefixes up to ``data[:stop]``.

        The automaton gives all tokens that end at each place.
        """
        known, apart, append, done = self._apart.get, self.apart, last.append, len(last)
        for at, (token, size) in self._ending.iter(data.decode("latin-1"), max(0, done - self.reach), stop):
            if at + 1 < done:
                continue
            left = last[at + 1 - size]
            if (held := known(left << 20 | token)) is None:
                held = apart(left, token)
            if held:
                append(token)
                done += 1
        if done <= stop:
            raise ValueError("the vocabulary lacks a byte")


class Prefixes:
    """The last tokens of all prefixes of one piece, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def splice(self, start: int, stop: int, data: bytes) -> int:
        """Replace ``[start, stop)`` and re-encode from there; how many prefixes had to be read again.

        The old table holds again once as many prefixes in a row as a token can be
        long end in the same tokens, since a last token depends on no more of them.
        """
        old, shift = self.last[stop:], len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start + 1 :]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend(self.data, self.last, end)
            at = end - shift - stop
            same = same + 1 if at > 0 and old[at] == self.last[end] else 0
            if same >= self.vocabulary.reach:
                self.last += old[at + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the piece, or of any prefix of it."""
        out, at = [], len(self.data) if end is None else end
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


class Encoder:
    """Whole texts to packed ids.  The first words, which the common ones are among, are remembered as their ids."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 400_000):
        self.vocabulary, self.memo = Vocabulary(ranks), memo
        self._packed = {i: i.to_bytes(4, "little") for i in ranks.values()}
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        if (token := self.vocabulary.ranks.get(data)) is not None:
            return self._packed[token]
        return b"".join(map(self._packed.__getitem__, Prefixes(self.vocabulary, data).ids()))

    def _word(self, word: str) -> bytes:
        out, known = [], self._pieces
        for piece in pieces(word):
            if (ids := known.get(piece)) is None:
                ids = self._piece(piece)
                if len(known) < self.memo and len(piece) < 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def pack(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        A match of the pattern never runs on from a visible character into a space,
        so the text falls into words at those places without changing a match.
        """
        if _ODD_SPACE.search(text):
            return b"".join(map(self._word, _BREAK.split(text)))
        first, *words = text.split(" ")
        known = self._words
        out = list(map(known.get, words))
        if None in out:
            for at, ids in enumerate(out):
                if ids is None:
                    word = words[at]
                    if (ids := known.get(word)) is None:
                        ids = self._word(" " + word)
                        if len(known) < self.memo and len(word) < 64:
                            known[word] = ids
                    out[at] = ids
        return self._word(first) + b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(load_ranks(path))


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text as an array of ints.  A null text has no ids."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks_path)
        for batch in texts:
            yield pd.Series([np.frombuffer(encoder.pack(x or ""), "<u4").astype("i4") for x in batch], dtype=object)

    return docs.withColumn(ids, ids_of(F.col(text)))


def decode(docs: DataFrame, ranks_path: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids decode to no bytes."""

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks_path)
        for batch in batches:
            yield pd.Series([b"" if x is None else encoder.decode(list(map(int, x))) for x in batch], dtype=object)

    return docs.withColumn(data, bytes_of(F.col(ids)))


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row for each row of ``docs``, whose other columns play no part; an empty or
    null text has no tokens and the digest of no bytes.  Encoding and decoding
    share a task, so a text crosses to Python once and its ids never leave it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sha = _encoder(ranks_path), hashlib.sha256
        for frame in frames:
            rows = []
            for text in frame["text"]:
                packed = encoder.pack(text or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                rows.append((len(ids), sha(packed).hexdigest(), sha(encoder.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield pd.concat([frame["doc_id"].reset_index(drop=True), out], axis=1)

    # As text, so that pandas does not turn ids beside a null into floats.
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
