"""Compression of vectors to short codes, by codebooks for each part of a vector.

Vectors become integers and are cut into parts.  Equal parts of a position are one
row with a weight; Lloyd's rounds run over these distinct rows, and their codes and
errors are joined back to the vectors at the end.  All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import forget, join_by_key, materialize

#: Components from here on count as non-finite: with 1,024 components a part, squared errors below it fit in a long.
LIMIT = 1 << 15


@dataclass
class Compressed:
    """codes: vec_id, label, codes (an entry a part), error.  books: ``[part, entry, place]``."""

    codes: DataFrame
    books: np.ndarray


def _usable(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    ok = vectors.where(F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & ~bad)
    return ok.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of ``book`` nearest to each row, the first of several, and its squared distance."""
    most = float(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * book.shape[1] < 2**53 else np.int64  # exact either way
    codes, errors = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    entries = book.astype(kind)
    own = (entries * entries).sum(axis=1)
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096].astype(kind)
        far = (part * part).sum(axis=1)[:, None] - 2 * (part @ entries.T) + own[None, :]
        codes[at : at + 4096] = found = far.argmin(axis=1)
        errors[at : at + 4096] = far[np.arange(len(part)), found]
    return codes, errors


def _sums(books: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for frame in frames:
            for p, group in frame.groupby("position"):
                rows, weights = np.stack(group["part"].to_numpy()).astype(np.int64), group["weight"].to_numpy(np.int64)
                codes, _ = nearest(rows, books[p])
                np.add.at(sums[p], codes, rows * weights[:, None])
                np.add.at(counts[p], codes, weights)
        p, e = np.nonzero(counts)
        if len(p):
            yield pd.DataFrame({"position": p.astype("i4"), "entry": e.astype("i4"), "n": counts[p, e], "sums": list(sums[p, e])})

    return run


def _assigned(books: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes, errors = np.zeros(len(frame), np.int32), np.zeros(len(frame), np.int64)
            for p, at in frame.groupby("position").indices.items():
                codes[at], errors[at] = nearest(np.stack(frame["part"].to_numpy()[at]).astype(np.int64), books[p])
            yield frame.assign(code=codes, error=errors)

    return run


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Compressed:
    """Codes of ``parts`` entries for each usable vector of ``vectors``, and the codebooks.

    A component x becomes floor(``scale`` * x).  A part's codebook starts as that part of
    the ``entries`` first vectors in the order of (vec_id, integers), null ids last (fewer
    entries where there are fewer vectors).  Each of ``rounds`` rounds assigns all
    parts to their nearest entries, the first of equals, and moves each used entry to
    the componentwise floor of the mean; at the end all are assigned once more.

    Left out are null and empty vectors, those with null or non-finite components (or of
    LIMIT or more in size), and those whose length is no multiple of ``parts`` or not that of
    the first vector.  Repeated vec_ids are rows like any other.

    The driver holds the codebooks and one sum for each of their components, which
    ``entries`` and the vectors' length bound.
    """
    usable = _usable(vectors, parts, scale)
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = usable.orderBy(*order).limit(1).select(F.size("q")).first()
    wide = first[0] if first else parts
    rows = materialize(usable.where(F.size("q") == wide).withColumn("_row", F.monotonically_increasing_id()))
    start = [r["q"] for r in rows.orderBy(*order).limit(entries).select("q").collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, wide // parts).transpose(1, 0, 2).copy()
    cut = F.array(*[F.slice("q", p * (wide // parts) + 1, wide // parts) for p in range(parts)])
    pieces = rows.select("_row", "vec_id", "label", F.posexplode(cut).alias("position", "part"))
    distinct = materialize(pieces.groupBy("position", "part").agg(F.count("*").alias("weight")))
    for _ in range(rounds if start else 0):
        sums = distinct.mapInPandas(_sums(books), "position int, entry int, n long, sums array<long>")
        sums = sums.select("position", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in sums.collect():
            books[r["position"], r["entry"], r["place"]] = r["x"] // r["n"]
    known = materialize(distinct.mapInPandas(_assigned(books), "position int, part array<int>, weight long, code int, error long"))
    forget(distinct)
    # A part that many vectors share is a hot key.
    key = F.struct("position", "part").alias("key")
    joined = join_by_key(pieces.select("_row", "vec_id", "label", "position", key), known.select(key, "weight", "code", "error"), "key", "weight")
    codes = F.array(*[F.max(F.when(F.col("position") == p, F.col("code"))) for p in range(parts)])
    out = joined.groupBy("_row", "vec_id", "label").agg(codes.alias("codes"), F.sum("error").alias("error"))
    return Compressed(out.select("vec_id", "label", "codes", "error"), books)


def digests(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (the errors of equal labels, nulls together) and codebooks_sha256."""
    if entries > 256:
        raise ValueError("two hex digits name 256 entries")
    found = compress(vectors, parts, entries, rounds, scale)
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    code = F.lower(F.concat_ws("", F.transform("codes", lambda x: F.lpad(F.hex(x), 2, "0"))))
    rows = materialize(found.codes.select("vec_id", code.alias("code"), "error", named))
    labels = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, found.books.ravel().tolist())).encode()).hexdigest()
    return join_by_key(rows, materialize(labels), "key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
