"""Quality by co-training: a text-content view and a page-metadata view.

Each view's classifier labels the unlabelled documents that it is surest of for the
other view, over some rounds.  The views are then calibrated on held-out labels and
their calibrated log-odds combined into one score for every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.llm.common import give_back, materialize, released, small_batches
from tripwright.llm.langid import fit_linear

#: Classes of bytes: lower, upper, digit, space, newline, other letters' bytes, and the marks.
_CLASS = np.full(256, 15, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", bytes(range(128, 256)), b".", b",;:", b"!?", b"|", b"#$%&*", b"'\"-_", b"()[]{}<>", b"=+/\\~^")):
    _CLASS[np.frombuffer(_bytes, np.uint8)] = _k
META_DIM, SLICE = 64 + 16 + 8, 256


def text_view(text: str) -> np.ndarray:
    """Shares of byte-class bigrams, at length one, and measures of repetition and shape."""
    data = text.encode("utf-8", "surrogatepass")
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    grams = np.sqrt(np.bincount(kinds[:-1].astype(np.int64) * 16 + kinds[1:], minlength=256).astype(float))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    shape = [
        min(np.log1p(len(words)) / 10, 2), len(set(words)) / n, repeats, len(set(lines)) / max(len(lines), 1),
        sum(x.isupper() for x in words) / n, min(len(data) / n / 20, 3), min(n / max(len(lines), 1) / 50, 2), float(not words),
    ]
    return np.concatenate([grams / (np.linalg.norm(grams) or 1.0), shape])


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed source and language, and bands of the recorded length."""
    out = np.zeros(META_DIM)
    out[zlib.crc32((source or "\0").encode()) % 64] = 1
    out[64 + zlib.crc32((lang or "\0").encode()) % 16] = 1
    out[80 + (0 if n_chars is None or n_chars != n_chars or n_chars < 0 else 1 + min(6, int(np.log10(n_chars + 1) * 1.4)))] = 1
    return out


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w[:-1] + w[-1])[:, 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """``views`` are the two classifiers; ``joint`` turns their log-odds into the score's.

    ``exchanged`` holds, for each round, how many texts the text and the metadata view were handed.
    """

    views: tuple[np.ndarray, np.ndarray] | None
    joint: np.ndarray | None
    prior: float
    exchanged: tuple[tuple[int, int], ...] = ()

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        z = np.stack([_logit(text, self.views[0]), _logit(meta, self.views[1])], axis=1)
        return _sigmoid(_logit(z, self.joint)), _sigmoid(z[:, 0]), _sigmoid(z[:, 1])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both classes weigh the same; with under 20 rows of either, the weights are held closer to zero."""
    ups, downs = (y > 0).sum(), (y < 0).sum()
    return fit_linear(x, y[:, None].astype(float), np.where(y > 0, 1 / max(ups, 1), 1 / max(downs, 1)), 1e-5 if min(ups, downs) >= 20 else 1e-3, 150)


def _held(y: np.ndarray) -> np.ndarray:
    """Every third row of each class."""
    return np.sort(np.concatenate([np.flatnonzero(y == side)[::3] for side in (1, -1)]))


def _calibrated(z: np.ndarray, w: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """``w`` with the scale and shift under which its log-odds ``z`` of held-out labels say how often it is right."""
    c = fit_linear(z[:, None], y[:, None].astype(float), share, 1e-3, 300)[:, 0]
    return np.vstack([w[:-1] * c[0], w[-1:] * c[0] + c[1]])


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in released(frames):
        if frame.empty:
            continue
        yield pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "key": frame["key"],
                "t": [text_view(x or "").astype("f4").tobytes() for x in frame["text"]],
                "m": [meta_view(a, b, c).astype("u1").tobytes() for a, b, c in zip(frame["lang"], frame["source"], frame["n_chars"])],
            }
        )


def _stacked(t: pd.Series, m: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(t), "f4").reshape(len(t), -1).astype(float), np.frombuffer(b"".join(m), "u1").reshape(len(m), -1).astype(float)


def _chances(features: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """doc_id, key and each view's chance of good quality, of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                p = [_sigmoid(_logit(x, w)) for x, w in zip(_stacked(frame["t"], frame["m"]), weights)]
                yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "p0": p[0], "p1": p[1]})

    return features.mapInPandas(run, "doc_id long, key long, p0 double, p1 double")


def train(docs: DataFrame, labels: DataFrame, labelled: int = 3000, rounds: int = 4, step: int = 200) -> Model:
    """Co-train on at most ``labelled`` labelled documents, half of each class where there are enough, and all unlabelled ones.

    Every third labelled document is kept for calibration, at the classes' shares of
    all labels.  A round scores all unlabelled documents in Spark; each view hands the
    other at most ``step`` new texts a side, the first in its own calibrated order, if it
    gives them a chance above one half and above the class's share of all labels; so a view that
    knows little hands on what it knows best, and one that knows nothing hands on nothing.
    Labels that contradict each other for one doc_id and null ones are none.  With
    labels of one class only, the score is the base rate.
    """
    clean = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    known = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().join(clean.select("doc_id", F.when(F.col("a") > 0, 1).otherwise(-1).alias("y")), "doc_id")
    known = materialize(known)
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model(None, None, float(1 in total or not total))
    prior = total[1] / (total[1] + total[-1])
    ups = min(total[1], max(labelled // 2, labelled - total[-1]))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.where(F.col("y") == side).orderBy(*order).limit(n) for side, n in ((1, ups), (-1, min(total[-1], labelled - ups)))]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most ``labelled`` rows
    keyed = small_batches(docs).select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64("text", "lang", "source", "n_chars").alias("key"))
    features = materialize(keyed.mapInPandas(_features, "doc_id long, key long, t binary, m binary"))
    # A doc_id on several rows is learned from once, by its smallest key.
    one = features.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("key", "t", "m")).alias("x")).select("doc_id", "y", "x.t", "x.m").orderBy("doc_id").toPandas()
    y, views = one["y"].to_numpy(int), _stacked(one["t"], one["m"])
    held = _held(y)
    # A class of one or two labels is in both parts; there is nothing else to fit it on.
    fit = np.sort(np.concatenate([np.setdiff1d(np.arange(len(y)), held), *[np.flatnonzero(y == side) for side in (1, -1) if (y == side).sum() < 3]])).astype(int)
    rows, sides = [views[0][fit], views[1][fit]], [y[fit], y[fit]]
    given: list[set[int]] = [set(), set()]
    weights = [_fit(x, side) for x, side in zip(rows, sides)]
    drawn = {side: (y[held] == side).sum() for side in (1, -1)}
    share = np.array([total[side] / drawn[side] for side in y[held]])  # back to the shares of all labels
    exchanged: list[tuple[int, int]] = []
    got = handed = None
    for _ in range(rounds):
        sure_of = [_calibrated(_logit(x[held], w), w, y[held], share) for x, w in zip(views, weights)]
        scored = _chances(features, sure_of).join(clean, "doc_id", "left_anti").groupBy("key").agg(F.max("p0").alias("p0"), F.max("p1").alias("p1"))
        scored, new = materialize(scored), ({}, {})
        for k in (0, 1):
            fresh = scored.where(~F.col("key").isin(sorted(given[1 - k])))  # at most 2 x step x rounds keys
            for side, q in ((1, F.col(f"p{k}")), (-1, 1 - F.col(f"p{k}"))):
                floor = max(0.5, prior if side > 0 else 1 - prior)
                best = fresh.select("key", q.alias("q")).where(F.col("q") > floor).orderBy(F.desc("q"), "key").limit(step).collect()
                new[1 - k].update({r["key"]: side for r in best})
        exchanged.append((len(new[0]), len(new[1])))
        if not (new[0] or new[1]):
            break
        wanted = sorted({*new[0], *new[1]})
        got = features.where(F.col("key").isin(wanted)).groupBy("key").agg(F.first("t").alias("t"), F.first("m").alias("m")).orderBy("key").toPandas()
        handed = _stacked(got["t"], got["m"])
        for k in (0, 1):
            at = np.array([key in new[k] for key in got["key"]], bool)
            rows[k] = np.concatenate([rows[k], handed[k][at]])
            sides[k] = np.concatenate([sides[k], [new[k][key] for key in got["key"][at]]]).astype(int)
            given[k] |= set(new[k])
            weights[k] = _fit(rows[k], sides[k])
    z = np.stack([_logit(views[0][held], weights[0]), _logit(views[1][held], weights[1])], axis=1)
    joint = fit_linear(z, y[held][:, None].astype(float), share, 1e-3, 300)
    del one, views, rows, got, handed
    give_back()
    return Model((weights[0], weights[1]), joint, prior, tuple(exchanged))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``__tw_quality`` (score, text_score, meta_score) to each row."""

    @F.pandas_udf("score double, text_score double, meta_score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, chars in released(batches):
            out = np.zeros((len(text), 3))
            for at in range(0, len(text), SLICE):
                t = np.stack([text_view(x or "") for x in text.iloc[at : at + SLICE]])
                m = np.stack([meta_view(*x) for x in zip(lang.iloc[at : at + SLICE], source.iloc[at : at + SLICE], chars.iloc[at : at + SLICE])])
                out[at : at + SLICE] = np.stack(model.score(t, m), axis=1)
            yield pd.DataFrame(out, columns=["score", "text_score", "meta_score"])

    return small_batches(docs).withColumn("__tw_quality", run("text", "lang", "source", "n_chars"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = 3000) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept of each row; kept at ``threshold`` or more.

    Null texts count as empty, null metadata as a value of its own.  Rows that repeat
    get the same score each.  Labels that contradict each other for a doc_id are none.
    Without labels of both classes every score is the labels' base rate, 1 without labels.
    """
    model = train(docs, labels, labelled)
    out = score(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return out.select("doc_id", "__tw_quality.score", "__tw_quality.text_score", "__tw_quality.meta_score", (F.col("__tw_quality.score") >= threshold).alias("kept"))
