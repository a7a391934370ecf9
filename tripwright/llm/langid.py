"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a linear classifier over hashed byte
trigrams, which says on which side of the bit a text stands.  Decoding weighs each
bit by its loss at the margin and takes the codeword of the least total loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwright.llm.common import give_back, released, small_batches

BINS, SLICE = 2048, 256


def code(languages: int, seed: int = 7) -> np.ndarray:
    """``[language, bit]`` of +1 and -1: all distinct splits for up to five languages, else random ones kept far apart."""
    if languages <= 5:
        splits = [[1 if mask >> k & 1 else -1 for k in range(languages)] for mask in range(1, 1 << max(languages - 1, 0))]
        return np.array(splits or [[1] * languages], float).T.reshape(languages, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(12 * np.log2(languages)))
    tries = [rng.choice([-1.0, 1.0], (languages, bits)) for _ in range(200)]
    apart = [min((a != b).sum() for i, a in enumerate(t) for b in t[:i]) for t in tries]
    return tries[int(np.argmax(apart))]


def features(text: str) -> np.ndarray:
    """Square roots of hashed trigram counts of the lower-cased bytes, at length one, in single precision."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    grams = (data[:-2] * 2654435761 + data[1:-1] * 40503 + data[2:] * 97) * np.uint32(2246822519) >> np.uint32(21)
    counts = np.sqrt(np.bincount(grams, minlength=BINS).astype(np.float32))
    return counts / (np.linalg.norm(counts) or np.float32(1))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Logistic regressions, one a column of ``y`` in {-1, +1}; the last row holds the intercepts."""
    weight = np.full(len(x), 1 / len(x)) if weight is None else weight / weight.sum()
    w, m, v = (np.zeros((x.shape[1] + 1, y.shape[1])) for _ in range(3))
    for t in range(1, steps + 1):
        margin = np.clip(y * (x @ w[:-1].astype(x.dtype) + w[-1]), -30, 30)
        pull = weight[:, None] * y / (1 + np.exp(margin))
        grad = l2 * w - np.vstack([x.T @ pull.astype(x.dtype), pull.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.5 / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    ambiguous: float = 0.05

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]
        return np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code, -30, 30))).sum(axis=2)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        """lang_pred, score, is_ambiguous: the score is the codeword's share under the losses.

        Features exist for SLICE texts at a time, whatever the batch holds.
        """
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        unclear, values = np.ones(len(texts), bool), texts.array
        said = [k for k, x in enumerate(values) if has_letter(x)] if self.languages else []
        x = np.zeros((min(SLICE, len(said)), BINS), np.float32)
        for at in range(0, len(said), SLICE):
            own = said[at : at + SLICE]
            for row, k in enumerate(own):
                x[row] = features(values[k])
            loss = self.losses(x[: len(own)])
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            lang[own] = np.array(self.languages, object)[loss.argmin(axis=1)]
            score[own] = share.max(axis=1)
            second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
            unclear[own] = share.max(axis=1) - second < self.ambiguous
        return pd.DataFrame({"lang_pred": lang, "score": score, "is_ambiguous": unclear})


def _held_out(doc: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample: int = 3000, most_languages: int = 200) -> Model:
    """Fit on about ``sample`` labelled documents, whole texts, an equal number of each language where there are enough.

    Labelled: a doc_id, a language, a letter in the text, and not held out.  Each
    language gives those of the smallest doc_id hash, at least 20 of them, so that a rare one
    has a codeword too.  Learned are the ``most_languages`` values of ``lang`` with the most
    labelled documents, the smaller of equal ones, so that neither the sample nor the code grows with a dirty column.  A doc_id on several rows is learned from once, by its smallest
    (language, text hash).  The sample is the only thing that comes to the driver,
    as feature vectors of BINS single-precision floats.
    """
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~_held_out("doc_id"))
    one = labelled.groupBy("doc_id").agg(F.min(F.struct("lang", F.xxhash64("text").alias("key"))).alias("one")).select("doc_id", "one.*")
    langs = one.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang")
    one = one.join(F.broadcast(langs), "lang", "left_semi")  # at most ``most_languages`` rows
    most = max(20, sample // max(1, langs.count()))
    # First within 64 parts of a language, then among what they leave, so that no task ranks a language.
    chosen, order = one.withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))), [F.xxhash64("doc_id"), F.col("doc_id")]
    for keys in (["lang", "_part"], ["lang"]):
        chosen = chosen.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")
    chosen = chosen.drop("_part")
    picked = small_batches(docs).select("doc_id", "lang", "text", F.xxhash64("text").alias("key")).join(F.broadcast(chosen), ["doc_id", "lang", "key"])

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in released(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang": frame["lang"], "x": [features(x).tobytes() for x in frame["text"]]})

    seen = picked.select("doc_id", "lang", "text").mapInPandas(vectors, "doc_id long, lang string, x binary")
    got = seen.groupBy("doc_id", "lang").agg(F.first("x").alias("x")).toPandas().sort_values(["doc_id", "lang"])
    languages = sorted(got["lang"].unique().tolist())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BINS + 1, 0)))
    table, place = code(len(languages)), got["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    share = np.bincount(place, minlength=len(languages))
    x = np.frombuffer(b"".join(got.pop("x")), np.float32).reshape(len(got), BINS)  # stays in single precision: what the driver holds is sample x BINS x 4 bytes
    model = Model(languages, table, fit_linear(x, table[place], 1.0 / share[place]))
    del x, got
    give_back()
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``__tw_language`` (lang_pred, score, is_ambiguous), from the text alone."""

    @F.pandas_udf("lang_pred string, score double, is_ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            yield model.predict(batch.reset_index(drop=True))

    return small_batches(docs).withColumn("__tw_language", run(F.col(text)))


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, is_ambiguous of each row.

    A null, empty or letterless text is ``und`` with score 0.  Without any labelled
    document all are.  A null doc_id is not held out and not learned from.  Repeated
    rows are predicted alike; of several languages of one doc_id the smallest is learned.
    """
    model = train(docs, sample)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", _held_out("doc_id").alias("held_out"), "__tw_language.lang_pred", "__tw_language.score", "__tw_language.is_ambiguous")
