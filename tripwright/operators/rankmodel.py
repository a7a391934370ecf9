"""A linear ranker, fitted by gradient rounds over query groups that stay in their tasks.

Rows of a query are put together once and encoded as arrays, many groups a row.  In
each round every task scores its groups with the weights at hand, adds up the
gradient of each weight, and hands on these sums; the driver holds the weights, whose
number the numeric features and the ``most`` values of each category bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwright.operators.training import MISSING, ContractError, feature_value

OBJECTIVES = ("pairwise", "lambda", "listwise")
#: Groups of one encoded row, about.
CHUNK_GROUPS = 2048
#: Joins the two values of a cross.
CROSS = "\x1f"


@dataclass(frozen=True)
class Features:
    """Numeric columns, categories, and crosses of a query's column with an item's, which let a query change the order of items."""

    numbers: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    crosses: tuple[tuple[str, str], ...] = ()

    @property
    def coded(self) -> list[str]:
        return [*self.categories, *("×".join(c) for c in self.crosses)]

    def columns(self) -> list[Column]:
        """``_x``, the numbers, and ``_c``, the categories and crosses as text."""
        cross = [F.concat_ws(CROSS, *[feature_value(c, "category") for c in pair]) for pair in self.crosses]
        numbers = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.numbers]) if self.numbers else F.expr("CAST(array() AS array<double>)")
        texts = [*[feature_value(c, "category") for c in self.categories], *cross]
        return [numbers.alias("_x"), (F.array(*texts) if texts else F.expr("CAST(array() AS array<string>)")).alias("_c")]


@dataclass
class RankModel:
    """``weights`` are those of the numbers, then of each coded feature: its ``values`` in turn, and one for all other values."""

    features: Features
    means: np.ndarray
    scales: np.ndarray
    values: list[list[str]]
    weights: np.ndarray
    history: list[dict] = field(default_factory=list)

    @property
    def starts(self) -> np.ndarray:
        """The first weight of each coded feature."""
        return len(self.means) + np.concatenate([[0], np.cumsum([len(v) + 1 for v in self.values])]).astype(np.int64)

    def tables(self) -> list[tuple[dict[str, float], float]]:
        """Of each coded feature the weight of each value, and that of any other."""
        return [(dict(zip(v, self.weights[a : a + len(v)].tolist())), float(self.weights[a + len(v)])) for v, a in zip(self.values, self.starts)]

    def column(self) -> Column:
        """The score as an expression over the features' columns."""
        x, c = self.features.columns()
        out = F.lit(0.0)
        for k, (mean, scale, weight) in enumerate(zip(self.means, self.scales, self.weights)):
            out = out + (F.element_at(x, k + 1) - float(mean)) / float(scale) * float(weight)
        for k, (table, other) in enumerate(self.tables()):
            known = F.create_map(*[F.lit(y) for item in table.items() for y in item]) if table else None
            out = out + (F.lit(other) if known is None else F.coalesce(F.try_element_at(known, F.element_at(c, k + 1)), F.lit(other)))
        return out

    def predict(self, queries: pd.DataFrame, items: pd.DataFrame) -> np.ndarray:
        """The scores of all pairs of two frames, as ``training.score_catalogue`` asks for them."""
        out = np.zeros((len(queries), len(items)))
        for c, mean, scale, weight in zip(self.features.numbers, self.means, self.scales, self.weights):
            own, side = (items, None) if c in items else (queries, 1)
            z = (own[c].fillna(0).to_numpy(float) - mean) / scale * weight
            out += z[:, None] if side else z[None, :]
        text = lambda frame, c: frame[c].map(lambda v: MISSING if v is None or v != v else str(v))
        for names, (table, other) in zip([*[(c,) for c in self.features.categories], *self.features.crosses], self.tables()):
            if len(names) == 1:
                own = items if names[0] in items else queries
                z = text(own, names[0]).map(lambda v: table.get(v, other)).to_numpy(float)  # noqa: B023
                out += z[None, :] if own is items else z[:, None]
            else:  # a query's column first, an item's second
                a, left = pd.factorize(text(queries, names[0]))
                b, right = pd.factorize(text(items, names[1]))
                out += np.array([[table.get(f"{u}{CROSS}{v}", other) for v in right] for u in left]).reshape(len(left), len(right))[np.ix_(a, b)]
        return out


def _encode(features: Features, keys: list[str], values: list[list[str]], means: np.ndarray, scales: np.ndarray, starts: np.ndarray):
    codes_of = [{v: a + k for k, v in enumerate(vs)} for vs, a in zip(values, starts)]
    others = [int(a) + len(vs) for vs, a in zip(values, starts)]

    def packed(rows: pd.DataFrame) -> dict:
        new = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
        x = np.array(rows["_x"].tolist(), float).reshape(len(rows), len(features.numbers))
        c = np.array([[table.get(v, o) for v, table, o in zip(vs, codes_of, others)] for vs in rows["_c"]], "i4").reshape(len(rows), len(values))
        return {"_part": bool(rows["_part"].iloc[0]), "sizes": np.diff(np.append(np.flatnonzero(new), len(rows))).astype("i4").tobytes(), "labels": rows["label"].to_numpy("i1").tobytes(), "x": ((x - means) / scales).tobytes(), "c": c.tobytes()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (_part, keys, poi) to chunks of whole groups of one part."""
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            ids = held[["_part", *keys]]
            starts = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
            if len(starts) > CHUNK_GROUPS:  # the last group may go on
                yield from chunks(held.iloc[: starts[-1]])
                held = held.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield from chunks(held)

    def chunks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, own in rows.groupby("_part", sort=True):
            yield pd.DataFrame([packed(own.reset_index(drop=True))])

    return run


def gradient(labels: np.ndarray, sizes: np.ndarray, scores: np.ndarray, objective: str, top: int) -> tuple[np.ndarray, float, float, int]:
    """Of consecutive groups: the ascent of each row's score, the sum of the groups' losses and of their NDCG among the first ``top``, and how many groups have a positive.

    ``pairwise``: the logistic loss of each pair of a positive and another row, meaned over a group's
    pairs.  ``lambda``: the same, each pair weighted by how much its exchange would change the NDCG.  ``listwise``: the cross entropy of the
    softmax over the group.  Rows of equal score, to twelve digits, stand in the order given.
    """
    group = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    positive = labels > 0
    many = np.bincount(group, weights=positive, minlength=len(sizes))
    order = np.lexsort((np.arange(len(scores)), -np.round(scores, 12), group))
    rank = np.empty(len(scores), np.int64)
    rank[order] = np.arange(len(scores)) - first[group]
    discount = np.where(rank < top, 1 / np.log2(rank + 2.0), 0.0)
    ideal = np.concatenate([[0], np.cumsum(1 / np.log2(np.arange(top) + 2.0))])[np.minimum(many, top).astype(int)]
    gained = np.bincount(group, weights=discount * positive, minlength=len(sizes))
    used = int((many > 0).sum())
    ndcg = float(np.divide(gained, ideal, out=np.zeros(len(sizes)), where=ideal > 0).sum())
    if objective == "listwise":
        most = np.maximum.reduceat(scores, first) if len(sizes) else scores
        e = np.exp(scores - most[group])
        total = np.bincount(group, weights=e, minlength=len(sizes))
        share, wanted = e / total[group], np.divide(positive, many[group], out=np.zeros(len(scores)), where=many[group] > 0)
        loss = -float((wanted * (scores - most[group] - np.log(total[group]))).sum())
        return np.where(many[group] > 0, wanted - share, 0.0), loss, ndcg, used
    # All pairs of a positive and another row of a group.
    a, b = np.flatnonzero(positive), np.flatnonzero(~positive)
    others = np.bincount(group[b], minlength=len(sizes))
    start = np.concatenate([[0], np.cumsum(others)])[:-1]
    n = others[group[a]]
    left = np.repeat(a, n)
    right = b[np.repeat(start[group[a]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    margin = scores[left] - scores[right]
    own = group[left]
    weight = 1 / (many[own] * others[own]) if objective == "pairwise" else np.abs(discount[left] - discount[right]) / ideal[own]
    pull = weight / (1 + np.exp(margin))
    loss = float((weight * np.logaddexp(0, -margin)).sum())
    return np.bincount(left, weights=pull, minlength=len(scores)) - np.bincount(right, weights=pull, minlength=len(scores)), loss, ndcg, used


def _round(weights: np.ndarray, n_numbers: int, n_coded: int, objective: str, top: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, told = np.zeros(len(weights)), {False: np.zeros(3), True: np.zeros(3)}
        for frame in frames:
            for part, sizes, labels, x, c in zip(frame["_part"], frame["sizes"], frame["labels"], frame["x"], frame["c"]):
                sizes, labels = np.frombuffer(sizes, "i4"), np.frombuffer(labels, "i1")
                x, c = np.frombuffer(x, float).reshape(len(labels), n_numbers), np.frombuffer(c, "i4").reshape(len(labels), n_coded)
                pull, loss, ndcg, used = gradient(labels, sizes, x @ weights[:n_numbers] + weights[c].sum(axis=1), objective, top)
                told[bool(part)] += (used, loss, ndcg)
                if not part:
                    sums[:n_numbers] += x.T @ pull
                    for k in range(n_coded):
                        sums += np.bincount(c[:, k], weights=pull, minlength=len(weights))
        at = np.flatnonzero(sums)
        kinds = ["weight"] * len(at) + ["train"] * 3 + ["valid"] * 3
        yield pd.DataFrame({"kind": kinds, "at": [*at.tolist(), 0, 1, 2, 0, 1, 2], "x": [*sums[at].tolist(), *told[False].tolist(), *told[True].tolist()]})

    return run


def _vocabulary(rows: DataFrame, coded: list[str], most: int) -> list[list[str]]:
    """The ``most`` commonest values of each coded feature, equal counts by value."""
    if not coded:
        return []
    counts = rows.select(F.posexplode("_c").alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "v"))).where(F.col("_r") <= most)
    out: list[list[str]] = [[] for _ in coded]
    for r in best.orderBy("k", "_r").collect():
        out[r["k"]].append(r["v"])
    return out


def fit_ranker(
    frame: DataFrame, features: Features, objective: str = "lambda", rounds: int = 100, rate: float = 0.5, l2: float = 1e-3, top: int = 10, valid: DataFrame | None = None, patience: int | None = None, most: int = 1000, keys: tuple[str, ...] = ("region", "query")
) -> RankModel:
    """Fit on ``frame(*keys, poi, label, ..)``, whose rows of equal ``keys`` are one list to rank.

    Each round adds ``rate`` times the mean gradient of the groups, less ``l2`` times the
    weights.  ``history`` has each round's mean loss and NDCG among the first ``top``, of
    the weights before it, also over ``valid``.  With ``patience``, fitting stops once
    that many rounds have not raised the NDCG of ``valid``, and the best weights stay;
    without it, all rounds run and the last weights stay, whatever ``valid`` says.

    Numbers are standardised, missing ones zero; values beyond the ``most`` commonest of a category
    share a weight.  Labels other than 0 and 1 are an error.  Groups without
    a positive count nowhere.  An empty frame gives zero weights.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"no objective {objective}")
    if patience is not None and valid is None:
        raise ValueError("patience needs rows to validate on")
    keep = lambda df, part: df.select(F.lit(part).alias("_part"), *keys, "poi", F.col("label").cast("int").alias("label"), *features.columns())
    train = keep(frame, False)
    sums = train.agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("odd"),
        *[f(F.col("_x")[k]).alias(f"{name}{k}") for k in range(len(features.numbers)) for name, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if sums["odd"]:
        raise ContractError(f"{sums['odd']} labels are neither 0 nor 1")
    means = np.array([sums[f"m{k}"] or 0.0 for k in range(len(features.numbers))])
    scales = np.array([sums[f"s{k}"] or 1.0 for k in range(len(features.numbers))])
    model = RankModel(features, means, scales, _vocabulary(train, features.coded, most), np.zeros(0))
    model.weights = weights = np.zeros(int(model.starts[-1]))
    rows = train if valid is None else train.unionByName(keep(valid, True))
    rows = rows.repartition("_part", *keys).sortWithinPartitions("_part", *keys, "poi")
    chunks = rows.mapInPandas(_encode(features, list(keys), model.values, means, scales, model.starts), "_part boolean, sizes binary, labels binary, x binary, c binary").persist()
    best, since = -1.0, 0
    try:
        for k in range(rounds + 1):
            found = chunks.mapInPandas(_round(weights, len(features.numbers), len(features.coded), objective, top), "kind string, at int, x double")
            told = {"weight": np.zeros(len(weights)), "train": np.zeros(3), "valid": np.zeros(3)}
            for r in found.groupBy("kind", "at").agg(F.sum("x").alias("x")).collect():  # one row a weight
                told[r["kind"]][r["at"]] = r["x"]
            mean = lambda name, at: float(told[name][at] / told[name][0]) if told[name][0] else None  # noqa: B023, E731
            model.history.append({"round": k, "loss": mean("train", 1), "ndcg": mean("train", 2), "valid_loss": mean("valid", 1), "valid_ndcg": mean("valid", 2)})
            score = model.history[-1]["valid_ndcg"] or 0.0
            if patience is None or score > best:
                best, since, model.weights = score, 0, weights
            elif (since := since + 1) >= patience:
                break
            if k < rounds and told["train"][0]:
                weights = weights + rate * (told["weight"] / told["train"][0] - l2 * weights)
    finally:
        chunks.unpersist()
    return model


def history_frame(spark, models: dict[str, RankModel]) -> DataFrame:
    """name, round, loss, ndcg, valid_loss, valid_ndcg of each model's rounds."""
    rows = [(name, h["round"], h["loss"], h["ndcg"], h["valid_loss"], h["valid_ndcg"]) for name, m in models.items() for h in m.history]
    return spark.createDataFrame(rows, "name string, round int, loss double, ndcg double, valid_loss double, valid_ndcg double")


def weights_frame(spark, models: dict[str, RankModel]) -> DataFrame:
    """name, feature, value (null for a number and for the rest of a category's values), weight."""
    rows = []
    for name, m in models.items():
        rows += [(name, c, None, float(w)) for c, w in zip(m.features.numbers, m.weights)]
        for c, (table, other) in zip(m.features.coded, m.tables()):
            rows += [(name, c, v, w) for v, w in table.items()] + [(name, c, None, other)]
    return spark.createDataFrame(rows, "name string, feature string, value string, weight double")
