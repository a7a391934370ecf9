"""The rank model against plain loops, and against the pointwise default on planted orders."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwright.operators import rankmodel, training

FEATURES = rankmodel.Features(numbers=("a", "b"), categories=("kind",), crosses=(("month", "kind"),))


def made(groups, seed, rule):
    """Rows (region, query, poi, label, a, b, kind, month); the best of a group by ``rule`` are its positives."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        month = rng.choice(["01", "07"])
        rows = [[f"p{k:02}", rng.gauss(0, 1), rng.choice([None, rng.gauss(0, 3)]), rng.choice(["x", "y", None])] for k in range(rng.randint(1, 9))]
        rows.sort(key=lambda r: -rule(r, month))  # noqa: B023
        many = rng.randint(0, max(1, len(rows) // 2))
        out += [(rng.choice(["N"]), f"q{g:04}", p, int(k < many), a, b, kind, month) for k, (p, a, b, kind) in enumerate(rows)]
    return out


SCHEMA = "region string, query string, poi string, label int, a double, b double, kind string, month string"


def plain(rows, objective, rounds, rate, l2, top):
    """Rounds over lists and dictionaries."""
    mean = lambda c: sum((r[c] or 0.0) for r in rows) / len(rows)
    ma, mb = mean(4), mean(5)
    sa, sb = (math.sqrt(sum(((r[c] or 0.0) - m) ** 2 for r in rows) / len(rows)) for c, m in ((4, ma), (5, mb)))
    lists = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        kind = r[6] or "__MISSING__"
        lists.setdefault(r[1], []).append((r[3], {"a": (r[4] - ma) / sa, "b": ((r[5] or 0.0) - mb) / sb, f"kind {kind}": 1.0, f"cross {r[7]} {kind}": 1.0}))
    weights = {f: 0.0 for own in lists.values() for _, x in own for f in x}
    history = []
    for turn in range(rounds + 1):
        slope, loss, ndcg, used = dict.fromkeys(weights, 0.0), 0.0, 0.0, 0
        for own in lists.values():
            s = [sum(weights[f] * v for f, v in x.items()) for _, x in own]
            good = [i for i, (y, _) in enumerate(own) if y]
            bad = [i for i, (y, _) in enumerate(own) if not y]
            if not good:
                continue
            used += 1
            order = sorted(range(len(own)), key=lambda i: (-round(s[i], 12), i))  # noqa: B023
            d = {i: 1 / math.log2(k + 2) if k < top else 0.0 for k, i in enumerate(order)}
            ideal = sum(1 / math.log2(k + 2) for k in range(min(len(good), top)))
            ndcg += sum(d[i] for i in good) / ideal
            pull = [0.0] * len(own)
            if objective == "listwise":
                total = sum(math.exp(v) for v in s)
                for i, (y, _) in enumerate(own):
                    pull[i] = y / len(good) - math.exp(s[i]) / total
                    loss -= y / len(good) * math.log(math.exp(s[i]) / total)
            else:
                for i in good:
                    for j in bad:
                        w = 1 / (len(good) * len(bad)) if objective == "pairwise" else abs(d[i] - d[j]) / ideal
                        g = w / (1 + math.exp(s[i] - s[j]))
                        pull[i] += g
                        pull[j] -= g
                        loss += w * math.log(1 + math.exp(-(s[i] - s[j])))
            for g, (_, x) in zip(pull, own):
                for f, v in x.items():
                    slope[f] += g * v
        history.append((loss / used, ndcg / used))
        if turn < rounds:
            weights = {f: w + rate * (slope[f] / used - l2 * w) for f, w in weights.items()}
    return weights, history


@pytest.mark.parametrize("objective", rankmodel.OBJECTIVES)
def test_rounds_equal_plain_loops(spark, monkeypatch, objective):
    monkeypatch.setattr(rankmodel, "CHUNK_GROUPS", 7)
    rows = made(60, 1, lambda r, m: r[1] + (2 if (m, r[3]) == ("07", "x") else 0))
    model = rankmodel.fit_ranker(spark.createDataFrame(rows, SCHEMA).repartition(5), FEATURES, objective, rounds=4, rate=0.7, l2=0.01, top=3)
    weights, history = plain(rows, objective, 4, 0.7, 0.01, 3)
    assert [(h["loss"], h["ndcg"]) for h in model.history] == pytest.approx(np.array(history), abs=1e-9)
    got = {c: w for c, w in zip("ab", model.weights)}
    for name, (table, other) in zip(("kind", "cross"), model.tables()):
        assert other == 0
        got |= {f"{name} {v.replace(rankmodel.CROSS, ' ')}": w for v, w in table.items()}
    assert got == pytest.approx(weights, abs=1e-9)


@pytest.mark.parametrize("objective", rankmodel.OBJECTIVES)
def test_planted_order_beats_the_pointwise_default(spark, objective):
    """The level of a list says nothing of its order, and drowns it for a model of single rows."""
    rng, rows = random.Random(2), []
    for g in range(400):
        level = rng.gauss(0, 20)
        own = sorted([[f"p{k}", level + rng.gauss(0, 1)] for k in range(8)], key=lambda r: -r[1])
        rows += [("N", f"q{g:04}", p, int(k < (6 if level < 0 else 1)), x, 0.0, "x", "01") for k, (p, x) in enumerate(own)]
    frame = spark.createDataFrame(rows, SCHEMA)
    train, valid = frame.where("query < 'q0300'"), frame.where("query >= 'q0300'")
    model = rankmodel.fit_ranker(train, rankmodel.Features(numbers=("a",)), objective, rounds=30, rate=2.0, valid=valid, top=10)
    assert model.history[-1]["valid_ndcg"] > 0.999 > model.history[0]["valid_ndcg"]
    pointwise = training.fit_pointwise(train, ["a"])
    assert pointwise.coefficients[0] < 0 < model.weights[0]


def test_patience_keeps_the_best_weights(spark):
    rows = made(80, 3, lambda r, m: r[1])
    frame = spark.createDataFrame(rows, SCHEMA)
    valid = frame.withColumn("label", F.when(F.col("a") < 0, 1).otherwise(0))  # the other way round: training makes it worse
    model = rankmodel.fit_ranker(frame, rankmodel.Features(numbers=("a",)), "lambda", rounds=50, valid=valid, patience=3)
    scores = [h["valid_ndcg"] for h in model.history]
    assert len(scores) < 51 and len(scores) - 1 - int(np.argmax(scores)) == 3
    again = rankmodel.fit_ranker(frame, rankmodel.Features(numbers=("a",)), "lambda", rounds=int(np.argmax(scores)))
    assert model.weights.tolist() == pytest.approx(again.weights.tolist())
    whole = rankmodel.fit_ranker(frame, rankmodel.Features(numbers=("a",)), "lambda", rounds=10, valid=valid)
    assert len(whole.history) == 11 and whole.weights[0] > again.weights[0]


def test_scores_agree_as_column_and_as_blocks(spark):
    rows = made(50, 4, lambda r, m: r[1] + (r[3] == "x"))
    frame = spark.createDataFrame(rows, SCHEMA)
    model = rankmodel.fit_ranker(frame, FEATURES, "lambda", rounds=3, most=2)
    queries = pd.DataFrame({"region": ["N", "N"], "query": ["u", "v"], "month": ["07", "09"]})
    items = pd.DataFrame({"region": ["N"] * 3, "poi": ["1", "2", "3"], "a": [0.5, -1.0, 2.0], "b": [1.0, None, 3.0], "kind": ["x", None, "z"]})
    got = {(r.query, r.poi): r.score for r in training.score_catalogue(spark.createDataFrame(queries), spark.createDataFrame(items), model.predict, 3).collect()}
    both = queries.merge(items, on="region")
    want = {(r.query, r.poi): r.s for r in spark.createDataFrame(both).select("query", "poi", model.column().alias("s")).collect()}
    assert got == pytest.approx(want)


def test_odd_frames(spark):
    empty = rankmodel.fit_ranker(spark.createDataFrame([], SCHEMA), FEATURES, rounds=3)
    assert empty.weights.tolist() == [0.0] * 4 and empty.history[0]["loss"] is None
    lonely = spark.createDataFrame([("N", "q", "p", 1, 1.0, None, None, None), ("N", "r", "p", 0, 2.0, 1.0, "x", "01")], SCHEMA)
    for o in rankmodel.OBJECTIVES:
        assert np.isfinite(rankmodel.fit_ranker(lonely, FEATURES, o, rounds=2).weights).all()
    with pytest.raises(training.ContractError):
        rankmodel.fit_ranker(lonely.withColumn("label", F.lit(2)), FEATURES)
    with pytest.raises(ValueError):
        rankmodel.fit_ranker(lonely, FEATURES, "ranknet")
