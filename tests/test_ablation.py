"""Feature sets and the association sweep against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripwright.operators import ablation, association

FIELDS = ["a", "b", "c"]
SETS = {"one": ["a"], "two": ["a", "b"], "all": FIELDS, "rare": ["c"]}
PAIRS = [("one_vs_all", "one", "all"), ("two_vs_rare", "two", "rare")]


def made(n, seed, rare=0.5):
    rng = random.Random(seed)
    return [(rng.choice(["TL", "TL", "VL"]), rng.choice([None, "x", "y", "z"]), rng.choice([None, 1, 2]), rng.choice(["u", "v"]) if rng.random() < rare else None, rng.choice([None, "1", "2", "3"])) for _ in range(n)]


def bayes(rows, uses, needs, least=10):
    """(train_rows, rows, accuracy, majority_accuracy, status) of one fit on the rows that have ``needs``."""
    at = {f: k + 1 for k, f in enumerate(FIELDS)}
    whole = [r for r in rows if r[4] is not None and all(r[at[f]] is not None for f in needs)]
    train, test = [r for r in whole if r[0] == "TL"], [r for r in whole if r[0] == "VL"]
    classes = Counter(r[4] for r in train)
    seen = Counter((r[4], f, str(r[at[f]])) for r in train for f in uses)
    vocab = {f: len({str(r[at[f]]) for r in train}) for f in uses}
    status = "insufficient-support" if not train or not test else "privacy-limited" if min(len(train), len(test)) < least else "observed"
    if status != "observed":
        return len(train), len(test), None, None, status
    major = min(classes, key=lambda c: (-classes[c], c))

    def said(r):
        score = {c: math.log(n / len(train)) + sum(math.log((seen[c, f, str(r[at[f]])] + 1) / (n + vocab[f] + 1)) for f in uses) for c, n in classes.items()}
        return min(score, key=lambda c: (-round(score[c], 9), c))

    return len(train), len(test), sum(said(r) == r[4] for r in test) / len(test), sum(major == r[4] for r in test) / len(test), status


@pytest.mark.parametrize("n,rare", [(400, 0.5), (400, 0.02), (40, 0.5), (1, 1.0)])
def test_runs_equal_fits_of_their_own(spark, n, rare):
    rows = made(n, n, rare)
    frame = spark.createDataFrame(rows, "split string, a string, b int, c string, y string").repartition(4)
    runs = ablation.single(SETS) + ablation.compared(SETS, PAIRS)
    stats = ablation.patterns(frame, FIELDS, "y", F.col("split") == "VL")
    got = {r.run: r for r in ablation.evaluate(stats, FIELDS, runs).collect()}
    assert got.keys() == {r.name for r in runs}
    for run in runs:
        train_rows, tested, accuracy, usual, status = bayes(rows, run.uses, run.needs)
        r = got[run.name]
        if status == "insufficient-support":
            assert r.status == status and r.accuracy is None
            continue
        assert (r.train_rows, r.rows, r.status) == (train_rows, tested, status)
        assert (r.accuracy, r.majority_accuracy) == ((pytest.approx(accuracy, abs=1e-6), pytest.approx(usual, abs=1e-6)) if status == "observed" else (None, None))
    for r in ablation.paired(ablation.evaluate(stats, FIELDS, ablation.compared(SETS, PAIRS))).collect():
        left, right = got[f"{r.comparison}/left"], got[f"{r.comparison}/right"]
        assert (r.left_accuracy, r.right_accuracy, r.status) == (left.accuracy, right.accuracy, left.status)
        assert r.difference == (None if left.accuracy is None else pytest.approx(right.accuracy - left.accuracy, abs=1e-6))


def test_runs_without_rows_and_with_too_many_classes(spark):
    empty = spark.createDataFrame([], "split string, a string, b int, c string, y string")
    found = ablation.evaluate(ablation.patterns(empty, FIELDS, "y", F.col("split") == "VL"), FIELDS, ablation.single(SETS)).collect()
    assert {(r.run, r.status, r.rows) for r in found} == {(n, "insufficient-support", 0) for n in SETS}
    many = spark.range(12).selectExpr("'TL' AS split", "'x' AS a", "1 AS b", "'u' AS c", "id AS y")
    with pytest.raises(ValueError):
        ablation.evaluate(ablation.patterns(many, FIELDS, "y", F.col("split") == "VL"), FIELDS, ablation.single(SETS), most_classes=10)


def cramer(pairs, least=10):
    """(n, rows, cols, status, V) over full margins."""
    pairs = [(a, b) for a, b in pairs if a is not None and b is not None]
    left, right, both, n = Counter(a for a, _ in pairs), Counter(b for _, b in pairs), Counter(pairs), len(pairs)
    status = "insufficient-support" if len(left) < 2 or len(right) < 2 else "privacy-limited" if n < least else "observed"
    if status != "observed":
        return n, len(left), len(right), status, None
    chi = sum((both[a, b] - left[a] * right[b] / n) ** 2 / (left[a] * right[b] / n) for a in left for b in right)
    return n, len(left), len(right), status, round(math.sqrt(chi / (n * min(len(left) - 1, len(right) - 1))), 6)


def test_sweep_equals_plain_counts(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["TL", "VL"]), rng.choice(["N", "S", None]), rng.choice([None, *map(str, range(12))]), rng.choice([None, "x", "y"]), rng.choice(["k", "l", None]), rng.choice(["f", "m"]), rng.choice([None, "1", "2"])) for _ in range(300)]
    rows += [("VL", "tiny", "t", "x", "k", "f", "1"), ("VL", "tiny", "t", "y", "l", "m", "2"), ("VL", "flat", "t", "x", "k", "f", "1")]
    frame = spark.createDataFrame(rows, "split string, region string, trip string, c string, p string, g string, y string")
    studies = association.analyses(["c"], ["p"], ["g"], ["p"], ["y"])
    assert len(studies) == 2 + 2 + 1 + 1 + 1 + 1
    at = dict(zip("split region trip c p g y".split(), range(7)))
    got = {(r.scope, r.split, r.analysis, r.grain, r.feature, r.target): (r.n, r.rows, r.cols, r.status, r.cramers_v) for r in association.sweep(frame, studies).collect()}
    want = {}
    for scope in ("aggregate", "N", "S", "tiny", "flat"):
        for split in ("TL", "VL"):
            own = [r for r in rows if r[0] == split and scope in ("aggregate", r[1])]
            for analysis, grain, feature, target in studies:
                value = lambda r: None if any(r[at[f]] is None for f in feature) else "\x1f".join(r[at[f]] for f in feature)  # noqa: B023, E731
                pairs = [(value(r), r[at[target]]) for r in own]
                if grain == association.TRIP:
                    pairs = [p[1:] for p in {(r[2], value(r), r[at[target]]) for r in own if r[2] is not None and value(r) is not None and r[at[target]] is not None}]
                found = cramer(pairs)
                if found[0]:
                    want[scope, split, analysis, grain, " × ".join(feature), target] = found
    assert got == want
    assert {x[3] for x in want.values()} == {"observed", "privacy-limited", "insufficient-support"}
