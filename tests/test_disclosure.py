"""Whatever is hidden in a profile, nothing that is shown gives it back."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwright.operators import disclosure
from tripwright.plans import QUERIES
from tripwright.plans.publishing import WHOLE

SMALL = "/root/testdata/sf0.001"


def recoverable(rows, shown):
    """Hidden cells that a least-squares solver can tell from the shown ones: by the rank of the sums with and without each."""
    hidden = [r for r in rows if r["cell"] not in shown]
    at = {r["cell"]: i for i, r in enumerate(hidden)}
    names, sums = {r["cell"] for r in rows}, {}
    for r in rows:
        if r["parent"] in names:
            own = sums.setdefault((r["family"], r["parent"]), np.zeros(len(hidden)))
            if r["cell"] in at:
                own[at[r["cell"]]] = -1
            if r["parent"] in at:
                own[at[r["parent"]]] = 1
    matrix = np.array(list(sums.values())).reshape(len(sums), len(hidden))
    rank = np.linalg.matrix_rank(matrix) if len(hidden) else 0
    return {c for c, i in at.items() if np.linalg.matrix_rank(np.vstack([matrix, np.eye(len(hidden))[i]])) == rank}


def test_determined_equals_ranks():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randint(1, 7)
        equations = [{c: rng.choice([-1, 1]) for c in rng.sample(range(size), rng.randint(1, size))} for _ in range(rng.randint(1, 5))]
        hidden = [c for c in range(size) if rng.random() < 0.7]
        matrix = np.zeros((len(equations), len(hidden)))
        for e, c in product(range(len(equations)), range(len(hidden))):
            matrix[e, c] = equations[e].get(hidden[c], 0)
        rank = np.linalg.matrix_rank(matrix) if hidden else 0
        want = {c for k, c in enumerate(hidden) if np.linalg.matrix_rank(np.vstack([matrix, np.eye(len(hidden))[k]])) == rank}
        assert disclosure.determined(hidden, equations) == want


def test_a_lone_small_count_takes_a_second_with_it():
    # rows 100 = 60 + 35 + 5
    assert disclosure.protect([100, 60, 35, 5], [{0: 1, 1: -1, 2: -1, 3: -1}]) == {3: "small", 2: "complement"}
    assert disclosure.protect([100, 95, 5], [{0: 1, 1: -1, 2: -1}]) == {2: "small", 1: "complement"}
    assert disclosure.protect([100, 60, 40], [{0: 1, 1: -1, 2: -1}]) == {}
    # two that come to less than ten tell that much
    assert disclosure.protect([100, 92, 4, 4], [{0: 1, 1: -1, 2: -1, 3: -1}])[1] == "complement"
    # the same rows cut twice: what one cut hides, the other must not tell
    assert len(disclosure.protect([50, 30, 20, 45, 5], [{0: 1, 1: -1, 2: -1}, {0: 1, 3: -1, 4: -1}])) >= 2


def test_random_profiles_keep_their_secrets(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None] * 8 + [" "] * 8 + ["k"] * 60 + ["l"] * 23 + ["m"]), rng.choice([None, -1.0, 0.0, 5.0, 5.0, 5.0, 5000.0]), f"20{rng.choice(['20', '21'])}-{rng.randint(1, 12):02}-01") for _ in range(400)]
    frame = spark.createDataFrame(rows, "a string, c string, x double, d string").withColumn("d", F.to_date("d"))
    spec = [*disclosure.column_cells("a", "text"), *disclosure.column_cells("c", "category", ["k", "l"]), *disclosure.column_cells("x", "number"), *disclosure.column_cells("d", "date")]
    counts = disclosure.cells(frame, "t", spec)
    got = [r.asDict() for r in disclosure.protected(counts).collect()]
    assert any(r["reason"] == "small" for r in got) and any(r["reason"] == "complement" for r in got)
    assert all(r["reason"] for r in got if 0 < r["n"] < 10)
    assert recoverable(got, {r["cell"] for r in got if r["reason"] is None}) == set()
    by = {}
    for r in got:  # every family adds up to its parent
        by.setdefault((r["family"], r["parent"]), []).append(r["n"])
    n = {r["cell"]: r["n"] for r in got}
    assert all(sum(own) == n[parent] for (_, parent), own in by.items() if parent in n)


def test_refreshing_a_section_hides_what_depends_on_it(spark):
    old = spark.createDataFrame([("k", "u")] * 40 + [("l", "u")] * 60, "c string, d string")
    new = spark.createDataFrame([("k", "u")] * 40 + [("l", "u")] * 56 + [("m", "u")] * 4, "c string, d string")
    spec = [*disclosure.column_cells("c", "category"), *disclosure.column_cells("d", "category")]
    before = disclosure.protected(disclosure.cells(old, "t", spec))
    assert before.where("reason IS NOT NULL").count() == 0
    after = disclosure.refreshed(before, "categorical_values", disclosure.cells(new, "t", spec))
    got = [r.asDict() for r in after.collect()]
    assert {r["cell"]: r["reason"] for r in got if r["reason"]} == {"c=:m": "small", "c=:k": "complement"}
    assert recoverable(got, {r["cell"] for r in got if r["reason"] is None}) == set()
    # what has been hidden stays so when the reason is gone
    again = disclosure.refreshed(after, "columns", disclosure.cells(old, "t", spec))
    assert {r.cell for r in again.where("reason IS NOT NULL").collect()} >= {"c=:m", "c=:k"}
    other = disclosure.refreshed(before, "categorical_values", disclosure.cells(new, "u", spec))
    assert other.where("scope = 't'").count() == before.count()
    assert {r.value for r in disclosure.published(after).where("cell LIKE 'c=:%'").collect()} == {"<suppressed>", "56"}


@pytest.mark.parametrize("name", ["protected_profile", "refreshed_profile"])
def test_profiles_of_the_tables_keep_their_secrets(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]
    assert {r["scope"] for r in rows} == set(WHOLE) and len({r["section"] for r in rows}) >= 12
    counts = [r.asDict() for r in QUERIES[name].__globals__["_profile"](spark, SMALL).collect()]
    parents = {(r["scope"], r["cell"]): r["parent"] for r in counts}
    for scope in WHOLE:
        own = [r | {"parent": parents[scope, r["cell"]]} for r in rows if r["scope"] == scope]
        shown = {r["cell"] for r in own if r["value"] != "<suppressed>"}
        assert all(int(r["value"]) == 0 or int(r["value"]) >= 10 for r in own if r["cell"] in shown)
        assert recoverable(own, shown) == set()
