"""Queries against their oracles, and operators against the literal cases of their definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import difference
from tripwright.functions import bands, codes, geo, temporal, text
from tripwright.operators import association, contract, profile, publish, ranking, recommend, split, training
from tripwright.functions.keys import ITEM_TIE_KEY, USER_TIE_KEY
from tripwright.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), SF, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cleaning_and_codes(spark):
    assert one(spark, text.clean(F.lit(" \t　a b\x1f "))) == "a b" and one(spark, text.clean(F.lit(" \t"))) is None
    assert one(spark, text.blank_to_null(F.lit(" a "))) == " a "
    assert [one(spark, codes.in_domain(F.lit(x), codes.STYLE)) for x in ("7", "8")] == ["7", None]
    assert [one(spark, codes.parse_count(F.lit(x))) for x in ("0", "3", "-1", "2.0", "2.5", "x")] == [0, 3, None, 2, None, None]
    assert [one(spark, bands.count_bucket(F.lit(n))) for n in (0, 1, 9, 10, 100)] == ["0", "<10", "<10", "10+", "10+"]
    assert [one(spark, bands.rate_band(F.lit(a), F.lit(b), "n/a")) for a, b in ((0, 100), (1, 100), (10, 100), (100, 100), (0, 0))] == ["0-<10%", "<10/suppressed", "10-<25%", "90-100%", "n/a"]


def test_dates(spark):
    ok = one(spark, F.struct(*[c.alias(n) for c, n in zip(temporal.trip_time(F.lit("2023-05-10"), F.lit("20230512")), "mer")]))
    back = one(spark, F.struct(*[c.alias(n) for c, n in zip(temporal.trip_time(F.lit("2023-05-12"), F.lit("2023-05-10")), "mer")]))
    assert tuple(ok) == ("05", 2, None) and tuple(back) == ("05", None, "inverted_date_range")
    assert one(spark, temporal.iso_date(F.lit("2023-1-5"))) is None


def test_districts(spark):
    """Codes agree with themselves in either province numbering, with their city for a ward, and with nothing else."""
    yes = [("26350", "26", "350"), ("4282000000", "51", "820"), ("45790", "52", "790"), ("29155", "12", "270"), ("46900", "12", "860"), ("26", "26", ""), ("48121", "48", "120"), ("41280", "41", "285"), ("36110", "36110", "36110")]
    no = [("26350", "27", "350"), ("26350", "26", "351"), ("42820", "52", "820"), ("29155", "12", "155"), ("46900", "12", "900"), ("41280", "41", "291"), ("26", "27", "")]
    frame = spark.createDataFrame([(*x, True) for x in yes] + [(*x, False) for x in no], "c string, r string, g string, want boolean")
    assert [tuple(r) for r in frame.where(codes.sgg_compatible(F.col("c"), F.col("r"), F.col("g")) != F.col("want")).collect()] == []


def test_distance(spark):
    metres = lambda *at: one(spark, geo.haversine(*map(F.lit, map(float, at))))
    degree = math.radians(1) * geo.RADIUS_M
    assert metres(0, 0, 0, 1) == pytest.approx(degree) and metres(10, 20, 11, 20) == pytest.approx(degree) and metres(60, 0, 60, 1) == pytest.approx(degree / 2, rel=1e-4)
    assert metres(35.5, 128.25, 35.5, 128.25) == 0 and metres(0, 0, 0, 180) == pytest.approx(math.pi * geo.RADIUS_M)
    assert [one(spark, geo.in_korea(F.lit(a), F.lit(b))) for a, b in ((33.0, 132.5), (32.9, 127.0), (35.0, 140.0))] == [True, False, False]
    frame = spark.createDataFrame([(1, 1.0, 1.0)], "l_id int, l_lat double, l_lon double")
    with pytest.raises(ValueError):
        geo.near(frame, frame, 900)


def test_cf_literals(spark):
    """Scores by hand: A and B share two of three places, C shares one with A; what only a neighbour has seen gets its cosine."""
    seen = {"A": "pqr", "B": "pqs", "C": "rt"}
    pairs = spark.createDataFrame([("x", u, i) for u, items in seen.items() for i in items] + [("y", "A", "s")], "region string, traveler string, poi string")
    ab, ac = 2 / 3, 1 / math.sqrt(6)
    scores = {r.poi: r.score for r in recommend.user_cf(pairs, 5).where("region = 'x' AND traveler = 'A'").collect()}
    assert scores == {k: pytest.approx(v) for k, v in {"p": ab, "q": ab, "s": ab, "r": ac, "t": ac}.items()}
    assert {r.poi for r in recommend.user_cf(pairs, 1).where("region = 'x' AND traveler = 'A'").collect()} == {"p", "q", "s"}
    items = {r.poi: r.score for r in recommend.item_cf(pairs, 5).where("region = 'x' AND traveler = 'C'").collect()}
    assert items["r"] == pytest.approx(1 / math.sqrt(2)) and items["p"] == pytest.approx(1 / 2)  # r is one of p's two travelers' places
    assert recommend.neighbours(pairs, "traveler", "poi", USER_TIE_KEY, 5).where("region = 'y'").count() == 0


def test_lists_hold_the_whole_universe(spark):
    """A traveler with one scored place is ranked over all training places, in tie order after it."""
    rows = [("r", "TL", f"t{i}", f"u{i}", f"p{i}", "1", "1") for i in range(30)] + [("r", "VL", "v", "u0", "p5", "1", "1"), ("r", "VL", "w", "quiet", "p5", "1", "1")]
    events = spark.createDataFrame(rows, "region string, split string, trip string, traveler string, poi string, kind string, feedback string")
    scores = spark.createDataFrame([("r", "u0", "p7", 0.5)], "region string, traveler string, poi string, score double")
    got = recommend.score_lists(events, scores, 20).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21)) and got[0].poi == "p7" and len({r.poi for r in got}) == 20 and {r.traveler for r in got} == {"u0"}


def test_draws_are_even_and_apart(spark):
    """Every place is drawn about equally often, and no two places go together."""
    catalog = spark.createDataFrame([("r", f"p{i}") for i in range(20)], "region string, poi string")
    queries = spark.createDataFrame([("r", f"q{i}", "p0") for i in range(600)], "region string, query string, poi string")
    drawn = ranking.sample_unobserved(queries, catalog, 2, "seed").toPandas()
    assert (drawn.groupby("query").size() == 2).all() and "p0" not in set(drawn["poi"])
    assert drawn["poi"].value_counts().between(30, 105).all() and drawn["poi"].nunique() == 19
    pairs = drawn.groupby("query")["poi"].apply(lambda x: tuple(sorted(x))).value_counts()
    assert len(pairs) > 120 and pairs.max() < 20  # of 171 pairs; neighbours in one order would be 19


def test_hot_features_are_cut(spark, monkeypatch):
    pairs = spark.createDataFrame([("r", f"u{i}", "hot") for i in range(40)] + [("r", f"u{i}", f"p{i % 7}") for i in range(40)], "region string, traveler string, poi string")
    whole = sorted(map(tuple, recommend.neighbours(pairs, "traveler", "poi", USER_TIE_KEY, 5).collect()))
    monkeypatch.setattr(recommend, "PART", 6)
    assert sorted(map(tuple, recommend.neighbours(pairs, "traveler", "poi", USER_TIE_KEY, 5).collect())) == whole and len(whole) == 200


def test_catalogue_scoring_in_blocks(spark, monkeypatch):
    """The blocks' best merge to the best of the whole matrix, ties by name; a score that is no number is an error."""
    rng = np.random.default_rng(3)
    items, queries = [("r", f"i{k:03}", float(rng.integers(0, 9))) for k in range(300)], [("r", f"q{k}", float(k % 4)) for k in range(20)]
    predict = lambda q, i: (i["w"].to_numpy()[None, :] * q["m"].to_numpy()[:, None]) % 5
    catalog, asked = spark.createDataFrame(items, "region string, poi string, w double"), spark.createDataFrame(queries, "region string, query string, m double")
    monkeypatch.setattr(training, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(training, "BLOCK_QUERIES", 3)
    got = sorted((r.query, r["rank"], r.poi, r.score) for r in training.score_catalogue(asked, catalog, predict, 7).collect())
    want = sorted((q, k + 1, i, -s) for _, q, m in queries for k, (s, i) in enumerate(sorted((-(w * m % 5), i) for _, i, w in items)[:7]))
    assert got == want
    with pytest.raises(Exception, match="not finite"):
        training.score_catalogue(asked, catalog, lambda q, i: np.full((len(q), len(i)), np.nan), 7).collect()


def test_rules_of_a_run(spark):
    frame = spark.createDataFrame([("r", "a", 1), ("r", "a", 2)], "region string, poi string, x int")
    with pytest.raises(training.ContractError):
        training.check_columns(frame, ["region", "poi"])
    with pytest.raises(training.ContractError):
        training.check_columns(frame, frame.columns, ["x"])
    with pytest.raises(training.ContractError):
        training.inner_features(frame, frame, frame, frame)
    with pytest.raises(training.ContractError):
        training.require_split(spark.createDataFrame([("VL",)], "split string"))
    with pytest.raises(Exception, match="negative"):
        frame.select(training.feature_value(-F.col("x"), "count")).collect()
    assert training.feature_columns({"a": ["x", "y", "z"], "b": ["z", "w"]}, ["a", "b"], 2, "a") == ["x", "y", "z", "w"]
    model = training.fit_pointwise(spark.createDataFrame([(k % 2, float(k % 2 + k % 3)) for k in range(60)], "label int, x double"), ["x"])
    assert model.coefficients[0] > 0
    assert publish.name_words("visitAreaNm_2") == ["visit", "area", "nm", "2"] and [publish.name_kind(x) for x in ("mapX", "poi_id", "place", "weight")] == ["coordinate", "identifier", "text", None]


def test_validation_rows_change_no_training_output(spark):
    rows = [("r", "TL", f"t{i}", f"u{i % 4}", f"p{i % 3}", "1", "1") for i in range(12)]
    schema = "region string, split string, trip string, traveler string, poi string, kind string, feedback string"
    before = spark.createDataFrame(rows, schema)
    after = before.union(spark.createDataFrame([("r", "VL", "v", "u0", "p0", "1", "1")] * 5, schema))
    for f in (recommend.popularity, lambda e: recommend.neighbours(recommend.history(e), "poi", "traveler", ITEM_TIE_KEY, 5)):
        assert sorted(map(tuple, f(before).collect())) == sorted(map(tuple, f(after).collect()))


def test_owners_and_split(spark):
    trips = spark.createDataFrame([("r", "TL", "a", "1"), ("r", "TL", "b", "1"), ("r", "TL", "b", "1"), ("r", "TL", "c", "1"), ("r", "TL", "c", "2")], "region string, split string, trip string, traveler string")
    assert [r.trip for r in contract.unique_trips(trips).collect()] == ["a"]
    assert sorted(r.trip for r in contract.single_owner(trips).collect()) == ["a", "b"]
    parts = split.hash_split(spark.range(10).selectExpr("'r' AS region", "CAST(id AS STRING) AS traveler"), "traveler", "s")
    assert parts.where("part = 'inner-validation'").count() == 2


def test_suppression_literals(spark):
    counts = lambda rows: spark.createDataFrame(rows, "label string, n long")
    got = [tuple(r) for r in profile.safe_counts(counts([("small", 8), ("public", 10), ("large", 15)])).collect()]
    assert sorted(got) == [("<suppressed>", 18), ("large", 15)]
    assert [tuple(r) for r in profile.safe_counts(counts([("a", 3), ("b", 4), ("c", 12)]), keep_small_total=False).collect()] == [("<suppressed>", 19)]
    assert profile.safe_counts(counts([("a", 7)]), keep_small_total=False).count() == 0


def test_association_literals(spark):
    table = lambda rows: association.contingency(spark.createDataFrame(rows, "a string, b string"), ["a"], ["b"], [], True).first()
    strong = table([("a", "x")] * 12 + [("b", "y")] * 12)
    assert strong.status == "observed" and strong.cramers_v > 0.99 and strong.p < 1e-5
    assert table([("a", "x")] * 5 + [("b", "y")] * 4).status == "privacy-limited"
    assert table([("a", "x")] * 12).status == "insufficient-support"
    assert association.upper_gamma(0.5, 1.920729) == pytest.approx(0.05, abs=1e-4) and association.upper_gamma(5, 1.0) == pytest.approx(0.99634, abs=1e-5)
