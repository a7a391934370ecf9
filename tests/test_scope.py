"""Candidate scope, exact shares, file order and identifiers in texts, by literal cases and plain loops."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import gcd

import pytest
from pyspark.sql import functions as F

from tripwright.operators import markers, scope, signatures, training
from tripwright.sources import order

# File order


def test_order_over_files_and_splits(spark, tmp_path):
    """Many splits of several files, read by name order and by an order of ours."""
    rng, rows = random.Random(4), []
    for k, name in enumerate(["b.csv", "a.csv", "c.csv"]):
        own = [(str(rng.randint(0, 40)), f"{name}-{i}", "x" * rng.randint(0, 60)) for i in range(3000)]
        rows.append((name, own))
        (tmp_path / name).write_text("key,value,pad\n" + "".join(",".join(r) + "\n" for r in own))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for files in (None, ["c.csv", "b.csv", "a.csv"]):
            frame = spark.read.option("header", True).csv(str(tmp_path)).withColumn("_ordinal", order.ordinal(files)).select("key", "value", "_ordinal")
            assert frame.rdd.getNumPartitions() > 20
            said = [r for name in (files or sorted(n for n, _ in rows)) for r in dict(rows)[name]]
            first, last = {}, {}
            for key, value, _ in said:
                first.setdefault(key, value)
                last[key] = value
            assert {r.key: r.value for r in order.first_rows(frame, ["key"]).collect()} == first
            assert {r.key: r.value for r in order.last_rows(frame, ["key"]).collect()} == last
            assert [r.value for r in frame.repartition(7).orderBy("_ordinal").collect()] == [v for _, v, _ in said]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_later_tables_overwrite_earlier_ones(spark, tmp_path):
    (tmp_path / "one.csv").write_text("code,name,note\n1,a,n\n2,b,n\n1,c,\n")
    (tmp_path / "two.csv").write_text("code,name\n2,d\n3,e\n")
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / n)).withColumn("_ordinal", order.ordinal())
    got = {tuple(r) for r in order.crosswalk([read("one.csv"), read("two.csv")], ["code"]).collect()}
    assert got == {("1", "c", None), ("2", "d", None), ("3", "e", None)}
    assert {tuple(r) for r in order.crosswalk([read("two.csv"), read("one.csv")], ["code"]).select("code", "name").collect()} == {("1", "c"), ("2", "b"), ("3", "e")}


# Identifiers in texts

TOKENS = ["A12", "a-12", "IMG_0001.jpg", "서울", "#", "--", "x.y", "\\E", "a\\Eb", "(z)", "ÉCOLE", " ", "", None, "12", "Ab Cd", "*"]
TEXTS = ["a12", "xA12", "A12_", "(A-12)", "A-123", "img_0001.JPG!", "서울역 서울", "# 1", "a--b", "xx.y x.yz", "see X.Y.", "q \\E q", "a\\eb", "((z))", "école ÉCOLE", "", None, "ab  cd ab cd1", "AB CD", "12a 12", "*" * 9]


def test_tokens_equal_search_text_by_text(spark):
    rng = random.Random(9)
    texts = list(enumerate(TEXTS + ["".join(rng.choice([*"aA12-_. #(", "서울", "x.y", "A12", "\\E"]) for _ in range(rng.randint(1, 14))) for _ in range(300)]))
    want = set()
    for i, text in texts:
        for token in TOKENS:
            if text is not None and token and token.strip() and re.search(rf"(?<![A-Za-z0-9]){re.escape(token)}(?![A-Za-z0-9])", text, re.IGNORECASE):
                want.add((i, token))
    found = markers.find_tokens(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([(t,) for t in TOKENS], "token string"))
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(want)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan


# Exact shares


def test_shares_and_stages_equal_fractions(spark):
    rng = random.Random(6)
    history = [("N", f"p{rng.randint(0, 25)}", f"t{k}", f"u{rng.randint(0, 9)}", rng.random() < 0.6, rng.choice(["x", "y", None]), rng.choice(["1", "2"])) for k in range(90)]
    frame = spark.createDataFrame(history, "region string, poi string, trip string, traveler string, core boolean, a string, b string")
    cohorts = {"all": F.lit(True), "core": F.col("core")}
    want, signature = {}, defaultdict(dict)
    for cohort in cohorts:
        for poi in {r[1] for r in history}:
            own = [r for r in history if r[1] == poi and (cohort == "all" or r[4])]
            if not own:
                continue
            facts = []
            for field, at in (("a", 5), ("b", 6)):
                there = [r for r in own if r[at] is not None]
                shares = {v: Fraction(n, len(there)) for v, n in Counter(r[at] for r in there).items()}
                for v, s in shares.items():
                    want["N", poi, cohort, field, v] = (len(there), len({r[3] for r in there}), s.numerator, s.denominator)
                facts.append((len(there), len({r[3] for r in there}), tuple(sorted(shares.items()))))
            signature[poi][cohort] = (len(own), len({r[3] for r in own}), tuple(facts))
    got = {(r.region, r.poi, r.cohort, r.field, r.value): (r.valid, r.travelers, r.num, r.den) for r in signatures.field_shares(frame, cohorts, ["a", "b"]).collect()}
    assert got == want
    assert {(r.poi, r.cohort): (r.pairs, r.travelers) for r in signatures.supports(frame, cohorts).collect()} == {(p, c): s[:2] for p, own in signature.items() for c, s in own.items()}

    items = [("N", f"p{k}", rng.choice(["k", "l", None]), rng.choice([1, None])) for k in range(40)]
    table = spark.createDataFrame(items, "region string, poi string, kind string, size int")
    for name, test in cohorts.items():
        table = table.join(signatures.history_signature(frame, name, test, ["a", "b"]), ["region", "poi"], "left")
    keys = [lambda i: i[2], lambda i: i[3], lambda i: signature[i[1]].get("all"), lambda i: signature[i[1]].get("core")]
    stages = signatures.tuple_stages(table, [("kind", ["kind"]), ("size", ["size"]), ("all", ["all"]), ("core", ["core"])]).collect()
    for n, r in enumerate(stages, 1):
        groups = Counter(tuple(k(i) for k in keys[:n]) for i in items)
        shared = sum(c for c in groups.values() if c > 1)
        assert (r.candidates, r.tuples, r.sharing, r.largest, r.rate) == (40, len(groups), shared, max(groups.values()), round(shared / 40, 8))
    alone = signatures.tuple_stages(table.where("poi = 'p1'"), [("kind", ["kind"]), ("size", ["size"])]).collect()
    assert [(r.tuples, r.sharing, r.largest) for r in alone] == [(1, 0, 1), (1, 0, 1)]
    assert [(r.tuples, r.largest, r.rate) for r in signatures.tuple_stages(table.limit(0), [("kind", ["kind"])]).collect()] == [(0, 0, 0.0)]


def test_gcd(spark):
    pairs = [(1, 1), (12, 18), (7, 7), (2**62, 2**40), (6557470319842, 10610209857723), (10**15, 3)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", signatures.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r.g for r in got] == [gcd(a, b) for a, b in pairs]


# Scope

MASTER = [("N", "1", "resolved", "11"), ("N", "2", "resolved", "22"), ("N", "3", "unresolved", "11"), ("N", "4", "resolved", "11"), ("N", "4", "resolved", "11"), ("N", " ", "resolved", "11"), ("N", None, None, None), ("N", "5", "resolved", " "), ("N", "6", "resolved_with_conflict", "11"), ("S", "1", "resolved", "33")]
POLICY = [("N", "11"), ("N", "12"), ("S", "22")]
PAIRS = [("N", "q1", "1"), ("N", "q1", "1"), ("N", "q1", "2"), ("N", "q2", "3"), ("N", "q2", "4"), ("N", "q3", "9"), ("S", "q4", "1")]


@pytest.fixture
def scoped(spark):
    master = spark.createDataFrame(MASTER, "region string, poi string, status string, code string")
    places = scope.catalogue(master, spark.createDataFrame(POLICY, "region string, code string"))
    return master, places, spark.createDataFrame(PAIRS, "region string, query string, poi string")


def test_reasons_and_counts(scoped):
    master, places, pairs = scoped
    assert {(r.region, r.poi): (r.reason, r.code) for r in places.collect()} == {
        ("N", "1"): ("candidate", "11"), ("N", "2"): ("other_region", "22"), ("N", "3"): ("unresolved", None), ("N", "4"): ("duplicate_key", None), ("N", "5"): ("unresolved", None), ("N", "6"): ("candidate", "11"), ("S", "1"): ("other_region", "33"),
    }
    assert {(r.query, r.poi): r.reason for r in scope.misses(pairs, places).collect()} == {("q1", "1"): "candidate", ("q1", "2"): "other_region", ("q2", "3"): "unresolved", ("q2", "4"): "duplicate_key", ("q3", "9"): "missing", ("q4", "1"): "other_region"}
    told = {(r.region, r.metric, r.detail): r.n for r in scope.before(*scoped).collect()}
    assert told["N", "source_rows", None] == 9 and told["N", "blank_id_rows", None] == 2 and told["N", "ids", None] == 6
    assert told["N", "positive_queries", None] == 3 and told["N", "positive_pairs", None] == 5 and told["N", "covered_queries", None] == 1 and told["S", "covered_queries", None] == 0
    assert told["N", "candidates_by_code", "11"] == 2 and ("S", "candidates_by_code", "33") not in told
    rates = {r.region: (r.unresolved_rate, r.pair_coverage_rate) for r in scope.rates(scope.before(*scoped)).collect()}
    assert rates == {"N": (0.4, 0.2), "S": (0.0, 0.0)}


def test_candidates_feed_the_scoring(spark, scoped):
    master, places, pairs = scoped
    with pytest.raises(training.ContractError):  # S has no candidate
        scope.candidates(master, places)
    north = lambda df: df.where("region = 'N'")
    kept = scope.candidates(north(master), north(places))
    assert {(r.poi, r.code, r.product_region) for r in kept.collect()} == {("1", "11", "N"), ("6", "11", "N")}
    queries = north(pairs).select("region", "query").distinct()
    got = training.score_catalogue(queries, scope.of_region(queries, kept), lambda q, i: [[float(p) for p in i["poi"]]] * len(q), 5)
    assert {(r.query, r.poi, r.rank) for r in got.collect()} == {(f"q{k}", p, n) for k in (1, 2, 3) for p, n in (("6", 1), ("1", 2))}
    with pytest.raises(training.ContractError):
        scope.of_region(pairs, kept)
    with pytest.raises(training.ContractError):
        scope.of_region(queries, kept.withColumn("product_region", F.lit("S")))
