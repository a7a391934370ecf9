"""Names, addresses, districts and identity stages against literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripwright.functions import address, codes, names, text
from tripwright.operators import admin, identity, matching


def values(spark, f, rows, schema="x string"):
    got = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}").withColumn("out", f)
    return [r.out for r in got.orderBy("i").collect()]


def test_name_keys(spark):
    f = names.gated_variants(text.fold("x"), F.array(F.lit("서울")))
    got = values(spark, f, ["서울 푸른언덕", "물빛정원 주차장", "달콤상회 북문점", "은하루 (별빛전시실)", "주차장", None, "", "Ｑ R-7"])
    assert got[0] == sorted(["푸른언덕", "서울 푸른언덕"]) and got[1] == sorted(["물빛정원", "물빛정원 주차장"])
    assert got[2] == sorted(["달콤상회", "달콤상회 북문점"]) and "별빛전시실" in got[3] and "은하루" in got[3]
    assert got[4] == [] and not got[5] and got[6] == [] and got[7] == ["q r 7"]


def test_addresses(spark):
    rows = ["서울특별시 종로구 세종대로 175", "경기도 수원시 장안구 조원로 12-3, 2층", "강원도 양양군 강현면 설악리 산 1-2", "서울 종로구", "제주시 (본관) 어딘가 없음", None, "부산시 중구 중앙로 앞"]
    got = values(spark, address.parse(F.col("x")), rows)
    assert got[0].sido == "서울" and tuple(got[0].road) == ("세종대로", 175, 0) and got[0].lot is None
    assert got[1].sigungu == "수원시 장안구" and tuple(got[1].road) == ("조원로", 12, 3)
    assert tuple(got[2].lot) == ("강현면 설악리", True, 1, 2) and got[2].sigungu == "양양군"
    assert got[3:] == [None] * 4
    pairs = [("서울 종로구 가로 1", "서울시 종로구 가로 1"), ("서울 종로구 가로 1-2", "서울 종로구 가로 1"), ("서울 종로구 가로 1-2", "서울 종로구 가로 1-3"), ("서울 종로구 신동 산 5", "서울 종로구 신동 5"), ("서울 종로구 신동 5", "서울 종로구 신동 5")]
    parsed = address.match(address.parse(F.col("x")), address.parse(F.col("y")))
    assert values(spark, parsed, pairs, "x string, y string") == ["road_exact_full", "road_exact_main", None, None, "lotno_exact_full"]


def test_districts_of_places(spark):
    book = spark.createDataFrame([("11110", "11", "110", "서울특별시", "종로구"), ("41111", "41", "111", "경기도", "수원시 장안구"), ("41999", "41", "999", "경기", "수원시 장안구"), ("bad", "1", "2", "x", "y")], "code string, sido_code string, sgg_part string, sido_name string, sgg_name string")
    known = admin.lookup(book)
    assert known.count() == 3
    with pytest.raises(ValueError):
        admin.lookup(book.union(spark.createDataFrame([("11110", "11", "110", "서울특별시", "중구")], book.schema)))
    said = spark.createDataFrame(
        [("a", "master", "1111000000", None), ("b", "master", None, "서울 종로구 1"), ("b", "tourapi", "11110", None), ("c", "master", "11110", None), ("c", "tourapi", "41111", None), ("d", "master", None, "경기도 수원시 장안구 조원로 1"), ("e", "master", "1111012345", "서울"), ("f", "master", None, None)],
        "id string, source string, code string, address string",
    )
    places = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    got = {r.id: tuple(r)[1:] for r in admin.resolve(places, said, known).collect()}
    assert got["a"] == ("resolved_single_source", "11110", "11", "master_sgg_code", "") and got["b"] == ("resolved_multi_source", "11110", "11", "master_address|tourapi_sgg_code", "")
    assert got["c"][0] == "conflict" and got["c"][4] == "master|tourapi" and got["d"][0] == "ambiguous_address"
    assert all(got[x][0] == "unavailable" for x in "efg")


def test_code_anomalies(spark):
    got = values(spark, codes.anomaly(F.col("x"), ["1", "2"], listed=["1", "9"], special=["9"]), ["1", "1|2", "1,1", "9", "é", "44"])
    assert got == ["in_domain", "multiple_exact_hwp_domain_codes_delimited", "multiple_exact_hwp_and_reference_codes_delimited", "reference_table_special_category", "undocumented_non_numeric_representation", "undocumented_numeric_code"]


ROAD = "서울 종로구 가로 "


@pytest.fixture(scope="module")
def world(spark):
    """source and catalogue in which each place shows one stage; a degree of latitude is about 111 km."""
    cat = [  # id, title, address, signgu, lat
        (1, "alpha", ROAD + "1", "110", 37.0), (2, "beta", ROAD + "2", "110", 37.1), (3, "gamma", ROAD + "30", "110", 37.2), (4, "gamma", ROAD + "31", "140", 37.3),
        (5, "delta", None, "140", 37.4), (6, "delta", None, "140", 37.5), (7, "eta", None, "140", 37.6), (8, "theta park", None, "140", 37.7), (9, "iota", None, "140", 37.8), (10, "iota", None, "140", 37.8002), (11, "kappa", None, "110", 37.85),
    ]
    src = [  # id, name, exact address, parsed address, sgg, lat, visit name
        ("exact", "alpha", ROAD + "1", None, None, None, None), ("structured", "beta", None, "서울시 종로구 가로 2", None, None, None), ("district", "gamma", None, None, "11110", None, None),
        ("near", "delta", None, None, None, 37.4001, None), ("visit", "nothing", None, None, None, 37.6, "eta"), ("gated", "theta park (2층)", None, None, None, 37.7001, None),
        ("tie", "iota", None, None, None, 37.8001, None), ("nameless", None, None, None, None, None, None), ("unknown", "zeta", None, None, None, None, None), ("far", "kappa", None, None, "11110", 37.853, None), ("open", "delta", None, None, None, None, None),
    ]
    catalog = spark.createDataFrame([(i, "r", t, a, "11", g, lat, 127.0) for i, t, a, g, lat in cat], "content_id long, region string, title string, address string, regn string, signgu string, lat double, lon double").withColumn("parsed", address.parse(F.col("address")))
    source = spark.createDataFrame([(i, "r", n, e, p, s, lat, v) for i, n, e, p, s, lat, v in src], "source_id string, region string, name string, e string, p string, sgg string, lat double, v string")
    source = source.select("source_id", "region", "name", "sgg", "lat", F.when(F.col("lat").isNotNull(), 127.0).alias("lon"), F.array("e").alias("exact"), F.array(address.parse(F.col("p"))).alias("parsed"), F.array("v").alias("visit_names"), F.array(address.parse(F.col("v"))).alias("visit_parsed"), F.array("sgg").alias("visit_sggs"), F.lit(None).cast("double").alias("visit_lat"), F.lit(None).cast("double").alias("visit_lon"))
    return source, catalog


def test_stages(world):
    got = {r.source_id: (r.stage, r.content_id, r.status_5) for r in matching.stages(*world).collect()}
    assert len(got) == 11
    want = {"exact": (0, 1), "structured": (1, 2), "district": (2, 3), "near": (3, 5), "visit": (4, 7), "gated": (5, 8)}
    assert {k: got[k][:2] for k in want} == want
    # 333 m away, a lone name in its district: the district settles it unless it is vetoed, nearness then does.
    assert got["far"] == (3, 11, "MATCHED")
    assert {k: got[k] for k in ("tie", "nameless", "unknown", "open")} == {"tie": (None, None, "AMBIGUOUS"), "nameless": (None, None, "identity_source_missing"), "unknown": (None, None, "UNMATCHED"), "open": (None, None, "AMBIGUOUS")}


def test_stages_only_add_matches_and_take_empty_tables(spark, world):
    rows = matching.stages(*world).collect()
    for k in range(5):
        assert all(r[f"status_{k + 1}"] == "MATCHED" for r in rows if r[f"status_{k}"] == "MATCHED")
    source, catalog = world
    assert {r.status_5 for r in matching.stages(source, catalog.limit(0)).collect()} == {"UNMATCHED", "identity_source_missing"}
    assert matching.stages(source.limit(0), catalog).count() == 0
    rules = {r.rule: r for r in matching.independent_rules(source, catalog).collect()}
    assert all(r.anchors == 1 for r in rules.values())


def test_fuzzy_titles(spark):
    grams = lambda key, titles: spark.createDataFrame([(t,) for t in titles], f"{key} string").withColumn("grams", text.bigrams(F.col(key)))
    got = identity.fuzzy_candidates(grams("source_id", ["red widget"]), grams("content_id", ["red widgets", "blue bolt", "widget"]), 250, 2).orderBy("rank").collect()
    assert [r.content_id for r in got] == ["red widgets", "widget"] and got[0].similarity == pytest.approx(20 / 21)
