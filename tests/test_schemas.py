"""Masking by path over structs, arrays and maps, and tables told apart by their columns."""

import pytest
from pyspark.sql import functions as F

from tripwright.functions import codes, text
from tripwright.operators import checks, schemas, training
from tripwright.sources import readers

SCHEMA = "id int, a struct<b: string, c: array<struct<d: string, e: double>>, when: date>, m map<string, struct<x: int, y: array<string>>>, flag boolean, raw binary"


@pytest.fixture
def nested(spark):
    return spark.createDataFrame([(1, ("p", [("q", 1.5), (None, None)], None), {"k": (3, ["u", None]), "j": None}, True, b"z"), (2, None, None, None, None), (3, ("r", None, None), {}, False, b"")], SCHEMA)


def test_everything_is_masked_but_its_shape(nested):
    got = {r.id: r.asDict(recursive=True) for r in schemas.masked(nested, ["id"]).collect()}
    assert got[1] == {"id": 1, "a": {"b": "***", "c": [{"d": "***", "e": 0.0}, {"d": None, "e": None}], "when": None}, "m": {"key_1": None, "key_2": {"x": 0, "y": ["***", None]}}, "flag": False, "raw": b""}
    assert got[2] == {"id": 2, "a": None, "m": None, "flag": None, "raw": None}
    assert got[3]["a"] == {"b": "***", "c": None, "when": None} and got[3]["m"] == {}


def test_kept_paths_at_any_depth(nested):
    got = schemas.masked(nested, ["a.c[].e", "m{key}", "m{}.y", "flag"]).where("flag").first().asDict(recursive=True)
    assert got["id"] == 0 and got["a"]["c"] == [{"d": "***", "e": 1.5}, {"d": None, "e": None}] and got["m"] == {"k": {"x": 0, "y": ["u", None]}, "j": None}
    assert schemas.masked(nested, ["a"]).where("a IS NOT NULL").first().a.b in "pr"
    with pytest.raises(ValueError):
        schemas.masked(nested, ["a.c.e"])
    assert schemas.masked(nested, []).schema.simpleString() == nested.schema.simpleString()


def test_types_and_leaves(nested):
    assert {r["column"]: r.type for r in schemas.reported_types(nested).collect()} == {"id": "int", "a": "NESTED", "m": "NESTED", "flag": "boolean", "raw": "binary"}
    assert "struct" in {r["column"]: r.type for r in schemas.reported_types(nested, hide=False).collect()}["a"]
    assert schemas.leaves(nested.schema)[:6] == [("id", "int"), ("a.b", "string"), ("a.c[].d", "string"), ("a.c[].e", "double"), ("a.when", "date"), ("m{key}", "string")]


def test_roles_and_pairs(spark):
    profile = spark.createDataFrame([("t2", "x"), ("t2", "y"), ("t1", "x"), ("t1", "y"), ("t1", "y"), ("t3", "x"), ("t4", "x"), ("t4", "y"), ("t4", "z"), ("t5", "z")], "alias string, column string")
    roles = spark.createDataFrame([("xy", "x"), ("xy", "y"), ("z", "z")], "role string, column string")
    found = schemas.roles_of(profile, roles)
    assert {(r.alias, r.role) for r in found.collect()} == {("t1", "xy"), ("t2", "xy"), ("t5", "z")}  # t4 has the columns of both
    files = spark.createDataFrame([("xy", "b"), ("xy", "a"), ("other", "c")], "role string, path string")
    assert {tuple(r) for r in schemas.paired(found, files).collect()} == {("xy", "t1", "a", "paired"), ("xy", "t2", "b", "paired"), ("z", None, None, "unequal"), ("other", None, None, "unequal")}


def test_books_against_what_is_wanted(spark):
    book = spark.createDataFrame([("1", "a"), (" 1 ", "a "), ("2", "b"), ("2", "c"), ("3", None), ("9", "z"), ("", "q"), (None, "q")], "code string, label string")
    wanted = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "code string, label string")
    cohorts = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "2"), ("y", "3")], "cohort string, code string")
    assert {tuple(r) for r in checks.book_problems(book, wanted, cohorts).collect()} == {("label_mismatch", "2"), ("conflicting_label", "2"), ("label_mismatch", "3"), ("missing", "4"), ("unexpected", "9"), ("outside_cohorts", "9"), ("cohort_overlap", "2")}
    right = spark.createDataFrame([("1", "a")], "code string, label string")
    assert checks.book_problems(right, right, cohorts.where("code = '1'")).count() == 0


def test_settings_snapshots_and_parsing(spark):
    known = {"a": ("x", "y", "z"), "b": ("n",)}
    config = checks.RunConfig(("a", "b"), known=known)
    assert config.protocol()["sha256"] == checks.RunConfig(("a", "b"), known=known).protocol()["sha256"] != checks.RunConfig(("a",), known=known).protocol()["sha256"]
    for wrong in ({"objective": "x"}, {"strategy": "x"}, {"ratio": 0}, {"ks": ()}, {"ks": (0,)}, {"depth": 4}, {"popularity": "x"}, {"rounds": 0}, {"smoothing": float("nan")}, {"uniform": 1.5}):
        with pytest.raises(training.ContractError):
            checks.RunConfig(("a",), known=known, **wrong)
    with pytest.raises(training.ContractError):
        checks.RunConfig(("c",), known=known)
    good = {"policy_config_sha256": "h", "request_config": {"region_codes": ["1", "2"]}, "supported_content_type_ids": ["12"], "provider": "p", "manual_version": "1"}
    assert checks.check_snapshot(good, "h", {"1", "2"}, {"12"}, "p", "1") is good
    for change in ({"policy_config_sha256": "x"}, {"request_config": {}}, {"supported_content_type_ids": []}, {"provider": "q"}, {"manual_version": "2"}):
        with pytest.raises(training.ContractError):
            checks.check_snapshot(good | change, "h", {"1", "2"}, {"12"}, "p", "1")
    rows = spark.createDataFrame([('"37.5"', "Ｓｔｒａße 1 "), (" 126.9 ", None), ("x", "　a\tB")], "c string, t string")
    assert [tuple(r) for r in rows.select(codes.parse_coordinate(F.col("c")), text.compact(F.col("t"))).collect()] == [(37.5, "strasse1"), (126.9, ""), (None, "ab")]


def test_profiles_of_exactly_the_expected_regions(spark, tmp_path):
    for region in ("east", "west"):
        (tmp_path / region).mkdir()
        (tmp_path / region / "profile.json").write_text('{"region": "%s", "n": 1}' % region)
    paths = {r: str(tmp_path / r / "profile.json") for r in ("east", "west")}
    assert readers.profiles(spark, paths, ["west", "east"]).count() == 2
    with pytest.raises(ValueError):
        readers.profiles(spark, paths, ["west", "east", "north"])
    with pytest.raises(ValueError):
        readers.profiles(spark, {"east": paths["west"], "west": paths["east"]}, ["west", "east"])
