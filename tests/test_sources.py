"""Readers and sinks over files in a temporary folder."""

from __future__ import annotations

import hashlib
import io
import random
import zipfile

import pytest

from tripwright.sources import archives, readers, sinks


def test_csv_tolerance(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿ID,Name\n1,a\n2,b\n", encoding="utf-8")
    assert [tuple(r) for r in readers.strict_csv(spark, str(path), ["ID"]).collect()] == [("1", "a"), ("2", "b")]
    with pytest.raises(ValueError):
        readers.strict_csv(spark, str(path), ["missing"])
    (short := tmp_path / "b.csv").write_text("id,name,x\n1\n2,b,c\n")
    assert [tuple(r) for r in readers.loose_csv(spark, str(short), ["NAME"]).collect()] == [(None,), ("b",)]
    (twice := tmp_path / "c.csv").write_text("id,ID\n1,2\n")
    with pytest.raises(ValueError):
        readers.loose_csv(spark, str(twice), ["id"])


def test_documents_inventory_and_snapshot(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"a": 1}')
    (tmp_path / "j/b.json").write_text("{broken")
    assert sorted(r.parses for r in readers.json_documents(spark, str(tmp_path / "j")).collect()) == [False, True]
    assert readers.inventory(spark, str(tmp_path / "j")).count() == 2
    good = spark.createDataFrame([("1", "1.5"), ("2", "x")], "contentid string, mapx string")
    assert sorted(r.mapx or 0 for r in readers.snapshot(good).collect()) == [0, 1.5]
    with pytest.raises(ValueError):
        readers.snapshot(good.union(good))


def test_sinks_do_not_overwrite(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string")
    sinks.write_table(frame, str(tmp_path / "t"), frame.schema, ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_report(frame, {"run": 1}, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exists|EXISTS"):
        sinks.write_report(frame, {"run": 1}, str(tmp_path / "r"))


def test_strict_width_shows_in_a_narrow_select(spark, tmp_path):
    (path := tmp_path / "w.csv").write_text("id,name,x\n1,a,b\n2,c\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.strict_csv(spark, str(path), ["id"]).select("id").collect()


def test_marks_inference_and_roles(spark, tmp_path):
    (path := tmp_path / "u.csv").write_bytes("ID,Straße\n1,ä\n".encode("utf-16"))
    assert readers.encoding(spark, str(path)) == "UTF-16LE"
    assert [tuple(r) for r in readers.loose_csv(spark, str(path), ["STRASSE"]).collect()] == [("ä",)]
    (good := tmp_path / "g.csv").write_text("a,b\n1,x\n2,y\n")
    frame, status = readers.inferred_csv(spark, str(good))
    assert status == "inferred" and dict(frame.dtypes)["a"] == "int"
    (bad := tmp_path / "b.csv").write_bytes(b"a,b\n1,\xff\xfe\xfd\n")
    assert readers.inferred_csv(spark, str(bad)) == (None, "unsupported_encoding")
    assert readers.text_csv(spark, str(good), ["b"]).columns == ["b"]
    (more := tmp_path / "m.csv").write_text("b,c\nz,w\n")
    assert sorted(map(tuple, readers.union_csv(spark, [str(good), str(more)]).select("b", "c").collect())) == [("x", None), ("y", None), ("z", "w")]
    assert readers.role(["d/VISIT.csv", "d/visit_a.csv", "d/visits.csv"], "visit") == ["d/VISIT.csv", "d/visit_a.csv"]
    seen = readers.observations(readers.text_csv(spark, str(good), ["a", "b"]), {"poi": "a", "name": "b"}, "west")
    assert [r.region for r in seen.collect()] == ["west", "west"] and seen.columns == ["poi", "name", "region"]


def test_json_policy_archive_and_cache(spark, tmp_path):
    (tmp_path / "v.json").write_text('[{"a": 1}, {"a": 2, "b": "x"}]')
    assert readers.json_view(spark, str(tmp_path / "v.json")).count() == 2
    (tmp_path / "p.json").write_text('{"west": ["1", "2"], "east": ["3"]}')
    codes, mark = readers.policy(spark, str(tmp_path / "p.json"))
    assert codes.count() == 3 and len(mark) == 64
    (tmp_path / "q.json").write_text('{"west": ["1"], "east": ["1"]}')
    with pytest.raises(ValueError):
        readers.policy(spark, str(tmp_path / "q.json"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/t.csv", "a\n1\n")
    members = archives.archive_members(spark, str(tmp_path / "a.zip"))
    assert members.select("name", "bytes").first() == ("d/t.csv", 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.csv").write_text("a\n1\n")
    files = readers.inventory(spark, str(tmp_path / "in"))
    assert files.select("class", "label").first() == ("tabular", "table_000001.csv")
    assert readers.provenance(members, files.select("path", "sha256")).first().same
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../x", "1")
    with pytest.raises(ValueError):
        archives.archive_members(spark, str(tmp_path / "b.zip"))
    calls = spark.createDataFrame([(1,)], "a int")
    assert readers.cached(calls, str(tmp_path / "c"), "k").count() == readers.cached(calls.union(calls), str(tmp_path / "c"), "k").count() == 1
    assert readers.cached(calls.union(calls), str(tmp_path / "c"), "other").count() == 2
    (tmp_path / "west.json").write_text('{"region": "west", "n": 1}')
    assert readers.profiles(spark, {"west": str(tmp_path / "west.json")}).count() == 1
    with pytest.raises(ValueError):
        readers.profiles(spark, {"east": str(tmp_path / "west.json")})


def test_manifests_hashes_and_reports(spark, tmp_path):
    frame = spark.createDataFrame([("2", "b"), ("1", None)], "k string, v string")
    assert sinks.content_hash(frame) == sinks.content_hash(frame.orderBy("k").repartition(3)) != sinks.content_hash(frame.where("k = '1'"))
    assert sinks.content_hash(frame) != sinks.content_hash(frame.union(frame)) and sinks.content_hash(frame.limit(0)) == sinks.content_hash(frame.limit(0))
    assert sinks.manifest("run-1", {"a": 1}, {"rows": 2})["counts"] == {"rows": 2}
    with pytest.raises(ValueError):
        sinks.manifest("../x", {}, {})
    assert sinks.markdown(frame, "T") == "## T\n\n| k | v |\n|-|-|\n| 1 |  |\n| 2 | b |\n"
    sinks.write_profile({"a": frame, "b": frame}, str(tmp_path / "p"))
    sinks.write_profile({"a": frame.limit(1)}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/a")).count() == 1 and spark.read.parquet(str(tmp_path / "p/b")).count() == 2
    sinks.check_ignored("/x/private/run", ["private/"])
    with pytest.raises(ValueError):
        sinks.check_ignored("/x/run", ["private/"])
    assert readers.normalized(spark.createDataFrame([(" a ", None)], "x string, y string"), ["x", "y", "z"]).first() == ("a", "", "")


def test_values_that_do_not_fit_are_text(spark, tmp_path):
    (path := tmp_path / "n.csv").write_text("a,b\n" + "".join(f"{k},x\n" for k in range(50)) + "1,2,3\n")
    frame, status = readers.inferred_csv(spark, str(path))
    assert status == "all_text" and dict(frame.dtypes)["a"] == "string" and frame.count() == 51
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):  # not taken for a table of texts
        readers.inferred_csv(spark, str(tmp_path / "none.csv"))


class Stream(io.RawIOBase):
    """Takes bytes only one after the other, so that sizes come after the members."""

    def __init__(self):
        self.data = bytearray()

    def writable(self):
        return True

    def write(self, b):
        self.data += b
        return len(b)


def test_archives_in_many_splits(spark, tmp_path):
    rng, inner = random.Random(3), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "inside " * 50)
        z.writestr("b.txt", "PK\x03\x04" * 9)
    want = {f"d/{k}.bin": bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 3000, 40_000]))) for k in range(20)}
    want |= {"a.txt": b"PK\x03\x04PK\x03\x04 twice" * 40, "nested.zip": inner.getvalue(), "text.csv": b"x,y\n" * 30_000, "é.txt": b"", "plain.txt": b"only here once!"}  # odd lengths are stored
    stream, path = Stream(), tmp_path / "all.zip"
    with zipfile.ZipFile(stream, "w") as z:
        for name, data in want.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if len(data) % 2 else zipfile.ZIP_DEFLATED)
    path.write_bytes(bytes(stream.data))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("10k", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {r.name: (r.bytes, r.sha256, bytes(r.content)) for r in archives.archive_members(spark, str(path), content=True).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == {n: (len(d), hashlib.sha256(d).hexdigest(), d) for n, d in want.items()}
    with pytest.raises(ValueError):
        archives.archive_members(spark, str(path), most=5)
    with pytest.raises(ValueError):
        archives.archive_members(spark, str(path), largest=1000)
    spoilt = bytearray(stream.data)
    spoilt[spoilt.find(b"only here")] = ord("O")
    (tmp_path / "bad.zip").write_bytes(bytes(spoilt))
    with pytest.raises(Exception, match="checksum of plain.txt"):
        archives.archive_members(spark, str(tmp_path / "bad.zip")).collect()
