"""Readers with the tolerance that each kind of source asks for."""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tripwright.sources.files import first_bytes

#: Byte-order marks and the encodings that they stand for.
MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


#: Marks a row that does not fit its types.
CORRUPT = "_corrupt_row"


def encoding(spark: SparkSession, path: str, default: str = "UTF-8") -> str:
    """The encoding that a file's byte-order mark names, else the default."""
    start = first_bytes(spark, path)
    return next((name for mark, name in MARKS if start.startswith(mark)), default)


def header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """The names in a CSV's first line, trimmed, without a byte-order mark."""
    row = spark.read.option("encoding", encoding).option("multiLine", encoding != "UTF-8").csv(path, header=False).first()
    return [] if row is None else [(x or "").replace("\ufeff", "").strip() for x in row]


def _schema(names: Iterable[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def strict_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Every column as text; a blank, repeated or missing name, or a row of another width, is an error.

    All columns are parsed, whatever is selected later, since a row's width shows only then.
    """
    names = header(spark, path)
    if not all(names) or len(set(names)) < len(names) or not set(required) <= set(names):
        raise ValueError("blank, repeated or missing column")
    reader = spark.read.schema(_schema(names)).option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", False).option("columnPruning", False)
    return reader.csv(path)


def loose_csv(spark: SparkSession, path: str, selected: list[str], encoding_: str | None = None) -> DataFrame:
    """``selected`` columns, names compared without case, short rows filled with null, bad bytes replaced.

    Without a given encoding the byte-order mark decides, and UTF-8 if there is none.
    """
    found = encoding_ or encoding(spark, path)
    names = [n.casefold() for n in header(spark, path, found)]
    if len(set(names)) < len(names):
        raise ValueError("repeated column")
    if missing := {n.casefold() for n in selected} - set(names):
        raise ValueError(f"missing columns: {len(missing)}")
    frame = spark.read.schema(_schema(names)).option("header", True).option("mode", "PERMISSIVE").option("encoding", found).option("multiLine", found != "UTF-8").csv(path)
    return frame.select(*[F.col(n.casefold()).alias(n) for n in selected])


def inferred_csv(spark: SparkSession, path: str) -> tuple[DataFrame | None, str]:
    """The file with inferred types and ``inferred``; as text and ``all_text`` where a value does not fit its type; or nothing and ``unsupported_encoding``."""
    found = encoding(spark, path)
    if found == "UTF-8" and spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0] is False:
        return None, "unsupported_encoding"
    names = header(spark, path, found)
    base = spark.read.option("header", True).option("encoding", found).option("multiLine", found != "UTF-8")  # lines of two-byte characters cannot be split as bytes
    types = base.option("inferSchema", True).csv(path).schema
    typed = StructType([StructField(n, f.dataType) for n, f in zip(names, types)])
    # Rows that do not fit are marked, not raised, so that any other failure stays one.
    marked = base.schema(StructType([*typed, StructField(CORRUPT, StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    fits = marked.agg(F.count(CORRUPT), *[F.count(F.col(f"`{n}`")) for n in names]).first()[0] == 0  # all columns, since only those are parsed
    if fits:
        return base.schema(typed).option("mode", "FAILFAST").csv(path), "inferred"
    return base.schema(_schema(names)).option("mode", "PERMISSIVE").csv(path), "all_text"


def text_csv(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """The ``allowed`` columns of a file whose header is trusted, all text; the scan reads no others."""
    names = header(spark, path)
    return spark.read.schema(_schema(names)).option("header", True).csv(path).select(*[F.col(f"`{n}`") for n in names if n in allowed])


def union_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files by column name, all text, absent columns null; each file in the encoding of its mark, ragged rows kept."""
    frames = []
    for p in paths:
        found = encoding(spark, p)
        frames.append(spark.read.schema(_schema(header(spark, p, found))).option("header", True).option("mode", "PERMISSIVE").option("encoding", found).option("multiLine", found != "UTF-8").csv(p))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def json_view(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON with inferred types: an array of objects, or one object."""
    return spark.read.option("multiLine", True).json(path)


def observations(frame: DataFrame, fields: dict[str, str], region: str | None = None) -> DataFrame:
    """``frame`` under the names of ``fields`` (ours to theirs), blank as null, and a default region."""
    if missing := set(fields.values()) - set(frame.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = frame.select(*[F.when(F.btrim(theirs) != "", F.btrim(theirs)).alias(ours) for ours, theirs in fields.items()])
    if region is None:
        return out
    return out.withColumn("region", F.coalesce("region", F.lit(region)) if "region" in fields else F.lit(region))


def role(paths: Iterable[str], table: str) -> list[str]:
    """The files of a table: those whose stem is its name, or starts with it and an underscore."""
    stems = {p: posixpath.basename(p).rsplit(".", 1)[0].casefold() for p in paths}
    name = table.casefold()
    return sorted(p for p, s in stems.items() if s == name or s.startswith(f"{name}_"))


def provenance(members: DataFrame, tables: DataFrame) -> DataFrame:
    """table, name, same: the archive members that carry a table's file name, and whether the content is the same; ``tables(path, sha256)``."""
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    left = tables.select(F.col("path").alias("table"), base("path").alias("_b"), F.col("sha256").alias("_s"))
    return left.join(members.select("name", base("name").alias("_b"), "sha256"), "_b", "left").select("table", "name", F.coalesce(F.col("_s") == F.col("sha256"), F.lit(False)).alias("same"))


def policy(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``(region, code)`` of a JSON policy of regions to codes, and its fingerprint; a code in two regions, or a region without any, is an error."""
    text = "".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())  # one small file
    regions = json.loads(text)
    codes = [(region, code) for region, own in sorted(regions.items()) for code in own]
    if not all(regions.values()) or len({c for _, c in codes}) < len(codes):
        raise ValueError("the regions do not part the codes")
    return spark.createDataFrame(codes, "region string, code string"), hashlib.sha256(json.dumps(regions, sort_keys=True).encode()).hexdigest()


def profiles(spark: SparkSession, paths: dict[str, str], expected: Iterable[str] | None = None) -> DataFrame:
    """The profile documents of the named regions, each with its ``region``; a document of another label is an error.

    With ``expected``, the regions must be exactly these, and each document must lie in a folder of its region's name.
    """
    if expected is not None:
        if set(paths) != set(expected):
            raise ValueError("not exactly the expected regions")
        if odd := sorted(r for r, p in paths.items() if posixpath.basename(posixpath.dirname(p)) != r):
            raise ValueError(f"folders of another name: {odd}")
    out = None
    for region, path in sorted(paths.items()):
        frame = json_view(spark, path)
        if "region" in frame.columns and frame.where(~F.col("region").eqNullSafe(region)).limit(1).count():
            raise ValueError("a document of another region")
        frame = frame.withColumn("region", F.lit(region))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, body and whether the body parses, of whole-file JSON documents."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return files.withColumn("parses", F.expr("try_parse_json(body)").isNotNull())


def file_class(path: Column) -> Column:
    """tabular, photo or other, by the ending."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end.isin("csv", "tsv", "json", "parquet", "xlsx"), "tabular").when(end.isin("jpg", "jpeg", "png", "webp"), "photo").otherwise("other")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, class, label, length and SHA-256 of every file below ``path``; labels as table_000001.csv tell nothing of a name.

    Files are numbered by class in the order of their paths; a listing is small beside what it lists.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", file_class(F.col("path")).alias("class"), "length", F.sha2("content", 256).alias("sha256"))
    nth = F.row_number().over(Window.partitionBy("class").orderBy("path"))
    kind = F.when(F.col("class") == "tabular", "table").otherwise(F.col("class"))
    return rows.withColumn("label", F.format_string("%s_%06d.%s", kind, nth, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))))


def cached(frame: DataFrame, path: str, key: str) -> DataFrame:
    """``frame`` from its Parquet copy under ``path`` for this ``key`` (a fingerprint of its sources), written if there is none."""
    spark, where = frame.sparkSession, f"{path.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    try:
        return spark.read.parquet(where)
    except AnalysisException:
        frame.write.mode("errorifexists").parquet(where)
        return spark.read.parquet(where)


def snapshot(frame: DataFrame, key: str = "contentid") -> DataFrame:
    """A catalogue snapshot with numeric coordinates; a missing or repeated key is an error."""
    bad = frame.groupBy(F.col(key).alias("k")).count().where("k IS NULL OR trim(k) = '' OR count > 1")
    if not bad.isEmpty():
        raise ValueError("missing or repeated key")
    return frame.withColumns({c: F.col(c).try_cast("double") for c in ("mapx", "mapy") if c in frame.columns})


def normalized(frame: DataFrame, fields: list[str]) -> DataFrame:
    """The ``fields`` of a snapshot as trimmed text, absent and null ones empty, all others left out."""
    return frame.select(*[(F.coalesce(F.btrim(F.col(f).cast("string")), F.lit("")) if f in frame.columns else F.lit("")).alias(f) for f in fields])
