"""Sinks: typed Parquet in a stated order, staged reports that never overwrite, hashes of what was written."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUN_ID = re.compile(r"[a-z0-9][a-z0-9._-]{0,63}")


def write_table(frame: DataFrame, path: str, schema: StructType, order: list[str]) -> None:
    """Zstandard Parquet with the declared types, also when empty, range-sorted by ``order``."""
    typed = frame.select(*[frame[f.name].cast(f.dataType).alias(f.name) for f in schema])
    typed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").mode("errorifexists").parquet(path)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_report(frame: DataFrame, metadata: dict, path: str) -> None:
    """An aggregate as one CSV beside its metadata; fails if ``path`` exists.

    Both are written to a folder beside it, which then takes its name: there is the whole
    pair or none.
    """
    spark = frame.sparkSession
    files, at = _files(spark, path)
    if files.exists(at):
        raise FileExistsError(f"{path} exists")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    frame.coalesce(1).write.option("header", True).csv(f"{staging}/metrics")
    text = spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string")
    text.coalesce(1).write.text(f"{staging}/metadata")
    if files.exists(at) or not files.rename(_files(spark, staging)[1], at):
        files.delete(_files(spark, staging)[1], True)
        raise FileExistsError(f"{path} exists")


def write_profile(sections: dict[str, DataFrame], path: str) -> None:
    """The sections of a profile, one folder each; a section that is there already is replaced alone.

    All are written beside it first.  A section changes by two renames, and the old one is
    deleted after the new one is there, so a failure leaves one of them whole.
    """
    staged = {}
    for name, frame in sections.items():
        frame.write.parquet(f"{path.rstrip('/')}/.{(mark := uuid.uuid4().hex)}-{name}")
        staged[name] = mark
    for name, mark in staged.items():
        spark, base = sections[name].sparkSession, path.rstrip("/")
        files, target = _files(spark, f"{base}/{name}")
        new, old = (_files(spark, f"{base}/.{mark}{kind}-{name}")[1] for kind in ("", "-old"))
        if files.exists(target) and not files.rename(target, old):
            raise OSError(f"{name} cannot be put aside")
        if not files.rename(new, target):
            raise OSError(f"{name} cannot be replaced")
        files.delete(old, True)


def manifest(run: str, config: dict, counts: dict[str, int], code: bytes = b"") -> dict:
    """What a run did: its id, settings and their hash, the code's hash, counts, and what the output does not hold."""
    if not RUN_ID.fullmatch(run):
        raise ValueError("not a run id")
    settings = json.dumps(config, sort_keys=True)
    return {
        "run": run, "config": config, "config_sha256": hashlib.sha256(settings.encode()).hexdigest(), "code_sha256": hashlib.sha256(code).hexdigest(), "counts": dict(sorted(counts.items())),
        "privacy": {"raw_identifiers": False, "small_cells": False},
    }


def markdown(frame: DataFrame, title: str, limit: int = 200) -> str:
    """An aggregate as a Markdown table, in the order of its columns; longer ones are an error."""
    rows = frame.orderBy(*frame.columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("not an aggregate for a report")
    shown = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "-|" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows]) + "\n"


def content_hash(frame: DataFrame) -> str:
    """A hash of all rows, repeated ones too, that neither their order nor their files change.

    Rows are hashed in Spark, and the parts of their hashes added up, so that tasks hand
    on five numbers each, whatever the size.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    one = frame.agg(F.count("*"), *[F.coalesce(F.sum(p), F.lit(0)) for p in parts]).first()
    return hashlib.sha256(":".join(map(str, one)).encode()).hexdigest()


def check_ignored(path: str, patterns: list[str]) -> None:
    """Raise unless one of the ignore patterns (folder names) covers the path: raw data must not be committed."""
    parts = path.strip("/").split("/")
    if not any(p.strip("/") in parts for p in patterns):
        raise ValueError("the path is not ignored by version control")
