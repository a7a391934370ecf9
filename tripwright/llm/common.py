"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a
    cluster must name one, since its machines do not see each other's disks.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="tripwright-"))
    return made


def small_batches(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``df``, its session told to hand texts to Python in Arrow batches of about ``most`` bytes, if nobody chose a bound.

    Otherwise a batch is 10,000 rows however long their texts are, and a worker's
    memory follows the longest ones.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return df


T = TypeVar("T")


def give_back() -> None:
    """Return what this Python process no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterator[T]) -> Iterator[T]:
    """The batches of a task; after the last, memory is given back, since workers outlive tasks."""
    yield from batches
    give_back()


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tripwright-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder once and read it back."""
    spark = df.sparkSession
    df.write.parquet(path := _path(spark))
    out = spark.read.schema(df.schema).parquet(path)
    out._tripwright_path = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like materialize, in buckets of ``key``: later joins on it move only the other side."""
    spark, path = df.sparkSession, _path(df.sparkSession)
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def forget(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``materialize`` that nothing reads any more."""
    for df in frames:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(df._tripwright_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one task ranks at about, in ``hash_buckets``.
BUCKET_ROWS = 1 << 16


def hash_buckets(df: DataFrame, *by: str | Column) -> Column:
    """A bucket of each row by hash: 64 of them, and more where 64 would hold over BUCKET_ROWS rows each."""
    return F.pmod(F.xxhash64(*by), F.lit(max(64, -(-df.count() // BUCKET_ROWS))))


def gapless_index(df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order (bucket, order).

    No task holds a group: rows are ranked within (group, bucket), and a bucket
    starts where the counts of the buckets before it end.  ``df`` is read twice, so
    it should be materialized and deterministic.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_local", local).join(starts, keys).withColumn(name, F.col("_start") + F.col("_local")).drop("_bucket", "_start", "_local")


#: A key with more than one row in HOT is hot; there are fewer than HOT of them.
HOT = 256


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``count`` how many of ``rows`` the key has.

    Hot keys, fewer than HOT whatever the data, are broadcast, so that their rows
    stay where they are; all others meet by a shuffle.  Both frames are read twice.
    """
    total, size = rows.count(), F.col(count)
    hot, rest = F.broadcast(table.where(size * HOT > total).drop(count)), table.where(size * HOT <= total).drop(count)
    first = rows.join(hot, key)
    return first.unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, how), allowMissingColumns=True)


def sorted_groups(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The whole groups of a stream that is sorted by ``keys``; only the open group is held back."""
    for _, groups in group_batches(frames, keys):
        yield from groups


def group_batches(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[int, list[tuple[tuple, pd.DataFrame]]]]:
    """Like sorted_groups, with the groups that one incoming batch completes given together."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        held.append(frame)
        if len(held) > 1 and tuple(held[0][k].iloc[0] for k in keys) == tuple(frame[k].iloc[-1] for k in keys):
            continue  # one group runs through this batch; join the pieces once, at its end
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else frame.reset_index(drop=True)
        cuts = _starts(whole, keys)
        held = [whole.iloc[cuts[-1] :]]
        if len(cuts) > 1:
            yield len(cuts) - 1, [(tuple(whole[k].iloc[a] for k in keys), whole.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield 1, [(tuple(whole[k].iloc[0] for k in keys), whole)]


def _starts(frame: pd.DataFrame, keys: Sequence[str]) -> list[int]:
    changed = (frame[list(keys)] != frame[list(keys)].shift()).any(axis=1)
    return changed.to_numpy().nonzero()[0].tolist()
