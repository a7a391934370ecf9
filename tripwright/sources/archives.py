"""ZIP archives read by tasks: nothing is extracted, and no member is inflated on the driver.

The driver reads the archive's directory of entries, by ranges.  Spark reads the
archive as text whose lines end where a member's header starts, so that it is split
like any text, through any file system.  Pieces go to the member of the entry that
their place in the archive falls to; each member is then put together, inflated
and checked by a task.
"""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwright.sources.files import RangeFile

#: What a member's header starts with.
SIGNATURE = b"PK\x03\x04"
#: Where the lengths of its name and its extra field are, and where its name starts.
_NAME, _EXTRA, _BODY = 22, 24, 26
_BLOCK = 1 << 20


def entries(spark: SparkSession, path: str, most: int = 10_000, largest: int = 1 << 30) -> list[zipfile.ZipInfo]:
    """The members that an archive's directory names; unsafe, repeated, too many or too large ones are errors, and so are encrypted ones."""
    with zipfile.ZipFile(RangeFile(spark, path)) as archive:
        members = [m for m in archive.infolist() if not m.is_dir()]
    names = [m.filename for m in members]
    if len(members) > most or len(set(names)) < len(names):
        raise ValueError("too many or repeated members")
    for m in members:
        parts = m.filename.replace("\\", "/").split("/")
        if m.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or max(m.file_size, m.compress_size) > largest:
            raise ValueError("unsafe or too large member")
        if m.flag_bits & 1 or m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError("encrypted or unknown compression")
    return members


def inflate(data: bytes, deflated: bool, size: int) -> Iterator[bytes]:
    """The bytes of a member, in blocks; more or fewer than ``size`` are an error."""
    done, inflater = 0, zlib.decompressobj(-15) if deflated else None
    for at in range(0, len(data), _BLOCK):
        block = data[at : at + _BLOCK]
        while block:
            out = inflater.decompress(block, _BLOCK) if inflater else block
            block = inflater.unconsumed_tail if inflater else b""
            done += len(out)
            if done > size:
                raise ValueError("a member is larger than its entry says")
            yield out
    if done != size or (inflater and not inflater.eof):
        raise ValueError("a member is shorter than its entry says")


def _members(content: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, size, packed, crc, deflated, pieces in zip(frame["name"], frame["size"], frame["packed"], frame["crc"], frame["deflated"], frame["pieces"]):
                raw = SIGNATURE.join(p["value"] for p in pieces)  # the reader took the signatures between them away
                start = _BODY + int.from_bytes(raw[_NAME : _NAME + 2], "little") + int.from_bytes(raw[_EXTRA : _EXTRA + 2], "little")
                check, digest, kept = 0, hashlib.sha256(), []
                for block in inflate(raw[start : start + packed], deflated, size):
                    check = zlib.crc32(block, check)
                    digest.update(block)
                    if content:
                        kept.append(block)
                if check != crc:
                    raise ValueError(f"the checksum of {name} is wrong")
                rows.append((name, size, packed, digest.hexdigest(), *([b"".join(kept)] if content else [])))
            yield pd.DataFrame(rows, columns=["name", "bytes", "compressed", "sha256", *["content"] * content])

    return run


def archive_members(spark: SparkSession, path: str, most: int = 10_000, largest: int = 1 << 30, content: bool = False) -> DataFrame:
    """name, bytes, compressed, sha256 (and content) of a ZIP file's members, each inflated whole by a task, which checks its CRC and size.

    ``path`` may be in any file system.  An unsafe name, a member that stands twice, more
    members than ``most`` or one larger than ``largest`` are errors at once; a broken member is
    an error when it is read.
    """
    found = entries(spark, path, most, largest)
    table = spark.createDataFrame(
        [(m.filename, m.file_size, m.compress_size, m.CRC, m.compress_type == zipfile.ZIP_DEFLATED, m.header_offset + len(SIGNATURE)) for m in found], "name string, size long, packed long, crc long, deflated boolean, at long",
    )
    pieces = spark.read.option("lineSep", SIGNATURE.decode()).text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")).alias("turn"))
    # Where each piece starts: pieces are about as many as members, and only their lengths meet in one window.
    places = pieces.select("turn", F.octet_length("value").cast("long").alias("n"))
    places = places.withColumn("place", F.sum(F.col("n") + len(SIGNATURE)).over(Window.orderBy("turn")) - F.col("n") - len(SIGNATURE))
    starts = table.select(F.col("at").alias("place"), F.lit(None).cast(places.schema["turn"].dataType).alias("turn"), F.col("at"))
    owned = places.select("place", "turn", F.lit(None).cast("long").alias("at")).unionByName(starts)
    owned = owned.withColumn("at", F.last("at", ignorenulls=True).over(Window.orderBy("place", F.col("turn").isNotNull()))).where("turn IS NOT NULL AND at IS NOT NULL")
    whole = pieces.join(owned.select("turn", "place", "at"), "turn").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("pieces"))
    joined = table.join(whole, "at", "left").withColumn("pieces", F.coalesce("pieces", F.array().cast(whole.schema["pieces"].dataType)))
    schema = "name string, bytes long, compressed long, sha256 string" + ", content binary" * content
    return joined.select("name", "size", "packed", "crc", "deflated", "pieces").mapInPandas(_members(content), schema)
