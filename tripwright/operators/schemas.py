"""Nested types and values masked by path, and tables told apart by the columns that they have."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: How a nested type is reported where the names of its members must not be.
NESTED = "NESTED"
#: What stands for a text.
MASK = "***"


def reported_types(frame: DataFrame, hide: bool = True) -> DataFrame:
    """column, type: the types of a frame; with ``hide``, nested ones as NESTED, since their text names their members."""
    rows = [(f.name, NESTED if hide and isinstance(f.dataType, StructType | ArrayType | MapType) else f.dataType.simpleString()) for f in frame.schema]
    return frame.sparkSession.createDataFrame(rows, "column string, type string")


def leaves(kind: DataType, path: str = "") -> list[tuple[str, str]]:
    """(path, type) of the values within a type: ``a.b`` in a struct, ``a[]`` in an array, ``a{}`` in a map and ``a{key}`` of its keys."""
    if isinstance(kind, StructType):
        return [x for f in kind for x in leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, ArrayType):
        return leaves(kind.elementType, f"{path}[]")
    if isinstance(kind, MapType):
        return [(f"{path}{{key}}", kind.keyType.simpleString()), *leaves(kind.valueType, f"{path}{{}}")]
    return [(path, kind.simpleString())]


def _masked(value: Column, kind: DataType, path: str, keep: frozenset[str]) -> Column:
    if path in keep:
        return value
    if isinstance(kind, StructType):
        inner = F.struct(*[_masked(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, keep).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _masked(x, kind.elementType, f"{path}[]", keep))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(value))
        keys = F.transform(entries, lambda e: e["key"])
        if f"{path}{{key}}" not in keep:  # keys stay different from each other, but say nothing
            keys = F.transform(entries, lambda e, i: F.concat(F.lit("key_"), (i + 1).cast("string"))) if isinstance(kind.keyType, StringType) else F.transform(entries, lambda e, i: (i + 1).cast(kind.keyType))
        return F.map_from_arrays(keys, F.transform(entries, lambda e: _masked(e["value"], kind.valueType, f"{path}{{}}", keep)))
    blank = F.lit(MASK) if isinstance(kind, StringType) else F.lit({"boolean": "false", "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01", "binary": ""}.get(kind.simpleString(), "0")).cast(kind)
    return F.when(value.isNotNull(), blank)


def masked(frame: DataFrame, keep: Iterable[str]) -> DataFrame:
    """``frame`` with every value replaced by one of its type that says nothing, but for the paths of ``leaves`` to keep.

    A kept path of a struct, array or map keeps all below it.  What is null stays null, and
    arrays and maps keep their sizes.  Unknown paths are an error, so that a misspelt one does not pass.
    """
    kept, known = frozenset(keep), set()

    def walk(kind: DataType, path: str) -> None:
        known.add(path)
        if isinstance(kind, StructType):
            for f in kind:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            known.add(f"{path}{{key}}")
            walk(kind.valueType, f"{path}{{}}")

    walk(frame.schema, "")
    if unknown := sorted(kept - known):
        raise ValueError(f"unknown paths: {unknown}")
    return frame.select(*[_masked(F.col(f"`{f.name}`"), f.dataType, f.name, kept).alias(f.name) for f in frame.schema])


def roles_of(profile: DataFrame, roles: DataFrame) -> DataFrame:
    """alias, role of ``profile(alias, column)`` where an alias has all columns of exactly one of ``roles(role, column)``.

    Aliases and roles meet by the columns that they share, and are counted.
    """
    wanted = roles.select("role", "column").distinct()
    size = wanted.groupBy("role").agg(F.count("*").alias("size"))
    shared = profile.select("alias", "column").distinct().join(wanted, "column").groupBy("alias", "role").agg(F.count("*").alias("shared"))
    whole = shared.join(size, "role").where("shared = size")
    return whole.groupBy("alias").agg(F.first("role").alias("role"), F.count("*").alias("n")).where("n = 1").select("alias", "role")


def paired(aliases: DataFrame, documents: DataFrame) -> DataFrame:
    """role, alias, path, status: the aliases of each role, in their order, with its ``documents(role, path)``, in theirs.

    A role whose aliases and documents differ in number pairs nothing: its row has the status ``unequal``.
    """
    nth = lambda df, c: df.withColumn("_n", F.row_number().over(Window.partitionBy("role").orderBy(c)))
    counts = aliases.groupBy("role").agg(F.count("*").alias("a")).join(documents.groupBy("role").agg(F.count("*").alias("d")), "role", "full")
    fit = counts.withColumn("same", F.coalesce(F.col("a") == F.col("d"), F.lit(False)))
    pairs = nth(aliases.select("role", "alias"), "alias").join(nth(documents.select("role", "path"), "path"), ["role", "_n"]).join(fit.where("same").select("role"), "role")
    odd = fit.where("NOT same").select("role", F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("path"), F.lit("unequal").alias("status"))
    return pairs.select("role", "alias", "path", F.lit("paired").alias("status")).unionByName(odd)
