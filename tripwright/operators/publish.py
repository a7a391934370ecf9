"""What of a profile may be shown: policies by name and statistics, relations, relabelling and bands."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwright.functions.bands import K, count_bucket, length_band
from tripwright.operators.profile import TEXT_DATE, columns

# The words of column names that stand for coordinates, identifiers and texts, and parts of names that do.
COORDINATE = ["lat", "latitude", "lon", "lng", "long", "longitude", "x", "y", "mapx", "mapy", "coord", "coords", "coordinate", "coordinates", "gps", "geom", "geometry", "wkt"]
COORDINATE_PARTS = ["위도", "경도", "좌표"]
IDENTIFIER = ["id", "ids", "uid", "uuid", "key", "sn", "no", "num", "seq", "idx", "index", "pk", "fk"]
IDENTIFIER_PARTS = ["번호", "식별", "아이디"]
TEXT = ["name", "nm", "title", "caption", "text", "memo", "desc", "description", "addr", "address", "poi", "place", "comment", "remark"]
TEXT_PARTS = ["명칭", "장소", "주소", "내용", "캡션", "제목", "메모", "설명"]


def name_words(name: str) -> list[str]:
    """The words of a column name, cut at capitals and marks."""
    return [w for w in re.split(r"[^0-9a-z가-힣]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if w]


def name_kind(name: str) -> str | None:
    """coordinate, identifier or text, or nothing."""
    words = set(name_words(name))
    for kind, whole, parts in (("coordinate", COORDINATE, COORDINATE_PARTS), ("identifier", IDENTIFIER, IDENTIFIER_PARTS), ("text", TEXT, TEXT_PARTS)):
        if words & set(whole) or any(p in name for p in parts):
            return kind
    return None


def type_class(dtype: str) -> str:
    """integer, float, boolean, datetime, varchar, blob, nested or other of a Spark type's short name."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "float"
    if dtype == "date" or dtype.startswith("timestamp"):
        return "datetime"
    if dtype.startswith(("struct", "map", "array", "variant")):
        return "nested"
    return {"boolean": "boolean", "string": "varchar", "binary": "blob"}.get(dtype, "other")


#: Most values of which the counts are shown, and the share of a column's values that must be dates.
MOST_VALUES, DATES = 50, 0.95


def _date_counts(frame: DataFrame) -> DataFrame:
    """column, dates: how many values of each date, text and whole-number column are dates; eight-digit numbers from 1900 to 2100."""
    counted = {}
    for c, t in frame.dtypes:
        v = F.col(f"`{c}`")
        if type_class(t) == "datetime":
            counted[c] = v.isNotNull()
        elif type_class(t) == "varchar":
            counted[c] = F.btrim(v).rlike(TEXT_DATE)
        elif type_class(t) == "integer":
            n = v.cast("long")
            counted[c] = n.between(19000101, 21001231) & F.pmod(F.expr(f"`{c}` div 100"), F.lit(100)).between(1, 12) & F.pmod(n, F.lit(100)).between(1, 31)
    if not counted:
        return frame.sparkSession.createDataFrame([], "column string, dates long")
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(x, F.lit(False)).alias("d")) for c, x in counted.items()]))
    return frame.select(cells).groupBy("column").agg(F.count_if("d").alias("dates"))


def policies(frame: DataFrame, shown: list[str] = [], least: int = K) -> DataFrame:  # noqa: B006
    """column, class, policy of every column: whether its values may be shown, from its name and one row of statistics.

    Texts named in ``shown`` may be.  Of dates only months are shown, whatever their number of
    values; of what has few values their counts, if there are ``least`` values or more.
    """
    known = frame.sparkSession.createDataFrame([(c, type_class(t), name_kind(c), c.lower() in [x.lower() for x in shown]) for c, t in frame.dtypes], "column string, class string, name string, shown boolean")
    ratio = F.try_divide("distinct_values", "present")
    low, high = F.col("least"), F.col("greatest")
    epoch = ((low >= 946684800) & (high <= 4102444800)) | ((low >= 946684800000) & (high <= 4102444800000))
    policy = (
        F.when(F.col("class").isin("nested", "blob", "other"), "structure_only").when(F.col("present") == 0, "all_null").when(F.col("name") == "coordinate", "suppressed:coordinate_name")
        .when(F.col("name") == "identifier", "suppressed:identifier_name").when((F.col("name") == "text") & ~F.col("shown"), "suppressed:name_or_text_like")
        .when((F.col("class") == "float") & (low >= -180) & (high <= 180) & (ratio >= 0.5), "suppressed:coordinate_like_range")
        .when((F.col("class") == "integer") & epoch, "suppressed:epoch_like").when((F.col("class") == "integer") & (ratio >= 0.9), "suppressed:row_unique_integer")
        .when(((F.col("class") != "integer") | ((low >= 19000101) & (high <= 21001231))) & (F.col("dates") >= DATES * F.col("present")), "date_month_only")
        .when((F.col("class") == "varchar") & ((F.col("mean_length") > 40) | (ratio > 0.2)), "suppressed:high_cardinality_or_text_like")
        .when((F.col("distinct_values") <= MOST_VALUES) & (ratio <= 0.2), F.when(F.col("present") < least, "suppressed:cohort_below_k").otherwise("profile+value_counts")).otherwise("profile")
    )
    stats = columns(frame).join(_date_counts(frame), "column", "left")
    return stats.join(F.broadcast(known), "column").select("column", "class", policy.alias("policy"))


def public_columns(profile: DataFrame) -> DataFrame:
    """A column profile with every count as its bucket and every length as its band."""
    counts = [c for c in ("rows", "present", "blank", "distinct_values", "non_finite") if c in profile.columns]
    lengths = [c for c in ("min_length", "mean_length", "max_length") if c in profile.columns]
    return profile.select("column", *[count_bucket(F.col(c)).alias(c) for c in counts], *[length_band(F.col(c)).alias(c) for c in lengths])


def relabelled(counts: DataFrame, group: list[str], label: str, prefix: str) -> DataFrame:
    """``counts`` with labels of each group replaced by prefix_001 and so on, the commonest first; suppressed ones stay.

    A published distribution is short, and so is each group here.
    """
    hidden = F.col(label) == "<suppressed>"
    order = Window.partitionBy(*group, hidden).orderBy(F.desc("n"), label)
    return counts.withColumn("_r", F.row_number().over(order)).withColumn(label, F.when(hidden, F.col(label)).otherwise(F.format_string(f"{prefix}_%03d", "_r"))).drop("_r")


def relations(tables: dict[str, DataFrame], limit: int = 50, least: int = K) -> DataFrame:
    """left_table, right_table, column, left_distinct, right_distinct, shared_distinct, containments and rows without match.

    Columns of the same name, whole numbers or texts that are neither long nor
    coordinates, are compared pair by pair, those with the most distinct values first, up to
    ``limit``.  A pair of which any count is under ``least`` is left out whole.
    """
    cells = []
    for table, frame in tables.items():
        fit = [c for c, t in frame.dtypes if type_class(t) in ("integer", "varchar") and name_kind(c) != "coordinate"]
        if fit:
            cells.append(frame.select(F.inline(F.array(*[F.struct(F.lit(table).alias("table"), F.lit(c.lower()).alias("column"), F.col(c).cast("string").alias("v"), F.lit(type_class(dict(frame.dtypes)[c]) == "varchar").alias("text")) for c in fit]))))
    values = reduce(DataFrame.unionByName, cells).where("v IS NOT NULL").groupBy("table", "column", "v", "text").agg(F.count("*").alias("n"))
    long = F.col("text") & (F.col("letters") / F.col("rows") > 64)
    sizes = values.groupBy("table", "column", "text").agg(F.count("*").alias("d"), F.sum("n").alias("rows"), F.sum(F.length("v") * F.col("n")).alias("letters")).where(~long).select("table", "column", "d", "rows")
    a, b = (sizes.select("column", *[F.col(c).alias(f"{s}_{c}") for c in ("table", "d", "rows")]) for s in ("l", "r"))
    first = (F.col("l_d") > F.col("r_d")) | ((F.col("l_d") == F.col("r_d")) & (F.col("l_table") < F.col("r_table")))
    pairs = a.join(b, "column").where("l_table <> r_table").where(first).orderBy(F.desc(F.col("l_d") + F.col("r_d")), "column", "l_table", "r_table").limit(limit)
    left = values.select("column", "v", F.col("table").alias("l_table"), F.col("n").alias("ln"))
    right = values.select("column", "v", F.col("table").alias("r_table"), F.col("n").alias("rn"))
    shared = left.join(right, ["column", "v"]).where("l_table <> r_table").groupBy("column", "l_table", "r_table").agg(F.count("*").alias("s"), F.sum("ln").alias("ln"), F.sum("rn").alias("rn"))
    out = pairs.join(shared, ["column", "l_table", "r_table"], "left").fillna(0, ["s", "ln", "rn"])
    out = out.withColumn("lm", F.col("l_rows") - F.col("ln")).withColumn("rm", F.col("r_rows") - F.col("rn")).where(F.least("l_d", "r_d", "s", "lm", "rm") >= least)
    return out.select(
        F.col("l_table").alias("left_table"), F.col("r_table").alias("right_table"), "column", F.col("l_d").alias("left_distinct"), F.col("r_d").alias("right_distinct"), F.col("s").alias("shared_distinct"),
        F.round(F.col("s") / F.col("l_d"), 6).alias("left_containment"), F.round(F.col("s") / F.col("r_d"), 6).alias("right_containment"), F.col("lm").alias("left_rows_without_match"), F.col("rm").alias("right_rows_without_match"),
    )


def match_tiers(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """tier, n: distinct keys of the left that the right has exactly, when trimmed, when trimmed and folded, or not; and how often trimmed keys collide."""
    own, known = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct()
    forms = {"exact": lambda c: c, "trimmed": F.btrim, "folded": lambda c: F.lower(F.btrim(c))}
    tier = own
    for name, form in forms.items():
        tier = tier.join(known.select(form(F.col("_k")).alias(f"_{name}")).distinct(), form(F.col(key)) == F.col(f"_{name}"), "left")
    kind = F.coalesce(*[F.when(F.col(f"_{name}").isNotNull(), name) for name in forms], F.lit("unmatched"))
    folded = own.groupBy(F.lower(F.btrim(key)).alias("f")).agg(F.count("*").alias("n"))
    collisions = folded.agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("folded_collisions").alias("tier"), "n")
    return tier.groupBy(kind.alias("tier")).agg(F.count("*").alias("n")).unionByName(collisions)


def emitted(frame: DataFrame, metrics: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """metric, value, status of each ``name: (columns it needs, aggregate)``: the bucket of the count, or why there is none."""
    there = {n: a for n, (need, a) in metrics.items() if set(need) <= set(frame.columns)}
    missing = frame.sparkSession.createDataFrame([(n, "unavailable", "missing_column") for n in metrics if n not in there], "metric string, value string, status string")
    one = frame.agg(*[a.alias(n) for n, a in there.items()])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("n")) for n in there])))
    status = F.when(F.col("n") == 0, "empty").when(F.col("n") < K, "suppressed_k10").otherwise("observed")
    return rows.select("metric", count_bucket(F.col("n")).alias("value"), status.alias("status")).unionByName(missing)


def allow_lists(fields: DataFrame, domains: DataFrame, book: DataFrame) -> DataFrame:
    """field, allowed, resolved: the codes of each field's domain that the book has for the field's group.

    ``fields(field, group)``, ``domains(field, code)``, ``book(group, code)``.  A field
    without a group or without a code in common is unresolved and allows nothing.
    """
    both = domains.join(fields, "field").join(book.distinct(), ["group", "code"]).groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("code")), "|").alias("allowed"))
    return fields.select("field").distinct().join(both, "field", "left").select("field", F.coalesce("allowed", F.lit("")).alias("allowed"), F.col("allowed").isNotNull().alias("resolved"))


def group_scan(frame: DataFrame, unit: str, fields: dict[str, str], book: DataFrame) -> DataFrame:
    """unit, field, observed, blank, outside, group_missing of coded ``fields`` (field to group of the book) for each unit."""
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(g).alias("group"), F.btrim(F.col(f)).alias("code")) for f, g in fields.items()]))
    known = book.select("group", "code").distinct().withColumn("_in", F.lit(True))
    groups = book.select("group").distinct().withColumn("_g", F.lit(True))
    rows = frame.select(F.col(unit).alias("unit"), cells).join(F.broadcast(known), ["group", "code"], "left").join(F.broadcast(groups), "group", "left")  # a code book is short
    blank = F.col("code").isNull() | (F.col("code") == "")
    return rows.groupBy("unit", "field").agg(
        F.count_if(~blank).alias("observed"), F.count_if(blank).alias("blank"), F.count_if(~blank & F.col("_g").isNotNull() & F.col("_in").isNull()).alias("outside"), F.count_if(~blank & F.col("_g").isNull()).alias("group_missing")
    )


def type_conflicts(schemas: DataFrame) -> DataFrame:
    """column, types, units of ``schemas(unit, column, type)`` where units disagree on a column's type."""
    per = schemas.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"), F.count_distinct("type").alias("k"), F.count_distinct("unit").alias("units"))
    return per.where("k > 1").select("column", "types", "units")
