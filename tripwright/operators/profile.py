"""Profiles of unknown tables, and suppression of their small cells."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwright.functions.text import label as clean_label

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def columns(frame: DataFrame) -> DataFrame:
    """column, rows, present, blank, distinct_values, non_finite, min_length, mean_length, max_length, least and greatest of every column, in one pass over long form.

    ``least`` and ``greatest`` are of the finite numbers of numeric columns.
    """
    kinds = dict(frame.dtypes)
    number = lambda c: F.col(c).cast("double") if kinds[c] in NUMBERS or kinds[c].startswith("decimal") else F.lit(None).cast("double")
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), number(c).alias("x")) for c in frame.columns]))
    odd = F.col("x").isNotNull() & (F.isnan("x") | (F.abs("x") == float("inf")))
    return frame.select(cells).groupBy("column").agg(
        F.count("*").alias("rows"), F.count("v").alias("present"), F.count_if(F.btrim("v") == "").alias("blank"), F.count_distinct("v").alias("distinct_values"), F.count_if(odd).alias("non_finite"),
        F.min(F.length("v")).cast("long").alias("min_length"), F.round(F.avg(F.length("v")), 6).alias("mean_length"), F.max(F.length("v")).cast("long").alias("max_length"),
        F.min(F.when(~odd, F.col("x"))).alias("least"), F.max(F.when(~odd, F.col("x"))).alias("greatest"),
    )


def most_varied(frame: DataFrame, n: int = 8) -> list[str]:
    """The ``n`` columns with the most distinct values, equal ones by name."""
    one = frame.agg(*[F.count_distinct(c).alias(c) for c in frame.columns]).first().asDict()
    return sorted(one, key=lambda c: (-one[c], c))[:n]


def duplicates(frame: DataFrame) -> DataFrame:
    """How many rows repeat another: grouped by all columns, so that no task sees all rows."""
    return frame.groupBy(*frame.columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("surplus"))


def composite_keys(frame: DataFrame, names: list[str]) -> DataFrame:
    """a, b, is_key for each pair of columns: whether the pairs of values are as many as the rows."""
    one = frame.agg(F.count("*").alias("_n"), *[F.count_distinct(F.struct(a, b)).alias(f"{a}/{b}") for a, b in combinations(names, 2)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"`{a}/{b}`") == F.col("_n")).alias("is_key")) for a, b in combinations(names, 2)])))


def containment(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows and distinct values of ``left[name]`` that ``right[name]`` lacks."""
    counts = left.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    known = right.select(name).where(F.col(name).isNotNull()).distinct().withColumn("known", F.lit(True))
    out = counts.join(known, name, "left")
    missing = F.col("known").isNull()
    return out.agg(F.count("*").alias("distinct_values"), F.count_if(missing).alias("unmatched_values"), F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("unmatched_rows"))


# The forms of dates in texts, and in numbers of eight digits.
TEXT_DATE = r"^(\d{4})[-./]?(\d{2})[-./]?\d{2}([ T]\d{1,2}:?\d{2}(:?\d{2}(\.\d+)?)?)?$"
NUMBER_DATE = r"^(\d{4})(\d{2})\d{2}$"


def month_of(column: Column, kind: str) -> Column:
    """yyyy-MM of a ``date``, of a ``text`` that starts with a date in digits, or of an ``int`` of eight digits; null where it is none."""
    if kind == "date":
        return F.date_format(column, "yyyy-MM")
    text = F.btrim(column) if kind == "text" else column.cast("string")
    form = TEXT_DATE if kind == "text" else NUMBER_DATE
    found = F.concat_ws("-", F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2))
    return F.when(found.rlike("^(19|20)[0-9]{2}-(0[1-9]|1[0-2])$"), found)


def months(frame: DataFrame, name: str, kind: str = "date") -> DataFrame:
    return frame.groupBy(month_of(F.col(name), kind).alias("month")).agg(F.count("*").alias("n"))


def numeric(frame: DataFrame, names: list[str]) -> DataFrame:
    """column, finite, negative, zero."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names]))
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return frame.select(cells).groupBy("column").agg(F.count_if(finite).alias("finite"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"))


def value_counts(frame: DataFrame, name: str) -> DataFrame:
    """label, n of a column's values as they may be shown: control characters as spaces, 60 characters at most, those that then agree counted together."""
    return frame.where(F.col(name).isNotNull()).groupBy(clean_label(F.col(name).cast("string")).alias("label")).agg(F.count("*").alias("n"))


def safe_counts(counts: DataFrame, least: int = 10, keep_small_total: bool = True) -> DataFrame:
    """label, n with cells under ``least`` merged, and shown ones with them until the merged sum is ``least``.

    Shown cells are added from the smallest; of equal ones, the last label first.
    ``keep_small_total`` says whether a merged sum still under ``least`` is shown.
    Labels are few: a distribution is published whole.
    """
    small = counts.where(F.col("n") < least).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hidden"))
    up = Window.orderBy("n", F.desc("label")).rowsBetween(Window.unboundedPreceding, -1)
    shown = counts.where(F.col("n") >= least).withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).join(F.broadcast(small), how="full")  # one row
    marked = shown.withColumn("merged", (F.col("hidden") > 0) & (F.col("hidden") + F.col("before") < least))
    total = marked.agg((F.first("hidden") + F.coalesce(F.sum(F.when(F.col("merged"), F.col("n"))), F.lit(0))).alias("n"))
    rest = total.where((F.col("n") >= least) | ((F.col("n") > 0) & F.lit(keep_small_total))).select(F.lit("<suppressed>").alias("label"), "n")
    return marked.where("NOT merged AND label IS NOT NULL").select("label", "n").unionByName(rest)


def domain_scan(frame: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """field, observed, blank, outside, distinct_outside for each coded field, in one pass."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.btrim(F.col(c)).alias("v"), (~F.btrim(F.col(c)).isin(*d)).alias("bad")) for c, d in domains.items()]))
    blank = F.col("v").isNull() | (F.col("v") == "")
    return frame.select(cells).groupBy("field").agg(
        F.count_if(~blank).alias("observed"), F.count_if(blank).alias("blank"), F.count_if(~blank & F.col("bad")).alias("outside"), F.count_distinct(F.when(~blank & F.col("bad"), F.col("v"))).alias("distinct_outside")
    )


def json_keys(frame: DataFrame, name: str) -> DataFrame:
    """key, present, null_or_empty over JSON objects in a text column."""
    rows = frame.select(F.explode(F.from_json(name, "map<string,string>")).alias("key", "v"))
    return rows.groupBy("key").agg(F.count("*").alias("present"), F.count_if(F.col("v").isNull() | (F.col("v") == "")).alias("null_or_empty"))


def json_types(frame: DataFrame, name: str) -> DataFrame:
    """key, type, n, empty over JSON objects in a text column: object, array, string, number, boolean or null; an empty text, object or array is empty."""
    values = frame.select(F.try_parse_json(name).alias("j")).lateralJoin(frame.sparkSession.tvf.variant_explode(F.col("j").outer())).select("key", "value")
    schema, text = F.schema_of_variant("value"), F.to_json("value")
    kind = (
        F.when(schema == "VOID", "null").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")
    )
    return values.where("key IS NOT NULL").groupBy("key", kind.alias("type")).agg(F.count("*").alias("n"), F.count_if(text.isin('""', "{}", "[]")).alias("empty"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def signatures(frame: DataFrame, unit: str, value: str) -> DataFrame:
    """unit, signature, members, group: units with the same set of values are one group, the commonest numbered first.

    Units are few (regions, tables); ``frame`` is aggregated to its distinct pairs before they meet.
    """
    per = frame.select(unit, F.col(value).cast("string").alias("v")).where("v IS NOT NULL").distinct().groupBy(unit).agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("signature"))
    groups = per.groupBy("signature").agg(F.count("*").alias("members"))
    groups = groups.withColumn("group", F.row_number().over(Window.orderBy(F.desc("members"), "signature")))
    return per.join(groups, "signature").select(unit, "signature", "members", "group")


def presence(frame: DataFrame, unit: str, value: str) -> DataFrame:
    """value, n_units, everywhere: in how many units each value occurs."""
    pairs = frame.select(unit, F.col(value).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    total = pairs.agg(F.count_distinct(unit).alias("t"))
    counts = pairs.groupBy("value").agg(F.count("*").alias("n_units"))
    return counts.join(F.broadcast(total)).select("value", "n_units", (F.col("n_units") == F.col("t")).alias("everywhere"))  # one row


def codebook_check(frame: DataFrame, field: str, book: DataFrame) -> DataFrame:
    """code, in_book, rows: every code of the data or of ``book(code)``, and whether it is in which."""
    seen = frame.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("code")).agg(F.count("*").alias("rows"))
    return seen.join(book.select("code").distinct().withColumn("in_book", F.lit(True)), "code", "full").select("code", F.coalesce("in_book", F.lit(False)).alias("in_book"), F.coalesce("rows", F.lit(0)).alias("rows"))
