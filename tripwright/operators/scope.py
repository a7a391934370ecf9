"""The candidates of a run: which places a region may recommend, and why others are missed, known before any scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.operators.training import check_none

CANDIDATE, UNRESOLVED, OTHER, DUPLICATE, MISSING, BLANK = "candidate", "unresolved", "other_region", "duplicate_key", "missing", "blank"
#: The states of an administrative location that count as resolved.
RESOLVED = ("resolved", "resolved_with_conflict")


def catalogue(master: DataFrame, policy: DataFrame, resolved: tuple[str, ...] = RESOLVED) -> DataFrame:
    """region, poi, code, reason: one row for each id of ``master(region, poi, status, code)`` that is not blank.

    ``policy(region, code)`` says which province codes a region may recommend.  An id on
    several rows is a ``duplicate_key`` and has no code; of the others only those with a resolved code of
    their region are candidates.
    """
    named = master.where("poi IS NOT NULL AND trim(poi) <> ''")
    ids = named.groupBy("region", "poi").agg(F.count("*").alias("n"), F.first("status").alias("status"), F.first("code").alias("code"))
    code = F.when((F.col("n") == 1) & F.col("status").isin(*resolved), F.nullif(F.trim("code"), F.lit("")))
    allowed = policy.groupBy("region").agg(F.collect_set("code").alias("allowed"))  # a row a region
    reason = F.when(F.col("n") > 1, DUPLICATE).when(F.col("code").isNull(), UNRESOLVED).when(F.array_contains("allowed", F.col("code")), CANDIDATE).otherwise(OTHER)
    found = ids.withColumn("code", code).join(allowed, "region", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    return found.select("region", "poi", "code", reason.alias("reason"))


def misses(positives: DataFrame, places: DataFrame) -> DataFrame:
    """``positives(region, query, poi)``, distinct, with the reason of ``catalogue`` that each place has; ``missing`` where it has none."""
    distinct = positives.select("region", "query", "poi").distinct()
    return distinct.join(places.select("region", "poi", "reason"), ["region", "poi"], "left").withColumn("reason", F.coalesce("reason", F.lit(MISSING)))


def before(master: DataFrame, places: DataFrame, positives: DataFrame) -> DataFrame:
    """region, metric, detail, n: a run's scope before it starts.

    Of the master: source rows, blank ids, ids, and ids by reason and of candidates by
    province code.  Of the positives: queries, pairs, pairs by reason, and the queries that have a candidate.
    """
    long = lambda df, **parts: df.select("region", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(None).cast("string").alias("detail"), v.alias("n")) for k, v in parts.items()])))
    told = lambda df, metric, detail: df.groupBy("region", detail.alias("detail")).agg(F.count("*").alias("n")).select("region", F.lit(metric).alias("metric"), "detail", "n")
    rows = master.groupBy("region").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.trim("poi"), F.lit("")) == "").alias("blank"))
    ids = places.groupBy("region").agg(F.count("*").alias("ids"))
    pairs = misses(positives, places)
    queries = pairs.groupBy("region", "query").agg(F.count("*").alias("n"), F.max(F.when(F.col("reason") == CANDIDATE, 1).otherwise(0)).alias("covered"))
    queries = queries.groupBy("region").agg(F.count("*").alias("queries"), F.sum("n").alias("pairs"), F.sum("covered").cast("long").alias("covered"))
    out = long(rows, source_rows=F.col("rows"), blank_id_rows=F.col("blank")).unionByName(long(ids, ids=F.col("ids")))
    out = out.unionByName(told(places, "ids_by_reason", F.col("reason"))).unionByName(told(places.where(F.col("reason") == CANDIDATE), "candidates_by_code", F.col("code")))
    out = out.unionByName(long(queries, positive_queries=F.col("queries"), positive_pairs=F.col("pairs"), covered_queries=F.col("covered")))
    return out.unionByName(told(pairs, "pairs_by_reason", F.col("reason")))


def candidates(master: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``master`` that are candidates, with their ``product_region`` and ``code``; a region without any is an error."""
    kept = places.where(F.col("reason") == CANDIDATE).select("region", "poi", F.col("code").alias("_code"))
    out = master.join(kept, ["region", "poi"]).withColumn("product_region", F.col("region")).withColumn("code", F.col("_code")).drop("_code")
    check_none(places.select("region").distinct().join(kept.select("region").distinct(), "region", "left_anti"), "a region has no candidate")
    return out


def of_region(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``items``, if every query's region has some and none is of a region without a policy; what ``score_catalogue`` then meets is of a query's own region."""
    check_none(queries.select("region").distinct().join(items.select("region").distinct(), "region", "left_anti"), "a query's region has no candidates")
    check_none(items.where(~F.col("product_region").eqNullSafe(F.col("region"))), "a candidate is of another product region")
    return items.join(queries.select("region").distinct(), "region", "left_semi")


def rates(told: DataFrame) -> DataFrame:
    """region, unresolved_rate, pair_coverage_rate of the counts of ``before``; 0 without a denominator."""
    pick = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    by = lambda metric, *details: (F.col("metric") == metric) & F.col("detail").isin(*details)
    unique = pick(by("ids_by_reason", CANDIDATE, OTHER, UNRESOLVED))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return told.groupBy("region").agg(rate(pick(by("ids_by_reason", UNRESOLVED)), unique).alias("unresolved_rate"), rate(pick(by("pairs_by_reason", CANDIDATE)), pick(F.col("metric") == "positive_pairs")).alias("pair_coverage_rate"))
