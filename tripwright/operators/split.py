"""Deterministic inner splits and the features that only their training side may feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwright.functions.codes import TOURISM_CORE, VISIT_KIND, in_domain
from tripwright.operators.ranks import by_prefix, rank_in_buckets


def hash_split(keys: DataFrame, unit: str, seed: str, fraction: float = 0.2) -> DataFrame:
    """region, unit, part: the first of the digest order in each region are validation, at least one and not all.

    Ranks are over distinct keys, in buckets of the digest.
    """
    distinct = keys.select("region", unit).distinct().withColumn("_h", F.sha2(F.concat_ws("\0", F.lit(seed), unit), 256))
    sizes = distinct.groupBy("region").agg(F.count("*").alias("_n"))
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * fraction, 0).cast("long")))
    ranked = rank_in_buckets(distinct, ["region"], by_prefix("_h"), [F.col("_h"), F.col(unit)], "_r").join(sizes.select("region", cut.alias("_cut")), "region")
    return ranked.select("region", unit, F.when(F.col("_r") <= F.col("_cut"), "inner-validation").otherwise("inner-train").alias("part"))


def disagreement(trips: DataFrame, seed: str) -> DataFrame:
    """By region: trips that a split by trip places elsewhere than a split by traveler, and travelers it cuts."""
    a = hash_split(trips, "traveler", seed).withColumnRenamed("part", "by_traveler")
    b = hash_split(trips, "trip", seed).withColumnRenamed("part", "by_trip")
    both = trips.select("region", "trip", "traveler").join(a, ["region", "traveler"]).join(b, ["region", "trip"])
    cut = both.groupBy("region", "traveler").agg(F.count("*").alias("trips"), F.count_if(F.col("by_traveler") != F.col("by_trip")).alias("moved"), F.count_distinct("by_trip").alias("parts"))
    return cut.groupBy("region").agg(F.sum("trips").alias("trips"), F.sum("moved").alias("moved"), F.count_if(F.col("parts") > 1).alias("cut_travelers"), F.round(F.sum("moved") / F.sum("trips"), 6).alias("moved_share"))


def inner_counts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """region, poi, n: distinct training (trip, poi) pairs of every place of the inventory, 0 where none."""
    train = pairs.join(parts.where("part = 'inner-train'"), ["region", "traveler"], "left_semi")
    counts = train.groupBy("region", "poi").agg(F.count_distinct("trip").alias("n"))
    return pairs.select("region", "poi").distinct().join(counts, ["region", "poi"], "left").select("region", "poi", F.coalesce("n", F.lit(0)).alias("n"))


def inner_kinds(events: DataFrame, parts: DataFrame) -> DataFrame:
    """region, poi, kinds: valid kinds, in numeric order, of training pairs that have a core event."""
    kind = in_domain(F.col("kind"), VISIT_KIND)
    train = events.join(parts.where("part = 'inner-train'"), ["region", "traveler"], "left_semi").withColumn("k", kind)
    core = train.where(F.col("k").isin(*TOURISM_CORE)).select("region", "trip", "poi").distinct()
    kept = train.where("k IS NOT NULL").join(core, ["region", "trip", "poi"], "left_semi")
    order = F.array_sort(F.collect_set(F.col("k").cast("int")))
    return kept.groupBy("region", "poi").agg(F.array_join(F.transform(order, lambda x: x.cast("string")), "|").alias("kinds"))
