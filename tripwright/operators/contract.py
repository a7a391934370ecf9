"""Ownership, eligibility, positives and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwright.functions.codes import TOURISM_CORE, VISIT_KIND, in_domain
from tripwright.functions.text import blank_to_null, clean


def unique_trips(trips: DataFrame) -> DataFrame:
    """Trips with exactly one row."""
    once = trips.groupBy("region", "trip").agg(F.count("*").alias("n")).where("n = 1").select("region", "trip")
    return trips.join(once, ["region", "trip"])


def single_owner(trips: DataFrame) -> DataFrame:
    """region, split, trip, traveler of the trips with one distinct traveler; repeated rows do no harm."""
    own = trips.groupBy("region", "split", "trip").agg(F.count_distinct("traveler").alias("n"), F.min("traveler").alias("traveler"))
    return own.where("n = 1").drop("n")


def visit_outcomes(visits: DataFrame, trips: DataFrame) -> DataFrame:
    """outcome, n: each visit is unmapped, ambiguous, without a place, or an event."""
    owners = trips.groupBy("trip").agg(F.count_distinct("region", "traveler").alias("owners"))
    outcome = F.when(F.col("owners").isNull(), "unmapped").when(F.col("owners") > 1, "ambiguous").when(blank_to_null(F.col("poi")).isNull(), "missing_poi").otherwise("event")
    return visits.join(owners, "trip", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def events(visits: DataFrame, trips: DataFrame) -> DataFrame:
    """Visits with a place and a single owner: region, split, trip, traveler, poi, kind, feedback."""
    return visits.where(blank_to_null(F.col("poi")).isNotNull()).join(single_owner(trips), "trip").select("region", "split", "trip", "traveler", "poi", "kind", "feedback")


def eligibility(visits: DataFrame, trips: DataFrame) -> DataFrame:
    """Each visit's cohort and reasons; what a catalogue says of a place plays no part."""
    owned = visits.join(trips.groupBy("trip").agg(F.count("*").alias("rows")), "trip", "left")
    no_trip = clean(F.col("trip")).isNull() | (F.coalesce("rows", F.lit(0)) != 1)
    no_area, no_poi = clean(F.col("area")).isNull(), clean(F.col("poi")).isNull()
    kind = in_domain(F.col("kind"), VISIT_KIND)
    sound = ~(no_trip | no_area)
    core = F.coalesce(kind.isin(*TOURISM_CORE), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(no_trip, "missing_or_unmapped_trip"), F.when(no_area, "missing_visit_area_id"), F.when(no_poi, "missing_poi_id"),
            F.when(sound & kind.isNull(), "missing_or_invalid_visit_area_type"), F.when(sound & kind.isNotNull() & ~core, "non_tourism_visit_area_type"),
        )
    )
    cohort = F.when(~sound, "excluded_structural").when(core, "tourism_core").otherwise("non_tourism")
    return owned.select("trip", "area", "poi", cohort.alias("cohort"), F.array_join(reasons, "|").alias("reasons"), (sound & ~no_poi).alias("trip_poi"))


def positives(events_: DataFrame) -> DataFrame:
    """Distinct (region, split, trip, traveler, poi) with repeats, kinds in text order and whether one is core."""
    kind = in_domain(F.col("kind"), VISIT_KIND)
    return events_.groupBy("region", "split", "trip", "traveler", "poi").agg(
        F.count("*").alias("repeats"), F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("kinds"), F.coalesce(F.bool_or(kind.isin(*TOURISM_CORE)), F.lit(False)).alias("core")
    )


def diagnostics(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("region", "split").agg(
        F.count("*").alias("positives"), F.count_if("core").alias("core_positives"), F.count_if(F.col("repeats") > 1).alias("repeat_pairs"), F.sum(F.col("repeats") - 1).alias("extra_events"),
        F.count_distinct("trip").alias("trips"), F.count_distinct("poi").alias("items"), F.count_distinct("traveler").alias("travelers"),
    )


def kind_breakdown(visits: DataFrame) -> DataFrame:
    """kind, n, share of each visit kind, and of those outside the domain."""
    counts = visits.groupBy(F.coalesce(in_domain(F.col("kind"), VISIT_KIND), F.lit("invalid")).alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def cold_start(pairs: DataFrame) -> DataFrame:
    """By region: validation places that training has not seen, over all pairs and over core pairs."""
    keys = ["region", "poi"]
    items = pairs.groupBy(*keys).agg(*[F.max(F.when((F.col("split") == s) & c, 1).otherwise(0)).alias(n) for n, s, c in (("tl", "TL", F.lit(True)), ("vl", "VL", F.lit(True)), ("tlc", "TL", F.col("core")), ("vlc", "VL", F.col("core")))])
    return items.groupBy("region").agg(
        F.sum("vl").alias("vl_items"), F.sum(F.col("vl") * (1 - F.col("tl"))).alias("cold_items"), F.sum("vlc").alias("vl_core_items"), F.sum(F.col("vlc") * (1 - F.col("tlc"))).alias("cold_core_items")
    )


def overlap(trips: DataFrame) -> DataFrame:
    """How many trips stand in both splits; anything but 0 stops a run."""
    sides = trips.groupBy("region", "trip").agg(F.count_distinct("split").alias("n"))
    return sides.agg(F.count_if(F.col("n") > 1).alias("overlapping_trips"))


def traveler_distribution(trips: DataFrame) -> DataFrame:
    per = trips.groupBy("region", "traveler").agg(F.count_distinct("trip").alias("n"))
    return per.groupBy("region").agg(
        F.count("*").alias("travelers"), F.round(F.avg("n"), 6).alias("mean_trips"), F.percentile("n", 0.5).alias("median_trips"), F.max("n").alias("max_trips"),
        F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.count_if(F.col("n") >= 3).alias("three_or_more"),
    )


def positive_districts(visits: DataFrame, trips: DataFrame) -> DataFrame:
    """region, split, trip, poi, events, districts, core: the positives of ``visits(trip, poi, kind, sgg)`` with their distinct district codes in order.

    Blank codes are none, and a positive without any has an empty list.
    """
    kind, sgg = in_domain(F.col("kind"), VISIT_KIND), clean(F.col("sgg"))
    rows = visits.where(blank_to_null(F.col("poi")).isNotNull()).join(single_owner(trips), "trip")
    return rows.groupBy("region", "split", "trip", "poi").agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set(sgg)), "|").alias("districts"), F.coalesce(F.bool_or(kind.isin(*TOURISM_CORE)), F.lit(False)).alias("core"))
