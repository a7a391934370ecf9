"""The three tables of a training dataset, and the funnel that leads to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwright.functions import bands
from tripwright.functions.codes import TOURISM_CORE, VISIT_KIND, in_domain
from tripwright.functions.keys import surrogate_key
from tripwright.functions.temporal import trip_time
from tripwright.functions.text import clean
from tripwright.operators.contract import single_owner

#: Names of the two splits in the output.
ROLE = {"TL": "train", "VL": "validation"}


def _role() -> Column:
    return F.when(F.col("split") == "TL", ROLE["TL"]).otherwise(ROLE["VL"])


def trip_context(trips: DataFrame, ends: DataFrame, run: str, fields: list[str]) -> DataFrame:
    """trip_key, traveler_key, region, split, month, elapsed_days, time_reason, ``fields`` and context_complete of owned trips.

    ``ends(trip, end_at)`` has one row a trip.  A context is complete if the month and
    every field are there.
    """
    owned = single_owner(trips).select("region", "split", "trip")
    rows = trips.dropDuplicates(["region", "split", "trip"]).join(owned, ["region", "split", "trip"], "left_semi").join(ends, "trip", "left")
    month, elapsed, reason = trip_time(F.date_format("start_at", "yyyy-MM-dd"), F.date_format("end_at", "yyyy-MM-dd"))
    complete = month.isNotNull()
    for f in fields:
        complete = complete & F.col(f).isNotNull()
    return rows.select(
        surrogate_key(F.lit(run), F.lit("trip"), "region", "trip").alias("trip_key"), surrogate_key(F.lit(run), F.lit("traveler"), "region", "traveler").alias("traveler_key"), "region", _role().alias("split"),
        month.alias("month"), elapsed.alias("elapsed_days"), reason.alias("time_reason"), *fields, complete.alias("context_complete"),
    )


def interactions(pairs: DataFrame, run: str) -> DataFrame:
    """trip_key, item_key, region, split, observed_positive, repeat_visit_count of the core positives."""
    return pairs.where("core").select(
        surrogate_key(F.lit(run), F.lit("trip"), "region", "trip").alias("trip_key"), surrogate_key(F.lit(run), F.lit("item"), "region", "poi").alias("item_key"),
        "region", _role().alias("split"), F.lit(1).alias("observed_positive"), F.col("repeats").alias("repeat_visit_count"),
    )


def item_features(master: DataFrame, pairs: DataFrame, run: str, classes: list[str]) -> DataFrame:
    """One row for each item of the master table or of a core positive.

    Kinds and popularity come from training positives alone; validation only adds its
    name to split_presence.  ``master(region, poi, *classes)`` may repeat a key, which
    then has no classes.
    """
    tl = F.col("split") == "TL"
    seen = pairs.where("core").groupBy("region", "poi").agg(
        F.count_if(tl).alias("tl_popularity"), F.bool_or(tl).alias("_t"), F.bool_or(~tl).alias("_v"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(tl, F.split("kinds", r"\|")))))), "|").alias("kinds"),
    )
    unique = master.groupBy("region", "poi").agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in classes])
    rows = unique.select("region", "poi", *[F.when(F.col("_n") == 1, F.col(c)).alias(c) for c in classes]).join(seen, ["region", "poi"], "full")
    presence = F.concat_ws("|", F.when(F.col("_t"), ROLE["TL"]), F.when(F.col("_v"), ROLE["VL"]))
    return rows.select(
        surrogate_key(F.lit(run), F.lit("item"), "region", "poi").alias("item_key"), "region", *classes, presence.alias("split_presence"),
        F.coalesce("kinds", F.lit("")).alias("kinds"), F.coalesce("tl_popularity", F.lit(0)).alias("tl_popularity"),
    )


def broken(context: DataFrame, items: DataFrame, facts: DataFrame) -> DataFrame:
    """check, n: interactions without a trip or an item or unlike their trip, repeated keys and odd values; all must be 0 before the tables are written."""
    lost = lambda dim, key: facts.join(dim.select(key), key, "left_anti").agg(F.count("*").alias("n"))
    twice = lambda dim, *keys: dim.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    checks = {"trip_missing": lost(context, "trip_key"), "item_missing": lost(items, "item_key"), "trip_repeated": twice(context, "trip_key"), "item_repeated": twice(items, "item_key"), "interaction_repeated": twice(facts, "trip_key", "item_key")}
    unlike = facts.join(context.select("trip_key", F.col("region").alias("_r"), F.col("split").alias("_s")), "trip_key").where("region <> _r OR split <> _s")
    count = lambda rows: rows.agg(F.count("*").alias("n"))
    checks |= {"trip_disagrees": count(unlike), "not_positive": count(facts.where("NOT observed_positive <=> 1")), "no_visit": count(facts.where("NOT coalesce(repeat_visit_count >= 1, false)"))}
    out = None
    for name, frame in checks.items():
        row = frame.select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def funnel(trips: DataFrame, visits: DataFrame, pairs: DataFrame) -> DataFrame:
    """region, split, metric, n along the way from trips to core positives; a metric that does not occur is 0."""
    owner = single_owner(trips)
    seen = visits.join(owner, "trip").groupBy("region", "split").agg(
        F.count("*").alias("visits"), F.count_if(F.trim("poi") != "").alias("visits_with_place"), F.count_distinct("trip").alias("trips_with_visits")
    )
    good = pairs.groupBy("region", "split").agg(
        F.count("*").alias("positives"), F.count_if("core").alias("core_positives"), F.count_distinct("trip").alias("trips_with_positive"),
        F.count_distinct(F.when(F.col("core"), F.col("trip"))).alias("trips_with_core"), F.count_distinct("poi").alias("items"),
    )
    base = owner.groupBy("region", "split").agg(F.count("*").alias("trips"), F.count_distinct("traveler").alias("travelers"))
    wide = base.join(seen, ["region", "split"], "left").join(good, ["region", "split"], "left").fillna(0)
    names = [c for c in wide.columns if c not in ("region", "split")]
    return wide.select("region", "split", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in names])))


def choice_rows(trips: DataFrame, events: DataFrame) -> DataFrame:
    """region, trip, size, inside, outside of each validation trip: its region's training places, and its positives among and beside them."""
    known = events.where("split = 'TL'").select("region", "poi").distinct()
    sizes = known.groupBy("region").agg(F.count("*").alias("size"))
    pairs = events.where("split = 'VL'").select("region", "trip", "poi").distinct().join(known.withColumn("k", F.lit(1)), ["region", "poi"], "left")
    per = pairs.groupBy("region", "trip").agg(F.count("k").alias("inside"), F.count_if(F.col("k").isNull()).alias("outside"))
    return single_owner(trips).where("split = 'VL'").select("region", "trip").join(sizes, "region", "left").join(per, ["region", "trip"], "left").fillna(0)


def _choice_status() -> Column:
    return (
        F.when(F.col("size") == 0, "empty_candidate").when(F.col("size") < 2, "insufficient_candidate_support").when((F.col("inside") > 0) & (F.col("outside") > 0), "positive_outside_candidate_universe")
        .when(F.col("outside") > 0, "cold_start_only").when(F.col("inside") > 0, "evaluable").otherwise("no_observed_positive")
    )


def choice_sets(trips: DataFrame, events: DataFrame) -> DataFrame:
    """region, status, trips: whether each validation trip's positives can be ranked among its region's training places."""
    return choice_rows(trips, events).groupBy("region", _choice_status().alias("status")).agg(F.count("*").alias("trips"))


def choice_histograms(trips: DataFrame, events: DataFrame) -> DataFrame:
    """region, metric, bucket, trips: sizes and densities of choice sets, their support, and how their positives are covered, all in one pass.

    Trips without candidates have no size and no density.
    """
    size, inside, outside = F.col("size"), F.col("inside"), F.col("outside")
    support = F.when(size == 0, "empty_candidate").when(size < 2, "insufficient_candidate_support").otherwise("rankable_candidate_support")
    covered = (
        F.when((inside == 0) & (outside == 0), "no_usable_positive").when((inside > 0) & (outside > 0), "positive_outside_candidate_universe").when(outside > 0, "cold_start_only").otherwise("all_positives_in_candidate_universe")
    )
    metrics = {
        "choice_set_status": _choice_status(), "candidate_support_status": support, "positive_coverage_status": covered, "candidate_size": F.when(size > 0, bands.choice_size_band(size)),
        "candidate_positive_density": F.when(size > 0, bands.density_band(inside, size)), "positives_a_trip": bands.positive_band(inside + outside),
    }
    cells = F.filter(F.array(*[F.struct(F.lit(m).alias("metric"), b.alias("bucket")) for m, b in metrics.items()]), lambda c: c["bucket"].isNotNull())
    return choice_rows(trips, events).select("region", F.inline(cells)).groupBy("region", "metric", "bucket").agg(F.count("*").alias("trips"))


def structure(trips: DataFrame, events: DataFrame) -> DataFrame:
    """region, split, trips, with_repeats, repeat_share, mean and largest number of distinct places a trip."""
    per = events.groupBy("region", "split", "trip").agg(F.count("*").alias("e"), F.count_distinct("poi").alias("p"))
    rows = single_owner(trips).join(per, ["region", "split", "trip"], "left").fillna(0)
    return rows.groupBy("region", "split").agg(
        F.count("*").alias("trips"), F.count_if(F.col("e") > F.col("p")).alias("with_repeats"), F.round(F.try_divide(F.sum(F.col("e") - F.col("p")), F.sum("e")), 6).alias("repeat_share"),
        F.round(F.avg("p"), 6).alias("mean_places"), F.max("p").alias("most_places"),
    )


#: The parts of a trip's context, in the order in which they are reported.
CONTEXT = ("style", "motive", "destination", "companion", "temporal")


def _long(wide: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("n")) for c in names])))


def whole_funnel(trips: DataFrame, visits: DataFrame, masters: DataFrame, feedback: tuple[str, ...]) -> DataFrame:
    """region, split, metric, n of the whole way from trips to positives; ``all`` stands for all regions and for both splits together.

    ``trips(region, split, trip, traveler, style, motive, destination, companion, temporal, inverted, relations)``
    say which parts of a trip's context are complete; ``visits(region, split, trip,
    area, poi, kind, sgg, sgg_known, *feedback)`` whether a district code is in the crosswalk and each answer valid;
    ``masters(region, poi, sgg_known, rich)`` have a row for each row of a region's master.
    A metric that does not occur is 0.
    """
    keys = ["region", "split"]
    once = F.col("rows") == 1
    per = trips.groupBy(*keys, "trip").agg(F.count("*").alias("rows"), F.count_distinct("traveler").alias("owners"), *[F.coalesce(F.bool_and(c), F.lit(False)).alias(c) for c in (*CONTEXT, "inverted", "relations")])
    whole = F.lit(True)
    for c in CONTEXT:
        whole = whole & F.col(c)
    per = per.withColumn("owned", once & (F.col("owners") == 1)).withColumn("whole", F.col("owned") & whole)
    owned = lambda c: F.count_if(F.col("owned") & F.col(c))
    trip_side = per.groupBy(*keys).agg(
        F.count_if(once).alias("trips_total"), F.count_if("owned").alias("trips_valid_owner"), F.count_if("whole").alias("trips_primary_context_complete"), *[owned(c).alias(f"trips_{c}_complete") for c in CONTEXT],
        owned("inverted").alias("trips_inverted_dates"), owned("relations").alias("trips_companion_relation_recorded"),
    )

    state = per.select(*keys, "trip", "rows", "owned", "whole")
    kind = in_domain(F.col("kind"), VISIT_KIND)
    rows = visits.join(state, [*keys, "trip"], "left").withColumn("core", F.coalesce(kind.isin(*TOURISM_CORE), F.lit(False))).withColumn("poi", clean(F.col("poi")))
    unmapped = F.coalesce(F.col("rows"), F.lit(0)) != 1
    rows = rows.withColumn("event", ~unmapped & F.coalesce(F.col("owned"), F.lit(False)) & clean(F.col("area")).isNotNull())
    event, core, place = F.col("event"), F.col("core"), F.col("poi").isNotNull()
    valid = {f: F.coalesce(F.col(f), F.lit(False)) for f in feedback}
    every = F.lit(True)
    for v in valid.values():
        every = every & v
    sgg = clean(F.col("sgg")).isNotNull()
    visit_side = rows.groupBy(*keys).agg(
        F.count("*").alias("visit_rows_total"), F.count_if(event).alias("visit_events_valid"), F.count_if(event & ~place).alias("visit_rows_missing_poi_id"), F.count_if(unmapped).alias("visit_rows_unmapped_trip"), F.count_if(~unmapped & ~F.coalesce(F.col("owned"), F.lit(False))).alias("visit_rows_ambiguous_traveler"),
        F.count_if(event & core).alias("visit_events_tourism_core"), F.count_if(event & ~core).alias("visit_events_non_tourism"), F.count_if(event & core & place).alias("visit_events_with_poi_tourism_core"), F.count_if(event & ~core & place).alias("visit_events_with_poi_non_tourism"),
        F.count_if(event & sgg).alias("visit_events_sgg_nonblank"), F.count_if(event & sgg & F.coalesce(F.col("sgg_known"), F.lit(False))).alias("visit_events_sgg_crosswalk_valid"),
        *[F.count_if(event & v).alias(f"visit_events_{f}_valid") for f, v in valid.items()], F.count_if(event & every).alias("visit_events_all_feedback_valid"),
    )

    master = masters.groupBy("region", "poi").agg(F.count("*").alias("m"), F.bool_or("sgg_known").alias("m_known"), F.bool_and("rich").alias("m_rich"))
    pairs = rows.where(event & place).groupBy(*keys, "trip", "poi").agg(F.count("*").alias("k"), F.bool_or("core").alias("core"), F.first("whole").alias("whole"), F.bool_or(F.coalesce(F.col("sgg_known"), F.lit(False)) & sgg).alias("known"))
    pairs = pairs.join(master, ["region", "poi"], "left")
    joined = F.coalesce(F.col("m"), F.lit(0)) == 1
    kinds = {"primary_context_complete": F.col("whole"), "sgg_crosswalk_valid": F.col("known") | (joined & F.coalesce(F.col("m_known"), F.lit(False))), "master_unique_join": joined, "master_rich_complete": joined & F.coalesce(F.col("m_rich"), F.lit(False))}
    pair_side = pairs.groupBy(*keys).agg(
        F.count("*").alias("trip_poi_positives_all"), F.count_if("core").alias("trip_poi_positives_tourism_core"), F.count_if(~F.col("core")).alias("trip_poi_positives_non_tourism_only"), F.count_if(F.col("k") > 1).alias("trip_poi_within_trip_repeat_pairs"), F.sum(F.col("k") - 1).alias("trip_poi_within_trip_repeat_extra_events"),
        *[F.count_if(t & c).alias(f"trip_poi_{n}_{name}") for n, t in kinds.items() for name, c in (("all", F.lit(True)), ("tourism_core", F.col("core")))],
        F.count_distinct("trip").alias("trips_with_any_poi_visit"), F.count_distinct(F.when(F.col("core"), F.col("trip"))).alias("trips_with_tourism_core_visit"), F.count_distinct("poi").alias("distinct_pois_all"), F.count_distinct(F.when(F.col("core"), F.col("poi"))).alias("distinct_pois_tourism_core"),
    )
    out = None
    cells = trip_side.select(*keys).union(visit_side.select(*keys)).distinct()
    for side in (trip_side, visit_side, pair_side):
        filled = _long(cells.join(side, keys, "left").fillna(0), keys)
        out = filled if out is None else out.unionByName(filled)
    sums = F.explode(F.array(F.struct("region", "split"), F.struct(F.lit("all").alias("region"), "split"), F.struct(F.lit("all").alias("region"), F.lit("all").alias("split")))).alias("c")
    return out.select(sums, "metric", "n").groupBy("c.region", "c.split", "metric").agg(F.sum("n").alias("n"))
