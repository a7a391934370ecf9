"""Queries that assemble the training dataset and say what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwright.operators import contract, dataset
from tripwright.plans.queries import CORE, PAIRS, M, _events, _pairs
from tripwright.plans.registry import query
from tripwright.sources import mapping

RUN = "run-v1"
FIELDS = ["segment", "priority", "status"]
CLASSES = ["p_type", "p_brand", "p_size"]


def _key(*parts: str) -> str:
    return "substr(sha256(" + " || unhex('00') || ".join(f"encode({p})" for p in (f"'{RUN}'", *parts)) + "), 1, 32)"


TRIP_KEY, ITEM_KEY = _key("'trip'", "region", "trip"), _key("'item'", "region", "poi")
ROLE = "CASE WHEN split = 'TL' THEN 'train' ELSE 'validation' END"


def _context(spark: SparkSession, d: str) -> DataFrame:
    ends = mapping.visits(spark, d).groupBy("trip").agg(F.max("end_at").alias("end_at"))
    return dataset.trip_context(mapping.trips(spark, d), ends, RUN, FIELDS)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Each part belongs to one region's master table; places visited elsewhere have no master."""
    regions = mapping.table(spark, d, "region")
    master = mapping.table(spark, d, "part").withColumn("r_regionkey", F.col("p_partkey") % 5).join(regions, "r_regionkey").select(F.col("r_name").alias("region"), F.col("p_partkey").cast("string").alias("poi"), *CLASSES)
    return dataset.item_features(master, _pairs(spark, d), RUN, CLASSES)


@query(f"""{M}, e AS (SELECT trip, max(end_at)::DATE AS b FROM visits GROUP BY ALL), c AS (SELECT t.*, start_at::DATE AS a, b FROM trips t LEFT JOIN e USING (trip))
  SELECT {TRIP_KEY} AS trip_key, {_key("'traveler'", 'region', 'traveler')} AS traveler_key, region, {ROLE} AS split, CASE WHEN b IS NOT NULL THEN strftime(a, '%m') END AS month, CASE WHEN b >= a THEN CAST(date_diff('day', a, b) AS INT) END AS elapsed_days,
  CASE WHEN b IS NULL THEN 'missing_start_or_end_date' WHEN b < a THEN 'inverted_date_range' END AS time_reason, segment, priority, status, b IS NOT NULL AS context_complete FROM c""")
def dataset_trip_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d)


@query(f"""{PAIRS}, master AS (SELECT r_name AS region, CAST(p_partkey AS VARCHAR) AS poi, p_type, p_brand, p_size FROM part JOIN region ON p_partkey % 5 = r_regionkey),
  k AS (SELECT region, poi, string_agg(DISTINCT k, '|' ORDER BY k) AS kinds FROM (SELECT region, poi, unnest(string_split(kinds, '|')) AS k FROM pairs WHERE core AND split = 'TL') GROUP BY ALL),
  s AS (SELECT region, poi, count_if(split = 'TL') AS tl, concat_ws('|', max(CASE WHEN split = 'TL' THEN 'train' END), max(CASE WHEN split = 'VL' THEN 'validation' END)) AS presence FROM pairs WHERE core GROUP BY ALL),
  i AS (SELECT region, poi, p_type, p_brand, p_size, coalesce(presence, '') AS split_presence, coalesce(tl, 0) AS tl_popularity FROM master FULL JOIN s USING (region, poi))
  SELECT {ITEM_KEY} AS item_key, region, p_type, p_brand, p_size, split_presence, coalesce(kinds, '') AS kinds, tl_popularity FROM i LEFT JOIN k USING (region, poi)""")
def dataset_item_features(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


@query(f"{PAIRS} SELECT {TRIP_KEY} AS trip_key, {ITEM_KEY} AS item_key, region, {ROLE} AS split, 1 AS observed_positive, repeats AS repeat_visit_count FROM pairs WHERE core")
def dataset_interactions(spark: SparkSession, d: str) -> DataFrame:
    return dataset.interactions(_pairs(spark, d), RUN)


@query(f"""{PAIRS}, b AS (SELECT region, split, count(*) AS trips, count(DISTINCT traveler) AS travelers FROM trips GROUP BY ALL),
  v AS (SELECT region, split, count(*) AS visits, count_if(poi <> '') AS visits_with_place, count(DISTINCT v.trip) AS trips_with_visits FROM visits v JOIN trips t ON v.trip = t.trip GROUP BY ALL),
  g AS (SELECT region, split, count(*) AS positives, count_if(core) AS core_positives, count(DISTINCT trip) AS trips_with_positive, count(DISTINCT CASE WHEN core THEN trip END) AS trips_with_core, count(DISTINCT poi) AS items FROM pairs GROUP BY ALL),
  w AS (SELECT * FROM b LEFT JOIN v USING (region, split) LEFT JOIN g USING (region, split))
  SELECT region, split, metric, n FROM (UNPIVOT (SELECT * REPLACE (coalesce(travelers, 0) AS travelers, coalesce(visits, 0) AS visits, coalesce(visits_with_place, 0) AS visits_with_place, coalesce(trips_with_visits, 0) AS trips_with_visits, coalesce(positives, 0) AS positives, coalesce(core_positives, 0) AS core_positives, coalesce(trips_with_positive, 0) AS trips_with_positive, coalesce(trips_with_core, 0) AS trips_with_core, coalesce(items, 0) AS items) FROM w) ON trips, travelers, visits, visits_with_place, trips_with_visits, positives, core_positives, trips_with_positive, trips_with_core, items INTO NAME metric VALUE n)""")
def cohort_funnel(spark: SparkSession, d: str) -> DataFrame:
    return dataset.funnel(mapping.trips(spark, d), mapping.visits(spark, d), _pairs(spark, d))


@query(f"""{M}, k AS (SELECT DISTINCT region, poi, 1 AS k FROM seen WHERE split = 'TL'), z AS (SELECT region, count(*) AS size FROM k GROUP BY ALL),
  p AS (SELECT region, trip, count(k) AS i, count(*) - count(k) AS o FROM (SELECT DISTINCT region, trip, poi FROM seen WHERE split = 'VL') LEFT JOIN k USING (region, poi) GROUP BY ALL),
  t AS (SELECT region, trip, coalesce(size, 0) AS size, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM trips LEFT JOIN z USING (region) LEFT JOIN p USING (region, trip) WHERE split = 'VL')
  SELECT region, CASE WHEN size = 0 THEN 'empty_candidate' WHEN size < 2 THEN 'insufficient_candidate_support' WHEN i > 0 AND o > 0 THEN 'positive_outside_candidate_universe' WHEN o > 0 THEN 'cold_start_only' WHEN i > 0 THEN 'evaluable' ELSE 'no_observed_positive' END AS status, count(*) AS trips FROM t GROUP BY ALL""")
def choice_set_status(spark: SparkSession, d: str) -> DataFrame:
    return dataset.choice_sets(mapping.trips(spark, d), _events(spark, d))


@query(f"""{M}, p AS (SELECT region, split, trip, count(*) AS e, count(DISTINCT poi) AS p FROM seen GROUP BY ALL), t AS (SELECT region, split, trip, coalesce(e, 0) AS e, coalesce(p, 0) AS p FROM trips LEFT JOIN p USING (region, split, trip))
  SELECT region, split, count(*) AS trips, count_if(e > p) AS with_repeats, round(sum(e - p) / sum(e), 6) AS repeat_share, round(avg(p), 6) AS mean_places, max(p) AS most_places FROM t GROUP BY ALL""")
def structural_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return dataset.structure(mapping.trips(spark, d), _events(spark, d))


@query(f"""{M}, k AS (SELECT DISTINCT region, poi, 1 AS k FROM seen WHERE split = 'TL'), z AS (SELECT region, count(*) AS size FROM k GROUP BY ALL),
  p AS (SELECT region, trip, count(k) AS i, count(*) - count(k) AS o FROM (SELECT DISTINCT region, trip, poi FROM seen WHERE split = 'VL') LEFT JOIN k USING (region, poi) GROUP BY ALL),
  t AS (SELECT region, trip, coalesce(size, 0) AS size, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM trips LEFT JOIN z USING (region) LEFT JOIN p USING (region, trip) WHERE split = 'VL'),
  c AS (SELECT region, unnest(['choice_set_status', 'candidate_support_status', 'positive_coverage_status', 'candidate_size', 'candidate_positive_density', 'positives_a_trip']) AS metric, unnest([
    CASE WHEN size = 0 THEN 'empty_candidate' WHEN size < 2 THEN 'insufficient_candidate_support' WHEN i > 0 AND o > 0 THEN 'positive_outside_candidate_universe' WHEN o > 0 THEN 'cold_start_only' WHEN i > 0 THEN 'evaluable' ELSE 'no_observed_positive' END,
    CASE WHEN size = 0 THEN 'empty_candidate' WHEN size < 2 THEN 'insufficient_candidate_support' ELSE 'rankable_candidate_support' END,
    CASE WHEN i = 0 AND o = 0 THEN 'no_usable_positive' WHEN i > 0 AND o > 0 THEN 'positive_outside_candidate_universe' WHEN o > 0 THEN 'cold_start_only' ELSE 'all_positives_in_candidate_universe' END,
    CASE WHEN size = 0 THEN NULL WHEN size < 10 THEN '1-9' WHEN size < 50 THEN '10-49' WHEN size < 100 THEN '50-99' WHEN size < 500 THEN '100-499' ELSE '500+' END,
    CASE WHEN size = 0 THEN NULL WHEN i = 0 THEN '0%' WHEN i / size::DOUBLE < 0.01 THEN '0-<1%' WHEN i / size::DOUBLE < 0.1 THEN '1-<10%' WHEN i / size::DOUBLE < 0.25 THEN '10-<25%' ELSE '25%+' END,
    CASE WHEN i + o = 0 THEN '0' WHEN i + o = 1 THEN '1' WHEN i + o <= 4 THEN '2-4' WHEN i + o <= 9 THEN '5-9' ELSE '10+' END]) AS bucket FROM t)
  SELECT region, metric, bucket, count(*) AS trips FROM c WHERE bucket IS NOT NULL GROUP BY ALL""")
def choice_histograms(spark: SparkSession, d: str) -> DataFrame:
    return dataset.choice_histograms(mapping.trips(spark, d), _events(spark, d))


def _funnel_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trips, visits and masters with gaps by rule: trips on two rows, visits of unknown trips, codes and answers outside their domains."""
    t, key = mapping.trips(spark, d), F.col("trip").cast("long")
    trips = t.select("region", "split", "trip", "traveler", (F.col("segment") != "BUILDING").alias("style"), (F.col("priority") != "5-LOW").alias("motive"), (F.col("status") != "P").alias("destination"), (key % 5 > 0).alias("companion"), (key % 11 > 0).alias("temporal"), (key % 11 == 0).alias("inverted"), (key % 3 == 0).alias("relations"))
    twice = trips.where(key % 41 == 0).withColumn("traveler", F.when(key % 82 == 0, F.col("traveler")).otherwise("other"))
    v = mapping.visits(spark, d).join(t.select("region", "split", "trip"), "trip")
    visits = v.select(
        "region", "split", F.when(key % 97 == 0, F.concat(F.lit("x"), "trip")).otherwise(F.col("trip")).alias("trip"), F.when(F.col("kind") != "9", F.col("area")).alias("area"), "poi", "kind", F.when(F.col("feedback") != "4", F.concat("kind", F.lit("0"))).alias("sgg"),
        (F.col("kind").cast("int") < 15).alias("sgg_known"), F.col("feedback").isin("1", "2", "3", "4", "5").alias("a"), (F.col("feedback") != "1").alias("b"), F.when(F.col("feedback") != "2", True).alias("c"),
    )
    p = F.col("p_partkey")
    masters = mapping.table(spark, d, "part").withColumn("r_regionkey", p % 5).join(mapping.table(spark, d, "region"), "r_regionkey")
    masters = masters.withColumn("_copy", F.explode(F.when(p % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(F.col("r_name").alias("region"), p.cast("string").alias("poi"), (F.col("p_size") > 25).alias("sgg_known"), (p % 9 > 0).alias("rich"))
    return trips.unionByName(twice), visits, masters


FUNNEL_PAIRS = ["primary_context_complete", "sgg_crosswalk_valid", "master_unique_join", "master_rich_complete"]


@query(f"""{M}, tt AS (SELECT region, split, trip, trip::BIGINT AS k, traveler, segment <> 'BUILDING' AS style, priority <> '5-LOW' AS motive, status <> 'P' AS destination FROM trips),
  per AS (SELECT *, k % 5 > 0 AS companion, k % 11 > 0 AS temporal, k % 11 = 0 AS inverted, k % 3 = 0 AS relations, k % 41 <> 0 AS once FROM tt), pw AS (SELECT *, once AND style AND motive AND destination AND companion AND temporal AS whole FROM per),
  vs AS (SELECT t.region, t.split, CASE WHEN t.k % 97 = 0 THEN NULL ELSE t.trip END AS trip, v.kind <> '9' AS area, nullif(v.poi, '') AS poi, v.kind IN {CORE} AS core, v.feedback <> '4' AS sgg, v.kind::INT < 15 AS known, v.feedback <> '6' AS a, v.feedback <> '1' AS b, v.feedback <> '2' AS c FROM visits v JOIN pw t ON v.trip = t.trip),
  rw AS (SELECT vs.*, p.whole, coalesce(p.once, false) AS mapped, coalesce(p.once, false) AND area AS event FROM vs LEFT JOIN pw p ON p.trip = vs.trip),
  ms AS (SELECT r_name AS region, CAST(p_partkey AS VARCHAR) AS poi, p_size > 25 AS m_known, p_partkey % 9 > 0 AS m_rich FROM part JOIN region ON p_partkey % 5 = r_regionkey WHERE p_partkey % 29 <> 0),
  pr AS (SELECT region, split, trip, poi, count(*) AS k, bool_or(core) AS core, any_value(whole) AS primary_context_complete, bool_or(known AND sgg) AS known FROM rw WHERE event AND poi IS NOT NULL GROUP BY ALL),
  pj AS (SELECT pr.*, m.poi IS NOT NULL AS master_unique_join, known OR coalesce(m_known, false) AS sgg_crosswalk_valid, coalesce(m_rich, false) AS master_rich_complete FROM pr LEFT JOIN ms m ON m.region = pr.region AND m.poi = pr.poi),
  a AS (SELECT region, split, count_if(once) AS trips_total, count_if(once) AS trips_valid_owner, count_if(whole) AS trips_primary_context_complete, {", ".join(f"count_if(once AND {c}) AS trips_{c}_complete" for c in dataset.CONTEXT)}, count_if(once AND inverted) AS trips_inverted_dates, count_if(once AND relations) AS trips_companion_relation_recorded FROM pw GROUP BY ALL),
  b AS (SELECT region, split, count(*) AS visit_rows_total, count_if(event) AS visit_events_valid, count_if(event AND poi IS NULL) AS visit_rows_missing_poi_id, count_if(NOT mapped) AS visit_rows_unmapped_trip, 0::BIGINT AS visit_rows_ambiguous_traveler, count_if(event AND core) AS visit_events_tourism_core, count_if(event AND NOT core) AS visit_events_non_tourism,
    count_if(event AND core AND poi IS NOT NULL) AS visit_events_with_poi_tourism_core, count_if(event AND NOT core AND poi IS NOT NULL) AS visit_events_with_poi_non_tourism, count_if(event AND sgg) AS visit_events_sgg_nonblank, count_if(event AND sgg AND known) AS visit_events_sgg_crosswalk_valid, count_if(event AND a) AS visit_events_a_valid,
    count_if(event AND b) AS visit_events_b_valid, count_if(event AND c) AS visit_events_c_valid, count_if(event AND a AND b AND c) AS visit_events_all_feedback_valid FROM rw GROUP BY ALL),
  c AS (SELECT region, split, count(*) AS trip_poi_positives_all, count_if(core) AS trip_poi_positives_tourism_core, count_if(NOT core) AS trip_poi_positives_non_tourism_only, count_if(k > 1) AS trip_poi_within_trip_repeat_pairs, CAST(sum(k - 1) AS BIGINT) AS trip_poi_within_trip_repeat_extra_events,
    {", ".join(f"count_if({n}) AS trip_poi_{n}_all, count_if({n} AND core) AS trip_poi_{n}_tourism_core" for n in FUNNEL_PAIRS)}, count(DISTINCT trip) AS trips_with_any_poi_visit, count(DISTINCT CASE WHEN core THEN trip END) AS trips_with_tourism_core_visit, count(DISTINCT poi) AS distinct_pois_all, count(DISTINCT CASE WHEN core THEN poi END) AS distinct_pois_tourism_core FROM pj GROUP BY ALL),
  l AS (SELECT region, split, metric, n FROM (UNPIVOT a ON COLUMNS(* EXCLUDE (region, split)) INTO NAME metric VALUE n) UNION ALL SELECT region, split, metric, n FROM (UNPIVOT b ON COLUMNS(* EXCLUDE (region, split)) INTO NAME metric VALUE n) UNION ALL SELECT region, split, metric, n FROM (UNPIVOT c ON COLUMNS(* EXCLUDE (region, split)) INTO NAME metric VALUE n))
  SELECT region, split, metric, n FROM l UNION ALL SELECT 'all', split, metric, CAST(sum(n) AS BIGINT) FROM l GROUP BY split, metric UNION ALL SELECT 'all', 'all', metric, CAST(sum(n) AS BIGINT) FROM l GROUP BY metric""")
def whole_funnel(spark: SparkSession, d: str) -> DataFrame:
    return dataset.whole_funnel(*_funnel_tables(spark, d), ("a", "b", "c"))


@query(f"""{M}, v AS (SELECT t.region, t.split, v.trip, v.poi, v.kind, CASE WHEN l.l_suppkey % 4 = 0 THEN ' ' ELSE CAST(l.l_suppkey % 30 AS VARCHAR) END AS sgg FROM visits v JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS trip, concat(l_orderkey, '-', l_linenumber) AS area, any_value(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) = 1) l ON l.trip = v.trip AND l.area = v.area JOIN trips t ON t.trip = v.trip WHERE v.poi <> '')
  SELECT region, split, trip, poi, count(*) AS events, coalesce(string_agg(DISTINCT CASE WHEN sgg <> ' ' THEN sgg END, '|' ORDER BY CASE WHEN sgg <> ' ' THEN sgg END), '') AS districts, bool_or(kind IN {CORE}) AS core FROM v GROUP BY ALL""")
def positive_districts(spark: SparkSession, d: str) -> DataFrame:
    """Positives of the visits whose order line stands once, with the districts of their suppliers."""
    line = mapping.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("trip"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("area")).agg(F.count("*").alias("n"), F.first("l_suppkey").alias("s")).where("n = 1")
    sgg = F.when(F.col("s") % 4 == 0, " ").otherwise((F.col("s") % 30).cast("string"))
    visits = mapping.visits(spark, d).join(line, ["trip", "area"]).select("trip", "poi", "kind", sgg.alias("sgg"))
    return contract.positive_districts(visits, mapping.trips(spark, d))
