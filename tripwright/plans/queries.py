"""The engine's queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwright.functions import bands, codes, geo, keys, temporal, text
from tripwright.operators import ablation, association, contract, identity, profile, ranking, recommend, split
from tripwright.operators.tables import written
from tripwright.plans.registry import query
from tripwright.sources import mapping

SEED = "inner-v1"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return contract.events(mapping.visits(spark, d), mapping.trips(spark, d))


def _once(spark: SparkSession, d: str) -> DataFrame:
    """The events, computed once for a query that reads them in many branches."""
    return written(_events(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return contract.positives(_events(spark, d))


def _core_parts(spark: SparkSession, d: str) -> DataFrame:
    return split.hash_split(mapping.trips(spark, d).where("split = 'TL'"), "traveler", SEED)


M = f"WITH {mapping.SQL}"
CORE = "('1','2','3','5','6','7','8','12','13')"
VALID = "('1','2','3','5','6','7','8','12','13','4','9','10','11','21','22','23','24')"
PAIRS = f"""{M}, pairs AS (SELECT region, split, trip, traveler, poi, count(*) AS repeats, bool_or(kind IN {CORE}) AS core,
  coalesce(string_agg(DISTINCT CASE WHEN kind IN {VALID} THEN kind END, '|' ORDER BY CASE WHEN kind IN {VALID} THEN kind END), '') AS kinds FROM seen GROUP BY ALL)"""
ITEM_IN, ITEM_OUT = (x.hex() for x in keys.pads(keys.ITEM_TIE_KEY))
USER_IN, USER_OUT = (x.hex() for x in keys.pads(keys.USER_TIE_KEY))


def _tie(pads: tuple[str, str], a: str, b: str) -> str:
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({a}) || unhex('00') || encode({b}))))"


ITEM_TIE = _tie((ITEM_IN, ITEM_OUT), "region", "poi")
SPLIT = f"""units AS (SELECT DISTINCT region, traveler FROM trips WHERE split = 'TL'),
parts AS (SELECT region, traveler, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY sha256(encode('{SEED}') || unhex('00') || encode(traveler)), traveler)
  <= greatest(1, least(count(*) OVER (PARTITION BY region) - 1, CAST(round_even(count(*) OVER (PARTITION BY region) * 0.2::DOUBLE, 0) AS BIGINT))) THEN 'inner-validation' ELSE 'inner-train' END AS part FROM units)"""
POP = f"""pop AS (SELECT region, poi, n, row_number() OVER (PARTITION BY region ORDER BY n DESC, {ITEM_TIE}) AS rank FROM
  (SELECT region, poi, count(*) AS n FROM seen WHERE split = 'TL' GROUP BY ALL))"""
METRICS = """sizes AS (SELECT region, count(*) AS ranked FROM (SELECT DISTINCT region, poi FROM seen WHERE split = 'TL') GROUP BY ALL),
rel AS (SELECT DISTINCT region, trip AS query, poi FROM seen WHERE split = 'VL'), ks AS (SELECT unnest([5, 10, 20]) AS k),
wanted AS (SELECT region, query, count(*) AS rel FROM rel GROUP BY ALL),
got AS (SELECT region, query, k, count(*) AS h, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg, min(rank) AS first FROM hits, ks WHERE rank <= k GROUP BY ALL),
ideal AS (SELECT n, (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, n + 1) t(i)) AS idcg FROM range(1, 21) s(n)),
cells AS (SELECT w.region, k, coalesce(h / least(k, ranked)::DOUBLE, 0) AS p, coalesce(h / rel::DOUBLE, 0) AS r, coalesce(dcg / idcg, 0) AS g, coalesce(1.0::DOUBLE / first, 0) AS m,
  CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, coalesce(h, 0) AS h
  FROM wanted w CROSS JOIN ks JOIN sizes USING (region) LEFT JOIN got USING (region, query, k) JOIN ideal ON n = least(rel, k)),
metrics AS (SELECT region, CAST(k AS INT) AS k, count(*) AS queries, CAST(sum(h) AS BIGINT) AS hits, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(g), 6) AS ndcg, round(avg(m), 6) AS mrr,
  round(avg(hit), 6) AS hit_rate FROM cells GROUP BY ALL)"""
POP_HITS = "hits AS (SELECT DISTINCT s.region, s.trip AS query, rank FROM seen s JOIN pop USING (region, poi) WHERE s.split = 'VL' AND rank <= 20)"


# Cleaning, codes, dates

WS_SQL = "' ' || chr(9) || chr(10)"


@query(f"""SELECT event_id, nullif(trim(raw, {WS_SQL}), '') AS cleaned, CASE WHEN trim(raw, {WS_SQL}) <> '' THEN raw END AS kept FROM
  (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ' ' || chr(9) ELSE ' ' || event_type || chr(10) END AS raw FROM events)""")
def clean_strings(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, " \t").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\n")))
    return mapping.table(spark, d, "events").select("event_id", text.clean(raw).alias("cleaned"), text.blank_to_null(raw).alias("kept"))


@query(f"{M} SELECT kind, CASE WHEN kind IN {VALID} THEN kind END AS valid_kind, CASE WHEN feedback IN ('1','2','3','4','5') THEN feedback END AS valid_feedback, count(*) AS n FROM visits GROUP BY ALL")
def code_domain(spark: SparkSession, d: str) -> DataFrame:
    v = mapping.visits(spark, d)
    return v.groupBy("kind", codes.in_domain(F.col("kind"), codes.VISIT_KIND).alias("valid_kind"), codes.in_domain(F.col("feedback"), codes.FEEDBACK).alias("valid_feedback")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN try_cast(raw AS DOUBLE) >= 0 AND try_cast(raw AS DOUBLE) = floor(try_cast(raw AS DOUBLE)) THEN CAST(try_cast(raw AS DOUBLE) AS BIGINT) END AS parsed FROM
  (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN p_size || '.0' WHEN 2 THEN p_size || '.5' WHEN 3 THEN '-' || p_size ELSE p_brand END AS raw FROM part)""")
def int_parse(spark: SparkSession, d: str) -> DataFrame:
    size, turn = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    raw = F.when(turn == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(turn == 1, F.concat(size, F.lit(".0"))).when(turn == 2, F.concat(size, F.lit(".5"))).when(turn == 3, F.concat(F.lit("-"), size)).otherwise(F.col("p_brand"))
    return mapping.table(spark, d, "part").select("p_partkey", codes.parse_count(raw).alias("parsed"))


@query("""SELECT reason, month, count(*) AS n, CAST(sum(elapsed) AS BIGINT) AS days FROM (SELECT
  CASE WHEN o_orderkey % 11 = 0 OR l_shipdate IS NULL THEN 'missing_start_or_end_date' WHEN o_orderkey % 13 = 0 THEN 'unparseable_date' WHEN l_shipdate::DATE < o_orderdate::DATE THEN 'inverted_date_range' END AS reason,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%m') END AS month,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND l_shipdate::DATE >= o_orderdate::DATE THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END AS elapsed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL""")
def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    rows = mapping.table(spark, d, "lineitem").join(mapping.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("o_orderkey") % 11 == 0, " ").when(F.col("o_orderkey") % 13 == 0, "2000-1-5").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    month, elapsed, reason = temporal.trip_time(start, F.date_format("l_shipdate", "yyyyMMdd"))
    return rows.groupBy(reason.alias("reason"), month.alias("month")).agg(F.count("*").alias("n"), F.sum(elapsed).alias("days"))


@query(f"{M} SELECT poi, substr(sha256(encode('{SEED}') || unhex('00') || encode('item') || unhex('00') || encode(poi)), 1, 32) AS surrogate FROM (SELECT DISTINCT poi FROM seen)")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("poi").distinct().select("poi", keys.surrogate_key(F.lit(SEED), F.lit("item"), "poi").alias("surrogate"))


# Ownership, eligibility, positives


@query(f"{M} SELECT region, split, count(*) AS trips, count(DISTINCT traveler) AS travelers FROM trips WHERE (region, trip) IN (SELECT (region, trip) FROM trips GROUP BY region, trip HAVING count(*) = 1) GROUP BY ALL")
def trip_owner_unique(spark: SparkSession, d: str) -> DataFrame:
    return contract.unique_trips(mapping.trips(spark, d)).groupBy("region", "split").agg(F.count("*").alias("trips"), F.count_distinct("traveler").alias("travelers"))


@query(f"""{M} SELECT CASE WHEN o.trip IS NULL THEN 'unmapped' WHEN owners > 1 THEN 'ambiguous' WHEN poi = '' THEN 'missing_poi' ELSE 'event' END AS outcome, count(*) AS n
  FROM visits v LEFT JOIN (SELECT trip, count(DISTINCT (region, traveler)) AS owners FROM trips GROUP BY ALL) o ON v.trip = o.trip GROUP BY ALL""")
def visit_owner_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return contract.visit_outcomes(mapping.visits(spark, d), mapping.trips(spark, d))


@query(f"""{M}, e AS (SELECT CASE WHEN kind IN {CORE} THEN 'tourism_core' ELSE 'non_tourism' END AS cohort,
  concat_ws('|', CASE WHEN poi = '' THEN 'missing_poi_id' END, CASE WHEN kind NOT IN {VALID} THEN 'missing_or_invalid_visit_area_type' WHEN kind NOT IN {CORE} THEN 'non_tourism_visit_area_type' END) AS reasons, poi <> '' AS trip_poi
  FROM visits) SELECT cohort, reasons, trip_poi, count(*) AS n FROM e GROUP BY ALL""")
def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    return contract.eligibility(mapping.visits(spark, d), mapping.trips(spark, d)).groupBy("cohort", "reasons", "trip_poi").agg(F.count("*").alias("n"))


@query(f"{PAIRS} SELECT * FROM pairs")
def trip_poi_positives(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(f"""{PAIRS} SELECT region, split, count(*) AS positives, count_if(core) AS core_positives, count_if(repeats > 1) AS repeat_pairs, CAST(sum(repeats - 1) AS BIGINT) AS extra_events,
  count(DISTINCT trip) AS trips, count(DISTINCT poi) AS items, count(DISTINCT traveler) AS travelers FROM pairs GROUP BY ALL""")
def positives_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return contract.diagnostics(_pairs(spark, d))


@query(f"""{M} SELECT coalesce(CASE WHEN kind IN {VALID} THEN kind END, 'invalid') AS kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM visits GROUP BY 1""")
def visit_type_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return contract.kind_breakdown(mapping.visits(spark, d))


@query(f"""{PAIRS}, items AS (SELECT region, poi, max((split = 'TL')::INT) AS tl, max((split = 'VL')::INT) AS vl, max((split = 'TL' AND core)::INT) AS tlc, max((split = 'VL' AND core)::INT) AS vlc FROM pairs GROUP BY ALL)
  SELECT region, CAST(sum(vl) AS BIGINT) AS vl_items, CAST(sum(vl * (1 - tl)) AS BIGINT) AS cold_items, CAST(sum(vlc) AS BIGINT) AS vl_core_items, CAST(sum(vlc * (1 - tlc)) AS BIGINT) AS cold_core_items FROM items GROUP BY ALL""")
def cold_start_by_region(spark: SparkSession, d: str) -> DataFrame:
    return contract.cold_start(_pairs(spark, d))


@query(f"{M} SELECT count(*) AS overlapping_trips FROM (SELECT region, trip FROM trips GROUP BY ALL HAVING count(DISTINCT split) > 1)")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    return contract.overlap(mapping.trips(spark, d))


@query(f"""{M}, per AS (SELECT region, traveler, count(DISTINCT trip) AS n FROM trips GROUP BY ALL) SELECT region, count(*) AS travelers, round(avg(n), 6) AS mean_trips, quantile_cont(n, 0.5) AS median_trips, max(n) AS max_trips,
  count_if(n = 1) AS one, count_if(n = 2) AS two, count_if(n >= 3) AS three_or_more FROM per GROUP BY ALL""")
def traveler_distribution(spark: SparkSession, d: str) -> DataFrame:
    return contract.traveler_distribution(mapping.trips(spark, d))


# Splits and what only training may feed


@query(f"{M}, {SPLIT} SELECT * FROM parts")
def hash_split_traveler(spark: SparkSession, d: str) -> DataFrame:
    return _core_parts(spark, d)


@query(f"{M}, {SPLIT.replace('traveler', 'trip')} SELECT * FROM parts")
def hash_split_trip(spark: SparkSession, d: str) -> DataFrame:
    return split.hash_split(mapping.trips(spark, d).where("split = 'TL'"), "trip", SEED)


@query(f"""{M}, {SPLIT}, {SPLIT.replace('units', 'trip_units').replace('parts', 'trip_parts').replace('traveler', 'trip')},
  cut AS (SELECT t.region, t.traveler, count(*) AS trips, count_if(p.part <> q.part) AS moved, count(DISTINCT q.part) AS n FROM trips t JOIN parts p USING (region, traveler) JOIN trip_parts q ON t.region = q.region AND t.trip = q.trip WHERE t.split = 'TL' GROUP BY ALL)
  SELECT region, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(moved) AS BIGINT) AS moved, count_if(n > 1) AS cut_travelers, round(sum(moved) / sum(trips), 6) AS moved_share FROM cut GROUP BY ALL""")
def split_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return split.disagreement(mapping.trips(spark, d).where("split = 'TL'"), SEED)


@query(f"""{PAIRS}, {SPLIT}, c AS (SELECT region, poi, count(DISTINCT trip) AS n FROM pairs JOIN parts USING (region, traveler) WHERE split = 'TL' AND part = 'inner-train' GROUP BY ALL)
  SELECT region, poi, coalesce(n, 0) AS n FROM (SELECT DISTINCT region, poi FROM pairs WHERE split = 'TL') LEFT JOIN c USING (region, poi)""")
def i3_inner_counts(spark: SparkSession, d: str) -> DataFrame:
    return split.inner_counts(_pairs(spark, d).where("split = 'TL'"), _core_parts(spark, d))


@query(f"""{M}, {SPLIT}, train AS (SELECT s.* FROM seen s JOIN parts USING (region, traveler) WHERE s.split = 'TL' AND part = 'inner-train' AND kind IN {VALID}),
  core AS (SELECT DISTINCT region, trip, poi FROM train WHERE kind IN {CORE}), kinds AS (SELECT DISTINCT region, poi, CAST(kind AS INT) AS k FROM train JOIN core USING (region, trip, poi))
  SELECT region, poi, string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) AS kinds FROM kinds GROUP BY ALL""")
def i4_visit_types(spark: SparkSession, d: str) -> DataFrame:
    return split.inner_kinds(_events(spark, d).where("split = 'TL'"), _core_parts(spark, d))


# Recommenders


@query(f"{M}, {POP} SELECT region, poi, n, CAST(rank AS INT) AS rank FROM pop")
def popularity_rank(spark: SparkSession, d: str) -> DataFrame:
    return recommend.popularity(_events(spark, d))


@query(f"{M}, {POP}, {POP_HITS.replace('SELECT DISTINCT s.region, s.trip AS query, rank', 'SELECT DISTINCT s.region, s.trip AS query, poi, rank')}, {METRICS} SELECT * FROM metrics")
def popularity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return recommend.evaluate_popularity(_once(spark, d))


@query(f"""{M}, {POP}, {POP_HITS}, {METRICS}, long AS (UNPIVOT metrics ON precision, recall, ndcg, mrr, hit_rate INTO NAME metric VALUE v)
  SELECT region, k, metric, CASE WHEN queries >= 10 AND hits >= 10 THEN format('{{:.6f}}', v) ELSE 'suppressed' END AS value, CASE WHEN queries >= 10 AND hits >= 10 THEN 'observed' ELSE 'suppressed_k10' END AS status FROM long""")
def popularity_metrics_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return recommend.suppressed(recommend.evaluate_popularity(_once(spark, d)))


@query(f"""{M}, known AS (SELECT DISTINCT region, poi, 1 AS known FROM seen WHERE split = 'TL'), p AS (SELECT DISTINCT s.region, s.trip, s.poi, known FROM seen s LEFT JOIN known USING (region, poi) WHERE s.split = 'VL'),
  t AS (SELECT region, trip, count(*) AS n, count(known) AS k FROM p GROUP BY ALL)
  SELECT region, count(*) AS trips, CAST(sum(n) AS BIGINT) AS positives, CAST(sum(k) AS BIGINT) AS covered, count_if(k > 0) AS covered_trips, any_value(items) AS items, any_value(known_items) AS known_items, round(sum(k) / sum(n), 6) AS positive_coverage
  FROM t JOIN (SELECT region, count(DISTINCT poi) AS items, count(DISTINCT CASE WHEN known = 1 THEN poi END) AS known_items FROM p GROUP BY ALL) USING (region) GROUP BY region""")
def popularity_coverage(spark: SparkSession, d: str) -> DataFrame:
    return recommend.coverage(_once(spark, d))


HIST = "hist AS (SELECT DISTINCT region, traveler, poi FROM seen WHERE split = 'TL')"


def _near(entity: str, feature: str, pads: tuple[str, str], top: int = 30) -> str:
    return f"""size AS (SELECT region, {entity}, count(*) AS size FROM hist GROUP BY ALL),
  com AS (SELECT a.region, a.{entity}, b.{entity} AS other, count(*) AS common FROM hist a JOIN hist b ON a.region = b.region AND a.{feature} = b.{feature} AND a.{entity} <> b.{entity} GROUP BY ALL),
  sim AS (SELECT c.region, c.{entity}, other, common, common / sqrt(CAST(s.size * o.size AS DOUBLE)) AS cosine FROM com c JOIN size s ON c.region = s.region AND c.{entity} = s.{entity} JOIN size o ON c.region = o.region AND other = o.{entity}),
  near AS (SELECT *, row_number() OVER (PARTITION BY region, {entity} ORDER BY cosine DESC, {_tie(pads, 'region', 'other')}) AS rank FROM sim QUALIFY rank <= {top})"""


def _near_rows(entity: str) -> str:
    return f"SELECT region, {entity}, other, common, round(cosine, 9) AS cosine, CAST(rank AS INT) AS rank FROM near"


LISTS = f"""asked AS (SELECT DISTINCT region, traveler FROM seen WHERE split = 'VL' AND (region, traveler) IN (SELECT (region, traveler) FROM scores WHERE score > 0)),
  lists AS (SELECT a.region, a.traveler, u.poi, row_number() OVER (PARTITION BY a.region, a.traveler ORDER BY round(coalesce(score, 0), 12) DESC, u.tie) AS rank
    FROM asked a JOIN (SELECT region, poi, {ITEM_TIE} AS tie FROM (SELECT DISTINCT region, poi FROM seen WHERE split = 'TL')) u ON u.region = a.region
    LEFT JOIN scores s ON s.region = a.region AND s.traveler = a.traveler AND s.poi = u.poi QUALIFY rank <= 20)"""
CF_HITS = f"""{LISTS}, hits AS (SELECT DISTINCT s.region, s.trip AS query, s.poi, rank FROM seen s JOIN lists USING (region, traveler, poi) WHERE s.split = 'VL')"""
USER_SCORES = "scores AS (SELECT n.region, n.traveler, h.poi, sum(cosine) AS score FROM near n JOIN hist h ON n.region = h.region AND n.other = h.traveler GROUP BY ALL)"
ITEM_SCORES = "scores AS (SELECT h.region, h.traveler, n.other AS poi, sum(cosine) AS score FROM hist h JOIN near n ON h.region = n.region AND h.poi = n.poi GROUP BY ALL)"


@query(f"{M}, {HIST}, {_near('traveler', 'poi', (USER_IN, USER_OUT))} {_near_rows('traveler')}")
def user_cf_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return recommend.neighbours(recommend.history(_once(spark, d)), "traveler", "poi", keys.USER_TIE_KEY, 30).withColumn("cosine", F.round("cosine", 9))


@query(f"{M}, {HIST}, {_near('poi', 'traveler', (ITEM_IN, ITEM_OUT))} {_near_rows('poi')}")
def item_cf_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return recommend.neighbours(recommend.history(_once(spark, d)), "poi", "traveler", keys.ITEM_TIE_KEY, 30).withColumn("cosine", F.round("cosine", 9))


@query(f"{M}, {HIST}, {_near('traveler', 'poi', (USER_IN, USER_OUT))}, {USER_SCORES} SELECT region, traveler, poi, round(score, 6) AS score FROM scores")
def user_cf_scores(spark: SparkSession, d: str) -> DataFrame:
    return recommend.user_cf(recommend.history(_once(spark, d))).withColumn("score", F.round("score", 6))


@query(f"{M}, {HIST}, {_near('poi', 'traveler', (ITEM_IN, ITEM_OUT))}, {ITEM_SCORES} SELECT region, traveler, poi, round(score, 6) AS score FROM scores")
def item_cf_scores(spark: SparkSession, d: str) -> DataFrame:
    return recommend.item_cf(recommend.history(_once(spark, d))).withColumn("score", F.round("score", 6))


@query(f"{M}, {HIST}, {_near('traveler', 'poi', (USER_IN, USER_OUT))}, {USER_SCORES}, {CF_HITS}, {METRICS} SELECT * FROM metrics")
def cf_metrics(spark: SparkSession, d: str) -> DataFrame:
    events = _once(spark, d)
    return recommend.evaluate_scores(events, recommend.user_cf(recommend.history(events)))


# Fit, structure, profiles

BAND = "CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 49 THEN '10-49' ELSE '50+' END"


@query(f"{M} SELECT region, split, count(DISTINCT trip) AS trips, count(DISTINCT traveler) AS travelers, count(DISTINCT poi) AS pois, count(*) AS events FROM seen GROUP BY ALL")
def fit_identity_counts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("region", "split").agg(F.count_distinct("trip").alias("trips"), F.count_distinct("traveler").alias("travelers"), F.count_distinct("poi").alias("pois"), F.count("*").alias("events"))


@query(f"{M}, deg AS (SELECT split, traveler, count(DISTINCT poi) AS n FROM seen GROUP BY ALL) SELECT split, {BAND} AS band, count(*) AS travelers FROM deg GROUP BY ALL")
def fit_degree_hist(spark: SparkSession, d: str) -> DataFrame:
    degree = _events(spark, d).groupBy("split", "traveler").agg(F.count_distinct("poi").alias("n"))
    return degree.groupBy("split", bands.degree_band(F.col("n")).alias("band")).agg(F.count("*").alias("travelers"))


@query(f"{M} SELECT split, CASE WHEN feedback IN ('1','2','3','4','5') THEN 'code_' || feedback ELSE 'outside' END AS code, count(*) AS n FROM seen GROUP BY ALL")
def fit_feedback_dist(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("split", F.when(F.col("feedback").isin(*codes.FEEDBACK), F.concat(F.lit("code_"), "feedback")).otherwise("outside").alias("code")).agg(F.count("*").alias("n"))


@query(f"""{M}, t AS (SELECT DISTINCT region, poi FROM seen WHERE split = 'TL'), v AS (SELECT DISTINCT region, poi FROM seen WHERE split = 'VL')
  SELECT count_if(EXISTS (SELECT 1 FROM t WHERE t.region = v.region AND t.poi = v.poi)) AS shared, count_if(NOT EXISTS (SELECT 1 FROM t WHERE t.region = v.region AND t.poi = v.poi)) AS cold FROM v""")
def fit_poi_overlap(spark: SparkSession, d: str) -> DataFrame:
    items = _events(spark, d).select("region", "poi", "split").distinct()
    t = items.where("split = 'TL'").select("region", "poi", F.lit(1).alias("t"))
    return items.where("split = 'VL'").join(t, ["region", "poi"], "left").agg(F.count("t").alias("shared"), F.count_if(F.col("t").isNull()).alias("cold"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS brand FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = mapping.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = mapping.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return profile.union_all([a, b])


@query(f"{M}, n AS (SELECT region, trip, count(*) AS n FROM seen WHERE split = 'VL' GROUP BY ALL) SELECT region, {BAND} AS band, count(*) AS trips FROM n GROUP BY ALL")
def degree_bands(spark: SparkSession, d: str) -> DataFrame:
    n = _events(spark, d).where("split = 'VL'").groupBy("region", "trip").agg(F.count("*").alias("n"))
    return n.groupBy("region", bands.degree_band(F.col("n")).alias("band")).agg(F.count("*").alias("trips"))


PROFILED = {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_mktsegment": False, "c_acctbal": True}


def _profiled(c: str, number: bool) -> str:
    low, high = (f"CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END",) * 2 if number else ("NULL::DOUBLE",) * 2
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS present, count_if(trim({c}::VARCHAR) = '') AS blank, count(DISTINCT {c}) AS distinct_values, {f"count_if(NOT isfinite({c}::DOUBLE))" if number else "0::BIGINT"} AS non_finite,
  min(length({c}::VARCHAR)) AS min_length, round(avg(length({c}::VARCHAR)), 6) AS mean_length, max(length({c}::VARCHAR)) AS max_length, min({low}) AS least, max({high}) AS greatest FROM customer"""


@query(" UNION ALL ".join(_profiled(c, n) for c, n in PROFILED.items()))
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile.columns(mapping.table(spark, d, "customer"))


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT *, count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 2) GROUP BY ALL)")
def profile_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """All columns of line items, of which the second lines stand twice."""
    line = mapping.table(spark, d, "lineitem")
    return profile.duplicates(line.union(line.where("l_linenumber = 2")))


KEYED = ["l_orderkey", "l_partkey", "l_linenumber"]


@query("SELECT a, b, k AS is_key FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(DISTINCT ({a}, {b})) = count(*) AS k FROM lineitem" for i, a in enumerate(KEYED) for b in KEYED[i + 1 :]) + ")")
def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    return profile.composite_keys(mapping.table(spark, d, "lineitem"), KEYED)


@query("""SELECT count(*) AS distinct_values, count_if(k IS NULL) AS unmatched_values, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS unmatched_rows
  FROM (SELECT o_orderkey AS o, count(*) AS n FROM orders GROUP BY ALL) LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o = k""")
def relation_containment(spark: SparkSession, d: str) -> DataFrame:
    return profile.containment(mapping.table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), mapping.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def year_month_hist(spark: SparkSession, d: str) -> DataFrame:
    return profile.months(mapping.table(spark, d, "orders"), "o_orderdate")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if(isfinite({c})) AS finite, count_if({c} < 0) AS negative, count_if({c} = 0) AS zero FROM lineitem" for c in ("l_discount", "l_tax", "l_quantity")))
def numeric_flags(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric(mapping.table(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


@query("""WITH c AS (SELECT CAST(orders AS VARCHAR) AS label, count(*) AS n FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY ALL) GROUP BY ALL), h AS (SELECT coalesce(sum(n), 0) AS hidden FROM c WHERE n < 10),
  s AS (SELECT *, hidden > 0 AND hidden + coalesce(sum(n) OVER (ORDER BY n, label DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS merged FROM c, h WHERE n >= 10),
  t AS (SELECT (SELECT hidden FROM h) + coalesce(sum(n), 0) AS n FROM s WHERE merged)
  SELECT label, n FROM s WHERE NOT merged UNION ALL SELECT '<suppressed>', CAST(n AS BIGINT) FROM t WHERE n > 0""")
def value_counts_suppressed(spark: SparkSession, d: str) -> DataFrame:
    per = mapping.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("string").alias("label"))
    return profile.safe_counts(per.groupBy("label").agg(F.count("*").alias("n")))


@query(f"""{M} SELECT 'kind' AS field, count(*) AS observed, 0::BIGINT AS blank, count_if(kind NOT IN {VALID}) AS outside, count(DISTINCT CASE WHEN kind NOT IN {VALID} THEN kind END) AS distinct_outside FROM visits
  UNION ALL SELECT 'feedback', count(*), 0, count_if(feedback NOT IN ('1','2','3','4','5')), count(DISTINCT CASE WHEN feedback NOT IN ('1','2','3','4','5') THEN feedback END) FROM visits""")
def domain_scan(spark: SparkSession, d: str) -> DataFrame:
    return profile.domain_scan(mapping.visits(spark, d), {"kind": codes.VISIT_KIND, "feedback": codes.FEEDBACK})


@query("""SELECT key, count(*) AS present, count_if(coalesce(json_extract_string(props, '$.' || key), '') = '') AS null_or_empty
  FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL""")
def json_structure(spark: SparkSession, d: str) -> DataFrame:
    return profile.json_keys(mapping.table(spark, d, "events"), "props")


@query(f"""{M}, a AS (SELECT region, count(*) AS trips, count_if(start_at >= TIMESTAMP '2000-07-01') AS late FROM trips GROUP BY ALL)
  SELECT region, CASE WHEN trips <= 0 THEN '0' WHEN trips < 10 THEN '<10' ELSE '10+' END AS trips, CASE WHEN trips < 10 OR (late > 0 AND late < 10) THEN '<10/suppressed' WHEN late / trips < 0.1 THEN '0-<10%' WHEN late / trips < 0.25 THEN '10-<25%'
  WHEN late / trips < 0.5 THEN '25-<50%' WHEN late / trips < 0.75 THEN '50-<75%' WHEN late / trips < 0.9 THEN '75-<90%' ELSE '90-100%' END AS late_share FROM a""")
def suppression_bundle(spark: SparkSession, d: str) -> DataFrame:
    a = mapping.trips(spark, d).groupBy("region").agg(F.count("*").alias("t"), F.count_if(F.col("split") == "VL").alias("l"))
    return a.select("region", bands.count_bucket(F.col("t")).alias("trips"), bands.rate_band(F.col("l"), F.col("t")).alias("late_share"))


# Association

CONTEXT, PLACE = ["segment", "priority", "month"], ["kind", "feedback"]
LONG = f"""{M}, ctx AS (SELECT v.*, t.split, t.segment, t.priority, strftime(t.start_at, '%m') AS month FROM visits v JOIN trips t ON v.trip = t.trip),
  long AS ({" UNION ALL ".join(f"SELECT split, '{a}' AS feature, {a} AS fv, '{b}' AS target, {b} AS tv FROM ctx" for a in CONTEXT for b in PLACE)})"""


def _context(spark: SparkSession, d: str) -> DataFrame:
    t = mapping.trips(spark, d).select("trip", "split", "segment", "priority", F.date_format("start_at", "MM").alias("month"))
    return mapping.visits(spark, d).join(t, "trip")


CRAMER = f"""{LONG}, o AS (SELECT split, feature, target, fv, tv, count(*) AS o FROM long WHERE fv IS NOT NULL AND tv IS NOT NULL GROUP BY ALL),
  r AS (SELECT split, feature, target, fv, sum(o) AS r FROM o GROUP BY ALL), c AS (SELECT split, feature, target, tv, sum(o) AS c FROM o GROUP BY ALL),
  m AS (SELECT r.split, r.feature, r.target, r, c, coalesce(o, 0) AS o FROM r JOIN c ON r.split = c.split AND r.feature = c.feature AND r.target = c.target LEFT JOIN o ON o.split = r.split AND o.feature = r.feature AND o.target = r.target AND o.fv = r.fv AND o.tv = c.tv),
  n AS (SELECT split, feature, target, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT fv) AS rows, count(DISTINCT tv) AS cols FROM o GROUP BY ALL),
  x AS (SELECT m.split, m.feature, m.target, sum((o - r * c / n::DOUBLE) * (o - r * c / n::DOUBLE) / (r * c / n::DOUBLE)) AS chi FROM m JOIN n USING (split, feature, target) GROUP BY ALL)
  SELECT split, feature, target, n, rows, cols, 'observed' AS status, round(sqrt(chi / (n * least(rows - 1, cols - 1))), 6) AS cramers_v FROM n JOIN x USING (split, feature, target)"""


@query(CRAMER)
def contingency_cramers_v(spark: SparkSession, d: str) -> DataFrame:
    return association.contingency(_context(spark, d), CONTEXT, PLACE, ["split"])


#: The upper tail of the chi-square distribution, by the series of the lower one.
TAIL = "round((SELECT greatest(0, least(1, 1 - sum(exp((a + k) * ln(chi / 2) - chi / 2 - lgamma(a + k + 1))))) FROM range(0, 2000) t(k)), 6) AS p"


@query(CRAMER.replace("cols, 'observed'", f"cols, {TAIL}, 'observed'").replace("FROM n JOIN x USING (split, feature, target)", "FROM (SELECT *, (rows - 1) * (cols - 1) / 2.0::DOUBLE AS a FROM n JOIN x USING (split, feature, target))"))
def contingency_p_values(spark: SparkSession, d: str) -> DataFrame:
    return association.contingency(_context(spark, d), CONTEXT, PLACE, ["split"], p_value=True).withColumn("p", F.round("p", 6))


@query(f"""{M}, p AS (SELECT DISTINCT t.split, t.trip, segment, kind FROM visits v JOIN trips t ON v.trip = t.trip) SELECT split, segment, kind, count(*) AS trips FROM p GROUP BY ALL""")
def trip_pair_association(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("split", "trip", "segment", "kind").distinct().groupBy("split", "segment", "kind").agg(F.count("*").alias("trips"))


@query(f"""{M}, ctx AS (SELECT v.area, row_number() OVER (ORDER BY area, poi, kind, feedback) AS id, t.split, t.segment, t.priority, v.kind, CASE WHEN v.feedback <> '6' THEN v.feedback END AS y FROM visits v JOIN trips t ON v.trip = t.trip),
  tr AS (SELECT * FROM ctx WHERE split = 'TL' AND y IS NOT NULL), te AS (SELECT * FROM ctx WHERE split = 'VL' AND y IS NOT NULL),
  cl AS (SELECT y AS class, count(*) AS nc FROM tr GROUP BY ALL), tl AS (UNPIVOT (SELECT y, segment, priority, kind FROM tr) ON segment, priority, kind INTO NAME f VALUE v), tel AS (UNPIVOT (SELECT id, y, segment, priority, kind FROM te) ON segment, priority, kind INTO NAME f VALUE v),
  cv AS (SELECT y AS class, f, v, count(*) AS ncv FROM tl GROUP BY ALL), vo AS (SELECT f, count(DISTINCT v) AS vocab FROM tl GROUP BY ALL),
  sc AS (SELECT id, tel.y, cl.class, sum(ln((coalesce(ncv, 0) + 1) / (nc + vocab + 1)::DOUBLE)) + any_value(ln(nc / (SELECT sum(nc) FROM cl)::DOUBLE)) AS s FROM tel CROSS JOIN cl JOIN vo USING (f) LEFT JOIN cv ON cv.class = cl.class AND cv.f = tel.f AND cv.v = tel.v GROUP BY ALL),
  pr AS (SELECT id, y, class FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, class) = 1)
  SELECT count(*) AS rows, round(avg(CASE WHEN y = class THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN y = (SELECT class FROM cl ORDER BY nc DESC, class LIMIT 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS majority_accuracy FROM pr""")
def nb_accuracy(spark: SparkSession, d: str) -> DataFrame:
    fields = ["segment", "priority", "kind"]
    rows = _context(spark, d).withColumn("y", codes.in_domain(F.col("feedback"), codes.FEEDBACK))
    stats = ablation.patterns(rows, fields, "y", F.col("split") == "VL")
    return ablation.evaluate(stats, fields, ablation.single({"all": fields})).select("rows", "accuracy", "majority_accuracy")


# Places


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Distinct source titles (name and brand) and catalogue titles (name), with their bigrams."""
    named = mapping.table(spark, d, "part")
    grams = lambda c, key: named.select(c.alias(key)).distinct().withColumn("grams", text.bigrams(F.col(key)))
    return grams(F.concat_ws(" ", "p_name", "p_brand"), "source_id"), grams(F.col("p_name"), "content_id")


COORD = "33 + (p_partkey * 7919 % 6000) / 1000.0::DOUBLE AS lat, 124 + (p_partkey * 104729 % 8500) / 1000.0::DOUBLE AS lon"
HAV = "6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"


def _h(a: str, b: str) -> str:
    return f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return mapping.table(spark, d, "part").select(k.alias("id"), (33 + (k * 7919 % 6000) / 1000.0).alias("lat"), (124 + (k * 104729 % 8500) / 1000.0).alias("lon"), "p_name", "p_brand", "p_type", "p_size")


@query(f"WITH p AS (SELECT p_partkey AS id, {COORD} FROM part), q AS (SELECT id, id + 1 AS nxt, lat, lon FROM p), r AS (SELECT q.id, {_h('q', 'p')} AS h, q.lat BETWEEN 33 AND 39 AND q.lon BETWEEN 124 AND 132.5 AS inside FROM q JOIN p ON q.nxt = p.id) SELECT id, round({HAV}, 3) AS metres, inside FROM r")
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = _points(spark, d).select("id", "lat", "lon")
    b = a.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "id").select("id", F.round(geo.haversine(*map(F.col, ("lat", "lon", "lat2", "lon2"))), 3).alias("metres"), geo.in_korea(F.col("lat"), F.col("lon")).alias("inside"))


#: Points close enough together to have neighbours.
DENSE = "37 + (p_partkey * 7919 % 3000) / 10000.0::DOUBLE AS lat, 127 + (p_partkey * 104729 % 3000) / 10000.0::DOUBLE AS lon"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return mapping.table(spark, d, "part").select(k.alias("id"), F.col("p_type").alias("region"), (37 + (k * 7919 % 3000) / 10000.0).alias("lat"), (127 + (k * 104729 % 3000) / 10000.0).alias("lon"))


@query(f"""WITH p AS (SELECT p_partkey AS id, {DENSE} FROM part), r AS (SELECT a.id AS l_id, b.id AS r_id, {_h('a', 'b')} AS h FROM p a JOIN p b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.03)
  SELECT l_id, r_id, round({HAV}, 3) AS metres FROM r WHERE {HAV} <= 800""")
def grid_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return geo.near_ids(_dense(spark, d).select("id", "lat", "lon"), 800).select("l_id", "r_id", F.round("metres", 3).alias("metres"))


@query(f"""WITH c AS (SELECT p_partkey AS id, upper(p_name) AS name, p_type AS region, p_brand AS address, CAST(p_size AS VARCHAR) AS code, {COORD} FROM part),
  s AS (SELECT id, CASE WHEN id % 17 = 0 THEN NULL WHEN id % 13 = 0 THEN name || ' DEPOT' ELSE name END AS name, region, CASE WHEN id % 3 = 0 THEN address END AS address, CASE WHEN id % 5 = 0 THEN '' ELSE code END AS code, lat + (id % 4) * 0.0005 AS lat, lon FROM c),
  e AS (SELECT s.id AS source_id, c.id AS content_id, coalesce(s.address = c.address, false) AS a, coalesce(s.code = c.code, false) AS k, {_h('s', 'c')} AS h FROM s JOIN c ON s.region = c.region AND s.name = c.name),
  e2 AS (SELECT *, {HAV} AS m FROM e), e3 AS (SELECT *, row_number() OVER w AS r, lead(m) OVER w AS nx FROM e2 WINDOW w AS (PARTITION BY source_id ORDER BY m, content_id)),
  g AS (SELECT source_id, count(*) AS names, count_if(a) AS na, count_if(k) AS nk, min(CASE WHEN a THEN content_id END) AS ba, min(CASE WHEN k THEN content_id END) AS bk, min(CASE WHEN k THEN m END) AS km,
    max(CASE WHEN r = 1 THEN content_id END) AS fc, max(CASE WHEN r = 1 THEN m END) AS d, max(CASE WHEN r = 1 THEN nx END) AS nx, bool_or(r = 1 AND k) AS fk FROM e3 GROUP BY ALL),
  st AS (SELECT *, CASE WHEN na = 1 THEN 0 WHEN na = 0 AND nk = 1 AND km <= 200 THEN 2 WHEN (d <= 200 AND (nx IS NULL OR nx > 200 OR nx - d >= 50)) OR (names = 1 AND d <= 500 AND fk) THEN 3 END AS stage FROM g)
  SELECT s.id AS source_id, CASE WHEN s.name IS NULL THEN 'identity_source_missing' WHEN st.source_id IS NULL THEN 'UNMATCHED' WHEN stage IS NULL THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status, stage,
    CASE stage WHEN 0 THEN ba WHEN 2 THEN bk WHEN 3 THEN fc END AS content_id FROM s LEFT JOIN st ON s.id = st.source_id""")
def identity_stage0_5(spark: SparkSession, d: str) -> DataFrame:
    base = _points(spark, d).select("id", F.upper("p_name").alias("name"), F.col("p_type").alias("region"), F.col("p_brand").alias("address"), F.col("p_size").cast("string").alias("code"), "lat", "lon")
    i = F.col("id")
    source = base.select(
        i.alias("source_id"), F.when(i % 17 == 0, None).when(i % 13 == 0, F.concat("name", F.lit(" DEPOT"))).otherwise(F.col("name")).alias("name"), "region", F.when(i % 3 == 0, F.col("address")).alias("address"),
        F.when(i % 5 == 0, "").otherwise(F.col("code")).alias("code"), (F.col("lat") + (i % 4) * 0.0005).alias("lat"), "lon",
    )
    return identity.match(source, base.withColumnRenamed("id", "content_id"))


@query("""SELECT s_suppkey, c, r, g, CASE WHEN substr(c, 1, 2) = '36' THEN r IN ('36110', '36') AND g IN ('36110', '110', '')
  WHEN c = '29110' THEN r = '12' AND g = '210' WHEN c = '29140' THEN r = '12' AND g = '240'
  ELSE CASE substr(c, 1, 2) WHEN '42' THEN '51' WHEN '45' THEN '52' WHEN '29' THEN '12' ELSE substr(c, 1, 2) END = r AND (substr(c, 3, 3) = g OR
    (substr(c, 3, 2) = substr(g, 1, 2) AND (substr(c, 1, 4) IN ('4111', '4113', '4511') OR r || substr(g, 1, 2) IN ('4111', '4113', '5211')) AND ((right(c, 1) = '0' AND right(g, 1) BETWEEN '1' AND '9') OR (right(g, 1) = '0' AND right(c, 1) BETWEEN '1' AND '9')))) END AS ok
  FROM (SELECT s_suppkey, ['41110', '41111', '42110', '29110', '36110', '45110', '11110', '29140'][1 + s_suppkey % 8] AS c, ['41', '51', '12', '36110', '52', '11'][1 + s_suppkey % 6] AS r, ['110', '111', '210', '36110', '113'][1 + s_suppkey % 5] AS g FROM supplier)""")
def sgg_compat(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (1 + F.col("s_suppkey") % len(values)).cast("int"))
    rows = mapping.table(spark, d, "supplier").select("s_suppkey", pick(["41110", "41111", "42110", "29110", "36110", "45110", "11110", "29140"]).alias("c"), pick(["41", "51", "12", "36110", "52", "11"]).alias("r"), pick(["110", "111", "210", "36110", "113"]).alias("g"))
    return rows.withColumn("ok", codes.sgg_compatible(F.col("c"), F.col("r"), F.col("g")))


@query("""WITH p AS (SELECT DISTINCT p_name || ' ' || p_brand AS nm FROM part), c AS (SELECT DISTINCT p_name AS nm FROM part),
  a AS (SELECT DISTINCT nm, substr(nm, CAST(i AS INT), 2) AS g FROM p, range(1, 200) t(i) WHERE i < length(nm)), b AS (SELECT DISTINCT nm, substr(nm, CAST(i AS INT), 2) AS g FROM c, range(1, 200) t(i) WHERE i < length(nm)),
  s AS (SELECT a.nm AS source_id, b.nm AS content_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY ALL)
  SELECT source_id, content_id, shared, CAST(row_number() OVER (PARTITION BY source_id ORDER BY shared DESC, content_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def bigram_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return identity.bigram_candidates(*_titles(spark, d), 5)


# Sampling, top-k, rich profiles

VL = "rel AS (SELECT DISTINCT region, trip AS query, poi FROM seen WHERE split = 'VL'), cat AS (SELECT DISTINCT region, poi FROM seen WHERE split = 'TL')"


def _digits(*parts: str) -> str:
    return "CAST(CAST('0x' || substr(sha256(" + " || unhex('00') || ".join(f"encode({p})" for p in parts) + "), 1, 12) AS BIGINT) AS BIGINT)"


DRAWS = f"""places AS (SELECT region, poi, row_number() OVER (PARTITION BY region ORDER BY sha256(encode('{SEED}') || unhex('00') || encode(poi)), poi) - 1 AS place FROM cat),
  size AS (SELECT region, count(*) AS size FROM cat GROUP BY ALL), prime AS (SELECT region, size, (SELECT min(v) FROM range(size, size + 400) p(v) WHERE v > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 2000) q(k) WHERE k * k <= v AND v % k = 0)) AS prime FROM size),
  w AS (SELECT region, query, count(*) AS n FROM rel GROUP BY ALL),
  st AS (SELECT w.*, prime, unnest(range(0, least(prime, n * 3 + prime - size))) AS step, {_digits(f"'{SEED}'", 'query')} % prime AS start, 1 + {_digits(f"'{SEED}'", "'stride'", 'query')} % greatest(prime - 1, 1) AS stride FROM w JOIN prime USING (region)),
  draws AS (SELECT st.region, st.query, n, step, poi, row_number() OVER (PARTITION BY st.region, st.query ORDER BY step) AS k FROM st JOIN places p ON p.region = st.region AND p.place = (start + step * stride) % st.prime
    WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.region = st.region AND rel.query = st.query AND rel.poi = p.poi))"""


@query(f"{M}, {VL}, {DRAWS} SELECT region, query, poi FROM draws WHERE k <= n * 2")
def sample_uniform(spark: SparkSession, d: str) -> DataFrame:
    e = _once(spark, d)
    return ranking.sample_unobserved(e.where("split = 'VL'").select("region", F.col("trip").alias("query"), "poi").distinct(), e.where("split = 'TL'").select("region", "poi").distinct(), 2, SEED)


@query(f"""{M}, {HIST}, {_near('traveler', 'poi', (USER_IN, USER_OUT))}, {USER_SCORES}, rel AS (SELECT DISTINCT region, traveler AS query, poi FROM seen WHERE split = 'VL'), w AS (SELECT region, query, count(*) AS n FROM rel GROUP BY ALL)
  SELECT region, query, poi FROM (SELECT s.region, s.traveler AS query, s.poi, n, row_number() OVER (PARTITION BY s.region, s.traveler ORDER BY round(score, 9) DESC, s.poi) AS k FROM scores s JOIN w ON w.region = s.region AND w.query = s.traveler
    WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.region = s.region AND r.query = s.traveler AND r.poi = s.poi)) WHERE k <= n""")
def sample_hard(spark: SparkSession, d: str) -> DataFrame:
    e = _once(spark, d)
    scored = recommend.user_cf(recommend.history(e)).select("region", F.col("traveler").alias("query"), "poi", F.round("score", 9).alias("score"))
    return ranking.sample_hard(e.where("split = 'VL'").select("region", F.col("traveler").alias("query"), "poi").distinct(), scored, 1)


@query(f"""{M} SELECT region, poi, score, CAST(rank AS INT) AS rank FROM (SELECT region, poi, score, row_number() OVER (PARTITION BY region ORDER BY score DESC, poi) AS rank FROM
  (SELECT region, poi, round(ln(1 + count(*)), 9) AS score FROM seen WHERE split = 'TL' GROUP BY ALL)) WHERE rank <= 10""")
def score_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = _events(spark, d).where("split = 'TL'").groupBy("region", "poi").agg(F.round(F.log1p(F.count("*").cast("double")), 9).alias("score"))
    return ranking.top_k(scored, ["region"], 10)


@query("""WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY ALL), e AS (SELECT *, 100.0::DOUBLE * n / (SELECT sum(n) FROM s) AS x FROM s),
  b AS (SELECT *, CAST(floor(x) AS BIGINT) AS base FROM e) SELECT stratum, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY round(x - base, 9) DESC, n DESC, stratum) <= 100 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b""")
def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    return ranking.quotas(mapping.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").alias("n")), 100)


@query(f"""{M}, h AS (SELECT s.region, s.poi, t.segment, t.priority FROM seen s JOIN trips t ON s.trip = t.trip WHERE s.split = 'TL'), l AS (UNPIVOT h ON segment, priority INTO NAME field VALUE value), c AS (SELECT region, poi, field, value, count(*) AS n FROM l GROUP BY ALL)
  SELECT *, CAST(sum(n) OVER w AS BIGINT) AS support, round(n / sum(n) OVER w, 6) AS share FROM c WINDOW w AS (PARTITION BY region, poi, field)""")
def rich_profile_shares(spark: SparkSession, d: str) -> DataFrame:
    ctx = mapping.trips(spark, d).select("trip", "segment", "priority")
    return ranking.shares(_events(spark, d).where("split = 'TL'").join(ctx, "trip"), ["segment", "priority"])


@query("SELECT count(*) AS tuples, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS sharing, max(n) AS largest FROM (SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)")
def tuple_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return ranking.uniqueness(mapping.table(spark, d, "part"), ["p_type", "p_brand", "p_size"])


@query(f"""{M}, c AS (SELECT region, poi, count(DISTINCT CASE WHEN split = 'TL' THEN trip END) AS n FROM seen GROUP BY ALL)
  SELECT region, CASE WHEN n <= 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' ELSE '10+' END AS band, count(*) AS items FROM c GROUP BY ALL""")
def support_bins(spark: SparkSession, d: str) -> DataFrame:
    n = _events(spark, d).groupBy("region", "poi").agg(F.count_distinct(F.when(F.col("split") == "TL", F.col("trip"))).alias("n"))
    return n.groupBy("region", bands.support_band(F.col("n")).alias("band")).agg(F.count("*").alias("items"))
