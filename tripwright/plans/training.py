"""Queries on the training frame, catalogue scoring, join states and audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwright.functions import codes
from tripwright.operators import audit, contract, dataset, split, training
from tripwright.operators.ranks import rank_in_buckets
from tripwright.plans.dataset import ITEM_KEY, RUN, TRIP_KEY, _context, _items
from tripwright.plans.evaluation import _sampling
from tripwright.plans.queries import CORE, DRAWS, PAIRS, SEED, SPLIT, VALID, VL, M, _core_parts, _events, _pairs
from tripwright.plans.registry import ORACLE_SQL, query
from tripwright.sources import mapping

# Features, frame, scoring

#: The columns of each feature group of an item.
GROUP_COLUMNS = {"category": ["p_type", "p_brand"], "size": ["p_size"], "region": ["region"], "popularity": ["popularity"], "kinds": ["kinds"], "price": ["price"]}
FEATURE_ITEMS = f"""p AS (SELECT region, poi, count(*) AS popularity, max(CASE WHEN kind IN {CORE} THEN kind END) AS kinds FROM seen WHERE split = 'TL' GROUP BY ALL),
  items AS (SELECT m.*, popularity, kinds FROM (SELECT r_name AS region, CAST(p_partkey AS VARCHAR) AS poi, p_type, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS p_size, CASE WHEN p_retailprice > 1000 THEN p_retailprice END AS price
    FROM part JOIN region ON p_partkey % 5 = r_regionkey) m LEFT JOIN p ON p.region = m.region AND p.poi = m.poi)"""


def _feature_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    seen = _events(spark, d).where("split = 'TL'").groupBy("region", "poi").agg(F.count("*").alias("popularity"), F.max(codes.in_domain(F.col("kind"), codes.TOURISM_CORE)).alias("kinds"))
    master = mapping.table(spark, d, "part").withColumn("r_regionkey", k % 5).join(mapping.table(spark, d, "region"), "r_regionkey")
    master = master.select(F.col("r_name").alias("region"), k.cast("string").alias("poi"), "p_type", F.when(k % 9 != 0, F.col("p_brand")).alias("p_brand"), F.when(k % 4 != 0, F.col("p_size")).alias("p_size"), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("price"))
    return master.join(seen, ["region", "poi"], "left")


@query(f"""{M}, {FEATURE_ITEMS}, s AS (SELECT m, list_filter([{", ".join(f"CASE WHEN m & {1 << k} > 0 THEN '{g}' END" for k, g in enumerate(GROUP_COLUMNS))}], lambda x: x IS NOT NULL) AS members FROM range(1, {1 << len(GROUP_COLUMNS)}) t(m))
  SELECT m AS mask, array_to_string(members, '|') AS members, CAST(len(members) AS INT) AS n, count(poi) AS items FROM s LEFT JOIN items ON {" AND ".join(f"(NOT list_contains(members, '{g}') OR ({' AND '.join(f'{c} IS NOT NULL' for c in cs)}))" for g, cs in GROUP_COLUMNS.items())} GROUP BY ALL""")
def feature_power_set(spark: SparkSession, d: str) -> DataFrame:
    return training.power_set(_feature_items(spark, d), GROUP_COLUMNS)


@query(f"""{M}, {VL}, n AS (SELECT region, query, count(*) AS n FROM rel SEMI JOIN cat USING (region, poi) GROUP BY ALL), z AS (SELECT region, count(*) AS size FROM cat GROUP BY ALL),
  c AS (SELECT r AS ratio, count(*) AS queries, CAST(sum(n) AS BIGINT) AS positives, CAST(sum(least(n * r, size - n)) AS BIGINT) AS negatives FROM n JOIN z USING (region), (SELECT unnest([1, 2, 4, 8, 16])::BIGINT AS r) GROUP BY r)
  SELECT s AS strategy, ratio, o AS objective, queries, positives, negatives FROM c, (SELECT unnest(['uniform', 'popularity', 'mixed', 'hard']) AS s), (SELECT unnest(['pairwise', 'lambda', 'listwise']) AS o)""")
def search_space(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    positives = e.where("split = 'VL'").select("region", F.col("trip").alias("query"), "poi")
    return training.search_space(positives, e.where("split = 'TL'"), ["uniform", "popularity", "mixed", "hard"], [1, 2, 4, 8, 16], ["pairwise", "lambda", "listwise"])


@query(f"""{M}, p AS (SELECT region, poi, count(*) AS n, list(DISTINCT kind) AS kinds FROM seen WHERE split = 'TL' GROUP BY ALL)
  SELECT m.poi, coalesce(p_brand, '__MISSING__') AS category, coalesce(array_to_string(list_sort(kinds), '|'), '__MISSING__') AS codes, round(ln(1 + coalesce(n, 0)::DOUBLE), 9) AS log_count
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS poi, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS p_brand FROM part) m LEFT JOIN p ON p.poi = m.poi AND p.region = 'ASIA'""")
def feature_values(spark: SparkSession, d: str) -> DataFrame:
    p = _events(spark, d).where("split = 'TL' AND region = 'ASIA'").groupBy("poi").agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))
    m = mapping.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("poi"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_brand")).alias("p_brand"))
    return m.join(p, "poi", "left").select("poi", training.feature_value("p_brand", "category").alias("category"), training.feature_value("kinds", "codes").alias("codes"), F.round(training.feature_value("n", "log_count"), 9).alias("log_count"))


INNER = f"""{SPLIT}, c AS (SELECT region, poi, count(DISTINCT trip) AS n FROM pairs JOIN parts USING (region, traveler) WHERE split = 'TL' AND part = 'inner-train' GROUP BY ALL),
  train AS (SELECT s.* FROM seen s JOIN parts USING (region, traveler) WHERE s.split = 'TL' AND part = 'inner-train' AND kind IN {VALID}), core AS (SELECT DISTINCT region, trip, poi FROM train WHERE kind IN {CORE}),
  k AS (SELECT region, poi, string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) AS kinds FROM (SELECT DISTINCT region, poi, CAST(kind AS INT) AS k FROM train JOIN core USING (region, trip, poi)) GROUP BY ALL),
  inn AS (SELECT i.region, i.poi, coalesce(n, 0) AS inner_count, kinds AS inner_kinds FROM (SELECT DISTINCT region, poi FROM pairs WHERE split = 'TL' AND region = 'ASIA') i LEFT JOIN c USING (region, poi) LEFT JOIN k USING (region, poi))"""


def _inner(spark: SparkSession, d: str) -> DataFrame:
    asia = F.col("region") == "ASIA"
    pairs, events, parts = _pairs(spark, d).where("split = 'TL'").where(asia), _events(spark, d).where("split = 'TL'").where(asia), _core_parts(spark, d).where(asia)
    items = pairs.select("region", "poi", F.lit(-1).alias("inner_count")).distinct()  # what comes in is dropped
    return training.inner_features(items, training.require_split(pairs), events, parts)


@query(f"{PAIRS}, {INNER} SELECT * FROM inn")
def inner_features(spark: SparkSession, d: str) -> DataFrame:
    return _inner(spark, d)


@query(f"{PAIRS}, {INNER} SELECT poi, CAST(row_number() OVER (ORDER BY poi) AS BIGINT) AS item_index, round(ln(1 + inner_count::DOUBLE), 9) AS popularity, coalesce(inner_kinds, '__MISSING__') AS kinds FROM inn")
def prepared_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The sorted inventory of a region with its place in it and normalised item columns."""
    items = _inner(spark, d)
    buckets = {"_first": (F.substring("poi", 1, 2), F.col("_first"))}
    ranked = rank_in_buckets(items, ["region"], buckets, [F.col("poi")], "item_index")
    return ranked.select("poi", F.col("item_index").cast("long").alias("item_index"), F.round(training.feature_value("inner_count", "log_count"), 9).alias("popularity"), training.feature_value("inner_kinds", "category").alias("kinds"))


FRAME = f"""{VL}, {DRAWS.replace('n * 3', 'n * 2').replace('w AS (SELECT region, query, count(*) AS n FROM rel GROUP BY ALL)', 'w AS (SELECT region, query, count(*) AS n FROM rel SEMI JOIN cat USING (region, poi) GROUP BY ALL)').replace('FROM rel WHERE rel.region', 'FROM ins rel WHERE rel.region')}"""
FRAME = FRAME.replace("places AS", "ins AS (SELECT * FROM rel SEMI JOIN cat USING (region, poi)), places AS", 1) + """, neg AS (SELECT region, query, poi FROM draws WHERE k <= n),
  fr AS (SELECT region, query, poi, 1 AS label FROM ins WHERE (region, query) IN (SELECT (region, query) FROM neg) UNION ALL SELECT *, 0 FROM neg),
  frame AS (SELECT f.region, f.query, f.poi, f.label, round(ln(1 + w::DOUBLE), 9) AS popularity, strftime(start_at, '%m') AS month, t.traveler FROM fr f JOIN (SELECT region, poi, count(*) AS w FROM seen WHERE split = 'TL' GROUP BY ALL) w USING (region, poi) JOIN trips t ON t.trip = f.query AND t.region = f.region)"""


def _frame(spark: SparkSession, d: str) -> DataFrame:
    positives, weights = _sampling(spark, d)
    items = weights.select("region", "poi", F.round(training.feature_value("w", "log_count"), 9).alias("popularity"))
    context = mapping.trips(spark, d).select("region", F.col("trip").alias("query"), F.date_format("start_at", "MM").alias("month"), "traveler")
    return training.training_frame(positives, weights, items, context, 1, SEED)


@query(f"{M}, {FRAME} SELECT * FROM frame")
def training_frame(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d)


@query(f"{M}, {FRAME}, g AS (SELECT region, query, count(*) AS n, count_if(label = 1 AND poi NOT LIKE '%7') AS p, count_if(poi LIKE '%7') AS odd FROM frame GROUP BY ALL) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positives, count_if(p = 0 OR p = n) AS one_sided, CAST(sum(odd) AS BIGINT) AS odd_labels FROM g")
def group_layout(spark: SparkSession, d: str) -> DataFrame:
    """A frame in which the labels of places ending in 7 are spoilt, some to 2 and some to nothing."""
    spoilt = F.when(F.col("poi").like("%77"), None).when(F.col("poi").like("%7"), 2).otherwise(F.col("label"))
    return training.group_layout(_frame(spark, d).withColumn("label", spoilt))


@query(f"""{M}, {FRAME}, {SPLIT}, it AS (SELECT region, poi, round(ln(1 + count(*)::DOUBLE), 9) AS popularity FROM seen WHERE split = 'TL' AND poi NOT LIKE '%7' GROUP BY ALL)
  SELECT 'item_unknown' AS problem, count(*) AS n FROM frame ANTI JOIN it USING (region, poi) UNION ALL SELECT 'features_differ', count(*) FROM frame f JOIN it USING (region, poi) WHERE f.popularity + CASE WHEN poi LIKE '%3' THEN 1 ELSE 0 END <> it.popularity
  UNION ALL SELECT 'outside_inner_train', count(*) FROM frame WHERE (region, traveler) NOT IN (SELECT (region, traveler) FROM parts WHERE part = 'inner-train')""")
def frame_provenance(spark: SparkSession, d: str) -> DataFrame:
    """A frame of validation trips, with places ending in 3 altered, against features that lack the places ending in 7."""
    items = _sampling(spark, d)[1].where("poi NOT LIKE '%7'").select("region", "poi", F.round(training.feature_value("w", "log_count"), 9).alias("popularity"))
    frame = _frame(spark, d).withColumn("popularity", F.col("popularity") + F.when(F.col("poi").like("%3"), 1.0).otherwise(0.0))
    return training.unbound(frame, items, _core_parts(spark, d), ["popularity"])


def _linear(q: pd.DataFrame, i: pd.DataFrame) -> np.ndarray:
    """Popularity, and a bonus where the size of a place suits the month."""
    fits = (i["size"].to_numpy() % 12 + 1)[None, :] == q["month"].to_numpy()[:, None]
    return np.round(i["popularity"].to_numpy()[None, :] + 0.5 * fits, 9)


@query(f"""{M}, i AS (SELECT region, poi, round(ln(1 + count(*)::DOUBLE), 9) AS popularity, any_value(p_size) AS size FROM seen JOIN part ON CAST(p_partkey AS VARCHAR) = poi WHERE split = 'TL' GROUP BY ALL),
  q AS (SELECT DISTINCT region, trip AS query, month(start_at) AS month FROM trips WHERE split = 'VL'),
  s AS (SELECT region, query, poi, round(popularity + CASE WHEN size % 12 + 1 = month THEN 0.5 ELSE 0 END, 9) AS score FROM q JOIN i USING (region))
  SELECT *, CAST(row_number() OVER (PARTITION BY region, query ORDER BY score DESC, poi) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def catalogue_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Every place of the region for every validation trip."""
    e = _events(spark, d).where("split = 'TL'").groupBy("region", "poi").agg(F.count("*").alias("w"))
    sizes = mapping.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("poi"), F.col("p_size").alias("size"))
    items = e.join(sizes, "poi").select("region", "poi", "size", F.round(training.feature_value("w", "log_count"), 9).alias("popularity"))
    asked = mapping.trips(spark, d).where("split = 'VL'").select("region", F.col("trip").alias("query"), F.month("start_at").alias("month")).distinct()
    return training.score_catalogue(asked, items, _linear, 10, reads=["month"])


# Integrity and reconciliation


def _sub(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


@query(f"""WITH ctx AS (SELECT * FROM {_sub("dataset_trip_context")} WHERE trip_key NOT LIKE '0%'), i0 AS {_sub("dataset_item_features")}, it AS (SELECT * FROM i0 UNION ALL SELECT * FROM i0 WHERE item_key LIKE '1%'), f0 AS {_sub("dataset_interactions")},
  f AS (SELECT * REPLACE (CASE WHEN trip_key LIKE '3%' THEN 'elsewhere' ELSE region END AS region, CASE WHEN item_key LIKE '4%' THEN 0 ELSE observed_positive END AS observed_positive, CASE WHEN item_key LIKE '5%' THEN 0 ELSE repeat_visit_count END AS repeat_visit_count) FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE item_key LIKE '2%'))
  SELECT 'trip_missing' AS "check", count(*) AS n FROM f ANTI JOIN ctx USING (trip_key) UNION ALL SELECT 'item_missing', count(*) FROM f ANTI JOIN it USING (item_key)
  UNION ALL SELECT 'trip_repeated', count(*) FROM (SELECT trip_key FROM ctx GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'item_repeated', count(*) FROM (SELECT item_key FROM it GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'interaction_repeated', count(*) FROM (SELECT trip_key, item_key FROM f GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'trip_disagrees', count(*) FROM f JOIN ctx c USING (trip_key) WHERE f.region <> c.region OR f.split <> c.split
  UNION ALL SELECT 'not_positive', count(*) FROM f WHERE observed_positive <> 1 UNION ALL SELECT 'no_visit', count(*) FROM f WHERE repeat_visit_count < 1""")
def dataset_integrity(spark: SparkSession, d: str) -> DataFrame:
    """The three tables, broken in eight ways, and how often each is found."""
    items, facts = _items(spark, d), dataset.interactions(_pairs(spark, d), RUN)
    facts = facts.union(facts.where("item_key LIKE '2%'")).withColumns({
        "region": F.when(F.col("trip_key").like("3%"), "elsewhere").otherwise(F.col("region")), "observed_positive": F.when(F.col("item_key").like("4%"), 0).otherwise(F.col("observed_positive")),
        "repeat_visit_count": F.when(F.col("item_key").like("5%"), 0).otherwise(F.col("repeat_visit_count")),
    })
    return dataset.broken(_context(spark, d).where("trip_key NOT LIKE '0%'"), items.union(items.where("item_key LIKE '1%'")), facts)


@query(f"""{M}, w AS (SELECT region, split, count(*) AS n FROM visits v JOIN trips t ON v.trip = t.trip GROUP BY ALL), p AS (SELECT region, split, count(*) AS n FROM seen GROUP BY ALL)
  SELECT region, split, p.n AS parts, w.n AS whole FROM w FULL JOIN p USING (region, split) WHERE coalesce(p.n, 0) <> coalesce(w.n, 0)""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Visits with a place against all visits with an owner: the groups that do not add up, for want of those without a place."""
    keys = ["region", "split"]
    owned = mapping.visits(spark, d).join(contract.single_owner(mapping.trips(spark, d)), "trip").groupBy(*keys).agg(F.count("*").alias("n"))
    return audit.unreconciled(_events(spark, d).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("n", F.col("n").cast("long")), owned, keys)


@query(f"""{M}, u AS (SELECT DISTINCT region, trip FROM trips WHERE split = 'TL'), parts AS (SELECT region, trip, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY sha256(encode('{SEED}') || unhex('00') || encode(trip)), trip)
    <= greatest(1, least(count(*) OVER (PARTITION BY region) - 1, CAST(round_even(count(*) OVER (PARTITION BY region) * 0.2::DOUBLE, 0) AS BIGINT))) THEN 'inner-validation' ELSE 'inner-train' END AS part FROM u)
  SELECT region, count(*) AS travelers, count_if(k > 1) AS in_both FROM (SELECT region, traveler, count(DISTINCT part) AS k FROM trips JOIN parts USING (region, trip) GROUP BY ALL) GROUP BY ALL""")
def traveler_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Travelers that a split by trip puts into both parts."""
    trips = mapping.trips(spark, d).where("split = 'TL'")
    per = trips.join(split.hash_split(trips, "trip", SEED), ["region", "trip"]).groupBy("region", "traveler").agg(F.count_distinct("part").alias("k"))
    return per.groupBy("region").agg(F.count("*").alias("travelers"), F.count_if(F.col("k") > 1).alias("in_both"))


# Masters and join states

MASTER = """m0 AS (SELECT r_name AS region, CAST(p_partkey AS VARCHAR) AS poi, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '99999' ELSE CAST(11000 + p_partkey % 25 AS VARCHAR) END AS sgg, p_partkey FROM part CROSS JOIN region WHERE p_partkey % 7 > 0 AND (p_partkey + r_regionkey) % 3 < 2),
  master AS (SELECT region, poi, sgg FROM m0 UNION ALL SELECT region, poi, sgg FROM m0 WHERE p_partkey % 11 = 0), codes AS (SELECT CAST(11000 + n_nationkey AS VARCHAR) AS code FROM nation),
  vs AS (SELECT t.region, t.split, v.trip, v.area, v.poi, v.kind, CASE WHEN v.kind = '5' THEN '' WHEN v.kind = '6' THEN 'x' WHEN v.feedback = '1' THEN '11024' WHEN v.poi <> '' THEN CAST(11000 + CAST(v.poi AS BIGINT) % 25 AS VARCHAR) ELSE '' END AS sgg FROM visits v JOIN trips t ON v.trip = t.trip)"""


def _master(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("p_partkey")
    rows = mapping.table(spark, d, "part").crossJoin(F.broadcast(mapping.table(spark, d, "region"))).where("p_partkey % 7 > 0 AND (p_partkey + r_regionkey) % 3 < 2")  # five regions
    sgg = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "99999").otherwise((11000 + key % 25).cast("string"))
    one = rows.select(F.col("r_name").alias("region"), key.cast("string").alias("poi"), sgg.alias("sgg"), "p_partkey")
    master = one.union(one.where("p_partkey % 11 = 0")).drop("p_partkey")
    visits = mapping.visits(spark, d).join(contract.single_owner(mapping.trips(spark, d)), "trip")
    said = F.when(F.col("kind") == "5", "").when(F.col("kind") == "6", "x").when(F.col("feedback") == "1", "11024").when(F.col("poi") != "", (11000 + F.col("poi").try_cast("long") % 25).cast("string")).otherwise("")
    return visits.withColumn("sgg", said), master, mapping.table(spark, d, "nation").select((11000 + F.col("n_nationkey")).cast("string").alias("code"))


STATES = f"""mm AS (SELECT region, poi, count(*) AS m, nullif(min(sgg), '') AS m_raw FROM master GROUP BY ALL),
  base AS (SELECT region, split, nullif(poi, '') AS poi, CASE WHEN kind IN {VALID} THEN kind END AS kind, nullif(sgg, '') AS raw, CASE WHEN sgg IN (SELECT code FROM codes) THEN sgg END AS visit FROM vs),
  co AS (SELECT *, unnest(list_filter(['all_valid_visits', CASE WHEN kind IN {CORE} THEN 'tourism_core' WHEN kind IS NOT NULL THEN 'non_tourism' END], lambda x: x IS NOT NULL)) AS cohort FROM base),
  per AS (SELECT region, split, cohort, poi, count(DISTINCT visit) AS k, min(visit) AS one FROM co WHERE poi IS NOT NULL GROUP BY ALL),
  j AS (SELECT c.*, m, m_raw, CASE WHEN m = 1 AND m_raw IN (SELECT code FROM codes) THEN m_raw END AS m_code, CASE WHEN c.poi IS NULL THEN CASE WHEN visit IS NULL THEN 0 ELSE 1 END ELSE k END AS k, CASE WHEN c.poi IS NULL THEN visit ELSE one END AS one
    FROM co c LEFT JOIN per USING (region, split, cohort, poi) LEFT JOIN mm USING (region, poi)),
  st AS (SELECT *, CASE WHEN poi IS NULL THEN 'poi_id_missing' WHEN m = 1 THEN 'unique' WHEN m > 1 THEN 'ambiguous' ELSE 'missing' END AS join_state,
    CASE WHEN m_code IS NOT NULL THEN 'valid' WHEN m = 1 AND m_raw IS NOT NULL THEN 'invalid_unregistered' WHEN m = 1 THEN 'missing' WHEN m > 1 THEN 'unavailable_ambiguous_join' ELSE 'unavailable_no_unique_master' END AS master_state,
    CASE WHEN visit IS NOT NULL THEN 'valid' WHEN raw IS NOT NULL THEN 'invalid_unregistered' ELSE 'missing' END AS visit_state,
    CASE WHEN poi IS NULL THEN 'not_applicable' WHEN k > 1 THEN 'multiple_valid_values' WHEN k = 1 THEN 'unique_valid_value' ELSE 'no_valid_value' END AS aggregate_state FROM j),
  states AS (SELECT *, CASE WHEN k > 1 OR (k = 1 AND m_code <> one) THEN 'value_conflicts' WHEN k = 1 AND visit IS NOT NULL THEN 'direct' WHEN k = 1 THEN 'poi_aggregate_filled' WHEN m_code IS NOT NULL THEN 'master_filled'
    WHEN visit_state = 'invalid_unregistered' OR master_state = 'invalid_unregistered' THEN 'invalid_unregistered' WHEN join_state <> 'unique' THEN 'poi_join_missing_or_ambiguous' WHEN master_state = 'missing' AND raw IS NULL THEN 'both_missing' ELSE 'master_missing' END AS outcome FROM st)"""


@query(f"""{M}, {MASTER}, {STATES} """ + " UNION ALL ".join(f"SELECT region, split, cohort, '{f}' AS family, {f} AS state, count(*) AS n FROM states GROUP BY ALL" for f in ("visit_state", "join_state", "master_state", "aggregate_state", "outcome"))
       + " UNION ALL SELECT region, split, cohort, 'poi_aggregate_state', aggregate_state, count(*) FROM (SELECT DISTINCT region, split, cohort, poi, aggregate_state FROM states WHERE poi IS NOT NULL) GROUP BY ALL")
def sgg_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.sgg_audit(audit.sgg_states(*_master(spark, d)))


@query(f"{M}, {MASTER}, c AS (SELECT region, poi, count(*) AS m FROM master GROUP BY ALL) SELECT region, CASE WHEN poi = '' THEN 'poi_id_missing' WHEN m = 1 THEN 'unique' WHEN m > 1 THEN 'ambiguous' ELSE 'missing' END AS join_state, count(*) AS n FROM vs LEFT JOIN c USING (region, poi) GROUP BY ALL")
def master_join_states(spark: SparkSession, d: str) -> DataFrame:
    visits, master, _ = _master(spark, d)
    return audit.join_state(visits, master).groupBy("region", "join_state").agg(F.count("*").alias("n"))


@query(f"""{M}, {MASTER}, miss AS (SELECT DISTINCT region, poi FROM vs WHERE poi <> '' AND (region, poi) NOT IN (SELECT (region, poi) FROM master)), k AS (SELECT i.region, i.poi, count(DISTINCT CASE WHEN m.region <> i.region THEN m.region END) AS k FROM miss i LEFT JOIN master m ON m.poi = i.poi GROUP BY ALL)
  SELECT CASE k WHEN 0 THEN 'in_no_other_region' WHEN 1 THEN 'in_one_other_region' ELSE 'in_several_other_regions' END AS state, count(*) AS n FROM k GROUP BY ALL""")
def cross_region_lookup(spark: SparkSession, d: str) -> DataFrame:
    visits, master, _ = _master(spark, d)
    return audit.other_regions(audit.join_state(visits, master).where("join_state = 'missing'"), master)


@query(f"{M}, {MASTER}, c AS (SELECT region, poi, count(*) AS n FROM master GROUP BY ALL), a AS (SELECT count(*) AS candidate_keys, count_if(n = 1) AS unique_keys, count_if(n > 1) AS duplicate_keys FROM c) SELECT *, " + ", ".join(f"CASE WHEN {c} <= 0 THEN '0' WHEN {c} < 10 THEN '<10' ELSE '10+' END AS {c}_bucket" for c in ("candidate_keys", "unique_keys", "duplicate_keys")) + " FROM a")
def master_key_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.key_audit(_master(spark, d)[1], ["region", "poi"])


@query(f"{M}, {MASTER} SELECT region, poi, any_value(CASE WHEN sgg IN (SELECT code FROM codes) THEN sgg END) AS sgg FROM master GROUP BY region, poi HAVING count(*) = 1")
def unique_master(spark: SparkSession, d: str) -> DataFrame:
    """Master rows whose key stands once, with the district code where it is registered."""
    _, master, codes = _master(spark, d)
    known = codes.select(F.col("code").alias("_c"))
    return audit.unique_master(master, ["region", "poi"]).join(F.broadcast(known), F.col("sgg") == F.col("_c"), "left").select("region", "poi", F.col("_c").alias("sgg"))  # 25 codes


@query(f"""WITH {mapping.SQL}, c AS (SELECT CAST(l_orderkey AS VARCHAR) AS trip, CAST(l_suppkey % 15 AS VARCHAR) AS relation FROM lineitem WHERE l_linenumber > 2)
  SELECT trip, any_value(r) AS relations FROM (SELECT DISTINCT trip FROM trips) LEFT JOIN (SELECT trip, string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) AS r FROM (SELECT DISTINCT trip, CAST(relation AS INT) AS k FROM c WHERE CAST(relation AS INT) BETWEEN 1 AND 11) GROUP BY ALL) USING (trip) GROUP BY trip""")
def companions(spark: SparkSession, d: str) -> DataFrame:
    rows = mapping.table(spark, d, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").cast("string").alias("trip"), (F.col("l_suppkey") % 15).cast("string").alias("relation"))
    return audit.companions(mapping.trips(spark, d), rows)


@query(f"""{M}, u AS (SELECT r_name AS region, CAST(c_custkey AS VARCHAR) AS traveler, c_mktsegment AS style FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT region, split, style, count(*) AS trips, count(DISTINCT traveler) AS travelers FROM trips JOIN u USING (region, traveler) WHERE CAST(traveler AS BIGINT) % 5 > 0 GROUP BY ALL""")
def traveler_context(spark: SparkSession, d: str) -> DataFrame:
    """Trips with their traveler's master row; every fifth traveler stands twice and has none."""
    t = lambda n: mapping.table(spark, d, n)
    u = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    u = u.select(F.col("r_name").alias("region"), F.col("c_custkey").cast("string").alias("traveler"), F.col("c_mktsegment").alias("style"), "c_custkey")
    master = u.union(u.where("c_custkey % 5 = 0")).drop("c_custkey")
    return audit.with_traveler(mapping.trips(spark, d), master, ["style"]).groupBy("region", "split", "style").agg(F.count("*").alias("trips"), F.count_distinct("traveler").alias("travelers"))


@query(f"""{M}, k AS (SELECT region, trip, poi, bool_or(kind IN {CORE}) AS core, bool_or(kind IN {VALID}) AS valid FROM seen GROUP BY ALL), c AS (SELECT region, CASE WHEN core THEN 'tourism_core' WHEN valid THEN 'known_non_tourism_only' ELSE 'actual_visit_type_unresolved' END AS class, count(*) AS n FROM k GROUP BY ALL)
  SELECT region, class, n AS count, CAST(sum(n) OVER (PARTITION BY region) AS BIGINT) AS denominator, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY region), 2) AS percent FROM c""")
def pair_classes(spark: SparkSession, d: str) -> DataFrame:
    pairs = _events(spark, d).groupBy("region", "trip", "poi").agg(F.collect_set("kind").alias("kinds")).withColumn("class", audit.pair_class("kinds"))
    counts, totals = pairs.groupBy("region", "class").agg(F.count("*").alias("n")), pairs.groupBy("region").agg(F.count("*").alias("total"))
    return counts.join(totals, "region").select("region", "class", audit.rate(F.col("n"), F.col("total")).alias("r")).select("region", "class", "r.*")


# Catalogue

ITEMS = """items AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 5 = 0 THEN '99' ELSE CAST(p_size % 4 AS VARCHAR) END AS type, p_partkey % 3 AS a, p_partkey % 7 AS b, CAST(p_partkey % 25 AS VARCHAR) AS district FROM part),
  req AS (SELECT n_nationkey AS request, n_regionkey AS region, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END AS district FROM nation),
  reasons AS (SELECT request, item, CASE WHEN region = 4 THEN 'request_region_unmapped' WHEN type NOT IN ('0', '1', '2') THEN 'unsupported_content_type' WHEN NOT (a = region OR b = region OR a = region + 1 OR b = region + 1) THEN 'outside_request_region'
    WHEN req.district = '' THEN 'request_district_invalid' WHEN req.district <> items.district THEN 'outside_request_district' ELSE 'eligible' END AS reason FROM items CROSS JOIN req)"""

def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    key = F.col("p_partkey")
    items = mapping.table(spark, d, "part").select(key.alias("item"), F.when(key % 5 == 0, "99").otherwise((F.col("p_size") % 4).cast("string")).alias("type"), F.array((key % 3).cast("string"), (key % 7).cast("string")).alias("region_codes"), F.array((key % 25).cast("string")).alias("district_codes"))
    n = F.col("n_nationkey")
    requests = mapping.table(spark, d, "nation").select(n.alias("request"), F.col("n_regionkey").alias("region"), F.when(n % 4 == 1, "").when(n % 4 > 1, n.cast("string")).alias("district"))
    regions = mapping.table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("region"), F.array(F.col("r_regionkey").cast("string"), (F.col("r_regionkey") + 1).cast("string")).alias("codes"))
    return items, requests, regions, ["0", "1", "2"]


@query(f"WITH {ITEMS}, u AS (SELECT request, unnest({audit.REASONS}) AS reason FROM req), c AS (SELECT request, reason, count(*) AS n FROM reasons GROUP BY ALL) SELECT request, reason, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM items)::DOUBLE, 6) AS share FROM u LEFT JOIN c USING (request, reason)")
def catalog_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of eligibility by request, every reason listed."""
    return audit.funnel(audit.eligibility_counts(*_asked(spark, d)), ["request"], "reason", audit.REASONS)


@query(f"""WITH {ITEMS}, f AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_quantity > 40), c AS (SELECT request, count_if(reason = 'eligible') AS eligible, count_if(reason = 'eligible' AND item IN (SELECT item FROM f)) AS found FROM reasons GROUP BY ALL)
  SELECT *, CASE WHEN eligible = 0 THEN 'privacy_limited' WHEN eligible < 10 OR found BETWEEN 1 AND 9 THEN '<10/suppressed' WHEN found / eligible < 0.1 THEN '0-<10%' WHEN found / eligible < 0.25 THEN '10-<25%' WHEN found / eligible < 0.5 THEN '25-<50%' WHEN found / eligible < 0.75 THEN '50-<75%' WHEN found / eligible < 0.9 THEN '75-<90%' ELSE '90-100%' END AS band FROM c""")
def request_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = mapping.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("item")).distinct()
    asked = _asked(spark, d)
    return audit.request_coverage(audit.eligible_pairs(*asked), asked[1], found)


SIGNALS = """sig AS (SELECT l_partkey AS poi, CASE WHEN l_partkey % 6 = 0 THEN l_linestatus WHEN l_partkey % 6 = 1 AND l_linenumber > 3 THEN ' Rail ' ELSE 'rail' END AS name, CASE WHEN l_partkey % 5 = 0 THEN l_returnflag ELSE 'A' END AS sgg,
  CASE WHEN l_partkey % 4 = 0 AND l_linenumber % 2 = 0 THEN '' WHEN l_partkey % 4 = 1 AND l_linenumber % 2 = 0 THEN 'y' WHEN l_partkey % 4 = 2 AND l_linenumber % 2 = 0 THEN 'z' ELSE 'x' END AS lot, CASE WHEN l_partkey % 4 = 1 AND l_linenumber % 2 = 0 THEN 'x' WHEN l_partkey % 4 = 1 THEN 'y' ELSE '' END AS road FROM lineitem)"""


@query(f"""WITH {SIGNALS}, f AS (SELECT poi, name, sgg, lot, road, lower(trim(name)) AS n, lower(sgg) AS s, lot AS l, road AS r FROM sig),
  g AS (SELECT poi, count(DISTINCT (name, sgg, lot, road)) AS raws, count(DISTINCT (n, s, l, r)) AS rows, count(DISTINCT n) > 1 AS dn, count(DISTINCT s) > 1 AS ds, count(DISTINCT (l, r)) > 1 AS da, count(DISTINCT (l <> '' OR r <> '')) > 1 AS dp,
    count(DISTINCT list_sort(list_distinct(list_filter([l, r], lambda x: x <> '')))) AS unions FROM f GROUP BY ALL),
  k AS (SELECT poi, CASE WHEN raws > 1 AND rows <= 1 THEN 'whitespace_only_differs' WHEN rows <= 1 THEN 'no_variation' WHEN dn::INT + ds::INT + (da OR dp)::INT > 1 THEN 'multiple_meaningful_fields_differ' WHEN dn THEN 'name_differs' WHEN ds THEN 'sgg_only_differs'
    WHEN dp THEN 'address_presence_differs' WHEN da AND unions = 1 THEN 'road_lot_representation_only_differs' WHEN da THEN 'address_value_differs' ELSE 'other_signal_variation' END AS variation FROM g) SELECT variation, count(*) AS n FROM k GROUP BY ALL""")
def signal_variation(spark: SparkSession, d: str) -> DataFrame:
    key, line = F.col("l_partkey"), F.col("l_linenumber")
    even = line % 2 == 0
    rows = mapping.table(spark, d, "lineitem").select(
        key.alias("poi"), F.when(key % 6 == 0, F.col("l_linestatus")).when((key % 6 == 1) & (line > 3), " Rail ").otherwise("rail").alias("name"), F.when(key % 5 == 0, F.col("l_returnflag")).otherwise("A").alias("sgg"),
        F.when((key % 4 == 0) & even, "").when((key % 4 == 1) & even, "y").when((key % 4 == 2) & even, "z").otherwise("x").alias("lot"), F.when((key % 4 == 1) & even, "x").when(key % 4 == 1, "y").otherwise("").alias("road"),
    )
    sets = audit.signal_sets(rows, ["poi"], ["name", "sgg", "lot", "road"])
    return audit.variation(sets, "name", "sgg", ["lot", "road"]).groupBy("variation").agg(F.count("*").alias("n"))
