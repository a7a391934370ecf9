"""Queries that compare feature sets, fields and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwright.functions import codes
from tripwright.operators import ablation, association, profile
from tripwright.plans.queries import VALID, M, _context
from tripwright.plans.registry import query
from tripwright.sources import mapping

SETS = {"context_only": ["segment", "priority", "month"], "poi_only": ["kind"], "context_plus_poi": ["segment", "priority", "month", "kind"], "popularity_free": ["segment", "month"]}
COMPARED = [("context_vs_poi", "context_only", "context_plus_poi"), ("fewer_vs_context", "popularity_free", "context_only"), ("poi_vs_context_plus_poi", "poi_only", "context_plus_poi")]
CTX = f"""{M}, ctx AS (SELECT row_number() OVER (ORDER BY area, poi, v.kind, v.feedback) AS id, t.split, t.segment, t.priority, strftime(t.start_at, '%m') AS month, CASE WHEN v.kind IN {VALID} THEN v.kind END AS kind,
  CASE WHEN v.feedback <> '6' THEN v.feedback END AS y, t.segment || chr(31) || CASE WHEN v.kind IN {VALID} THEN v.kind END AS joint FROM visits v JOIN trips t ON v.trip = t.trip)"""


FIELDS = ["segment", "priority", "month", "kind", "joint"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _context(spark, d).withColumn("y", codes.in_domain(F.col("feedback"), codes.FEEDBACK)).withColumn("kind", codes.in_domain(F.col("kind"), codes.VISIT_KIND))
    return association.with_joint(rows, "segment", "kind", "joint")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return ablation.patterns(_rows(spark, d), FIELDS, "y", F.col("split") == "VL")


def _paired(spark: SparkSession, d: str, sets: dict[str, list[str]], pairs: list[tuple[str, str, str]]) -> DataFrame:
    return ablation.paired(ablation.evaluate(_stats(spark, d), FIELDS, ablation.compared(sets, pairs))).drop("train_rows", "status")


def _nb(n: str, features: list[str], need: list[str]) -> str:
    """CTEs that end in acc_n: rows, accuracy and majority_accuracy of one feature set."""
    on, whole = ", ".join(features), " AND ".join(f"{c} IS NOT NULL" for c in [*need, "y"])
    return f"""tr_{n} AS (SELECT * FROM ctx WHERE split = 'TL' AND {whole}), te_{n} AS (SELECT * FROM ctx WHERE split = 'VL' AND {whole}), cl_{n} AS (SELECT y AS class, count(*) AS nc FROM tr_{n} GROUP BY ALL),
  tl_{n} AS (UNPIVOT (SELECT y, {on} FROM tr_{n}) ON {on} INTO NAME f VALUE v), tel_{n} AS (UNPIVOT (SELECT id, y, {on} FROM te_{n}) ON {on} INTO NAME f VALUE v),
  cv_{n} AS (SELECT y AS class, f, v, count(*) AS ncv FROM tl_{n} GROUP BY ALL), vo_{n} AS (SELECT f, count(DISTINCT v) AS vocab FROM tl_{n} GROUP BY ALL),
  sc_{n} AS (SELECT id, tel.y, cl.class, sum(ln((coalesce(ncv, 0) + 1) / (nc + vocab + 1)::DOUBLE)) + any_value(ln(nc / (SELECT sum(nc) FROM cl_{n})::DOUBLE)) AS s FROM tel_{n} tel CROSS JOIN cl_{n} cl JOIN vo_{n} USING (f) LEFT JOIN cv_{n} cv ON cv.class = cl.class AND cv.f = tel.f AND cv.v = tel.v GROUP BY ALL),
  pr_{n} AS (SELECT id, y, class FROM sc_{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, class) = 1),
  acc_{n} AS (SELECT count(*) AS rows, round(avg(CASE WHEN y = class THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN y = (SELECT class FROM cl_{n} ORDER BY nc DESC, class LIMIT 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS majority_accuracy FROM pr_{n})"""


def _need(left: str, right: str) -> list[str]:
    return list(dict.fromkeys(SETS[left] + SETS[right]))


@query(f"{CTX}, " + ", ".join(_nb(n, f, f) for n, f in SETS.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS features, *, round(accuracy - majority_accuracy, 6) AS delta FROM acc_{n}" for n in SETS))
def nb_ablation(spark: SparkSession, d: str) -> DataFrame:
    found = ablation.evaluate(_stats(spark, d), FIELDS, ablation.single(SETS))
    return found.select(F.col("run").alias("features"), "rows", "accuracy", "majority_accuracy", "delta")


@query(f"{CTX}, " + ", ".join(_nb(f"{n}_l", SETS[a], _need(a, b)) + ", " + _nb(f"{n}_r", SETS[b], _need(a, b)) for n, a, b in COMPARED) + " "
       + " UNION ALL ".join(f"SELECT '{n}' AS comparison, l.rows, l.accuracy AS left_accuracy, r.accuracy AS right_accuracy, round(r.accuracy - l.accuracy, 6) AS difference FROM acc_{n}_l l, acc_{n}_r r" for n, _, _ in COMPARED))
def pairwise_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d, SETS, COMPARED)


MAIN, JOINT = ["segment", "kind"], ["segment", "kind", "joint"]


@query(f"{CTX}, {_nb('l', MAIN, JOINT)}, {_nb('r', JOINT, JOINT)} SELECT l.rows, l.accuracy AS left_accuracy, r.accuracy AS right_accuracy, round(r.accuracy - l.accuracy, 6) AS difference FROM acc_l l, acc_r r")
def joint_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d, {"main": MAIN, "joint": JOINT}, [("joint", "main", "joint")]).drop("comparison")


AUDITED = ["segment", "priority", "month", "kind", "y"]


@query(f"""{CTX}, c AS (""" + " UNION ALL ".join(f"SELECT split, '{c}' AS field, {c} AS v, count(*) AS n FROM ctx GROUP BY ALL" for c in AUDITED) + """)
  SELECT split, field, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS present, count(v) AS cardinality, count_if(v IS NOT NULL AND n < 10) AS below, count_if(v IS NOT NULL AND n >= 10) AS at_least,
  round(max(n) FILTER (v IS NOT NULL) / sum(n) FILTER (v IS NOT NULL), 6) AS largest_share FROM c GROUP BY ALL""")
def availability_audit(spark: SparkSession, d: str) -> DataFrame:
    return association.availability(_rows(spark, d), AUDITED, ["split"])


ODD_CODES = ["1", "9", "7,8", "7;x", "7, 8", "3|", " 4", "11", "12", "77", "abc", "5/6", "1;9"]


@query(f"""SELECT s_suppkey, v AS value, CASE WHEN v IN ('7,8', '5/6') THEN 'multiple_exact_hwp_domain_codes_delimited' WHEN v = '7;x' THEN 'delimited_components_not_fully_mapped' WHEN v = '7, 8' THEN 'delimited_representation_with_whitespace' WHEN v = '3|' THEN 'delimited_representation_with_empty_component'
  WHEN v = '1;9' THEN 'multiple_exact_reference_codes_delimited' WHEN v = ' 4' THEN 'whitespace_or_format_representation' WHEN v IN ('1') THEN 'in_domain' WHEN v = '9' THEN 'reference_table_special_category' WHEN v = '11' THEN 'reference_table_entry_outside_manual_range' WHEN v = '12' THEN 'reference_entry_for_other_code_group'
  WHEN v = '77' THEN 'undocumented_numeric_code' ELSE 'undocumented_non_numeric_representation' END AS cause FROM (SELECT s_suppkey, ({ODD_CODES})[1 + s_suppkey % {len(ODD_CODES)}] AS v FROM supplier)""")
def anomaly_classes(spark: SparkSession, d: str) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, ODD_CODES)), (1 + F.col("s_suppkey") % len(ODD_CODES)).cast("int"))
    rows = mapping.table(spark, d, "supplier").select("s_suppkey", value.alias("value"))
    return rows.withColumn("cause", codes.anomaly(F.col("value"), ["1", "3", "4", "5", "6", "7", "8"], listed=["1", "9", "11"], special=["9"], elsewhere=["12"]))


SEGMENTS = "p AS (SELECT DISTINCT p_brand AS unit, p_size::VARCHAR AS v FROM part)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return mapping.table(spark, d, "part").select(F.col("p_brand").alias("unit"), "p_size")


@query(f"""WITH {SEGMENTS}, s AS (SELECT unit, string_agg(v, '|' ORDER BY v) AS signature FROM p GROUP BY ALL), g AS (SELECT signature, count(*) AS members FROM s GROUP BY ALL)
  SELECT unit, signature, members, CAST(row_ AS INT) AS "group" FROM s JOIN (SELECT *, row_number() OVER (ORDER BY members DESC, signature) AS row_ FROM g) USING (signature)""")
def schema_groups(spark: SparkSession, d: str) -> DataFrame:
    return profile.signatures(_segments(spark, d), "unit", "p_size")


@query(f"WITH {SEGMENTS} SELECT v AS value, count(*) AS n_units, count(*) = (SELECT count(DISTINCT unit) FROM p) AS everywhere FROM p GROUP BY ALL")
def region_presence(spark: SparkSession, d: str) -> DataFrame:
    return profile.presence(_segments(spark, d), "unit", "p_size")


@query(f"""{M}, b AS (SELECT CAST(i AS VARCHAR) AS code FROM range(1, 31) t(i) WHERE i NOT BETWEEN 14 AND 20), s AS (SELECT kind AS code, count(*) AS rows FROM visits GROUP BY ALL)
  SELECT code, b.code IS NOT NULL AS in_book, coalesce(rows, 0) AS rows FROM s FULL JOIN b USING (code)""")
def codebook_check(spark: SparkSession, d: str) -> DataFrame:
    book = spark.range(1, 31).where("id NOT BETWEEN 14 AND 20").select(F.col("id").cast("string").alias("code"))
    return profile.codebook_check(mapping.visits(spark, d), "kind", book)
