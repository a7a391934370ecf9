"""Queries on what a profile may show."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwright.functions import bands
from tripwright.operators import disclosure, profile, publish
from tripwright.plans.queries import PROFILED, _profiled
from tripwright.plans.registry import query
from tripwright.sources import mapping


def _words(words: list[str]) -> str:
    return "'(^|_)(" + "|".join(words) + ")($|_)'"


KINDS = {"customer": [("c_custkey", "integer"), ("c_name", "varchar"), ("c_nationkey", "integer"), ("c_mktsegment", "varchar"), ("c_acctbal", "float")],
         "part": [("p_partkey", "integer"), ("p_name", "varchar"), ("p_brand", "varchar"), ("p_type", "varchar"), ("p_size", "integer"), ("p_retailprice", "float")]}


def _policy(c: str, kind: str, table: str) -> str:
    number = kind in ("integer", "float")
    low, high = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if number else ("NULL::DOUBLE", "NULL::DOUBLE")
    return f"""SELECT '{c}' AS "column", '{kind}' AS class, CASE WHEN count({c}) = 0 THEN 'all_null' WHEN regexp_matches('{c}', {_words(publish.COORDINATE)}) THEN 'suppressed:coordinate_name' WHEN regexp_matches('{c}', {_words(publish.IDENTIFIER)}) THEN 'suppressed:identifier_name'
  WHEN regexp_matches('{c}', {_words(publish.TEXT)}) THEN 'suppressed:name_or_text_like' WHEN '{kind}' = 'float' AND {low} >= -180 AND {high} <= 180 AND count(DISTINCT {c}) / count({c}) >= 0.5 THEN 'suppressed:coordinate_like_range'
  WHEN '{kind}' = 'integer' AND {low} >= 946684800 AND {high} <= 4102444800 THEN 'suppressed:epoch_like' WHEN '{kind}' = 'integer' AND count(DISTINCT {c}) / count({c}) >= 0.9 THEN 'suppressed:row_unique_integer'
  WHEN '{kind}' = 'datetime' OR '{kind}' = 'varchar' AND count_if(regexp_full_match(trim({c}::VARCHAR), '[0-9]{{4}}[-./]?[0-9]{{2}}[-./]?[0-9]{{2}}')) >= 0.95 * count({c}) OR '{kind}' = 'integer' AND {low} >= 19000101 AND {high} <= 21001231 AND count_if(({c}::VARCHAR)[5:6] BETWEEN '01' AND '12' AND ({c}::VARCHAR)[7:8] BETWEEN '01' AND '31') >= 0.95 * count({c}) THEN 'date_month_only'
  WHEN '{kind}' = 'varchar' AND (avg(length({c}::VARCHAR)) > 40 OR count(DISTINCT {c}) / count({c}) > 0.2) THEN 'suppressed:high_cardinality_or_text_like' WHEN count(DISTINCT {c}) <= 50 AND count(DISTINCT {c}) / count({c}) <= 0.2 THEN CASE WHEN count({c}) < 10 THEN 'suppressed:cohort_below_k' ELSE 'profile+value_counts' END ELSE 'profile' END AS policy FROM {table}"""


#: Orders with dates in three forms, a text that is a date too seldom, and columns of few rows and few values.
DATED = """(SELECT o_orderdate AS moment, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 10 = 0 THEN 'May' ELSE strftime(o_orderdate, '%Y%m%d') END AS mixed, strftime(o_orderdate, '%Y%m%d')::BIGINT AS digits,
  o_orderstatus AS state, CASE WHEN o_orderkey < 5 THEN 'few' END AS rare, CASE WHEN o_orderkey < 0 THEN 1 END AS nothing FROM orders)"""
DATED_KINDS = [("moment", "datetime"), ("day", "varchar"), ("mixed", "varchar"), ("digits", "integer"), ("state", "varchar"), ("rare", "varchar"), ("nothing", "integer")]


@query(" UNION ALL ".join([*(_policy(c, k, t) for t, cs in KINDS.items() for c, k in cs), *(_policy(c, k, DATED) for c, k in DATED_KINDS)]))
def value_policies(spark: SparkSession, d: str) -> DataFrame:
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    digits = F.date_format(when, "yyyyMMdd")
    dated = mapping.table(spark, d, "orders").select(
        when.alias("moment"), F.date_format(when, "yyyy-MM-dd").alias("day"), F.when(key % 10 == 0, "May").otherwise(digits).alias("mixed"), digits.cast("long").alias("digits"), F.col("o_orderstatus").alias("state"), F.when(key < 5, "few").alias("rare"), F.when(key < 0, 1).alias("nothing"),
    )
    return publish.policies(mapping.table(spark, d, "customer")).unionByName(publish.policies(mapping.table(spark, d, "part"))).unionByName(publish.policies(dated))


def _bucket(c: str) -> str:
    return f"CASE WHEN {c} <= 0 THEN '0' WHEN {c} < 10 THEN '<10' ELSE '10+' END AS {c}"


def _length(c: str) -> str:
    return f"CASE WHEN {c} <= 0 THEN '0' WHEN {c} < 10 THEN '1-9' ELSE '10+' END AS {c}"


@query("SELECT \"column\", " + ", ".join([*map(_bucket, ("rows", "present", "blank", "distinct_values", "non_finite")), *map(_length, ("min_length", "mean_length", "max_length"))]) + " FROM (" + " UNION ALL ".join(_profiled(c, n) for c, n in PROFILED.items()) + ")")
def public_columns(spark: SparkSession, d: str) -> DataFrame:
    return publish.public_columns(profile.columns(mapping.table(spark, d, "customer")))


@query("""WITH c AS (SELECT l_returnflag AS "column", l_linestatus || (l_linenumber::VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT "column", 'category_' || lpad(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, label)::VARCHAR, 3, '0') AS label, n FROM c UNION ALL SELECT DISTINCT "column", '<suppressed>', 12::BIGINT FROM c""")
def relabelled_categories(spark: SparkSession, d: str) -> DataFrame:
    c = mapping.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("column"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("label")).agg(F.count("*").alias("n"))
    hidden = c.select("column", F.lit("<suppressed>").alias("label"), F.lit(12).cast("long").alias("n")).distinct()
    return publish.relabelled(c.unionByName(hidden), ["column"], "label", "category")


RENAMED = {"customer": ["custkey", "nationkey"], "orders": ["orderkey", "custkey"], "lineitem": ["orderkey", "partkey", "suppkey"], "supplier": ["suppkey", "nationkey"], "part": ["partkey"], "nation": ["nationkey", "regionkey"], "region": ["regionkey"]}


def _cells() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({t[0]}_{c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {t[0]}_{c} IS NOT NULL GROUP BY ALL" for t, cs in RENAMED.items() for c in cs)


@query(f"""WITH cells AS ({_cells()}), z AS (SELECT t, c, count(*) AS d, sum(n) AS rows FROM cells GROUP BY ALL),
  p AS (SELECT l.t AS lt, r.t AS rt, l.c, l.d AS ld, r.d AS rd, l.rows AS lr, r.rows AS rr FROM z l JOIN z r ON l.c = r.c AND l.t <> r.t AND (l.d > r.d OR (l.d = r.d AND l.t < r.t)) ORDER BY l.d + r.d DESC, l.c, l.t, r.t LIMIT 8),
  s AS (SELECT a.c, a.t AS lt, b.t AS rt, count(*) AS s, sum(a.n) AS ln, sum(b.n) AS rn FROM cells a JOIN cells b ON a.c = b.c AND a.v = b.v AND a.t <> b.t GROUP BY ALL)
  SELECT lt AS left_table, rt AS right_table, c AS "column", ld AS left_distinct, rd AS right_distinct, coalesce(s, 0) AS shared_distinct, round(coalesce(s, 0) / ld::DOUBLE, 6) AS left_containment, round(coalesce(s, 0) / rd::DOUBLE, 6) AS right_containment,
  CAST(lr - coalesce(ln, 0) AS BIGINT) AS left_rows_without_match, CAST(rr - coalesce(rn, 0) AS BIGINT) AS right_rows_without_match FROM p LEFT JOIN s USING (c, lt, rt)""")
def relation_discovery(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: mapping.table(spark, d, t).select(*[F.col(f"{t[0]}_{c}").alias(c) for c in cs]) for t, cs in RENAMED.items()}
    return publish.relations(tables, limit=8, least=0)


@query(f"""WITH cells AS ({_cells()}), z AS (SELECT t, c, count(*) AS d, sum(n) AS rows FROM cells GROUP BY ALL),
  p AS (SELECT l.t AS lt, r.t AS rt, l.c, l.d AS ld, r.d AS rd, l.rows AS lr, r.rows AS rr FROM z l JOIN z r ON l.c = r.c AND l.t <> r.t AND (l.d > r.d OR (l.d = r.d AND l.t < r.t))),
  s AS (SELECT a.c, a.t AS lt, b.t AS rt, count(*) AS s, sum(a.n) AS ln, sum(b.n) AS rn FROM cells a JOIN cells b ON a.c = b.c AND a.v = b.v AND a.t <> b.t GROUP BY ALL)
  SELECT count(*) AS shown FROM p LEFT JOIN s USING (c, lt, rt) WHERE least(ld, rd, coalesce(s, 0), lr - coalesce(ln, 0), rr - coalesce(rn, 0)) >= 10""")
def relation_suppression(spark: SparkSession, d: str) -> DataFrame:
    """How many of the relations are shown when a bundle with a small count is left out whole."""
    tables = {t: mapping.table(spark, d, t).select(*[F.col(f"{t[0]}_{c}").alias(c) for c in cs]) for t, cs in RENAMED.items()}
    return publish.relations(tables).agg(F.count("*").alias("shown"))


@query("""SELECT form, month, count(*) AS n FROM (SELECT 'date' AS form, strftime(o_orderdate, '%Y-%m') AS month FROM orders UNION ALL
  SELECT 'text', CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m') END FROM orders UNION ALL SELECT 'int', CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m') END FROM orders) GROUP BY ALL""")
def month_forms(spark: SparkSession, d: str) -> DataFrame:
    """Months of dates, of texts in two forms (a third of them no date) and of eight-digit numbers (a fifth too long)."""
    o, key = mapping.table(spark, d, "orders"), F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.date_format("o_orderdate", " yyyy-MM-dd ")).when(key % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("May 2000")
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("long") * F.when(key % 5 == 0, 10).otherwise(1)
    forms = {"date": F.col("o_orderdate"), "text": text, "int": number}
    rows = o.select(F.inline(F.array(*[F.struct(F.lit(k).alias("form"), profile.month_of(c, k).alias("month")) for k, c in forms.items()])))
    return rows.groupBy("form", "month").agg(F.count("*").alias("n"))


KEY_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM part" for c in KEY_COLUMNS) + "), top AS (SELECT c, row_number() OVER (ORDER BY n DESC, c) AS r FROM c ORDER BY r LIMIT 4), p AS ("
       + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(DISTINCT ({a}, {b})) = count(*) AS k FROM part" for a, b in combinations(KEY_COLUMNS, 2)) + ") SELECT l.c AS a, r.c AS b, k AS is_key FROM top l JOIN top r ON l.r < r.r JOIN p ON (x = l.c AND y = r.c) OR (x = r.c AND y = l.c)")
def key_search(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the four most varied columns of a table."""
    part = mapping.table(spark, d, "part")
    return profile.composite_keys(part, profile.most_varied(part, 4))


@query("""WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT key, json_extract(props, '$."' || key || '"') AS v FROM k),
  t AS (SELECT key, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type, v::VARCHAR IN ('""', '{}', '[]') AS e FROM v)
  SELECT key, type, count(*) AS n, count_if(e) AS empty FROM t GROUP BY ALL""")
def json_types(spark: SparkSession, d: str) -> DataFrame:
    return profile.json_types(mapping.table(spark, d, "events"), "props")


@query("""WITH g AS (SELECT o_custkey % 40 AS g, list(n) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL), b AS (SELECT g, list_transform(n, lambda x: CASE WHEN x = 0 THEN '0' WHEN x < 10 THEN '<10' ELSE '10+' END) AS c,
    list_transform(n, lambda x: CASE WHEN x = 0 THEN '0' WHEN x < 9 THEN '<1MiB' WHEN x < 14 THEN '1-<10MiB' WHEN x < 18 THEN '10-<100MiB' ELSE '100MiB+' END) AS s, list_distinct(list_transform(n, lambda x: CASE WHEN x < 12 THEN '<10/suppressed' WHEN x < 30 THEN '10-<25%' ELSE '25-<50%' END)) AS r FROM g)
  SELECT g, CASE WHEN list_contains(c, '10+') THEN '10+' WHEN list_count(list_filter(c, lambda x: x = '<10')) = 0 THEN '0' WHEN list_count(list_filter(c, lambda x: x = '<10')) = 1 THEN '<10' ELSE 'suppressed' END AS counts,
  CASE WHEN list_contains(s, '100MiB+') THEN '100MiB+' WHEN list_contains(s, '10-<100MiB') THEN '10MiB+' WHEN list_contains(s, '1-<10MiB') THEN '1MiB+' ELSE 'suppressed' END AS sizes,
  CASE WHEN len(r) = 1 THEN r[1] WHEN list_contains(r, '<10/suppressed') THEN '<10/suppressed' ELSE 'mixed' END AS rates FROM b""")
def combined_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of sums over groups of travelers of whom only the bands are known."""
    n, k = F.col("n"), 1 << 20
    size = F.when(n < 9, k - 1).when(n < 14, 2 * k).when(n < 18, 20 * k).otherwise(200 * k)
    rate = F.when(n < 12, bands.rate_band(F.lit(1), F.lit(20))).when(n < 30, bands.rate_band(F.lit(20), F.lit(100))).otherwise(bands.rate_band(F.lit(30), F.lit(100)))
    per = mapping.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select((F.col("o_custkey") % 40).alias("g"), bands.count_bucket(n).alias("c"), bands.size_band(size).alias("s"), rate.alias("r"))
    lists = per.groupBy("g").agg(*[F.collect_list(x).alias(x) for x in "csr"])
    return lists.select("g", bands.combined_counts(F.col("c")).alias("counts"), bands.combined_sizes(F.col("s")).alias("sizes"), bands.combined_rates(F.col("r")).alias("rates"))


@query("""SELECT decade, length, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN '1990s' WHEN 1 THEN '2000s' WHEN 2 THEN 'suppressed' END AS decade, CASE WHEN length(p_name) < 10 THEN '1-9' ELSE '10+' END AS length FROM part) GROUP BY ALL""")
def decade_bands(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("p_partkey") % 4
    text = F.when(turn == 0, "1995-03-01").when(turn == 1, "2000s").when(turn == 2, "May")
    return mapping.table(spark, d, "part").groupBy(bands.decade_band(text).alias("decade"), bands.length_band(F.length("p_name")).alias("length")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL) SELECT l_suppkey, CASE WHEN n < 10 OR r BETWEEN 1 AND 9 OR n - r BETWEEN 1 AND 9 THEN '<10/suppressed' ELSE r::VARCHAR END AS returned, n::VARCHAR AS exact, CASE WHEN n <= 0 THEN '0' WHEN n < 10 THEN '<10' ELSE '10+' END AS bucket FROM a""")
def both_sided_suppression(spark: SparkSession, d: str) -> DataFrame:
    a = mapping.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return a.select("l_suppkey", bands.both_sides(F.col("r"), F.col("n"), F.col("r")).alias("returned"), bands.counted(F.col("n"), exact=True).alias("exact"), bands.counted(F.col("n")).alias("bucket"))


@query("""WITH l AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'Part' || (s_suppkey % 50) WHEN 1 THEN ' Part' || (s_suppkey % 50) || ' ' WHEN 2 THEN 'PART' || (s_suppkey % 50) ELSE 'none' || (s_suppkey % 50) END AS k FROM supplier),
  r AS (SELECT DISTINCT 'Part' || (p_partkey % 40) AS k FROM part), t AS (SELECT k, CASE WHEN k IN (SELECT k FROM r) THEN 'exact' WHEN trim(k) IN (SELECT trim(k) FROM r) THEN 'trimmed' WHEN lower(trim(k)) IN (SELECT lower(k) FROM r) THEN 'folded' ELSE 'unmatched' END AS tier FROM l)
  SELECT tier, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'folded_collisions', count(*) FROM (SELECT lower(trim(k)) AS f FROM l GROUP BY ALL HAVING count(*) > 1)""")
def id_match_tiers(spark: SparkSession, d: str) -> DataFrame:
    key, part = F.col("s_suppkey"), F.concat(F.lit("Part"), (F.col("s_suppkey") % 50).cast("string"))
    form = F.when(key % 4 == 0, part).when(key % 4 == 1, F.concat(F.lit(" "), part, F.lit(" "))).when(key % 4 == 2, F.upper(part)).otherwise(F.concat(F.lit("none"), (key % 50).cast("string")))
    right = mapping.table(spark, d, "part").select(F.concat(F.lit("Part"), (F.col("p_partkey") % 40).cast("string")).alias("k"))
    return publish.match_tiers(mapping.table(spark, d, "supplier").select(form.alias("k")), right, "k")


@query("""SELECT 'orders' AS metric, '10+' AS value, 'observed' AS status FROM (SELECT count(*) AS n FROM orders) WHERE n >= 10 UNION ALL SELECT 'unknown_status', '0', 'empty' UNION ALL SELECT 'weights', 'unavailable', 'missing_column'""")
def emitted_metrics(spark: SparkSession, d: str) -> DataFrame:
    metrics = {"orders": (["o_orderkey"], F.count("o_orderkey")), "unknown_status": (["o_orderstatus"], F.count_if(F.col("o_orderstatus") == "?")), "weights": (["o_weight"], F.count("o_orderkey"))}
    return publish.emitted(mapping.table(spark, d, "orders"), metrics)


FIELD_GROUPS = {"l_returnflag": "flag", "l_linestatus": "status", "l_tax": "none"}


@query("""WITH l AS (SELECT l_linenumber AS unit, unnest(['l_returnflag', 'l_linestatus', 'l_tax']) AS field, unnest([l_returnflag, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE l_linestatus END, l_tax::VARCHAR]) AS v FROM lineitem)
  SELECT unit, field, count_if(trim(v) <> '') AS observed, count_if(v IS NULL OR trim(v) = '') AS blank, count_if(field = 'l_returnflag' AND v NOT IN ('A', 'N') OR field = 'l_linestatus' AND trim(v) <> '' AND v <> 'O') AS outside, count_if(field = 'l_tax' AND v IS NOT NULL) AS group_missing FROM l GROUP BY ALL""")
def field_group_scan(spark: SparkSession, d: str) -> DataFrame:
    book = spark.createDataFrame([("flag", "A"), ("flag", "N"), ("status", "O")], "group string, code string")
    line = mapping.table(spark, d, "lineitem").select("l_linenumber", "l_returnflag", F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(F.col("l_linestatus")).alias("l_linestatus"), F.col("l_tax").cast("string").alias("l_tax"))
    return publish.group_scan(line, "l_linenumber", FIELD_GROUPS, book)


@query(f"""WITH d AS (SELECT n_name AS field, (n_nationkey + k)::VARCHAR AS code FROM nation, range(0, 4) t(k)), f AS (SELECT n_name AS field, CASE WHEN n_regionkey < 4 THEN n_regionkey::VARCHAR END AS g FROM nation), b AS (SELECT DISTINCT (s_nationkey % 4)::VARCHAR AS g, (s_nationkey)::VARCHAR AS code FROM supplier)
  SELECT f.field, coalesce(string_agg(d.code, '|' ORDER BY d.code), '') AS allowed, count(d.code) > 0 AS resolved FROM f LEFT JOIN (SELECT d.field, d.code FROM d JOIN f USING (field) JOIN b ON b.g = f.g AND b.code = d.code) d USING (field) GROUP BY f.field""")
def allow_lists(spark: SparkSession, d: str) -> DataFrame:
    n = mapping.table(spark, d, "nation")
    domains = n.select(F.col("n_name").alias("field"), F.explode(F.array(*[(F.col("n_nationkey") + k).cast("string") for k in range(4)])).alias("code"))
    fields = n.select(F.col("n_name").alias("field"), F.when(F.col("n_regionkey") < 4, F.col("n_regionkey").cast("string")).alias("group"))
    book = mapping.table(spark, d, "supplier").select((F.col("s_nationkey") % 4).cast("string").alias("group"), F.col("s_nationkey").cast("string").alias("code"))
    return publish.allow_lists(fields, domains, book)


@query("""WITH s AS (SELECT p_brand AS unit, 'c' || (p_size % 6) AS c, CASE WHEN p_size % 6 < 2 AND p_partkey % 10 = 0 THEN 'text' WHEN p_size % 6 < 4 THEN 'int' ELSE 'date' END AS t FROM part)
  SELECT c AS "column", string_agg(DISTINCT t, '|' ORDER BY t) AS types, count(DISTINCT unit) AS units FROM s GROUP BY ALL HAVING count(DISTINCT t) > 1""")
def type_conflicts(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("p_size") % 6
    schemas = mapping.table(spark, d, "part").select(F.col("p_brand").alias("unit"), F.concat(F.lit("c"), turn.cast("string")).alias("column"), F.when((turn < 2) & (F.col("p_partkey") % 10 == 0), "text").when(turn < 4, "int").otherwise("date").alias("type"))
    return publish.type_conflicts(schemas)


# The whole profile

#: The columns of each table with their kinds, and the code books of some.
WHOLE = {
    "orders": {"o_orderstatus": ("category", ["F", "O"]), "o_orderpriority": ("category", None), "o_totalprice": ("number", None), "o_orderdate": ("date", None)},
    "customer": {"c_name": ("text", None), "c_mktsegment": ("category", ["BUILDING", "MACHINERY"]), "c_acctbal": ("number", None)},
    "lineitem": {"l_returnflag": ("category", None), "l_linestatus": ("category", ["O"]), "l_quantity": ("number", None), "l_shipdate": ("date", None)},
    "part": {"p_name": ("text", None), "p_brand": ("category", None), "p_size": ("number", None), "p_retailprice": ("number", None)},
}
#: A table's key, and the key of another that must be there.
KEYS = {"orders": ("o_orderkey", "o_custkey", "customer", "c_custkey"), "customer": ("c_name", "c_nationkey", "nation", "n_nationkey"), "lineitem": ("l_orderkey", "l_suppkey", "supplier", "s_suppkey"), "part": ("p_name", "p_partkey", "lineitem", "l_partkey")}


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """The counts of four tables in twelve sections."""
    out = None
    for name, columns in WHOLE.items():
        key, own, other, theirs = KEYS[name]
        frame = mapping.table(spark, d, name)
        if name == "orders":  # no table has a missing or blank text
            frame = frame.withColumn("o_orderpriority", F.when(F.col(key) % 50 == 0, " ").when(F.col(key) % 51 > 0, F.col("o_orderpriority")))
        many = frame.groupBy(key).agg((F.count("*") > 1).alias("_many"))
        there = mapping.table(spark, d, other).select(F.col(theirs).alias(own)).distinct().withColumn("_there", F.lit(True))
        frame = frame.join(many, key, "left").join(there, own, "left")
        spec = [cell for c, (kind, book) in columns.items() for cell in disclosure.column_cells(c, kind, book)]
        spec.append(("duplicates", "duplicates", F.when(F.col("_many"), f"{key} repeated").otherwise(f"{key} once"), disclosure.ROWS))
        spec.append(("relations", f"relations/{own}", F.when(F.col("_there"), f"{own} in {other}").otherwise(f"{own} not in {other}"), disclosure.ROWS))
        counts = disclosure.cells(frame, name, spec)
        out = counts if out is None else out.unionByName(counts)
    return out


@query()
def protected_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of four tables, with every count that is small, or that others would give away, hidden."""
    return disclosure.published(disclosure.protected(_profile(spark, d)))


@query()
def refreshed_profile(spark: SparkSession, d: str) -> DataFrame:
    """The same after its code book section has been counted anew."""
    counts = _profile(spark, d)
    return disclosure.published(disclosure.refreshed(disclosure.protected(counts), "codebook_check", counts))


@query("""SELECT substr(regexp_replace(raw, '[\\x00-\\x1f\\x7f]', ' ', 'g'), 1, 60) AS label, count(*) AS n FROM (SELECT p_type || CASE p_partkey % 3 WHEN 0 THEN chr(9) WHEN 1 THEN chr(10) ELSE ' ' END || repeat(p_brand || '/', CASE WHEN p_size > 40 THEN 9 ELSE 1 END) || CASE WHEN p_size > 40 THEN p_name ELSE '' END AS raw FROM part) GROUP BY ALL""")
def shown_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with control characters and of more than 60 characters, some of which then agree."""
    turn, long = F.col("p_partkey") % 3, F.col("p_size") > 40
    raw = F.concat("p_type", F.when(turn == 0, "\t").when(turn == 1, "\n").otherwise(" "), F.expr("repeat(concat(p_brand, '/'), CASE WHEN p_size > 40 THEN 9 ELSE 1 END)"), F.when(long, F.col("p_name")).otherwise(""))
    return profile.value_counts(mapping.table(spark, d, "part").select(raw.alias("raw")), "raw")
