"""Queries on nested tables and on tables told apart by their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwright.functions import text
from tripwright.operators import checks, schemas
from tripwright.plans.registry import query
from tripwright.sources import mapping

KEPT = ["key", "order.status", "order.customer.segment", "lines[].quantity", "facts{}"]


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer, their lines in order, and some facts by name."""
    line = mapping.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    o = mapping.table(spark, d, "orders").join(mapping.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customer = F.when(F.col("c_custkey") % 5 > 0, F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    facts = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("clerk"), F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), customer.alias("customer")).alias("order"), "lines", facts.alias("facts"))


@query("""SELECT o_orderkey AS key, o_orderstatus AS status, 0.0::DOUBLE AS price, CASE WHEN o_custkey % 5 > 0 THEN '***' END AS name, CASE WHEN o_custkey % 5 > 0 THEN c_mktsegment END AS segment, CASE WHEN o_custkey % 5 > 0 THEN 0.0::DOUBLE END AS balance,
  (SELECT string_agg('0 ' || l_quantity::INT || ' ***', ',' ORDER BY l_linenumber, l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, 'key_1=' || o_orderstatus || ',key_2=' || o_orderpriority AS facts FROM orders JOIN customer ON o_custkey = c_custkey""")
def nested_mask(spark: SparkSession, d: str) -> DataFrame:
    m = schemas.masked(_nested(spark, d), KEPT)
    line = F.transform("lines", lambda x: F.concat_ws(" ", x["number"], x["quantity"].cast("int"), x["flag"]))
    facts = F.transform(F.map_entries("facts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("key", "order.status", "order.price", "order.customer.name", "order.customer.segment", "order.customer.balance", F.when(F.col("lines").isNotNull(), F.concat_ws(",", line)).alias("lines"), F.concat_ws(",", facts).alias("facts"))


ROLES = [("urgent", "1-URGENT"), ("urgent", "2-HIGH"), ("slow", "5-LOW"), ("slow", "O"), ("finished", "F"), ("finished", "3-MEDIUM"), ("finished", "P")]


@query(f"""WITH p AS (SELECT DISTINCT printf('table_%06d.csv', o_custkey) AS alias, unnest([o_orderpriority, o_orderstatus]) AS c FROM orders WHERE o_orderkey % 3 = 0), r(role, c) AS (VALUES {", ".join(map(str, ROLES))}),
  z AS (SELECT role, count(*) AS z FROM r GROUP BY role),
  m AS (SELECT alias, role FROM (SELECT alias, role FROM p JOIN r USING (c) JOIN z USING (role) GROUP BY alias, role, z HAVING count(*) = z) QUALIFY count(*) OVER (PARTITION BY alias) = 1)
  SELECT alias, role FROM m""")
def alias_roles(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tables, whose columns are the priorities and states of a third of their orders."""
    return schemas.roles_of(*_profiles(spark, d))


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = mapping.table(spark, d, "orders").where("o_orderkey % 3 = 0")
    profile = o.select(F.format_string("table_%06d.csv", "o_custkey").alias("alias"), F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("column"))
    return profile, spark.createDataFrame(ROLES, "role string, column string")


@query(f"""WITH p AS (SELECT DISTINCT o_custkey AS k, unnest([o_orderpriority, o_orderstatus]) AS c FROM orders WHERE o_orderkey % 3 = 0), r(role, c) AS (VALUES {", ".join(map(str, ROLES))}),
  z AS (SELECT role, count(*) AS z FROM r GROUP BY role),
  m AS (SELECT k, role FROM (SELECT k, role FROM p JOIN r USING (c) JOIN z USING (role) GROUP BY k, role, z HAVING count(*) = z) QUALIFY count(*) OVER (PARTITION BY k) = 1),
  a AS (SELECT role, printf('table_%06d.csv', k) AS alias, row_number() OVER (PARTITION BY role ORDER BY k) AS n FROM m), d AS (SELECT role, 'raw/' || reverse(k::VARCHAR) || '.csv' AS path, row_number() OVER (PARTITION BY role ORDER BY 'raw/' || reverse(k::VARCHAR) || '.csv') AS n FROM m WHERE role <> 'slow' OR k % 2 = 0)
  SELECT role, alias, path, 'paired' AS status FROM a JOIN d USING (role, n) WHERE role <> 'slow' UNION ALL SELECT 'slow', NULL, NULL, 'unequal'""")
def alias_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same tables paired with files named otherwise, of which one role lacks some."""
    found = schemas.roles_of(*_profiles(spark, d))
    number = F.regexp_extract("alias", "_0*([0-9]+)", 1)
    files = found.where((F.col("role") != "slow") | (number.cast("long") % 2 == 0)).select("role", F.concat(F.lit("raw/"), F.reverse(number), F.lit(".csv")).alias("path"))
    return schemas.paired(found, files)


# Code books, settings and keys of texts


@query("""WITH book AS (SELECT trim(code) AS code, trim(label) AS label FROM (SELECT n_nationkey::VARCHAR || ' ' AS code, n_name AS label FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT n_nationkey::VARCHAR, 'x' || n_name FROM nation WHERE n_nationkey % 10 = 0 UNION ALL SELECT ' ', 'none' UNION ALL SELECT '99', 'nowhere')),
  wanted AS (SELECT DISTINCT n_nationkey::VARCHAR AS code, CASE WHEN n_nationkey % 7 = 0 THEN lower(n_name) ELSE n_name END AS label FROM nation JOIN supplier ON s_nationkey = n_nationkey),
  cohorts AS (SELECT DISTINCT CASE WHEN c_acctbal < 0 THEN 'poor' ELSE 'rich' END AS cohort, c_nationkey::VARCHAR AS code FROM customer WHERE c_nationkey % 6 = 0 AND c_acctbal < 9000 OR c_acctbal > 9990),
  o AS (SELECT code, list(DISTINCT label) AS labels FROM book WHERE code <> '' GROUP BY code), g AS (SELECT code, count(DISTINCT cohort) AS n FROM cohorts GROUP BY code),
  b AS (SELECT coalesce(o.code, w.code) AS code, labels, w.label AS wanted, g.n FROM o FULL JOIN wanted w ON o.code = w.code LEFT JOIN g ON g.code = coalesce(o.code, w.code))
  SELECT 'missing' AS problem, code FROM b WHERE labels IS NULL UNION ALL SELECT 'unexpected', code FROM b WHERE wanted IS NULL UNION ALL SELECT 'label_mismatch', code FROM b WHERE labels IS NOT NULL AND wanted IS NOT NULL AND labels <> [wanted]
  UNION ALL SELECT 'conflicting_label', code FROM b WHERE len(labels) > 1 UNION ALL SELECT 'outside_cohorts', code FROM b WHERE labels IS NOT NULL AND n IS NULL UNION ALL SELECT 'cohort_overlap', code FROM g WHERE n > 1""")
def book_problems(spark: SparkSession, d: str) -> DataFrame:
    """A book of nations, without one and with some entered twice, against the suppliers' nations and cohorts of customers."""
    n, key = mapping.table(spark, d, "nation"), F.col("n_nationkey")
    book = n.where(key != 3).select(F.concat(key.cast("string"), F.lit(" ")).alias("code"), F.col("n_name").alias("label"))
    book = book.unionByName(n.where(key % 10 == 0).select(key.cast("string").alias("code"), F.concat(F.lit("x"), "n_name").alias("label"))).unionByName(spark.createDataFrame([(" ", "none"), ("99", "nowhere")], "code string, label string"))
    wanted = n.join(mapping.table(spark, d, "supplier"), F.col("s_nationkey") == key).select(key.cast("string").alias("code"), F.when(key % 7 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("label")).distinct()
    c, money = mapping.table(spark, d, "customer"), F.col("c_acctbal")
    cohorts = c.where(((F.col("c_nationkey") % 6 == 0) & (money < 9000)) | (money > 9990)).select(F.when(money < 0, "poor").otherwise("rich").alias("cohort"), F.col("c_nationkey").cast("string").alias("code"))
    return checks.book_problems(book, wanted, cohorts)


@query("""SELECT doc_id, length(k) AS letters, sha256(k) AS key_sha256 FROM (SELECT doc_id, regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', '', 'g') AS k FROM documents)""")
def compact_keys(spark: SparkSession, d: str) -> DataFrame:
    key = mapping.table(spark, d, "documents").select("doc_id", text.compact(F.col("text")).alias("k"))
    return key.select("doc_id", F.length("k").cast("long").alias("letters"), F.sha2("k", 256).alias("key_sha256"))


@query("""SELECT p_partkey, coalesce(p_type, '__MISSING__') AS p_type, CASE WHEN p_partkey % 9 > 0 THEN p_brand ELSE '__MISSING__' END AS p_brand, round(ln(1 + p_size::DOUBLE), 9) AS p_size FROM part""")
def prepared_frame(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a run's feature groups as a model takes them: two of three categories, and a count in logarithms."""
    config = checks.RunConfig(("category", "size"), depth=2, popularity="log1p", known={"category": ("p_type", "p_brand", "p_name"), "size": ("p_size",), "price": ("p_retailprice",)})
    frame = mapping.table(spark, d, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 9 > 0, F.col("p_brand")))
    return config.prepared(frame, {"p_type": "category", "p_brand": "category", "p_size": "count"}, deep="category", keys=("p_partkey",)).withColumn("p_size", F.round("p_size", 9))
