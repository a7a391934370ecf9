"""The travel tables, read from the driver's order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, split, trip, traveler, start_at, segment, priority, status: an order is a trip, its customer the traveler."""
    t = lambda n: table(spark, sf_dir, n)
    where = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = t("orders").join(where, F.col("o_custkey") == F.col("c_custkey"))
    return out.select(
        F.col("r_name").alias("region"), F.when(F.col("o_orderdate") < F.lit("2000-07-01").cast("timestamp"), "TL").otherwise("VL").alias("split"),
        F.col("o_orderkey").cast("string").alias("trip"), F.col("o_custkey").cast("string").alias("traveler"), F.col("o_orderdate").alias("start_at"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, area, poi (blank for the seventh line), kind, feedback, end_at: a line item is a visit."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").cast("string").alias("trip"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("area"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_partkey").cast("string")).alias("poi"),
        (1 + F.col("l_suppkey") % 24).cast("string").alias("kind"), (1 + F.floor("l_quantity").cast("int") % 6).cast("string").alias("feedback"), F.col("l_shipdate").alias("end_at"),
    )


#: The same two tables for the oracle.
SQL = """trips AS (SELECT r_name AS region, CASE WHEN o_orderdate < TIMESTAMP '2000-07-01' THEN 'TL' ELSE 'VL' END AS split, CAST(o_orderkey AS VARCHAR) AS trip,
  CAST(o_custkey AS VARCHAR) AS traveler, o_orderdate AS start_at, c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
visits AS (SELECT CAST(l_orderkey AS VARCHAR) AS trip, concat(l_orderkey, '-', l_linenumber) AS area, CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS poi,
  CAST(1 + l_suppkey % 24 AS VARCHAR) AS kind, CAST(1 + CAST(floor(l_quantity) AS INT) % 6 AS VARCHAR) AS feedback, l_shipdate AS end_at FROM lineitem),
seen AS (SELECT t.region, t.split, t.trip, t.traveler, v.poi, v.kind, v.feedback FROM visits v JOIN trips t ON v.trip = t.trip WHERE v.poi <> '')"""
