"""Price panels, ledgers and contract tables as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_cents() -> Column:
    """Unit price, cut to cents."""
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100


def _bars(rows: DataFrame) -> DataFrame:
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.groupBy("code", F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six instruments (return flag and line status)."""
    li = table(spark, sf_dir, "lineitem")
    return _bars(li.withColumn("code", F.concat("l_returnflag", "l_linestatus")).withColumn("px", price_cents()))


BARS = """bars AS (
  SELECT code, trade_date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT l_returnflag || l_linestatus AS code, l_shipdate::DATE AS trade_date, floor(l_extendedprice * 100 / l_quantity) / 100 AS px, * FROM lineitem)
  GROUP BY code, trade_date)"""


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of brands: sparse, so that the universe changes."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    return _bars(li.join(part, li.l_partkey == part.p_partkey).withColumn("px", price_cents()))


BRANDS = """bars AS (
  SELECT code, trade_date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT p_brand AS code, l_shipdate::DATE AS trade_date, floor(l_extendedprice * 100 / l_quantity) / 100 AS px, lineitem.* FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY code, trade_date)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade ledger: one book a part, sells by return flag R."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"), F.lpad((F.col("l_linenumber") + 8).cast("string"), 2, "0").alias("trade_time"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"), price_cents().alias("price"), F.round(F.col("l_extendedprice") * F.col("l_tax") / 100, 2).alias("fee"), F.col("l_suppkey").alias("account_id"),
    )


TRADES = """trades AS (
  SELECT l_partkey AS code, l_shipdate::DATE AS trade_date, lpad((l_linenumber + 8)::VARCHAR, 2, '0') AS trade_time, l_orderkey * 10 + l_linenumber AS id,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, floor(l_extendedprice * 100 / l_quantity) / 100 AS price,
         round(l_extendedprice * l_tax / 100, 2) AS fee, l_suppkey AS account_id
  FROM lineitem)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows of contracts: root by market segment, contract by nation, open interest by count of orders."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    px = F.floor(F.col("o_totalprice")) / 100
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("root"), F.concat(F.substring("c_mktsegment", 1, 2), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("contract"), F.last_day(F.to_date("o_orderdate")).alias("trade_date"), "o_orderkey", px.alias("px"))
    return rows.groupBy("root", "contract", "trade_date").agg(F.min_by("px", "o_orderkey").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o_orderkey").alias("close"), F.count("*").alias("hold"))


CONTRACTS = """contracts AS (
  SELECT root, contract, trade_date, arg_min(px, o_orderkey) AS open, max(px) AS high, min(px) AS low, arg_max(px, o_orderkey) AS close, count(*) AS hold
  FROM (SELECT c_mktsegment AS root, substr(c_mktsegment, 1, 2) || lpad(c_nationkey::VARCHAR, 2, '0') AS contract, last_day(o_orderdate::DATE) AS trade_date, o_orderkey, floor(o_totalprice) / 100 AS px
        FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated cash flows of accounts (customers): every fourth order is a withdrawal."""
    o = table(spark, sf_dir, "orders")
    amount = F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 4 == 3, -1.0).otherwise(1.0)
    return o.select(F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("flow_date"), F.col("o_orderkey").alias("id"), amount.alias("amount"))


FLOWS = """flows AS (
  SELECT o_custkey AS account_id, o_orderdate::DATE AS flow_date, o_orderkey AS id, floor(o_totalprice) * CASE WHEN o_orderkey % 4 = 3 THEN -1.0 ELSE 1.0 END AS amount FROM orders)"""
