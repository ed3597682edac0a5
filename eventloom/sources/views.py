"""Market views over the driver's tables: prices, signals, a calendar, a universe; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKERS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close, volume: average price of what a ticker's parts shipped on a day; sums are exact decimals."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % TICKERS).cast("int").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity"
    )
    daily = rows.groupBy("ticker", "date").agg(money("l_extendedprice").alias("v"), money("l_quantity").alias("volume"))
    return daily.select("ticker", "date", (F.col("v") / F.col("volume")).alias("close"), "volume")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id, ticker, signal_type, sector, date, score."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("signal_id"), (F.col("o_custkey") % TICKERS).cast("int").alias("ticker"), F.col("o_orderpriority").alias("signal_type"),
        F.col("c_mktsegment").alias("sector"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("score"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, pos: all days with a price, numbered from 0 (a few thousand rows whatever the scale)."""
    from pyspark.sql import Window as W

    days = prices(spark, sf_dir).select("date").distinct()
    return days.select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("pos"))


PRICES = f"""prices AS (SELECT CAST(l_partkey % {TICKERS} AS INT) AS ticker, CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2)"""
SIGNALS = f"""signals AS (SELECT o_orderkey AS signal_id, CAST(o_custkey % {TICKERS} AS INT) AS ticker, o_orderpriority AS signal_type,
  c_mktsegment AS sector, CAST(o_orderdate AS DATE) AS date, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey)"""
CALENDAR = "calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM prices))"
