"""Registry, table access and the tables most queries start from.

How the given tables stand in for the inputs: a customer is an area, its nation
the mid-level area and its region the top level; orders are the incident feed
and the price series; suppliers and parts are service providers, with line
items as their yearly results. Places follow from the keys by arithmetic, the
same in Spark and SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def hundredths(c: str) -> Column:
    """Amount with two decimals as a whole number, so that sums are exact."""
    return F.round(F.col(c) * 100).cast("long")


def exact_mean(c: str) -> Column:
    return F.sum(hundredths(c)) / (F.count(c) * F.lit(100.0))


def population(key: Column) -> Column:
    """Residents of an area; some are zero and some unknown."""
    return F.when(key % 97 == 0, F.lit(0)).when(key % 89 != 0, 1000 + key % 2000).cast("double")


POPULATION_SQL = (
    "CAST(CASE WHEN c_custkey % 97 = 0 THEN 0 WHEN c_custkey % 89 <> 0 "
    "THEN 1000 + c_custkey % 2000 END AS DOUBLE)"
)

METRICS = (
    "balance", "order_count", "mean_price", "mean_quantity", "mean_discount", "mean_tax", "mean_item_price",
)


def area_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators per area (customer), with its mid-level and top-level areas."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    per_area = orders.groupBy(F.col("o_custkey").alias("area_code")).agg(
        F.count(F.lit(1)).alias("order_count"), exact_mean("o_totalprice").alias("mean_price")
    )
    per_item = (
        items.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("area_code")).agg(
            exact_mean("l_quantity").alias("mean_quantity"), exact_mean("l_discount").alias("mean_discount"),
            exact_mean("l_tax").alias("mean_tax"), exact_mean("l_extendedprice").alias("mean_item_price"),
        )
    )
    return (
        areas(spark, sf_dir).join(per_area, "area_code", "left").join(per_item, "area_code", "left")
        .withColumn("order_count", F.coalesce("order_count", F.lit(0)).cast("double"))
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("mid_code"), F.col("n_name").alias("mid_name"),
        F.col("n_regionkey").alias("top_code"),
    )
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("top_code"), F.col("r_name").alias("top_name")
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("area_code"), F.col("c_nationkey").alias("mid_code"),
        F.col("c_acctbal").alias("balance"), population(F.col("c_custkey")).alias("population"),
    )
    return customer.join(nation, "mid_code", "left").join(region, "top_code", "left")


AREAS_SQL = f"""areas AS (
  SELECT c_custkey AS area_code, c_nationkey AS mid_code, n_name AS mid_name,
         n_regionkey AS top_code, r_name AS top_name, c_acctbal AS balance, {POPULATION_SQL} AS population
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def _mean_sql(c: str) -> str:
    return f"sum(CAST(round({c} * 100) AS BIGINT)) / (count({c}) * 100.0::DOUBLE)"


METRICS_SQL = f"""{AREAS_SQL},
per_area AS (
  SELECT o_custkey AS area_code, count(*) AS order_count, {_mean_sql('o_totalprice')} AS mean_price
  FROM orders GROUP BY 1),
per_item AS (
  SELECT o_custkey AS area_code, {_mean_sql('l_quantity')} AS mean_quantity,
         {_mean_sql('l_discount')} AS mean_discount, {_mean_sql('l_tax')} AS mean_tax,
         {_mean_sql('l_extendedprice')} AS mean_item_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
metrics AS (
  SELECT a.*, CAST(coalesce(order_count, 0) AS DOUBLE) AS order_count, mean_price, mean_quantity,
         mean_discount, mean_tax, mean_item_price
  FROM areas a LEFT JOIN per_area USING (area_code) LEFT JOIN per_item USING (area_code))"""
