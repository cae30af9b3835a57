"""The flagship query: revenue per market segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowsql.sources.tables import frame

SQL = """
SELECT c_mktsegment, count(*) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus != 'P'
GROUP BY c_mktsegment
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = frame(spark, sf_dir, "customer"), frame(spark, sf_dir, "orders")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return (
        orders.where(F.col("o_orderstatus") != "P")
        .join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n_orders"), F.sum(amount).cast("double").alias("revenue"))
    )
