"""Three stages that hand over by Parquet path: extract, transform, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def extract(orders: DataFrame, out: str) -> None:
    """Orders as (order_id, customer, amount)."""
    orders.select("order_id", "customer", "amount").write.mode("overwrite").parquet(out)


def transform(spark: SparkSession, path: str, out: str) -> None:
    spark.read.parquet(path).groupBy("customer").agg(F.sum("amount").alias("total_amount")).write.mode(
        "overwrite"
    ).parquet(out)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("customer")
