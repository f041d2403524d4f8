"""A clickstream derived from the star-schema test tables, so every operator has a whole table to run on.

The modulo terms shape values (NULLs, negative prices, duplicates); no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CART, PURCHASE, REMOVE, VIEW
from ..session import prepare_session


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with dirty rows and duplicates, in the source schema plus ``event_date``."""
    prepare_session(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    day = F.dayofmonth("ts")
    copies = F.when(eid % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    renamed = (
        F.when(F.col("event_type") == "view", VIEW)
        .when(F.col("event_type") == "click", CART)
        .when(F.col("event_type") == "error", REMOVE)
        .when(F.col("event_type") == "purchase", PURCHASE)
        .otherwise(F.col("event_type"))
    )
    code = (
        F.when(k % 4 == 0, "electronics.smartphone")
        .when(k % 4 == 1, "appliances.kitchen.kettle")
        .when(k % 4 == 2, "computers")
    )
    brand = F.when(
        k % 11 != 0,
        F.concat(F.lit("brand"), (k % 7).cast("string"), F.when((k % 3 == 0) & (day > 10), "b").otherwise(""),
                 F.when((k % 5 == 0) & (day > 29), "c").otherwise("")),
    )
    price = F.when(eid % 107 == 0, None).when(eid % 89 == 0, -F.col("value")).otherwise(F.col("value"))
    session = (
        F.when(eid % 103 == 0, None)
        .when(eid % 101 == 0, "shared")
        .otherwise(F.concat_ws("-", F.col("user_id").cast("string"), day.cast("string")))
    )
    # one scan: the rows that exist twice are exploded, not read again
    rows = e.select(
        F.col("ts").cast("timestamp").alias("event_time"),
        renamed.alias("event_type"),
        k.alias("product_id"),
        (k % 10).alias("category_id"),
        code.alias("category_code"),
        brand.alias("brand"),
        price.alias("price"),
        F.when(eid % 97 != 0, F.col("user_id")).alias("user_id"),
        session.alias("user_session"),
        F.explode(copies).alias("copy"),
    )
    return (
        rows.withColumn("brand", F.when(F.col("copy") == 1, "zzz").otherwise(F.col("brand")))
        .drop("copy")
        .withColumn("event_date", F.to_date("event_time"))
    )


def skewed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines with one key on about 45% of the rows."""
    prepare_session(spark)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.when(F.col("l_orderkey") % 100 < 45, F.lit(9000001).cast("bigint")).otherwise(F.col("l_partkey")).alias(
            "product_id"
        ),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("sales_amount"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
    )
