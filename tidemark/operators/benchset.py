"""The benchmark queries, each in DataFrame form and in SQL form. Both forms give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import day_literal, is_type
from ..session import stack
from .daily import type_users_daily
from .reconcile import partition_digests


def q1_sum_price(fact: DataFrame) -> DataFrame:
    return fact.agg(F.sum("price").alias("total_price"))


def q1m_count(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count("*").alias("cnt"))


def q2_one_day(fact: DataFrame, day) -> DataFrame:
    return fact.filter(F.col("event_date") == day_literal(day)).agg(F.count("*").alias("cnt"))


def q3_group_type(fact: DataFrame) -> DataFrame:
    return fact.groupBy("event_type").agg(F.count("*").alias("cnt"))


def q4_day_gmv(fact: DataFrame) -> DataFrame:
    return fact.groupBy("event_date").agg(F.count("*").alias("cnt"), F.sum("price").alias("total_price"))


def q5_uv(fact: DataFrame) -> DataFrame:
    return fact.agg(F.countDistinct("user_id").alias("uv"))


def q6_group_product(fact: DataFrame) -> DataFrame:
    return fact.groupBy("product_id").agg(F.count("*").alias("cnt"), F.sum("price").alias("total_price"))


def q7_funnel_day(fact: DataFrame, day) -> DataFrame:
    """Three conditional distinct counts of one day, by way of one row per user."""
    users = type_users_daily(fact.filter(F.col("event_date") == day_literal(day)))
    return users.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("view_uv", "cart_uv", "purchase_uv")))


def q8_rank_category(hot_rank: DataFrame, categories: DataFrame, day, n: int = 100) -> DataFrame:
    """Category codes of the day's ranking. The ranking has at most ``HOT_RANK_SIZE`` rows a day."""
    return (
        hot_rank.filter(F.col("event_date") == day_literal(day))
        .select("product_id", "category_id", "sales_amount")
        .join(categories.select("category_id", "category_code"), "category_id", "left")
        .select("product_id", "category_code", "sales_amount")
        .orderBy(F.round("sales_amount", 4).desc_nulls_last(), F.asc("product_id"))
        .limit(n)
    )


def q9_buyers(fact: DataFrame) -> DataFrame:
    return fact.filter(is_type(K.PURCHASE)).groupBy("user_id").agg(
        F.count("*").alias("cnt"), F.sum("price").alias("total_price")
    )


def q10_topn_window(product_daily: DataFrame, n: int = 100) -> DataFrame:
    order = Window.partitionBy("event_date").orderBy(
        F.round("sales_amount", 4).desc_nulls_last(), F.asc("product_id")
    )
    return (
        product_daily.select("event_date", "product_id", "sales_amount")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= n)
    )


#: SQL forms over the views ``fact``, ``hot_rank``, ``dim_category`` and ``product_daily``; ``:day`` is a parameter
SQL = {
    "q1_sum_price": "SELECT SUM(price) AS total_price FROM fact",
    "q1m_count": "SELECT COUNT(*) AS cnt FROM fact",
    "q2_one_day": "SELECT COUNT(*) AS cnt FROM fact WHERE event_date = CAST(:day AS DATE)",
    "q3_group_type": "SELECT event_type, COUNT(*) AS cnt FROM fact GROUP BY event_type",
    "q4_day_gmv": "SELECT event_date, COUNT(*) AS cnt, SUM(price) AS total_price FROM fact GROUP BY event_date",
    "q5_uv": "SELECT COUNT(DISTINCT user_id) AS uv FROM fact",
    "q6_group_product": "SELECT product_id, COUNT(*) AS cnt, SUM(price) AS total_price FROM fact GROUP BY product_id",
    "q7_funnel_day": """
        SELECT COUNT(DISTINCT IF(event_type = 'view', user_id, NULL)) AS view_uv,
               COUNT(DISTINCT IF(event_type = 'cart', user_id, NULL)) AS cart_uv,
               COUNT(DISTINCT IF(event_type = 'purchase', user_id, NULL)) AS purchase_uv
        FROM fact WHERE event_date = CAST(:day AS DATE)""",
    "q8_rank_category": """
        SELECT h.product_id, c.category_code, h.sales_amount
        FROM hot_rank h LEFT JOIN dim_category c USING (category_id)
        WHERE h.event_date = CAST(:day AS DATE)
        ORDER BY ROUND(h.sales_amount, 4) DESC NULLS LAST, h.product_id LIMIT 100""",
    "q9_buyers": """
        SELECT user_id, COUNT(*) AS cnt, SUM(price) AS total_price
        FROM fact WHERE event_type = 'purchase' GROUP BY user_id""",
    "q10_topn_window": """
        SELECT * FROM (
            SELECT event_date, product_id, sales_amount,
                   ROW_NUMBER() OVER (PARTITION BY event_date ORDER BY ROUND(sales_amount, 4) DESC NULLS LAST, product_id) AS rn
            FROM product_daily) WHERE rn <= 100""",
}


def sql_form(spark: SparkSession, name: str, day=None) -> DataFrame:
    text = SQL[name]
    return spark.sql(text, args={"day": str(day)} if ":day" in text else None)


def row_gate(results: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Rows each query returned against the rows it must return; a time counts only where ``ok`` is 1."""
    rows = [
        df.agg(F.count("*").alias("actual_rows")).select(
            F.lit(name).alias("query"), F.lit(expected[name]).cast("bigint").alias("expected_rows"), "actual_rows"
        )
        for name, df in results.items()
    ]
    return stack(rows).withColumn("ok", F.when(F.col("expected_rows") == F.col("actual_rows"), 1).otherwise(0))


def forms_agree(one: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """(query, rows_one, rows_other, equal): both forms of every query by the digests of their values, in any row order."""
    def digest(df: DataFrame, side: str) -> DataFrame:
        whole = partition_digests(df, None)
        return whole.select(F.lit(side).alias("side"), "row_cnt", F.struct("hash_sum", "hash_xor").alias("h"))

    rows = []
    for name, df in one.items():
        if sorted(df.dtypes) != sorted(other[name].dtypes):
            raise ValueError(f"{name}: the forms have different columns")
        both = stack([digest(df, "one"), digest(other[name], "other")])
        rows.append(both.agg(
            F.coalesce(F.max(F.when(F.col("side") == "one", F.col("row_cnt"))), F.lit(0)).alias("rows_one"),
            F.coalesce(F.max(F.when(F.col("side") == "other", F.col("row_cnt"))), F.lit(0)).alias("rows_other"),
            F.when((F.count("*") == 0) | ((F.count("*") == 2) & (F.count_distinct("row_cnt", "h") == 1)), 1).otherwise(0).alias("equal"),
        ).select(F.lit(name).alias("query"), "rows_one", "rows_other", "equal"))
    return stack(rows)
