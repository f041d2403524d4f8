"""Spark side: the tables of the warehouse, derived from the test data, as plain lazy DataFrames."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bitmap, cleaning, daily, dims, reports, scd2
from tidemark.session import scratch_path, prepare_session
from tidemark.sources.clickstream import clickstream, skewed_sales
from tidemark.sources.warehouse import Warehouse

# the days of the test data, and the cuts used by period comparisons
START, END = "2024-01-01", "2024-01-30"
FIRST_HALF, SECOND_HALF = ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-30")
DAY, NEXT_DAY = "2024-01-05", "2024-01-06"
MERGE_DAY = "2024-01-30"  # the last day, so merges cover all days
BEFORE_MERGE = "2024-01-29"
RECENCY = 7
OFFSET = 1e-7  # moves a ratio off the exact half before rounding, where summation noise would decide


class Tables:
    """DataFrames are built once per query, never cached or collected."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare_session(spark), sf_dir

    def parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def warehouse(self, label: str, prefix: str = "") -> Warehouse:
        return Warehouse(self.spark, scratch_path(self.spark, label), prefix)

    @cached_property
    def raw(self):
        return clickstream(self.spark, self.sf_dir)

    @cached_property
    def dirty(self):
        return cleaning.dirty_events(self.raw)

    @cached_property
    def fact(self):
        return cleaning.build_fact(self.raw)

    @cached_property
    def us(self):
        return daily.user_session_daily(self.fact)

    @cached_property
    def pd(self):
        return daily.product_daily(self.fact)

    @cached_property
    def ub(self):
        return daily.user_behavior_daily(self.fact)

    @cached_property
    def th(self):
        return daily.traffic_hour_daily(self.fact)

    @cached_property
    def trade(self):
        return reports.trade_daily(self.ub)

    @cached_property
    def funnel(self):
        return reports.funnel_daily(self.fact)

    @cached_property
    def hot(self):
        return reports.hot_rank_daily(self.pd)

    @cached_property
    def session_report(self):
        return reports.session_behavior_daily(self.us)

    @cached_property
    def hour_report(self):
        return reports.traffic_hour_report(self.th)

    @cached_property
    def retention(self):
        return reports.retention_daily(self.ub, START, END)

    @cached_property
    def scored(self):
        return reports.rfm_scored(self.fact, START, END, RECENCY)

    @cached_property
    def rfm(self):
        return reports.rfm(self.fact, START, END, RECENCY)

    @cached_property
    def user_dim(self):
        return dims.user_dim(self.fact)

    @cached_property
    def bitmaps(self):
        return bitmap.build_uv_bitmap(self.fact)

    @cached_property
    def uv_daily(self):
        return bitmap.uv_daily(self.bitmaps)

    @cached_property
    def scd2(self):
        return scd2.scd2_build(self.fact, START, END)

    @cached_property
    def overview(self):
        return reports.daily_overview(self.fact, self.ub, self.us, self.th, self.user_dim, self.uv_daily)

    @cached_property
    def sales(self):
        return skewed_sales(self.spark, self.sf_dir)

    def fact_before(self, day) -> DataFrame:
        return self.fact.filter(F.col("event_date") < F.lit(day).cast("date"))


def money(*names: str) -> dict:
    return {n: F.round(F.col(n), 2) for n in names}


def rates(*names: str) -> dict:
    return {n: F.round(F.col(n) + OFFSET, 4) for n in names}


def micros(name: str):
    return F.unix_micros(name).alias(name.replace("time", "us"))


def days_of_range() -> list[date]:
    first = date.fromisoformat(START)
    return [first + timedelta(days=i) for i in range((date.fromisoformat(END) - first).days + 1)]
