"""Product history inferred from events, as slowly changing versions.

No product master exists: the attributes of a day are the most frequent
combination seen that day, and a version lasts while that combination stays the
same. Windows over a product see at most one row per day, whatever the number of
its events, so a product with a third of all events costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import between_days, cnt_if, day_literal, flag
from ..schemas import TABLES
from ..session import stack
from .numbering import number_rows

ATTRIBUTES = ("category_id", "category_code", "brand")
COLUMNS = TABLES["dim_product_scd2"].column_names


def _identity(prefix: str = "") -> Column:
    """What counts as a change: NULL and the empty string are the same value."""
    return F.struct(
        F.coalesce(F.col(prefix + "category_id"), F.lit(-1)).alias("category"),
        F.coalesce(F.col(prefix + "category_code"), F.lit("")).alias("code"),
        F.coalesce(F.col(prefix + "brand"), F.lit("")).alias("brand"),
    )


def dominant_attrs(fact: DataFrame) -> DataFrame:
    """Per day and product the most frequent attribute combination; ties by value, NULLs last."""
    counted = fact.groupBy("event_date", "product_id", *ATTRIBUTES).agg(F.count("*").alias("cnt"))
    best = Window.partitionBy("event_date", "product_id").orderBy(
        F.desc("cnt"), *(F.asc_nulls_last(c) for c in ATTRIBUTES)
    )
    # placed by product once: this window and all later ones per product need no further shuffle
    return (
        counted.repartition("product_id")
        .withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") == 1)
        .drop("rn")
    )


def _days_of_product():
    return Window.partitionBy("product_id").orderBy("event_date")


def version_runs(daily: DataFrame) -> DataFrame:
    """Change mark against the previous observed day, and the running version number."""
    previous = F.lag(_identity()).over(_days_of_product())
    marked = daily.withColumn("changed", flag(previous.isNull() | (previous != _identity())))
    running = _days_of_product().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("version_no", F.sum("changed").over(running))


def _versions(fact: DataFrame, start, end, close: str) -> DataFrame:
    """Versions without key. Only days that open a version are kept; the next such day closes it."""
    daily = dominant_attrs(fact.filter(between_days(start, end)))
    previous_day = F.lag("event_date").over(_days_of_product())
    opening = (
        version_runs(daily)
        .withColumn("seen_before", previous_day)
        .filter(F.col("changed") == 1)
    )
    next_opening = F.lead("event_date").over(_days_of_product())
    # the day before the next opening on which the product was seen is the last day of this version
    last_seen = F.lead("seen_before").over(_days_of_product())
    closing = {"last_seen": F.date_add(last_seen, 1), "change_day": next_opening}[close]
    return opening.select(
        "product_id",
        *ATTRIBUTES,
        F.col("event_date").alias("dw_start_date"),
        F.coalesce(closing, day_literal(K.OPEN_END)).alias("dw_end_date"),
        flag(next_opening.isNull()).alias("dw_is_current"),
    )


def scd2_build(fact: DataFrame, start, end, close: str = "last_seen") -> DataFrame:
    """All versions of the range.

    ``close="last_seen"`` ends a version the day after its product was last seen
    with it, ``"change_day"`` on the day of the change, as the daily merge does.
    They differ when the product was not seen in between. A version keeps the
    attributes of its first day.
    """
    versions = _versions(fact, start, end, close)
    return number_rows(versions, ["product_id", "dw_start_date"], "dim_product_sk").select(*COLUMNS)


def scd2_merge(dim: DataFrame, fact: DataFrame, dt) -> DataFrame:
    """State after one more day: changed versions closed at ``dt``, changed and new ones opened, the rest kept.

    Run :func:`scd2_preflight` first.
    """
    today = dominant_attrs(fact.filter(F.col("event_date") == day_literal(dt))).select(
        "product_id", *(F.col(c).alias("new_" + c) for c in ATTRIBUTES), F.lit(1).alias("seen")
    )
    newest = Window.partitionBy("product_id").orderBy(F.desc("dim_product_sk"))
    current = dim.filter(F.col("dw_is_current") == 1).withColumn("rn", F.row_number().over(newest))
    untouched = stack([
        dim.filter(F.coalesce(F.col("dw_is_current"), F.lit(0)) != 1), current.filter(F.col("rn") > 1).drop("rn")
    ])
    pairs = current.filter(F.col("rn") == 1).drop("rn").join(today, "product_id", "full_outer")
    changes = F.col("seen").isNotNull() & (_identity() != _identity("new_"))
    after = pairs.filter(F.col("dim_product_sk").isNotNull()).select(
        "dim_product_sk", "product_id", *ATTRIBUTES, "dw_start_date",
        F.when(changes, day_literal(dt)).otherwise(F.col("dw_end_date")).alias("dw_end_date"),
        F.when(changes, 0).otherwise(1).alias("dw_is_current"),
    )
    opened = pairs.filter(F.col("seen").isNotNull() & (F.col("dim_product_sk").isNull() | changes)).select(
        "product_id",
        *(F.col("new_" + c).alias(c) for c in ATTRIBUTES),
        day_literal(dt).alias("dw_start_date"),
        day_literal(K.OPEN_END).alias("dw_end_date"),
        F.lit(1).alias("dw_is_current"),
    )
    last_key = dim.agg(F.coalesce(F.max("dim_product_sk"), F.lit(0)).alias("k")).scalar()
    numbered = number_rows(opened, ["product_id"], "dim_product_sk", after=last_key)
    return stack([untouched.select(*COLUMNS), after, numbered.select(*COLUMNS)])


def scd2_preflight(dim: DataFrame, dt) -> DataFrame:
    """One row: may ``dt`` be merged? ``reason`` is NULL when it may."""
    state = dim.groupBy("product_id").agg(
        F.count("*").alias("versions"),
        cnt_if(F.col("dw_is_current") == 1).alias("current"),
        F.max(F.when(F.col("dw_is_current") == 1, F.col("dw_start_date"))).alias("newest"),
    ).agg(
        F.coalesce(F.sum("versions"), F.lit(0)).alias("versions"),
        F.count("*").alias("products"),
        F.coalesce(F.sum("current"), F.lit(0)).alias("current_versions"),
        F.max("newest").alias("newest_start"),
    )
    reason = (
        F.when(F.col("versions") == 0, "empty_table")
        .when(F.col("current_versions") != F.col("products"), "not_one_current_version")
        .when(day_literal(dt) < F.col("newest_start"), "day_before_newest_version")
    )
    return state.withColumn("reason", reason)


def ensure_mergeable(dim: DataFrame, dt) -> None:
    reason = scd2_preflight(dim, dt).first()["reason"]
    if reason:
        raise ValueError(f"product history cannot take {dt}: {reason}; rebuild it from the facts")


def scd2_validate(dim: DataFrame) -> DataFrame:
    """One row of counts, all zero for a sound table. One shuffle by product."""
    by_start = Window.partitionBy("product_id").orderBy("dw_start_date", "dim_product_sk")
    following = F.lead("dw_start_date").over(by_start)
    preceding = F.lag("dw_start_date").over(by_start)
    first_of_equal = (following == F.col("dw_start_date")) & ~F.coalesce(
        preceding == F.col("dw_start_date"), F.lit(False)
    )
    per_product = (
        dim.select(
            "product_id",
            "dw_is_current",
            flag(following < F.col("dw_end_date")).alias("overlap"),
            flag(first_of_equal).alias("same_start"),
        )
        .groupBy("product_id")
        .agg(*(F.sum(c).alias(c) for c in ("dw_is_current", "overlap", "same_start")))
    )
    return per_product.agg(
        F.coalesce(cnt_if(F.col("dw_is_current") != 1), F.lit(0)).alias("bad_current"),
        F.coalesce(F.sum("overlap"), F.lit(0)).alias("overlaps"),
        F.coalesce(F.sum("same_start"), F.lit(0)).alias("duplicate_starts"),
    )


def ensure_valid(dim: DataFrame) -> None:
    row = scd2_validate(dim).first()
    if any(row):
        raise ValueError(f"product history is inconsistent: {row.asDict()}")


def scd2_stats(dim: DataFrame, dt=None) -> DataFrame:
    """Versions, products, current, history, versions per product; with ``dt`` also opened and closed that day."""
    day = [] if dt is None else [
        F.sum(flag(F.col("dw_start_date") == day_literal(dt))).alias("opened"),
        F.sum(flag(F.col("dw_end_date") == day_literal(dt))).alias("closed"),
    ]
    per_product = dim.groupBy("product_id").agg(
        F.count("*").alias("versions"),
        cnt_if(F.col("dw_is_current") == 1).alias("current_versions"),
        cnt_if(F.col("dw_is_current") == 0).alias("history_versions"),
        *day,
    )
    names = ["versions", "current_versions", "history_versions"] + (["opened", "closed"] if day else [])
    return per_product.agg(
        F.count("*").alias("products"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)
    ).withColumn("versions_per_product", F.round(F.col("versions") / F.greatest(F.col("products"), F.lit(1)), 3))


def scd2_current(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("dw_is_current") == 1)


def scd2_asof(dim: DataFrame, facts: DataFrame, day: str = "event_date") -> DataFrame:
    """Each fact with the product version valid on its day, ``start <= day < end``; unmatched facts get NULLs.

    An equality on the product with a range on the day: a product with very many
    facts is split by AQE, as each of its few versions can be sent to every part.
    """
    versions = dim.select(
        F.col("product_id").alias("_product"),
        "dim_product_sk",
        *(F.col(c).alias("asof_" + c) for c in ATTRIBUTES),
        F.col("dw_start_date").alias("_from"),
        F.col("dw_end_date").alias("_to"),
    )
    match = (
        (F.col("product_id") == F.col("_product")) & (F.col(day) >= F.col("_from")) & (F.col(day) < F.col("_to"))
    )
    return facts.join(versions, match, "left").drop("_product", "_from", "_to")
