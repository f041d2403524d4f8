"""Quality gates. Each returns (event_date, seq, code, item, status, detail), status PASS, WARN or BLOCK.

Gates judge a whole range of days in one job; raising is left to the caller.
Windows without a partition below run over one row per day, after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import between_days, calendar, cnt_if, day_literal, flag, on_calendar, unusable_number
from ..session import prepare_session, stack

PASS, WARN, BLOCK = "PASS", "WARN", "BLOCK"
GATE_COLUMNS = ("event_date", "seq", "code", "item", "status", "detail")


class QualityBlock(RuntimeError):
    """At least one gate row has status BLOCK."""


def raise_on_block(gate: DataFrame) -> None:
    """Raise with the number of blocking rows and the first 20 of them."""
    blocks = gate.filter(F.col("status") == BLOCK)
    rows = blocks.orderBy("event_date", "seq").limit(20).collect()
    if rows:
        listed = "; ".join(f"{r.event_date} {r.code} ({r.detail})" for r in rows)
        raise QualityBlock(listed if len(rows) < 20 else f"{blocks.count()} blocking rows, the first: {listed}")


def passing_days(gate: DataFrame) -> DataFrame:
    """Days without a BLOCK."""
    return gate.groupBy("event_date").agg(cnt_if(F.col("status") == BLOCK).alias("blocks")).filter(
        F.col("blocks") == 0
    ).select("event_date")


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _n(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("string")


def _check(seq: int, code: str, item: str, status: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(item).alias("item"), status.alias("status"),
        detail.alias("detail"),
    )


def _rows(daily: DataFrame, checks: list[Column]) -> DataFrame:
    """One row per day and check; a check that yields NULL status does not apply."""
    return daily.select("event_date", F.inline(F.array(*checks))).filter(F.col("status").isNotNull()).select(
        *GATE_COLUMNS
    )


# --- source gate ------------------------------------------------------------

_CORE = ("user_id", "product_id", "user_session", "event_time")


def source_metrics(ods: DataFrame, start, end) -> DataFrame:
    """Row count, NULL counts and unusable prices of every wanted day, in one pass."""
    daily = ods.filter(between_days(start, end)).groupBy("event_date").agg(
        F.count("*").alias("row_cnt"),
        *(cnt_if(F.col(c).isNull()).alias(f"null_{c}") for c in _CORE),
        cnt_if(unusable_number("price")).alias("bad_price"),
    )
    return on_calendar(daily, start, end, {"row_cnt": 0})


def empty_gate(ods: DataFrame, start, end) -> DataFrame:
    return _empty(ods.filter(between_days(start, end)).groupBy("event_date").agg(F.count("*").alias("row_cnt")),
                  start, end)


def _empty(counts: DataFrame, start, end) -> DataFrame:
    daily = on_calendar(counts.select("event_date", "row_cnt"), start, end, {"row_cnt": 0})
    status = F.when(F.col("row_cnt") > 0, PASS).otherwise(BLOCK)
    return _rows(daily, [_check(1, "empty_partition", "partition not empty", status, _text("rows=", _n("row_cnt")))])


def volume_gate(
    ods: DataFrame, start, end, days: int = K.VOLUME_DAYS, warn: float = K.VOLUME_WARN,
    drop_block: float = K.VOLUME_DROP_BLOCK,
) -> DataFrame:
    """Rows of a day against the median of the last ``days`` existing days before it. Only a fall blocks."""
    counts = ods.filter(F.col("event_date") <= day_literal(end)).groupBy("event_date").agg(
        F.count("*").alias("row_cnt")
    )
    before = Window.orderBy("event_date").rowsBetween(-days, -1)
    judged = counts.withColumn("base", F.percentile("row_cnt", F.lit(0.5)).over(before)).filter(
        between_days(start, end)
    )
    base, rows = F.col("base"), F.col("row_cnt")
    diff = F.when(base != 0, (rows - base) / base).otherwise(F.lit(0.0))
    status = (
        F.when(base.isNull(), PASS)
        .when(diff >= 0, F.when(diff > warn, WARN).otherwise(PASS))
        .when(-diff > drop_block, BLOCK)
        .when(-diff > warn, WARN)
        .otherwise(PASS)
    )
    detail = F.when(base.isNull(), _text("rows=", _n("row_cnt"), " no history")).otherwise(
        _text("rows=", _n("row_cnt"), " median=", F.format_string("%.1f", base))
    )
    return _rows(judged, [_check(2, "row_count_drop", "row count against recent days", status, detail)])


def _null_checks(max_rate: float) -> list[Column]:
    out = []
    for i, c in enumerate(_CORE):
        nulls, rows = F.col(f"null_{c}"), F.col("row_cnt")
        status = F.when(rows > 0, F.when(nulls == 0, PASS).when(nulls / rows <= max_rate, WARN).otherwise(BLOCK))
        out.append(_check(3 + i, f"null_{c}", f"NULL rate of {c}", status,
                          _text("nulls=", _n(nulls), " rows=", _n(rows))))
    return out


def _price_check(max_rate: float) -> Column:
    bad, rows = F.col("bad_price"), F.col("row_cnt")
    status = F.when(rows > 0, F.when(bad / rows < max_rate, PASS).otherwise(BLOCK))
    return _check(7, "price_invalid", "NULL, NaN or infinite prices", status,
                  _text("bad=", _n(bad), " rows=", _n(rows)))


def null_gate(ods: DataFrame, start, end, max_rate: float = K.NULL_RATE_MAX) -> DataFrame:
    return _rows(source_metrics(ods, start, end), _null_checks(max_rate))


def price_gate(ods: DataFrame, start, end, max_rate: float = K.BAD_PRICE_RATE_MAX) -> DataFrame:
    return _rows(source_metrics(ods, start, end), [_price_check(max_rate)])


def ods_gate(ods: DataFrame, start, end) -> DataFrame:
    """All source checks of the range."""
    metrics = source_metrics(ods, start, end)
    checks = [
        _check(1, "empty_partition", "partition not empty",
               F.when(F.col("row_cnt") > 0, PASS).otherwise(BLOCK), _text("rows=", _n("row_cnt"))),
        *_null_checks(K.NULL_RATE_MAX),
        _price_check(K.BAD_PRICE_RATE_MAX),
    ]
    return stack([_rows(metrics, checks), volume_gate(ods, start, end)])


# --- fact gate --------------------------------------------------------------

def dwd_gate(ods: DataFrame, fact: DataFrame, dirty: DataFrame, start, end) -> DataFrame:
    """Seven checks of the fact table per day."""
    prepare_session(fact.sparkSession)  # the tables given may be unions
    in_range = between_days(start, end)
    no_key = (
        F.col("event_time").isNull() | F.col("user_id").isNull() | F.col("product_id").isNull()
        | F.col("event_type").isNull()
    )
    facts = fact.filter(in_range).groupBy("event_date").agg(
        F.count("*").alias("fact_cnt"),
        cnt_if(F.col("event_date") != F.to_date("event_time")).alias("other_day"),
        cnt_if(F.col("price") < 0).alias("negative"),
        cnt_if(~F.col("event_type").isin(*K.EVENT_TYPES)).alias("bad_type"),
        cnt_if(no_key).alias("no_key"),
        F.date_format(F.min("event_time"), "yyyy-MM-dd HH:mm:ss").alias("first_time"),
        F.date_format(F.max("event_time"), "yyyy-MM-dd HH:mm:ss").alias("last_time"),
    )
    groups = fact.filter(in_range).groupBy("event_date", *K.DEDUP_KEYS).agg(F.count("*").alias("n"))
    duplicates = groups.groupBy("event_date").agg(cnt_if(F.col("n") > 1).alias("dup_groups"))
    source = ods.filter(in_range).groupBy("event_date").agg(F.count("*").alias("ods_cnt"))
    rejected = dirty.filter(in_range).groupBy("event_date").agg(F.count("*").alias("dirty_cnt"))
    daily = calendar(fact.sparkSession, start, end)
    for part in (source, rejected, facts, duplicates):
        daily = daily.join(part, "event_date", "left")
    daily = daily.na.fill(0)  # sums over an empty day are NULL and would fail every comparison

    def zero(column: str) -> Column:
        return F.when(F.col(column) == 0, PASS).otherwise(BLOCK)

    rest = F.col("ods_cnt") - F.col("fact_cnt") - F.col("dirty_cnt")
    return _rows(daily, [
        _check(1, "count_overflow", "account balance", F.when(rest >= 0, PASS).otherwise(BLOCK),
               _text("source=", _n("ods_cnt"), " = clean=", _n("fact_cnt"), " + dirty=", _n("dirty_cnt"),
                     " + duplicates=", _n(rest))),
        _check(2, "empty_partition", "partition not empty", F.when(F.col("fact_cnt") > 0, PASS).otherwise(BLOCK),
               _text("rows=", _n("fact_cnt"))),
        _check(3, "dup_key", "event key unique", zero("dup_groups"), _text("groups=", _n("dup_groups"))),
        _check(4, "null_core_field", "core fields present", zero("no_key"), _text("rows=", _n("no_key"))),
        _check(5, "bad_event_type", "event type known", zero("bad_type"), _text("rows=", _n("bad_type"))),
        _check(6, "negative_price", "price not negative", zero("negative"), _text("rows=", _n("negative"))),
        _check(7, "timezone_offset", "partition is the UTC day", zero("other_day"),
               F.coalesce(_text("rows=", _n("other_day"), " | ", F.col("first_time"), " ~ ", F.col("last_time")),
                          F.lit("no data"))),
    ])


# --- report gate ------------------------------------------------------------

def gmv_gate(
    trade: DataFrame, start, end, days: int = K.GMV_DAYS, warn: float = K.GMV_WARN,
    drop_block: float = K.GMV_DROP_BLOCK,
) -> DataFrame:
    """gmv of a day against the median of the ``days`` days before it; skipped while there are fewer."""
    before = Window.orderBy("event_date").rowsBetween(-days, -1)
    judged = (
        trade.filter(F.col("event_date") <= day_literal(end))
        .select(
            "event_date",
            "gmv",
            F.count(F.lit(1)).over(before).alias("history"),
            F.percentile("gmv", F.lit(0.5)).over(before).alias("base"),
        )
        .filter(between_days(start, end))
    )
    gmv, base = F.col("gmv"), F.col("base")
    diff = (gmv - base) / base
    short = F.col("history") < days
    no_base = base.isNull() | (base <= 0)
    status = (
        F.when(short, PASS)
        .when(gmv.isNull(), BLOCK)
        .when(no_base, PASS)
        .when(diff >= 0, F.when(diff > warn, WARN).otherwise(PASS))
        .when(-diff > drop_block, BLOCK)
        .when(-diff > warn, WARN)
        .otherwise(PASS)
    )
    detail = (
        F.when(short, _text("history=", _n("history"), " days, skipped"))
        .when(gmv.isNull(), F.lit("no gmv"))
        .when(no_base, F.lit("median is zero, skipped"))
        .otherwise(F.format_string("gmv=%.2f median=%.2f", gmv, base))
    )
    return _rows(judged, [_check(1, "gmv_drop", "gmv against recent days", status, detail)])
