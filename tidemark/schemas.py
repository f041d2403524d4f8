"""Registry of every table: columns, types, comments, partition column.

The ``StructType`` is the single declaration; DDL text is generated from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "binary": T.BinaryType(),
    "array<smallint>": T.ArrayType(T.ShortType()),
}


@dataclass(frozen=True)
class TableSpec:
    layer: str
    name: str
    comment: str
    columns: tuple[tuple[str, str, str], ...]
    partition: str | None = None
    partition_type: str = "date"

    @property
    def schema(self) -> T.StructType:
        """Columns in table order, the partition column last."""
        fields = [T.StructField(n, _TYPES[t], True, {"comment": c} if c else None) for n, t, c in self.columns]
        if self.partition:
            fields.append(T.StructField(self.partition, _TYPES[self.partition_type], True))
        return T.StructType(fields)

    @property
    def column_names(self) -> list[str]:
        return self.schema.fieldNames()

    def ddl(self, database: str, location: str) -> str:
        def line(f: T.StructField) -> str:
            note = (f.metadata or {}).get("comment")
            suffix = " COMMENT '" + note.replace("'", "\\'") + "'" if note else ""
            return f"`{f.name}` {f.dataType.simpleString()}{suffix}"

        body = ", ".join(line(f) for f in self.schema.fields)
        parts = f" PARTITIONED BY (`{self.partition}`)" if self.partition else ""
        return (
            f"CREATE TABLE IF NOT EXISTS {database}.{self.name} ({body}) USING parquet{parts} "
            f"COMMENT '{self.comment}' LOCATION '{location}'"
        )


def _spec(layer, name, comment, columns, partition=None, partition_type="date") -> TableSpec:
    parsed = []
    for item in columns:
        head, _, note = item.partition(" -- ")
        col, typ = head.split()
        parsed.append((col, typ, note))
    return TableSpec(layer, name, comment, tuple(parsed), partition, partition_type)


_DAY = "event_date"

SOURCE_COLUMNS = (
    "event_time timestamp -- UTC",
    "event_type string",
    "product_id bigint",
    "category_id bigint",
    "category_code string",
    "brand string",
    "price double",
    "user_id bigint",
    "user_session string",
)

TABLES: dict[str, TableSpec] = {
    s.name: s
    for s in (
        _spec("ods", "ods_event_log", "raw events, unchanged", SOURCE_COLUMNS, _DAY),
        _spec("dwd", "dwd_event_fact", "clean, de-duplicated events", (
            "event_time timestamp -- UTC", "event_type string", "behavior_type string -- label of event_type",
            "product_id bigint", "category_id bigint -- as seen on the event", "category_code string", "brand string",
            "price double", "user_id bigint", "user_session string", "is_purchase int -- 0/1", "event_hour int -- 0..23",
        ), _DAY),
        _spec("dwd", "dwd_event_dirty", "rejected events with the first matching reason",
              SOURCE_COLUMNS + ("dirty_reason string -- null_key, invalid_event_type, negative_price",), _DAY),
        _spec("dim", "dim_product_scd2", "product versions", (
            "dim_product_sk bigint -- surrogate key of the version", "product_id bigint", "category_id bigint",
            "category_code string", "brand string", "dw_start_date date -- first day, included",
            "dw_end_date date -- first day no longer valid; 9999-12-31 while current", "dw_is_current int -- 0/1",
        )),
        _spec("dim", "dim_date", "calendar", (
            "date_id date", "year int", "month int", "day int", "week_of_year int -- ISO",
            "day_of_week int -- 1 is Sunday", "is_workday int -- Monday to Friday",
        )),
        _spec("dim", "dim_user", "users", (
            "user_id bigint", "first_seen_date date", "last_seen_date date", "active_days bigint",
            "first_purchase_date date -- NULL without purchase", "purchase_days bigint",
        )),
        _spec("dim", "dim_category", "categories", (
            "category_id bigint", "category_code string", "category_l1 string", "category_l2 string",
            "category_l3 string",
        )),
        _spec("dim", "dim_session", "sessions", (
            "user_session string", "user_id bigint -- the largest id when several users share it",
            "session_start_time timestamp", "session_end_time timestamp",
        )),
        _spec("dws", "dws_user_session_daily", "day x user x session", (
            "user_id bigint", "user_session string", "view_cnt bigint", "cart_cnt bigint", "purchase_cnt bigint",
            "remove_cart_cnt bigint", "session_duration_sec bigint",
        ), _DAY),
        _spec("dws", "dws_product_daily", "day x product", (
            "product_id bigint", "category_id bigint", "brand string", "exposure_uv bigint -- users who viewed",
            "cart_uv bigint", "purchase_uv bigint", "sales_cnt bigint", "sales_amount double",
        ), _DAY),
        _spec("dws", "dws_user_behavior_daily", "day x user", (
            "user_id bigint", "active_action_cnt bigint", "purchase_amount double",
            "purchase_product_cnt bigint -- distinct products", "purchase_cnt bigint",
        ), _DAY),
        _spec("dws", "dws_traffic_hour_daily", "day x hour; only pv may be summed over hours", (
            "event_hour int", "pv bigint", "uv bigint", "view_pv bigint", "cart_cnt bigint", "purchase_cnt bigint",
            "purchase_uv bigint", "gmv double", "session_cnt bigint",
        ), _DAY),
        _spec("ads", "ads_trade_daily", "trade report", (
            "gmv double", "order_cnt bigint", "buyer_cnt bigint", "avg_order_value double -- 0 without orders",
            "arppu double -- 0 without buyers",
        ), _DAY),
        _spec("ads", "ads_conversion_funnel_daily", "funnel report; rates 0..1, not clamped", (
            "view_uv bigint", "cart_uv bigint", "purchase_uv bigint", "view_to_cart_rate double",
            "view_to_purchase_rate double", "cart_to_purchase_rate double -- may exceed 1",
        ), _DAY),
        _spec("ads", "ads_product_hot_rank_daily", "top products of the day", (
            "rank int", "product_id bigint", "category_id bigint", "brand string", "sales_cnt bigint",
            "sales_amount double", "exposure_uv bigint",
        ), _DAY),
        _spec("ads", "ads_session_behavior_daily", "session report", (
            "session_cnt bigint", "avg_duration_sec double", "avg_action_cnt double",
            "cart_purchase_rate double -- 0..1, 0 without carts",
        ), _DAY),
        _spec("ads", "ads_traffic_hour_daily", "hourly report; shares and rate in percent", (
            "event_hour int", "time_bucket string", "pv bigint", "uv bigint", "purchase_cnt bigint",
            "purchase_uv bigint", "gmv double", "pv_share double -- percent", "order_share double -- percent",
            "purchase_rate double -- percent, NULL without users", "is_peak_hour int -- 0/1, ties all flagged",
        ), _DAY),
        _spec("ads", "ads_user_retention_daily", "retention by base day; NULL past the end of the data", (
            "d0_uv bigint", "d1_uv bigint", "d1_rate double -- percent", "d3_uv bigint", "d3_rate double -- percent",
            "d7_uv bigint", "d7_rate double -- percent",
        ), _DAY),
        _spec("ads", "ads_user_rfm_snapshot", "RFM of every buyer, newest snapshot only", (
            "user_id bigint", "r_days bigint", "f_cnt bigint", "m_amount double", "rfm_seg string",
        ), "as_of_dt", "string"),
        _spec("ads", "ads_ec_daily_overview", "daily overview; rates 0..1, 0 without a base", (
            "uv bigint -- exact, from bitmaps", "pv bigint", "session_cnt bigint", "view_uv bigint", "cart_uv bigint",
            "purchase_uv bigint", "gmv double", "order_cnt bigint", "buyer_cnt bigint", "new_user_cnt bigint",
            "old_user_cnt bigint -- uv minus new users", "avg_order_value double", "arppu double", "arpu double",
            "view_to_cart_rate double", "view_to_purchase_rate double", "cart_to_purchase_rate double",
            "avg_duration_sec double", "avg_action_cnt double", "cart_purchase_rate double",
        ), _DAY),
        _spec("dwd", "dwd_user_uv_bitmap", "users of a day in chunks of 32,768 ids", (
            "bucket bigint -- chunk number", "users int", "positions array<smallint> -- users of a chunk with few, ascending",
            "user_bitmap binary -- users of a chunk with many",
        ), _DAY),
        _spec("dws", "dws_user_sketch_daily", "mergeable sketches of a day", (
            "users_hll binary -- distinct users", "users_theta binary -- users, for common and lost ones",
            "events_kll binary -- events per user",
        ), _DAY),
    )
}

LAYERS = ("ods", "dwd", "dim", "dws", "ads")

#: schema of the clickstream source files
EVENT_SCHEMA = T.StructType([f for f in TABLES["ods_event_log"].schema.fields if f.name != _DAY])
EVENT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss z"
