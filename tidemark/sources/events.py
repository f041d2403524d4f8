"""Reading clickstream files and loading them into the raw layer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_literal
from ..operators.cleaning import with_event_date
from ..schemas import EVENT_SCHEMA, EVENT_TIME_FORMAT
from ..session import prepare_session
from .warehouse import Warehouse, Written

RAW = "ods_event_log"


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV with header, in the fixed schema; a value that does not parse is NULL."""
    prepare_session(spark)
    return spark.read.schema(EVENT_SCHEMA).csv(path, header=True, sep=",", timestampFormat=EVENT_TIME_FORMAT)


def ingest_bulk(wh: Warehouse, events: DataFrame) -> Written:
    """All days in one scan. Days not in the input stay as they are; unreadable times go to the NULL day."""
    return wh.write_partitions(RAW, with_event_date(events))


def ingest_day(wh: Warehouse, events: DataFrame, dt) -> Written:
    """One UTC day. Nothing is done if the day exists; a day without rows is an error."""
    if not wh.missing_days(RAW, dt, dt):
        return Written(0, ())
    day = with_event_date(events).filter(F.col("event_date") == day_literal(dt))
    written = wh.write_partitions(RAW, day)
    if written.rows == 0:
        raise ValueError(f"no events on {date.fromisoformat(str(dt))}")
    return written
