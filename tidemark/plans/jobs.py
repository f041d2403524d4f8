"""Building the warehouse: a range of days, one day, checks only, and backfill.

A step is a function over tables; a range is computed in one Spark job per table,
whatever the number of days.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import between_days, calendar
from ..operators import bitmap, cleaning, daily, dims, quality, reconcile, reports, scd2, sketches
from ..session import stack
from ..sources.events import RAW
from ..sources.warehouse import Warehouse, Written

FACT, DIRTY = "dwd_event_fact", "dwd_event_dirty"
SESSION, PRODUCT, USER, HOUR = (
    "dws_user_session_daily", "dws_product_daily", "dws_user_behavior_daily", "dws_traffic_hour_daily",
)
TRADE, FUNNEL, HOT, SESSION_REPORT, HOUR_REPORT, RETENTION, RFM, OVERVIEW, BITMAP = (
    "ads_trade_daily", "ads_conversion_funnel_daily", "ads_product_hot_rank_daily", "ads_session_behavior_daily",
    "ads_traffic_hour_daily", "ads_user_retention_daily", "ads_user_rfm_snapshot", "ads_ec_daily_overview",
    "dwd_user_uv_bitmap",
)
SKETCH = "dws_user_sketch_daily"
LAYERS = ("dwd", "dws", "dim", "ads")


class _Run:
    """One run: its range, and the range that retention and RFM look back over."""

    def __init__(self, wh: Warehouse, start, end, data_start, single_day=False, skip_existing=False, force=False,
                 on_block="raise"):
        self.wh, self.start, self.end, self.data_start = wh, str(start), str(end), str(data_start)
        self.single_day, self.skip_existing, self.force = single_day, skip_existing, force
        self.on_block = on_block

    def days(self, name: str) -> DataFrame:
        return self.wh.read(name, self.start, self.end)

    def put(self, name: str, df: DataFrame) -> Written:
        return self.wh.write_partitions(name, df, covering=(self.start, self.end))

    def judge(self, gate: DataFrame) -> None:
        if self.on_block == "raise":
            quality.raise_on_block(gate)

    # --- dwd ---
    def dwd_event_fact(self) -> Written:
        absent = self.wh.missing_days(RAW, self.start, self.end)
        if absent:
            raise ValueError(f"no source events on {', '.join(map(str, absent))}; load them first")
        raw = self.days(RAW)
        if self.skip_existing:
            wanted = self.wh.missing_days(FACT, self.start, self.end)
            if not wanted:
                return Written(0, ())
            return self.wh.write_partitions(FACT, cleaning.build_fact(raw.filter(F.col("event_date").isin(wanted))))
        return self.put(FACT, cleaning.build_fact(raw))

    def dwd_event_dirty(self) -> Written:
        """Also takes the rows without a readable time, which belong to no day."""
        raw = self.wh.read(RAW).filter(between_days(self.start, self.end) | F.col("event_date").isNull())
        return self.put(DIRTY, cleaning.dirty_events(raw))

    def dwd_event_fact_dqc(self) -> None:
        gate = quality.dwd_gate(self.days(RAW), self.days(FACT), self.days(DIRTY), self.start, self.end)
        self.judge(gate)

    # --- dws ---
    def dws_user_session(self):
        return self.put(SESSION, daily.user_session_daily(self.days(FACT)))

    def dws_product(self):
        return self.put(PRODUCT, daily.product_daily(self.days(FACT)))

    def dws_user_behavior(self):
        return self.put(USER, daily.user_behavior_daily(self.days(FACT)))

    def dws_traffic_hour(self):
        return self.put(HOUR, daily.traffic_hour_daily(self.days(FACT)))

    def uv_bitmap(self):
        return self.put(BITMAP, bitmap.build_uv_bitmap(self.days(USER)))

    def user_sketch(self):
        return self.put(SKETCH, sketches.daily_sketches(self.days(USER)))

    # --- dim ---
    def dim_product_scd2(self):
        name = "dim_product_scd2"
        if self.single_day:
            scd2.ensure_mergeable(self.wh.read(name), self.end)
            written = self.wh.rewrite(name, lambda dim: scd2.scd2_merge(dim, self.days(FACT), self.end))
        else:
            outside = [d for d in self.wh.partitions(FACT) if not self.start <= d <= self.end]
            if outside and not self.force:
                raise ValueError(
                    f"the range leaves out {len(outside)} fact days; a rebuild would lose their product versions"
                )
            written = self.wh.overwrite(name, scd2.scd2_build(self.days(FACT), self.start, self.end))
        scd2.ensure_valid(self.wh.read(name))
        return written

    def dim_user(self):
        if self.single_day:
            return self.wh.rewrite("dim_user", lambda dim: dims.merge_user_dim(dim, self.days(FACT), self.end))
        return self.wh.overwrite("dim_user", dims.user_dim(self.wh.read(FACT)))

    def dim_session(self):
        if self.single_day:
            new = dims.new_sessions(self.wh.read("dim_session"), self.days(FACT), self.end)
            return self.wh.append_new("dim_session", new)
        return self.wh.overwrite("dim_session", dims.session_dim(self.wh.read(FACT)))

    def dim_category(self):
        if self.single_day:
            return self.wh.rewrite(
                "dim_category", lambda dim: dims.merge_category_dim(dim, self.days(FACT), self.end)
            )
        return self.wh.overwrite("dim_category", dims.category_dim(self.wh.read(FACT)))

    def dim_date(self):
        return ensure_date_dim(self.wh, self.start, self.end)

    # --- ads ---
    def ads_trade(self):
        written = self.put(TRADE, reports.trade_daily(self.days(USER), self.start, self.end))
        self.judge(quality.gmv_gate(self.wh.read(TRADE), self.start, self.end))
        return written

    def ads_conversion_funnel(self):
        return self.put(FUNNEL, reports.funnel_daily(self.days(FACT), self.start, self.end))

    def ads_product_hot_rank(self):
        return self.put(HOT, reports.hot_rank_daily(self.days(PRODUCT)))

    def ads_session_behavior(self):
        return self.put(SESSION_REPORT, reports.session_behavior_daily(self.days(SESSION), self.start, self.end))

    def ads_traffic_hour(self):
        return self.put(HOUR_REPORT, reports.traffic_hour_report(self.days(HOUR)))

    def ads_user_retention(self):
        """One more day changes that day and the days it is an offset away from; all they need lies between them."""
        last = date.fromisoformat(str(self.end))
        changed = [last - timedelta(days=n) for n in (0, *K.RETENTION_OFFSETS)] if self.single_day else None
        first = max(min(changed).isoformat(), str(self.data_start)) if changed else self.data_start
        report = reports.retention_daily(self.wh.read(USER, first, self.end), first, self.end)
        return self.wh.write_partitions(RETENTION, report.filter(F.col("event_date").isin(changed)) if changed else report)

    def ads_user_rfm(self):
        """From the user aggregate, one row per user and day, rather than from all facts."""
        users = self.wh.read(USER, self.data_start, self.end)
        return self.wh.replace_snapshot(RFM, reports.rfm_from_daily(users, self.data_start, self.end))

    def ads_overview(self):
        return self.put(OVERVIEW, reports.daily_overview(
            self.days(FACT), self.days(USER), self.days(SESSION), self.days(HOUR), self.wh.read("dim_user"),
            bitmap.uv_daily(self.days(BITMAP)),
        ))


STEPS = {
    "dwd": ("dwd_event_fact", "dwd_event_dirty", "dwd_event_fact_dqc"),
    "dws": ("dws_user_session", "dws_product", "dws_user_behavior", "dws_traffic_hour", "uv_bitmap", "user_sketch"),
    "dim": ("dim_product_scd2", "dim_user", "dim_session", "dim_category", "dim_date"),
    "ads": (
        "ads_trade", "ads_conversion_funnel", "ads_product_hot_rank", "ads_session_behavior", "ads_traffic_hour",
        "ads_user_retention", "ads_user_rfm", "ads_overview",
    ),
}

#: These wait for all steps before them: they read what those wrote, or those may stop the run. The steps between two
#: of them write different tables and run side by side, so that small jobs do not leave the cluster idle.
_WAIT = ("dwd_event_dirty", "dwd_event_fact_dqc", "dws_user_session", "uv_bitmap", "ads_conversion_funnel")


def ensure_date_dim(wh: Warehouse, start, end) -> Written:
    """The calendar of the years touched; built only when the table is empty."""
    if not wh.read("dim_date").isEmpty():
        return Written(0, ())
    first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    return wh.overwrite("dim_date", dims.date_dim(wh.spark, f"{first.year}-01-01", f"{last.year}-12-31"))


def _execute(run: _Run, layers, steps) -> dict[str, Written | None]:
    unknown = [n for n in (*(layers or ()),) if n not in STEPS] + [
        n for n in (steps or ()) if all(n not in names for names in STEPS.values())
    ]
    if unknown:
        raise ValueError(f"unknown layers or steps: {', '.join(unknown)}")
    waves: list[list[str]] = [[]]
    for layer in LAYERS:
        for name in STEPS[layer]:
            if name in _WAIT:
                waves.append([])
            if (layers is None or layer in layers) and (steps is None or name in steps):
                waves[-1].append(name)
    done = {}
    for wave in filter(None, waves):
        with ThreadPoolExecutor(len(wave)) as pool:  # leaves when all have ended, also after a failure
            running = [pool.submit(getattr(run, name)) for name in wave]
        done |= {name: step.result() for name, step in zip(wave, running)}
    return done


def build_range(wh: Warehouse, start, end, layers=None, steps=None, skip_existing=False, force=False,
                on_block="raise") -> dict:
    """Rebuild all tables for ``[start, end]``; dimensions are rebuilt, retention and RFM look at the range.

    A blocking gate raises and stops the run; what was written before stays. A step that
    fails lets those beside it end. With
    ``on_block="continue"`` the gates are left to the caller.
    """
    run = _Run(wh, start, end, start, skip_existing=skip_existing, force=force, on_block=on_block)
    return _execute(run, layers, steps)


def build_day(wh: Warehouse, dt, data_start, layers=None, steps=None, on_block="raise") -> dict:
    """Add one day: dimensions are merged, retention and RFM look back to ``data_start``."""
    return _execute(_Run(wh, dt, dt, data_start, single_day=True, on_block=on_block), layers, steps)


def check(wh: Warehouse, start, end) -> DataFrame:
    """All reconciliations of the range as (check, ok, detail). Reads tables only."""
    def rd(name):
        return wh.read(name, start, end)

    fact, user, product, session = rd(FACT), rd(USER), rd(PRODUCT), rd(SESSION)
    results = {
        "purchase_conservation": reconcile.purchase_conservation(
            fact, user, product, session, rd(TRADE), start, end),
        "gmv_conservation": reconcile.gmv_conservation(fact, user, product, rd(TRADE), start, end),
        "funnel": reconcile.funnel_violations(rd(FUNNEL)).withColumn("ok", F.expr("int(violations = 0)")),
        "scd2_current": reconcile.current_version_violations(wh.read("dim_product_scd2")).withColumn(
            "ok", F.expr("int(violations = 0)")),
        "hour_conservation": reconcile.hour_conservation(fact, rd(HOUR), rd(HOUR_REPORT), start, end),
        "retention": reconcile.retention_check(rd(RETENTION), start, end),
        "fact_present": fact.agg(F.count("*").alias("rows")).withColumn("ok", F.expr("int(rows > 0)")),
    }
    rows = [
        df.select(F.lit(name).alias("check"), F.col("ok").cast("int").alias("ok"), F.to_json(F.struct("*")).alias("detail"))
        for name, df in results.items()
    ]
    return stack(rows)


def _recent(wh: Warehouse, start, end) -> DataFrame:
    """The source days of the range and those the volume gate looks back to, chosen from the list of partitions."""
    days = [d for d in wh.partitions(RAW) if d < str(start)][-K.VOLUME_DAYS:] + [d for d in wh.partitions(RAW) if str(start) <= d <= str(end)]
    return wh.read(RAW).filter(F.col("event_date").isin([date.fromisoformat(d) for d in days] or [None]))


def backfill(wh: Warehouse, events: DataFrame, start, end) -> DataFrame:
    """Load the missing days of the range that pass the source gate; report every day.

    One scan judges all days, one more writes those that pass. A failed day does
    not stop the others. Returns (event_date, status, codes), status ``existing``,
    ``loaded`` or ``failed``.
    """
    spark = wh.spark
    wanted = wh.missing_days(RAW, start, end)
    incoming = cleaning.with_event_date(events).select(*wh.spec(RAW).column_names).filter(
        F.col("event_date").isin(wanted) if wanted else F.lit(False)
    )
    gate = quality.ods_gate(stack([_recent(wh, start, end), incoming]), start, end).filter(F.col("status") == quality.BLOCK)
    blocked: dict = {}
    for row in gate.select("event_date", "seq", "code").orderBy("event_date", "seq").collect():  # a few rows per day
        blocked.setdefault(row.event_date, []).append(row.code)
    passing = [d for d in wanted if d not in blocked]
    if passing:
        wh.write_partitions(RAW, incoming.filter(F.col("event_date").isin(passing)))
    report = calendar(spark, start, end)
    failed = F.col("event_date").isin([d for d in wanted if d in blocked] or [None])
    loaded = F.col("event_date").isin(passing or [None])
    codes = F
    for day, names in blocked.items():
        codes = codes.when(F.col("event_date") == F.lit(day), ",".join(names))
    text = codes.otherwise("") if blocked else F.lit("")
    return report.select(
        "event_date",
        F.when(failed, "failed").when(loaded, "loaded").otherwise("existing").alias("status"),
        F.when(failed, text).otherwise("").alias("codes"),
    )
