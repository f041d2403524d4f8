"""Dated URL lists: entries become validity intervals, and every capture is judged by those active when it was fetched.

List entries are dated changes (list, kind, pattern, verdict, action, dated):

* kind ``domain``: a host and all hosts below it; ``prefix``: host and path up to a
  slash; ``url``: one address (host and path).
* verdict ``block`` or ``allow``; action ``add`` or ``remove``.

A capture is taken apart into the keys an entry could have (host suffixes, path
prefixes, its address), which are joined by equality with the intervals, narrowed
to those active at fetch time. The most specific active entry decides: ``url``, then the
longest prefix, then the longest domain; at equal length ``allow``, then the
smallest list name. DataFrame functions only; the join splits a host that holds a
third of all captures where the adaptive planner finds it skewed.

Rows: one row out per capture. A null or unreadable url, or a null time, matches
nothing and is allowed. Entries with a null in list, kind, pattern, verdict, action
or date are ignored; of several changes of an entry on a day a removal comes last.
Repeated additions keep an interval open. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Host in small letters without user, port and closing dot; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, '/' at least."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, verdict, since, until): an entry is active from ``since`` up to, not including, ``until``."""
    fine = entries.select("list", "kind", F.lower("pattern").alias("pattern"), "verdict", "action", F.col("dated").cast("date").alias("dated")).dropna()
    order = Window.partitionBy("list", "kind", "pattern", "verdict").orderBy("dated", F.col("action") == "remove")
    return (
        fine.distinct()
        .withColumn("before", F.lag("action").over(order)).withColumn("closed", F.min(F.when(F.col("action") == "remove", F.col("dated"))).over(
            order.rowsBetween(1, Window.unboundedFollowing)))
        .filter("action = 'add' AND (before IS NULL OR before = 'remove')")
        .select("list", "kind", "pattern", "verdict", F.col("dated").alias("since"), F.coalesce("closed", F.lit(FOREVER).cast("date")).alias("until"))
        .filter("since < until")
    )


def keys(host: Column, path: Column) -> Column:
    """array<struct<kind, pattern>> of all entries that could hold for an address."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    steps = F.split(path, "/")  # '/a/b' gives '', a, b: prefixes '/', '/a/'
    address = F.lower(F.concat(host, path))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.lower(F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))).alias("pattern")))
    return F.array_distinct(F.concat(domains, prefixes, F.array(F.struct(F.lit("url").alias("kind"), address.alias("pattern")))))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """page_id, url, fetched, verdict, list, kind, pattern (of the entry that decides; null without one), n_active."""
    scratch = Scratch(captures.sparkSession, "urlfilter")
    rows = captures.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(time_col).cast("date").alias("fetched"))
    rows = scratch.keep(rows, "captures")
    active = intervals(entries)
    asked = (
        rows.filter("fetched IS NOT NULL").withColumn("host", host_of(F.col("url"))).filter("host != ''")
        .select("_row", "fetched", F.inline(keys(F.col("host"), path_of(F.col("url")))))
    )
    rank = F.struct(
        F.when(F.col("kind") == "url", 2).when(F.col("kind") == "prefix", 1).otherwise(0).alias("kind_rank"),
        F.length("pattern").alias("size"), (F.col("verdict") == "allow").alias("allows"))
    hit = asked.join(active, ["kind", "pattern"]).filter("since <= fetched AND fetched < until")
    best = hit.groupBy("_row").agg(
        F.count("*").alias("n_active"),
        F.min(F.struct((-rank["kind_rank"]).alias("a"), (-rank["size"]).alias("b"), (~rank["allows"]).alias("c"), "list", "kind", "pattern", "verdict")).alias("best"))
    return rows.join(best, "_row", "left").select(
        "page_id", "url", "fetched", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.list").alias("list"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"))
