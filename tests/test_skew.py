import json

from pyspark.sql import functions as F

from tests.sample import event, frame
from tidemark.operators import cleaning, insight, skew


def sales(spark):
    """Two thirds of the rows on one key."""
    return spark.range(30000).select(
        F.when(F.col("id") % 3 != 0, F.lit(7).cast("bigint")).otherwise(F.col("id") % 500 + 100).alias("product_id"),
        (F.col("id") % 5).cast("double").alias("quantity"),
        (F.col("id") % 11).cast("double").alias("sales_amount"),
        F.col("id").alias("order_id"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("product_id", "gmv", "sales_cnt", "row_cnt").collect())


def test_all_variants_give_the_same_values(spark):
    df = sales(spark)
    want = rows(skew.agg_naive(df))
    hot = skew.hot_keys(df, min_share=0.2)
    assert rows(skew.agg_salted(df)) == want
    assert rows(skew.agg_salted_hot(df, hot)) == want
    assert rows(skew.agg_salted_hot(df, hot.filter("false"))) == want
    assert rows(skew.agg_salted_hot(df)) == want
    assert rows(skew.agg_rebalance(df)) == want
    assert [tuple(r)[1:] for r in skew.skew_equivalence(df).collect()] == [(len(want), 0)] * 3


def test_equivalence_reports_a_difference(spark, monkeypatch):
    honest = skew.agg_rebalance
    monkeypatch.setattr(skew, "agg_rebalance", lambda d, k: honest(d.filter("order_id <> 0"), k))
    got = {r["variant"]: r["diff_keys"] for r in skew.skew_equivalence(sales(spark)).collect()}
    assert got == {"salted_all": 0, "salted_hot": 0, "rebalance": 1}


def test_hot_keys_are_few_and_found(spark):
    hot = skew.hot_keys(sales(spark), min_share=0.1).collect()
    assert [r.product_id for r in hot] == [7] and len(hot) <= 10
    assert skew.hot_keys(sales(spark), rows=10**6, min_share=0.1).isEmpty()


def test_every_key_above_the_share_is_found(spark):
    """Forty keys just above the share and forty just below it, among many rare ones in an order that hides them."""
    heavy = spark.range(80).select(F.explode(F.sequence(F.lit(1), F.when(F.col("id") < 40, 1000).otherwise(999).cast("int"))), "id").select("id")
    rare = spark.range(100_000 - 40 * 1000 - 40 * 999).select((F.col("id") + 1000).alias("id"))
    df = heavy.unionByName(rare).select(F.col("id").alias("product_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half")).orderBy(F.xxhash64("id", F.rand(3)))
    got = skew.hot_keys(df, min_share=0.01).collect()
    assert sorted(tuple(r) for r in got) == [(k, 1000) for k in range(40)]
    both = skew.hot_keys(df, ["product_id", "half"], min_share=0.01).collect()  # NULL is a key like any other
    assert sorted((r.product_id, r.half) for r in both) == [(k, k if k % 2 == 0 else None) for k in range(40)]
    assert skew.hot_keys(df.filter("false")).isEmpty()
    plan = skew.agg_salted_hot(sales(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_salt_spreads_the_hot_key_over_reducers(spark):
    salted = sales(spark).repartition(8).withColumn("s", skew._salt(16)).filter("product_id = 7")
    sizes = [r["count"] for r in salted.groupBy("s").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_salting_and_hot_keys_read_what_they_need(spark, folder):
    sales(spark).withColumn("unused", F.lit("x")).write.parquet(f"{folder}/sales")
    df = spark.read.parquet(f"{folder}/sales")
    plan = skew.agg_salted(df)._jdf.queryExecution().executedPlan().toString()
    assert "order_id" not in plan and "unused" not in plan
    hot = skew.hot_keys(df, min_share=0.2)
    assert [r.product_id for r in hot.collect()] == [7]


def test_a_pair_of_any_size_is_spread_over_time(spark):
    """Half a percent or nearly all events: the join key holds a quarter of the time limit, and the values are the same."""
    many = spark.range(0, 20_000, 1, 8).select(
        F.timestamp_seconds(F.lit(1569891600) + F.col("id") * 60).alias("event_time"),
        F.when(F.col("id") == 7, "view").when(F.col("id") % 2 == 0, "cart").otherwise("purchase").alias("event_type"),
        F.lit(1).cast("bigint").alias("product_id"), F.lit(1).cast("bigint").alias("user_id"))
    steps = insight.funnel_steps(many, 24)
    (row,) = steps.collect()
    start = 1569891600
    assert [t.timestamp() for t in (row.view_time, row.cart_time, row.purchase_time)] == [start + 60 * k for k in (7, 8, 9)]
    assert "_part" in steps._jdf.queryExecution().executedPlan().toString()


def test_strict_funnel_with_a_hot_pair(spark):
    events = [event(0, 1, "view", 1, "a", 1), event(0, 2, "view", 2, "a", 2), event(0, 3, "cart", 2, "a", 2),
              event(0, 4, "purchase", 2, "a", 2), event(0, 1, "cart", 3, "a", 3), event(0, 2, "view", 3, "a", 3),
              event(0, 3, "purchase", 3, "a", 3), event(0, 1, "view", 4, "a", 4), event(1, 2, "cart", 4, "a", 4)]
    fact = cleaning.build_fact(frame(spark, events))
    many = spark.range(4000).select(
        F.timestamp_seconds(F.lit(1569891600) + F.col("id")).alias("event_time"), F.lit("cart").alias("event_type"),
        F.lit(1).cast("bigint").alias("product_id"), F.lit(1).cast("bigint").alias("user_id"),
    )
    fact = fact.select("event_time", "event_type", "product_id", "user_id").unionByName(
        many.select("event_time", "event_type", "product_id", "user_id")
    )
    steps = insight.funnel_steps(fact, 24)
    got = {r.user_id: (r.cart_time is not None, r.purchase_time is not None) for r in steps.collect()}
    # user 3 carted before the view, user 4 after 25 hours
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (False, False)}


def test_task_skew_reads_an_event_log(spark, folder):
    def task(stage, ms, read):
        return json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": stage,
                           "Task Info": {"Launch Time": 1000, "Finish Time": 1000 + ms},
                           "Task Metrics": {"Shuffle Read Metrics": {"Local Bytes Read": read, "Remote Bytes Read": 0}}})

    lines = [task(0, 10, 0), task(0, 30, 0), task(1, 10, 5), task(1, 10, 5), task(1, 100, 50), task(1, 0, 5),
             '{"Event": "SparkListenerJobEnd"}', "not json"]
    with open(f"{folder}/log", "w") as f:
        f.write("\n".join(lines))
    got = {(r.stage_id, r.side): r for r in skew.task_skew(spark, f"{folder}/log").collect()}
    assert set(got) == {(0, "all"), (1, "all"), (1, "reduce")}
    assert (got[1, "reduce"].tasks, got[1, "reduce"].skew_ratio, got[1, "reduce"].read_skew) == (3, 10.0, 10.0)
    assert got[0, "all"].read_skew is None
