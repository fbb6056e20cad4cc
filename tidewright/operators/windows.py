"""Ranking, analytic and framed window functions, and the first rows of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.sources import table


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    c = lambda f, name: f.over(w).cast("long").alias(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", c(F.row_number(), "rn"), c(F.rank(), "rk"), c(F.dense_rank(), "dr"), c(F.ntile(4), "quarter"), F.round(F.percent_rank().over(w), 8).alias("share"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_type").over(w).alias("next_type"), F.first("event_id").over(w).alias("first_id"))


def running_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("last3"))


def last_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n"))


def two_dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey")


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10).select("o_orderkey", "o_totalprice")


def order_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.cume_dist().over(w), 8).alias("upto"), F.nth_value("o_orderkey", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"), F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(whole), 6).alias("share"))


QUERIES = {
    "order_ranks": (order_ranks, """
        select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as quarter, round(percent_rank() over w, 8) as share
        from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)"""),
    "event_steps": (event_steps, """
        select event_id, lag(event_id) over w as before, lead(event_type) over w as next_type, first_value(event_id) over w as first_id
        from events window w as (partition by user_id order by ts, event_id)"""),
    "running_values": (running_values, "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 4) as last3 from events"),
    "last_hour": (last_hour, "select event_id, count(*) over (partition by user_id order by floor(epoch(ts)) range between 3600 preceding and current row) as n from events"),
    "two_dearest_orders": (two_dearest_orders, "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2"),
    "order_shares": (order_shares, """
        select o_orderkey, round(cume_dist() over (partition by o_custkey order by o_orderdate, o_orderkey), 8) as upto,
        nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second,
        round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from orders"""),
    "top_orders": (top_orders, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5"),
}
