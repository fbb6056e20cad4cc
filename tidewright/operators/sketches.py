"""Mergeable sketches: a table of them by hour is merged to days and weeks without reading the events again.

A row holds a HyperLogLog and a theta sketch of users and a quantile sketch (KLL) of values, a few kilobytes each whatever the number
of events. Sketches of parts merge to one of the whole, so late events are absorbed by sketching them alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources import table

#: Base-two logarithm of the registers of a HyperLogLog sketch, and of the entries of a theta sketch; K of a quantile sketch.
LOG_REGISTERS, LOG_ENTRIES, K = 12, 12, 200
#: Stated errors: of counts relative, at three standard deviations; of quantiles in ranks, at 99 %.
USERS_ERROR, RANK_ERROR = 3 * 1.04 / math.sqrt(1 << LOG_REGISTERS), 0.0133 * 1.1
THETA_ERROR = 3 / math.sqrt(1 << LOG_ENTRIES)


def sketched(events: DataFrame, unit: str = "hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """A row of sketches for each `unit` of ts and `by`. Null users and values are in no sketch, but in n; a null ts is a unit of its own."""
    return events.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("start"), *by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("user_id", LOG_REGISTERS).alias("users"), F.theta_sketch_agg("user_id", LOG_ENTRIES).alias("user_set"), F.kll_sketch_agg_double("value", K).alias("values"))


def rolled(sketches: DataFrame, unit: str, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The sketches of `sketched` merged to a longer unit or fewer columns; also merges those of late events with what was there."""
    return sketches.groupBy(F.date_trunc(unit, "start").cast("timestamp_ntz").alias("start"), *by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.theta_union_agg("user_set", LOG_ENTRIES).alias("user_set"), F.kll_merge_agg_double("values", K).alias("values"))


def users(sketch: str = "users") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "values") -> Column:
    """The value at `share` of the ranks; null for a sketch of nothing."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def returning(sketches: DataFrame, days: int = 1) -> DataFrame:
    """For each day of `sketches` (start, user_set) the users of that day who were there `days` days before, by intersection of theta sketches."""
    before = sketches.select((F.col("start") + F.expr(f"interval {days} days")).alias("start"), F.col("user_set").alias("__before"))
    return sketches.join(before, "start").select("start", F.theta_sketch_estimate(F.theta_intersection("user_set", "__before")).alias("returning"))


def _held_to_exact(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """Exact counts of users beside whether the estimates of merged hourly sketches lie within the stated errors."""
    events = table(spark, sf_dir, "events")
    merged = rolled(sketched(events), unit).select("start", "event_type", F.col("n").alias("n_events"), users().alias("about"), quantile(0.5).alias("median"))
    exact = events.select(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("start"), "event_type", "user_id", "value").join(merged.select("start", "event_type", "median"), ["start", "event_type"])
    counts = exact.groupBy("start", "event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count("value").alias("n"), F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    close = F.abs(F.col("about") - F.col("n_users")) <= F.greatest(F.lit(1.0), USERS_ERROR * F.col("n_users"))
    half, off = 0.5 * F.col("n"), 1 + RANK_ERROR * F.col("n")
    return merged.join(counts, ["start", "event_type"]).select("start", "event_type", "n_events", "n_users", close.alias("users_close"), ((F.col("below") <= half + off) & (F.col("upto") >= half - off)).alias("median_close"))


def sketched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_to_exact(spark, sf_dir, "day")


def sketched_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_to_exact(spark, sf_dir, "week")


def returning_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each day who were there the day before: the exact number, and whether the sketches' is within its error, which goes by the two days' users."""
    events = table(spark, sf_dir, "events")
    about = returning(rolled(sketched(events), "day", ()))
    seen = events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "user_id").where("user_id is not null").distinct()
    both = seen.join(seen.select((F.col("start") + F.expr("interval 1 day")).alias("start"), "user_id"), ["start", "user_id"]).groupBy("start").agg(F.count("*").alias("n_returning"))
    size = seen.groupBy("start").agg(F.count("*").alias("n_users"))
    size = size.join(size.select((F.col("start") + F.expr("interval 1 day")).alias("start"), F.col("n_users").alias("before")), "start")
    found = about.join(size, "start").join(both, "start", "left").withColumn("n_returning", F.coalesce("n_returning", F.lit(0).cast("long")))
    return found.select("start", "n_returning", (F.abs(F.col("returning") - F.col("n_returning")) <= F.greatest(F.lit(1.0), THETA_ERROR * (F.col("n_users") + F.col("before")))).alias("close"))


QUERIES = {
    "sketched_days": (sketched_days, """
        select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n_events, count(distinct user_id) as n_users, true as users_close, true as median_close from events group by 1, 2"""),
    "sketched_weeks": (sketched_weeks, """
        select date_trunc('week', ts)::timestamp as start, event_type, count(*) as n_events, count(distinct user_id) as n_users, true as users_close, true as median_close from events group by 1, 2"""),
    "returning_users": (returning_users, """
        with d as (select distinct date_trunc('day', ts)::timestamp as start, user_id from events), s as (select distinct start from d)
        select s.start, (select count(*) from d a join d b on a.user_id = b.user_id and b.start = a.start - interval 1 day where a.start = s.start) as n_returning, true as close
        from s where exists (select 1 from s t where t.start = s.start - interval 1 day)"""),
}
