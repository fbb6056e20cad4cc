"""Joins of two streams by key and time, whose state both sides let go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources import table


def interval_join(left: DataFrame, right: DataFrame, on: dict[str, str], times: tuple[str, str], after: str, upto: str, how: str = "inner") -> DataFrame:
    """Rows of `left` with those of `right` that have equal keys and a time from `after` to `upto` (intervals) later; how: inner or left.

    Of tables a plain join. Of streams both need a watermark on their time: each side is kept only as long as the other side's watermark allows a partner, and with `left`
    a row without one is emitted when that time is over, so rows near the end of a stream are still to come. Column names must differ.
    Null keys and times match nothing.
    """
    a, b = F.col(times[0]), F.col(times[1])
    near = (b >= a + F.expr(f"interval {after}")) & (b <= a + F.expr(f"interval {upto}"))
    for x, y in on.items():
        near = near & (F.col(x) == F.col(y))
    return left.join(right, near, how)


def clicks_and_purchases(events: DataFrame, how: str = "left") -> DataFrame:
    """Clicks with the purchases of the same user in the six hours after; of a table or of a stream with a watermark on ts."""
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("user"), F.col("ts").alias("clicked"))
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought"))
    return interval_join(clicks, bought, {"user": "buyer"}, ("clicked", "bought"), "0 seconds", "6 hours", how).select("click", "clicked", "purchase")


def purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_and_purchases(table(spark, sf_dir, "events")).select("click", "purchase")


QUERIES = {
    "purchases_after_clicks": (purchases_after_clicks, """
        select c.event_id as click, p.event_id as purchase from events c left join events p on p.event_type = 'purchase' and p.user_id = c.user_id
        and p.ts between c.ts and c.ts + interval 6 hour where c.event_type = 'click'"""),
}
