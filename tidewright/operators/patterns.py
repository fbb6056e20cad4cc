"""Row patterns: events that complete a sequence of steps within some time, with windows alone.

A pattern is a list of conditions; events that fulfil them one after another, with any others between, make a match. An event that fulfils the last step
has one match at most, that with the latest start. The latest start of the first j steps is a running maximum of that of j - 1 at events of step j, so
a pattern of k steps is k - 1 windows over one sorted shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.sources import table


def matches(events: DataFrame, by: str, time: str, key: str, steps: list[Column], within: float) -> DataFrame:
    """`by`, `key` and `time` of each event that completes `steps`, with `started` and `start_key`, the time and key of the match's first event, `within` seconds before at most.

    Events are in the order of `time` (a timestamp), then of `key`. Each is dealt to the cell of its time, `within` wide, and to the next as context, so no task holds more of
    a `by` than two cells. Rows with a null in `by` or `time` match nothing; a condition that is null isn't fulfilled. Repeated rows are events of their own: after a tie of time
    and key they follow each other in no fixed order.
    """
    micros = F.unix_micros(F.col("__time").cast("timestamp"))
    flags = [F.coalesce(s, F.lit(False)).alias(f"__s{i}") for i, s in enumerate(steps)]
    rows = events.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(F.col(by).alias("__by"), F.col(time).alias("__time"), F.col(key).alias("__key"), *flags)
    rows = rows.where(" or ".join(f"__s{i}" for i in range(len(steps)))).withColumn("__us", micros)
    cell = F.floor(F.col("__us") / int(within * 1_000_000)).cast("long")
    rows = rows.withColumn("__cell", F.explode(F.array(cell, cell + 1))).withColumn("__own", F.col("__cell") == cell)
    before = Window.partitionBy("__by", "__cell").orderBy("__us", "__key").rowsBetween(Window.unboundedPreceding, -1)
    best = F.struct("__us", "__time", "__key")
    for i in range(len(steps) - 1):
        rows = rows.withColumn(f"__b{i}", F.max(F.when(F.col(f"__s{i}"), best)).over(before))
        best = F.col(f"__b{i}")
    done = rows.where(F.col("__own") & F.col(f"__s{len(steps) - 1}") & (F.col("__us") - best["__us"] <= int(within * 1_000_000)))
    return done.select(F.col("__by").alias(by), F.col("__key").alias(key), F.col("__time").alias(time), best["__time"].alias("started"), best["__key"].alias("start_key"))


def purchases_after_two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.col("event_type") == k
    return matches(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", [kind("view"), kind("view"), kind("purchase")], 86_400).select("event_id", "started", "start_key")


QUERIES = {
    "purchases_after_two_views": (purchases_after_two_views, """
        select p.event_id, max(a.ts) as started, arg_max(a.event_id, a.ts) as start_key from events p
        join events b on b.user_id = p.user_id and b.event_type = 'view' and b.ts < p.ts join events a on a.user_id = p.user_id and a.event_type = 'view' and a.ts < b.ts
        where p.event_type = 'purchase' and p.ts - a.ts <= interval 1 day group by p.event_id"""),
}
