"""Event-time windows, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def counted(events: DataFrame, *window: str) -> DataFrame:
    """Events and their value by window and type, of a table or, with a watermark, a stream."""
    w = F.window("ts", *window)
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(_events(spark, sf_dir), "1 hour")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(_events(spark, sf_dir), "1 hour", "30 minutes")


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, which end when nothing comes for `gap`; of a table or, with a watermark, a stream in append mode."""
    made = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(_events(spark, sf_dir))


def stream(spark: SparkSession, path: str, schema, late: str = "1 hour", files: int = 1) -> DataFrame:
    """Events from a folder of parquet files, with a watermark; a repeated event counts once within it."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return read.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


QUERIES = {
    "tumbling": (tumbling, "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2"),
    "sliding": (sliding, """
        with w as (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as start, event_type, value from events)
        select start, event_type, count(*) as n, round(sum(value), 4) as value from w group by 1, 2"""),
    "sessions": (sessions, """
        with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
        b as (select *, sum(fresh) over (partition by user_id order by ts) as s from a) select user_id, min(ts) as start, count(*) as n from b group by user_id, s"""),
}
