"""VARIANT columns: documents without a schema, parsed once and read by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources import table


def parsed(text: str) -> Column:
    """A JSON text as a variant; null for a null text and for one that isn't JSON."""
    return F.try_parse_json(text)


def field(variant: Column, path: str, kind: str) -> Column:
    """What stands at `path`, as `kind`; null where there is nothing or something else."""
    return F.try_variant_get(variant, path, kind)


def entries(df: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """`keep` with pos, key and value (a variant) for each entry of an object, or each element of an array, where key is null; none of other documents."""
    exploded = df.select(*keep, F.col(variant).alias("__v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    return exploded.select(*keep, "pos", "key", "value")


def kinds(df: DataFrame, variant: str) -> DataFrame:
    """How many documents have which schema, from none (SQL null) to the nesting that each has."""
    return df.groupBy(F.schema_of_variant(variant).alias("schema")).agg(F.count("*").alias("n"))


def shredded(df: DataFrame, variant: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with a column for each of `fields` (name to path and type), and `rest`: the document as text where a path has none, so nothing is lost."""
    columns = {name: field(F.col(variant), path, kind) for name, (path, kind) in fields.items()}
    whole = F.lit(True)
    for c in columns.values():
        whole = whole & c.isNotNull()
    return df.withColumns(columns | {"rest": F.when(~whole, F.to_json(variant))}).drop(variant)


def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", parsed("props").alias("v"))
    found = shredded(events, "v", {"k": ("$.k", "long")})
    return found.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.count("rest").alias("n_rest"))


def property_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", parsed("props").alias("v"))
    found = entries(events, "v", ["user_id"])
    return found.groupBy("user_id", "key").agg(F.count("*").alias("n"), F.sum(field(F.col("value"), "$", "long")).alias("total"))


QUERIES = {
    "property_values": (property_values, "select event_type, cast(props::json->>'$.k' as bigint) as k, count(*) as n, 0::bigint as n_rest from events group by 1, 2"),
    "property_entries": (property_entries, """
        select user_id, e.key, count(*) as n, cast(sum(cast(e.value as bigint)) as bigint) as total from events, json_each(events.props::json) e group by 1, 2"""),
}
