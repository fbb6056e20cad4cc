"""Tables and files in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    """Writes `df` as parquet, orc, csv, json, text or xml, in folders by the columns `by`."""
    writer = df.write.format(form).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def load(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Reads what save() wrote; a schema spares the formats without one a pass over the data."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
