"""Functions written in Python, for what built-in ones can't express.

They leave the JVM, so built-in functions come first wherever there is one. Columns and parts of aggregates are computed by Arrow batches; a table
function that carries its decisions from row to row gets rows one by one, sorted, and holds nothing but its state. `in_two_steps` is for aggregates
over groups of any size: no group is brought together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidewright.sources import table


def unaccented(texts: pd.Series) -> pd.Series:
    """Texts in composed normal form without combining marks; null stays null."""
    strip = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))
    return texts.map(strip, na_action="ignore")


class Throttle:
    """A table function: which rows a bucket of tokens lets through, each by itself deciding what is left for the next.

    It takes a table and, as constants, the columns `by`, `time` (a timestamp) and `key`, the microseconds in which a token comes, and the tokens a bucket holds. It asks for the table by
    `by` in the order of `time` and `key`, and returns all columns and allowed and left_us, what is in the bucket after the row, in microseconds. A bucket is full at first.
    A null time neither fills the bucket nor is allowed. Memory is one number for the key at hand.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, time: AnalyzeArgument, key: AnalyzeArgument, token_us: AnalyzeArgument, burst: AnalyzeArgument) -> AnalyzeResult:
        for name in (by, time, key):
            if name.value not in rows.dataType.names:
                raise ValueError(f"no column {name.value}")
        schema = T.StructType([*rows.dataType.fields, T.StructField("allowed", T.BooleanType()), T.StructField("left_us", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn(time.value), OrderingColumn(key.value)])

    def __init__(self):
        self.left: int | None = None
        self.last: datetime | None = None

    def eval(self, rows: T.Row, by: str, time: str, key: str, token_us: int, burst: int):
        now, full = rows[time], burst * token_us
        if self.left is None:
            self.left = full
        if now is not None and self.last is not None:
            self.left = min(full, self.left + (now - self.last) // timedelta(microseconds=1))
        self.last = now or self.last
        allowed = now is not None and self.left >= token_us
        self.left -= token_us if allowed else 0
        yield (*rows, allowed, self.left)


def in_two_steps(df: DataFrame, keys: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], schema: str, merge: dict[str, Callable]) -> DataFrame:
    """An aggregate for groups of any size: `partial` makes rows of keys and parts of each batch, `merge` says for each part how parts are combined.

    Parts are combined in the JVM, in each task first; no group is brought together. Nulls in keys are a group of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                made = partial(b)
                made[keys] = made[keys].astype(object).where(made[keys].notna(), None)  # pandas has NaN for a group of nulls
                yield made

    return df.mapInPandas(run, schema).groupBy(*keys).agg(*[f(c).alias(c) for c, f in merge.items()])


def throttled(df: DataFrame, by: str, time: str, key: str, token_us: int, burst: int) -> DataFrame:
    """`df` with allowed and left_us: see Throttle."""
    return udtf(Throttle)(df.asTable(), *map(F.lit, (by, time, key, token_us, burst)))


def unaccented_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = pandas_udf(unaccented, "string")("text")
    return table(spark, sf_dir, "documents").select("doc_id", plain.alias("plain")).select("doc_id", F.md5("plain").alias("digest"), F.length("plain").cast("long").alias("n"))


def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users who have a token for each twelve hours and may save three."""
    return throttled(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 43_200_000_000, 3).select("event_id", "allowed", "left_us")


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, from sums of whole batches: exploding vectors would make a row of each of their numbers."""

    def partial(b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["embedding"].notna()]
        parts = [(label, i, total, len(own)) for label, own in b.groupby("label", dropna=False)["embedding"] for i, total in enumerate(np.stack(own.to_list()).astype(np.float64).sum(axis=0), 1)]
        return pd.DataFrame(parts, columns=["label", "i", "total", "n"])

    vectors = table(spark, sf_dir, "embeddings").select("label", "embedding")
    sums = in_two_steps(vectors, ["label", "i"], partial, "label int, i long, total double, n long", {"total": F.sum, "n": F.sum})
    return sums.select("label", "i", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


QUERIES = {
    "unaccented_documents": (unaccented_documents, "select doc_id, md5(nfc_normalize(strip_accents(text))) as digest, length(nfc_normalize(strip_accents(text))) as n from documents"),
    "throttled_events": (throttled_events, """
        with recursive o as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
        r(user_id, i, event_id, t, allowed, left_us) as (
            select user_id, i, event_id, t, true, 2 * 43200000000 from o where i = 1
            union all
            select o.user_id, o.i, o.event_id, o.t, least(3 * 43200000000, r.left_us + o.t - r.t) >= 43200000000,
            least(3 * 43200000000, r.left_us + o.t - r.t) - case when least(3 * 43200000000, r.left_us + o.t - r.t) >= 43200000000 then 43200000000 else 0 end
            from r join o on o.user_id = r.user_id and o.i = r.i + 1)
        select event_id, allowed, left_us from r"""),
    "label_centroids": (label_centroids, """
        select label, i, round(avg(x), 6) as mean from (select label, cast(unnest(range(1, len(embedding) + 1)) as bigint) as i, cast(unnest(embedding) as double) as x from embeddings) group by label, i"""),
}
