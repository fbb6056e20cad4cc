"""Exact duplicates: rows are grouped by a 128-bit hash of their text, and one of each group stays.

Built-in functions only. Texts are written to no table. They are shuffled once, to compare their bytes: copies are combined
in each task before, so a group of any size sends one text from a task. What that comparison leaves are the hashes that
different texts share (of MD5 none are known among ordinary texts); rows with such a hash are grouped by hash and bytes.
All else moves only ids and hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import documents, durable, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str | Column) -> Column:
    """A text in which A-Z are lowered and nothing else; null becomes empty.

    lower() does the same to a text that is all ASCII, in a fifth of the time.
    """
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_hash(text: Column) -> Column:
    """MD5, as 16 bytes."""
    return F.unhex(F.md5(text))


def shared_hashes(docs: DataFrame, text: Column, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The hashes (__hash) that texts with different bytes have in `docs`; every text is compared."""
    texts = docs.select(text.alias("__text")).select(hashed(F.col("__text")).alias("__hash"), "__text").distinct()
    return texts.groupBy("__hash").count().where("count > 1").select("__hash")


def duplicates(docs: DataFrame, text: Column, largest: bool = False, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of `docs`: its group is the rows with equal `text`, a column without nulls.

    The row with the least doc_id of a group stays, or with `largest` that with the largest. A row without doc_id comes after
    all others either way, and stays only in a group without any id, where keep_id is null. Rows that share text and id are
    told apart by their place in the table as it is read, and one of them stays. Texts may be empty or very long. Other
    columns are left out; an empty table gives an empty result.
    """
    source = docs.select("doc_id", text.alias("__text")).withColumn("__hash", hashed(F.col("__text")))
    shared = durable(shared_hashes(docs, text, hashed))
    key = F.col("__hash")
    if not shared.isEmpty():
        source = source.join(shared.withColumn("__shared", F.lit(True)), "__hash", "left")
        key = F.when(F.col("__shared"), F.concat("__hash", F.encode("__text", "UTF-8"))).otherwise(F.col("__hash"))
    rows = table(source.select("doc_id", key.alias("__key"), F.sha2("__text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("__row")), "hashes")
    order = F.struct(F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull(), "doc_id", "__row")
    groups = durable(rows.groupBy("__key").agg((F.max if largest else F.min)(order).alias("__stays"), F.count("*").alias("group_size")))
    return rows.join(groups, "__key").select("doc_id", F.col("__stays.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__stays.__row")).alias("kept"), "text_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(spark, sf_dir), lowered("text"), largest=True)


ORACLE_SQL = f"""
    with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
    from d window w as (partition by t order by doc_id desc nulls last)"""
