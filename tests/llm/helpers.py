"""Rows for the operators: nulls, empty and long texts, ties, repeated rows, clashing column names, and an empty table."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("n_words", T.LongType()), ("n_tokens", T.LongType()), ("score", T.StringType()), ("shard", T.StringType()), ("fp", T.StringType()))])
LONG = "word " * 30_000 + "x" * 5_000
TEXTS = ["", None, " \n\t ", "one", "Two words", "a b c d e f g h i j k l", "Ünï cödé 日本 語 🎉 ½ ٣", "<|endoftext|> a<|endoftext|>", "the the the the the the the the the the the", "a\x1cb\x85c d", LONG, "12 34 !! --", "line\nline\n\nline two"]


def odd_rows(spark):
    """Texts with ids, twice over; one text under two ids, and rows without id, language or source."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, 7, 8, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += rows[:4] + [(None, "one", None, None, 1, 7, 8, "x", "y", "z"), (100, "one", "en", "s", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, data, n=None):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return docs if n is None else docs.where(F.col("doc_id") < n)


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
