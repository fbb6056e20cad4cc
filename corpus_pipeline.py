"""The corpus pipeline: toxicity, language, near-duplicates, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. SQL can express none
of the models, so ORACLE_SQL is None; tests/llm hold the stages against plain versions.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import language, toxicity
from tidewright.llm.common import delete, documents, release, shared_folder, written
from tidewright.llm.packing import pack
from tidewright.llm.simhash import one_of_each_group

#: Scores from which a document goes (toxicity), and below which it goes (language: none, as the best of k languages scores 1 / k at least, whatever the text;
#: what decides there is the share of known trigrams, whose threshold is learned).
TOXIC, LANGUAGE = 0.5, 0.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity operator does not predict to be toxic; it learns from the labelled ones among `docs`.

    Without labels of both kinds nothing goes. Null and empty texts are judged as texts without words.
    """
    return toxicity.keep_clean(docs, toxicity.train(*toxicity.sample(docs, toxicity.labels_of(spark, sf_dir))), TOXIC)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language of the training rows among `docs`; those without a letter (null ones too) go, and those whose letters are like none of these languages.

    Without any language to learn from nothing goes. Repeated rows are judged alike, rows without id like any other; an empty table stays empty.
    """
    return language.keep_known(docs, language.train(*language.sample(docs)), LANGUAGE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id: by SimHash classes, and then by five-word shingles of a similarity of 0.8.

    Null, empty and blank texts are near-duplicates of one another. A row without id stays only in a group where no row has one; of repeated rows one stays. An
    empty table stays empty.
    """
    return one_of_each_group(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, null texts as empty ones (a piece with the final id alone); with a smaller memory, since workers still hold the other stages' models.

    Repeated rows are packed each; an empty table gives no pieces.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), memory=500_000)


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; what each one keeps is written to the shared folder and read by the next.

    The result has a row for each piece of a document that all stages keep; an empty table of documents gives none. A stage's output is deleted when the next one's is written, and with it the operators' own tables; the last stage
    writes the tokens of all it reads before it returns.
    """
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = written()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark, before)
        if i:
            delete(spark, f"{folder}/{STAGES[i - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{name}")
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, folder)
    return pieces
