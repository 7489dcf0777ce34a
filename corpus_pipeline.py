"""Corpus preparation: quality, language, near-duplicates, packing.

Every stage works on all rows that the one before it kept and is written as Parquet before the next.
In all stages repeated rows and null doc_ids are rows like others, columns besides doc_id, text and
lang are handed on whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm import language_id, near_copies, packing, quality_classifier
from veritrace.storage import materialize

#: No SQL: three of the stages are learned models or token ids.
ORACLE_SQL = None
SEQUENCE = 2048
#: Languages to keep; None for all that the labelled rows teach.
LANGUAGES: list[str] | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good.

    A null, empty or wordless text has the score of the bias alone, so all of them stay or all go.
    Without labels the score is 0.5 and all rows go.
    """
    score = quality_classifier.scored(spark, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.col("text").cast("string")) >= quality_classifier.PREDICTED)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES, by cross-parsing; a null lang becomes the predicted one.

    Documents that take clearly more phrases a letter than labelled ones are in no learned language
    and go, as do those that are null or without a letter. A tie is won by the first language by name.
    """
    return language_id.accepted(docs, LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    The smallest doc_id stays, at a tie the smallest hash of the row. Null, empty and wordless texts
    are one group. Rows of one doc_id and text are one document: one of them stays.
    """
    return near_copies.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their sequences and places; a null or empty text is one piece, the closing id."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
