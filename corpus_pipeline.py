"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

Every stage takes an empty table and gives one with the same columns; columns
beyond those of ``documents`` may have any names and are passed on. Nulls may be
in any column: a null text is an empty one, null languages and sources are
values of their own, null ids never decide against a row that has one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, langid, ngram_join, packing, quality
from brindle.llm.common import shared_dir, shipped, table

TOKENIZER = "byte_bpe_50k.json"


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages go; so do null texts and those without a letter.

    Repeated rows share their fate. Of equally likely languages the first by
    name counts. Where no row has a label, all rows stay.
    """
    return langid.keep(docs)


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or lie far from those of their language and source go.

    Repeated rows share their fate; a distance that equals the limit stays.
    """
    return quality.keep(docs)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    Of rows with the same id and text one stays; of different texts with the
    least id that with the least digest; a null id where the group has no other.
    """
    return ngram_join.keep_one(docs)


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; with an empty benchmark all stay. Repeated rows share their fate."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens; repeated rows are packed as often as they come."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Trained models, robust estimates and alignments have no SQL form; tests check against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
