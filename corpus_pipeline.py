"""A training corpus from documents: five stages, each over all that the one before kept.

Language ID drops documents without a language, the n-gram Jaccard join keeps one document
of each group of near copies, decontamination drops documents that hold benchmark text,
mixing takes a budget from the sources by weight, and packing writes rows of token ids.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables,
and columns besides doc_id, text, lang and source, of any name; what each makes of them is
in its docstring.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontam, jaccard_join, langid, mixing, packing, store

ROW_LENGTH = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from the labelled ones whose id's crc32 modulo 4 is not 2.

    Dropped are documents without text or letters, and those that no language claims
    (langid.LEAST_SCORE).  Documents with a null id are judged, but not learnt from.  Ties go to
    the language commoner in training.  Repeated rows stay.  Without labelled documents, as in an empty
    table, there is no language, and nothing stays.
    """
    return langid.reject(docs, langid.fit(docs.where(langid.remainder() != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the least id.

    Documents without words are near copies of none and stay, as do those with a null id.
    Rows of one id are one document and stay or go together.  An empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Documents with a null or empty text stay; repeated rows are judged alike; an empty table or benchmark drops nothing.
    """
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as come in, weighted half way to even sources; a document comes once for each pass that takes it.

    Documents without words are never taken.  A null source is a source.  Repeated rows are
    separate documents.  An empty table stays empty.
    """
    return mixing.draw(docs, mixing.count_words()).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids; a document without text is a lone end id, one longer than a row goes on in others, and a null id stays null."""
    return packing.pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ROW_LENGTH)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL has neither a kernel classifier nor a tokenizer.
ORACLE_SQL = None


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written to path to its end: a marker is written after it."""
    try:
        return spark.read.parquet(f"{path}-done").count() == 1
    except AnalysisException:
        return False


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; each result is written and read as the next one's input.

    folder: where; by default a new one in the shared checkpoint folder.  A run that is
    given the folder of one that was lost goes on after the last stage written there.
    """
    folder = folder or f"{store.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        if not _written(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
        docs = spark.read.parquet(path)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
