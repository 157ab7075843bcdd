"""The corpus pipeline: five stages, each of which keeps or encodes the documents that the one before it left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkrow.llm import bpe, decontaminate, language, near_duplicates, quality
from inkrow.llm._common import stored, table

#: A text is rejected as of no language if its best language has less than this share of its letters.
LEAST_LANGUAGE = 0.5
#: Texts are near copies if the sets of their five-word shingles share so many of a hundred of their union.
NEAR_PERCENT = 80


def packed(docs: DataFrame) -> DataFrame:
    """The rows of docs whole, as doc, beside their text, so that what a stage adds meets no column of the same name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is more likely good than low or toxic."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(packed(docs), model).where("accepted").select("doc.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters, mostly of one language."""
    return language.identify(packed(docs), language.train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near copies; rows that repeat an id and its text become one."""
    return near_duplicates.one_of_each(docs, percent=NEAR_PERCENT)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each), ("decontaminate", no_benchmark), ("encode", encoded)]

#: SQL can't express the classifiers, the signatures or the encoding; tests hold run() against brute force where the classifiers keep all texts with a letter.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
